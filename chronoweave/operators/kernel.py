"""Kernel ridge on random Fourier features, for classes and intensities at once: solved from sums over the rows, however many there are."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def added(df: DataFrame, columns: list[str], matrix: Callable[..., np.ndarray]) -> np.ndarray:
    """The sum of ``matrix(batch of each column)`` over all rows, in one job.

    Each task adds up its own batches and sends one matrix; its rows are dealt over the reducers, which add them up as they stream by.
    The driver gets one matrix.
    """

    def run(batches):
        total = None
        for b in batches:
            if len(b):
                part = matrix(*(np.stack(b[c]) if b[c].dtype == object else b[c].to_numpy() for c in columns))
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"i_": np.arange(len(total), dtype=np.int32), "row_": list(total)})

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for i, row in zip(b["i_"], b["row_"], strict=True):
                held[i] = held[i] + row if i in held else np.array(row)
        if held:
            yield pd.DataFrame({"i_": np.array(list(held), dtype=np.int32), "row_": list(held.values())})

    schema = "i_ int, row_ array<double>"
    total = df.select(*columns).mapInPandas(run, schema).repartition("i_").mapInPandas(add, schema).toPandas()
    return np.array(total.sort_values("i_")["row_"].tolist())


@dataclass
class Block:
    """Scale, principal components and scale again of one array column: one affine map, ``(x - mean) @ map``."""

    name: str
    mean: np.ndarray
    map: np.ndarray
    variance: float

    @property
    def width(self) -> int:
        return len(self.mean)


def whole(blocks: dict[str, int]) -> Column:
    """Rows all of whose blocks have their width and nothing that is null, NaN or infinite."""
    out = F.lit(True)
    for c, width in blocks.items():
        fine = F.forall(c, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x.cast("double")))
        out = out & F.coalesce((F.size(c) == width) & fine, F.lit(False))
    return out


def fit_blocks(df: DataFrame, kept: dict[str, int]) -> list[Block]:
    """Population moments of every block in two jobs (means, then deviations), and each block's map onto its ``kept[name]`` components.

    A map ends in a division by the root of the number of components, so that each block weighs alike.  Columns without variance and
    components without any are 0.
    """
    names = list(kept)
    sums = added(df, names, lambda *xs: np.concatenate([np.full((1, 1), len(xs[0])), *(x.sum(0, keepdims=True) for x in xs)], axis=1))
    if not len(sums):
        raise ValueError("no whole row to learn from")
    n = sums[0, 0]
    widths = _widths(df, names)
    means = np.split(sums[0, 1:] / n, np.cumsum(widths)[:-1])

    def squares(*xs):
        centred = np.concatenate([x - m for x, m in zip(xs, means, strict=True)], axis=1)
        return centred.T @ centred

    joint, out, at = added(df, names, squares) / n, [], 0
    for name, mean in zip(names, means, strict=True):
        cov = joint[at : at + len(mean), at : at + len(mean)]
        at += len(mean)
        sd = np.sqrt(np.diag(cov))
        inverse = np.divide(1.0, sd, out=np.zeros_like(sd), where=sd > 1e-12)
        values, vectors = np.linalg.eigh(cov * inverse[:, None] * inverse)
        dim = min(kept[name], len(mean))
        values, vectors = values[::-1][:dim], vectors[:, ::-1][:, :dim]
        fine = values > 1e-9
        unit = np.divide(1.0, np.sqrt(np.maximum(values, 1e-300)), out=np.zeros_like(values), where=fine)
        out.append(Block(name, mean, inverse[:, None] * vectors * unit / np.sqrt(dim), float(fine.sum()) / dim))
    return out


def _widths(df: DataFrame, names: list[str]) -> list[int]:
    row = df.agg(*(F.max(F.size(c)).alias(c) for c in names)).first()
    return [int(row[c] or 0) for c in names]


@dataclass
class KernelModel:
    """What ``fit`` learned; all of it is bounded by the widths of blocks and features, not by rows."""

    blocks: list[Block]
    gamma: float
    w: np.ndarray
    offset: np.ndarray
    coefficients: np.ndarray

    def features(self, *xs: np.ndarray) -> np.ndarray:
        """Random Fourier features of a batch: their inner products approximate ``exp(-gamma |x - y|^2)``."""
        z = np.concatenate([(np.asarray(x, dtype=float) - p.mean) @ p.map for x, p in zip(xs, self.blocks, strict=True)], axis=1)
        turned = z @ self.w.T
        return np.concatenate([np.cos(turned), np.sin(turned)], axis=1) / np.sqrt(len(self.w))

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``logits`` (one for each class), ``predicted`` (the first best class) and ``intensity``; nulls where a block isn't whole."""

        @F.pandas_udf("array<double>")
        def told(rows: pd.DataFrame) -> pd.Series:
            xs = [np.stack(rows[p.name]) for p in self.blocks]
            return pd.Series(list(self.offset + self.features(*xs) @ self.coefficients))

        fine = whole({p.name: p.width for p in self.blocks})
        filled = (F.when(fine, F.col(p.name).cast("array<double>")).otherwise(F.array_repeat(F.lit(0.0), p.width)).alias(p.name) for p in self.blocks)
        out = df.withColumn("told_", F.when(fine, told(F.struct(*filled))))
        classes = self.coefficients.shape[1] - 1
        logits = F.when(F.col("told_").isNotNull(), F.slice("told_", 1, classes))
        first = F.array_position(logits, F.array_max(logits)) - 1
        return out.select(*df.columns, logits.alias("logits"), first.cast("int").alias("predicted"), F.get("told_", F.lit(classes)).alias("intensity"))


def _directions(n: int, d: int, seed: int) -> np.ndarray:
    """``n`` Gaussian directions, orthogonal within each ``d`` of them, which brings the features nearer to the kernel than free ones."""
    rng = np.random.default_rng(seed)
    turns = np.concatenate([np.linalg.qr(rng.normal(size=(d, d)))[0].T for _ in range(-(-n // d))])[:n]
    return turns * np.sqrt(rng.chisquare(d, size=(n, 1)))


def fit(df: DataFrame, blocks: dict[str, int], label: str, value: str, train: str, classes: int = 3, width: int = 1024, penalty: float = 1.0, seed: int = 0) -> KernelModel:
    """A kernel ridge classifier (one against the rest, on classes 0, 1, ...) and regressor over blocks of features.

    ``blocks``: array columns and how many principal components to keep of each; all of a training row's blocks, label and value must be
    there and finite, other rows aren't trained on.  ``gamma`` is one over the summed variance of the mapped features.  The normal
    equations of ``width`` features take one job and are solved as one matrix of that side: with ``width`` as a parameter this is bounded,
    whatever the rows.
    """
    widths = dict(zip(blocks, _widths(df.where(F.col(train)), list(blocks)), strict=True))
    there = F.col(label).isNotNull() & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    rows = df.where(F.col(train) & there & whole(widths)).select(*(F.col(c).cast("array<double>").alias(c) for c in blocks), F.col(label).cast("int").alias("y_"), F.col(value).cast("double").alias("r_"))
    maps = fit_blocks(rows, blocks)
    gamma = 1 / max(sum(p.variance for p in maps), 1e-12)
    width += width % 2
    w = np.sqrt(2 * gamma) * _directions(width // 2, sum(p.map.shape[1] for p in maps), seed)
    model = KernelModel(maps, gamma, w, np.zeros(classes + 1), np.zeros((width, classes + 1)))

    def equations(*xs):
        *xs, y, r = xs
        z = np.concatenate([model.features(*xs), np.ones((len(y), 1))], axis=1)
        target = np.concatenate([2.0 * (y[:, None] == np.arange(classes)) - 1, r[:, None]], axis=1)
        return z.T @ np.concatenate([z, target], axis=1)

    total = added(rows, [*blocks, "y_", "r_"], equations)
    gram, sums, n = total[:width, :width], total[:width, width], total[width, width]
    model.offset = total[width, width + 1 :] / n
    # Targets without their means: Z'(Y - mean) = Z'Y - (Z'1) mean.
    model.coefficients = np.linalg.solve(gram + penalty * np.eye(width), total[:width, width + 1 :] - sums[:, None] * model.offset)
    return model
