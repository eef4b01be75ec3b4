"""Near-duplicate search of embeddings by an inverted multi-index.

Vectors are normalised and cut into halves; each half has its own codebook (k-means), and a vector lies in the cell of the product grid
that its halves' nearest codes name.  A query visits cells in the order of the sum of its halves' distances to the codes
(multi-sequence order), as many as calibration says that the target recall needs: sampled vectors are turned by the angle of the
threshold in random directions, and the number of visits is the quantile of the ranks at which the turned ones' cells come.  All
vectors are queries and all are indexed; a pair is found if either visits the other's cell, and is then verified in double precision.

Equal vectors are one class, so copies are compared once.  Residents and visitors of a part of the grid meet in blocks of bounded
size; a block gives sums and local components only, so dense groups make no rows for each pair.  Codebooks are fitted on a bounded
sample (``SAMPLE`` classes with the smallest hash); the number of codes grows with the square root of the number of classes.

Vectors of different lengths never link.  Each length has an index of its own; lengths with fewer than ``INDEX_FROM`` classes (but for
the most frequent one) are compared in whole, length by length.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing, as do rows with a null id;
equal vectors link with each other; an empty table gives an empty result; other columns, such as labels, are ignored.  Of repeated ids
each row counts as a vector; the rows of one id get equal results if their vectors are.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written
from .components import connected_components

SAMPLE = 20_000
TARGET_RECALL = 0.95
#: Classes for each cell, on average; bounds of the number of codes.
CELL_ROWS, CODES = 8, (4, 2048)
#: Residents of a group of cells, and rows that a block holds of either kind, on average.
GROUP_ROWS, BLOCK_ROWS = 2048, 2048
#: Classes of one length from which on it has an index.
INDEX_FROM = 1000


def _distances(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ codes.T + (codes**2).sum(axis=1), 0)


def codebook(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    """k-means codes of the rows of ``x``."""
    codes = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        at = np.concatenate([_distances(x[low : low + 512], codes).argmin(axis=1) for low in range(0, len(x), 512)])
        n = np.bincount(at, minlength=k)
        sums = np.zeros_like(codes)
        np.add.at(sums, at, x)
        codes = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], codes)
    return codes


def normalised(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


class MultiIndex:
    """Codebooks of both halves and the number of cells that a query visits."""

    def __init__(self, first: np.ndarray, second: np.ndarray, visits: int):
        self.first, self.second, self.visits = first, second, visits

    @classmethod
    def fit(cls, x: np.ndarray, k: int, cosine: float, recall: float = TARGET_RECALL, seed: int = 4) -> MultiIndex:
        rng = np.random.default_rng(seed)
        half = x.shape[1] // 2
        made = cls(codebook(x[:, :half], k, rng), codebook(x[:, half:], k, rng), 1)
        some = x[rng.choice(len(x), min(len(x), 2000), replace=False)]
        turn = rng.normal(size=some.shape)
        turn -= (turn * some).sum(axis=1, keepdims=True) * some
        turn /= np.maximum(np.sqrt((turn**2).sum(axis=1, keepdims=True)), 1e-12)
        other = made.cells(cosine * some + math.sqrt(1 - cosine**2) * turn)
        ranks = []
        for low in range(0, len(some), 200):
            # A cell's rank is one more than the number of nearer ones: for each first code, the second codes that stay below.
            for a, b, cell in zip(*made._halves(some[low : low + 200]), other[low : low + 200].tolist(), strict=True):
                own = a[cell // k] + b[cell % k]
                ranks.append(1 + int(np.searchsorted(np.sort(b), own - a, side="left").sum()))
        made.visits = int(np.ceil(np.quantile(ranks, recall)))
        return made

    def _halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.first.shape[1]
        return _distances(x[:, :half], self.first), _distances(x[:, half:], self.second)

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self._halves(x)
        return a.argmin(axis=1) * len(self.second) + b.argmin(axis=1)

    def traverse(self, x: np.ndarray) -> np.ndarray:
        """The first ``visits`` cells of each row in multi-sequence order.

        The pair of the p-th and q-th nearest codes comes after the p * q pairs that are no farther in either half, so only pairs with
        p * q up to ``visits`` can be among the first.
        """
        a, b = self._halves(x)
        n = min(self.visits, a.shape[1] * b.shape[1])
        pairs = [(p, q) for p in range(min(n, a.shape[1])) for q in range(min(n // (p + 1), b.shape[1]))]
        p, q = np.array(pairs).T
        i, j = np.argsort(a, axis=1, kind="stable"), np.argsort(b, axis=1, kind="stable")
        row = np.arange(len(x))[:, None]
        sums = np.take_along_axis(a, i, 1)[:, p] + np.take_along_axis(b, j, 1)[:, q]
        first = np.argsort(sums, axis=1, kind="stable")[:, :n]
        return i[row, p[first]] * len(self.second) + j[row, q[first]]


_PLACED = "kind int, g long, cls long, copies long, cell long, js array<int>, visits array<long>, vector binary"


def _place(shared, groups: int):
    """A row for each vector as resident of its group of cells, and one for each group of cells that it visits."""
    schema = pa.schema([
        ("kind", pa.int32()), ("g", pa.int64()), ("cls", pa.int64()), ("copies", pa.int64()), ("cell", pa.int64()),
        ("js", pa.list_(pa.int32())), ("visits", pa.list_(pa.int64())), ("vector", pa.binary()),
    ])

    def run(batches):
        index = shared.value
        k = len(index.second)
        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                b = whole.slice(low, 256)
                if not b.num_rows:
                    continue
                raw = b.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                x = normalised(raw)
                own, visits = index.cells(x), index.traverse(x)
                rows = []
                for r, (cls, copies) in enumerate(zip(b.column("cls").to_pylist(), b.column("copies").to_pylist(), strict=True)):
                    vector, cell = raw[r].tobytes(), int(own[r])
                    rows.append((0, cell // k * groups + cell % k % groups, cls, copies, cell, None, visits[r], vector))
                    by: dict[int, list[int]] = {}
                    for c in visits[r].tolist():
                        by.setdefault(c // k * groups + c % k % groups, []).append(c % k)
                    rows += [(1, g, cls, copies, cell, js, None, vector) for g, js in by.items()]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def _local(n_left: int, p: np.ndarray, q: np.ndarray, n_right: int) -> tuple[np.ndarray, np.ndarray]:
    """The least label reachable in the bipartite graph of the links (p, q), for its left and right nodes."""
    left, right = np.arange(n_left), np.arange(n_left, n_left + n_right)
    while True:
        new_left, new_right = left.copy(), right.copy()
        np.minimum.at(new_left, p, right[q])
        np.minimum.at(new_right, q, new_left[p])
        np.minimum.at(new_left, p, new_right[q])
        if (new_left == left).all() and (new_right == right).all():
            return left, right
        left, right = new_left, new_right


def _meet(cosine: float, k: int, dtype: str):
    """For each block, what each vector's links add up to, and a vector of its local component."""
    schema = pa.schema([("cls", pa.int64()), ("add", pa.int64()), ("root", pa.int64())])

    def block(rows: list[dict]):
        res, vis = [r for r in rows if r["kind"] == 0], [r for r in rows if r["kind"] == 1]
        if not res or not vis:
            return
        matrix = lambda some: normalised(np.stack([np.frombuffer(r["vector"], dtype=dtype) for r in some]))
        ids = lambda some, c: np.array([r[c] for r in some], dtype=np.int64)
        res_cls, vis_cls = ids(res, "cls"), ids(vis, "cls")
        allowed = np.zeros((len(vis), k), dtype=bool)
        for x, r in enumerate(vis):
            allowed[x, r["js"]] = True
        near = (matrix(vis) @ matrix(res).T >= cosine) & allowed[:, ids(res, "cell") % k] & (vis_cls[:, None] != res_cls)
        p, q = np.nonzero(near)
        if not len(p):
            return
        visits, cell = np.array([r["visits"] for r in res]), ids(vis, "cell")
        # Where the resident visits the visitor's cell too, the link is told to it there.
        once = np.concatenate([~(visits[q[s : s + 100_000]] == cell[p[s : s + 100_000], None]).any(axis=1) for s in range(0, len(p), 100_000)])
        to_vis, to_res = np.zeros(len(vis), dtype=np.int64), np.zeros(len(res), dtype=np.int64)
        np.add.at(to_vis, p, ids(res, "copies")[q])
        np.add.at(to_res, q[once], ids(vis, "copies")[p[once]])
        left, right = _local(len(vis), p, q, len(res))
        every = np.concatenate((vis_cls, res_cls))
        linked = np.unique(np.concatenate((p, len(vis) + q)))
        label, add = np.concatenate((left, right)), np.concatenate((to_vis, to_res))
        yield pa.RecordBatch.from_arrays([pa.array(every[linked]), pa.array(add[linked]), pa.array(every[label[linked]])], schema=schema)

    def run(batches):
        held: list[dict] = []
        for b in batches:
            for r in b.to_pylist():
                if held and any(held[0][c] != r[c] for c in ("g", "rb", "vb")):
                    yield from block(held)
                    held = []
                held.append(r)
        yield from block(held)

    return run


_MET = "cls long, add long, root long"


def _indexed(classes: DataFrame, n: int, cosine: float, recall: float, dtype: str) -> DataFrame:
    """What the vectors of one length (their ``n`` classes) link with, by the multi-index."""
    spark = classes.sparkSession
    k = int(min(CODES[1], max(CODES[0], 2 ** round(math.log2(max(1, math.sqrt(n / CELL_ROWS)))))))
    share = F.pmod(F.xxhash64(F.lit(4), "cls"), F.lit(1_000_000))
    sample = classes.where(share < math.ceil(1_000_000 * SAMPLE / max(n, SAMPLE))).select("cls", "embedding").toArrow().sort_by("cls")
    if not sample.num_rows:
        sample = classes.select("cls", "embedding").orderBy("cls").limit(1).toArrow()
    x = sample.column("embedding").combine_chunks().flatten().to_numpy().reshape(sample.num_rows, -1)
    x = normalised(np.concatenate((x, np.zeros((len(x), 1), dtype=x.dtype)), axis=1) if x.shape[1] == 1 else x)
    index = MultiIndex.fit(x, k, cosine, recall)
    # Cells with one first code are cut into groups, so that a group has about GROUP_ROWS residents.
    groups = min(k, max(1, round(n / k / GROUP_ROWS)))
    placed = written(classes.mapInArrow(_place(spark.sparkContext.broadcast(index), groups), _PLACED), "placed")
    sizes = placed.groupBy("g").agg(*(F.ceil(F.count(F.when(F.col("kind") == i, 1)) / BLOCK_ROWS).cast("int").alias(c) for i, c in enumerate(("rbs", "vbs"))))
    sizes = sizes.where("rbs > 0 and vbs > 0")
    dealt = placed.join(sizes, "g")
    own = F.pmod(F.xxhash64("cls"), F.when(F.col("kind") == 0, F.col("rbs")).otherwise(F.col("vbs"))).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("kind") == 0, F.col("vbs")).otherwise(F.col("rbs")) - 1)))
    dealt = dealt.withColumn("rb", F.when(F.col("kind") == 0, F.col("own")).otherwise(F.col("other"))).withColumn("vb", F.when(F.col("kind") == 1, F.col("own")).otherwise(F.col("other")))
    dealt = dealt.select("g", "rb", "vb", "kind", "cls", "copies", "cell", "js", "visits", "vector").repartition("g", "rb", "vb").sortWithinPartitions("g", "rb", "vb")
    return dealt.mapInArrow(_meet(cosine, k, dtype), _MET)


def _compared(cosine: float):
    """The same for all vectors of a length with few of them, by comparing all."""
    schema = pa.schema([("cls", pa.int64()), ("add", pa.int64()), ("root", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        cls, copies = group.column("cls").to_numpy(), group.column("copies").to_numpy()
        x = normalised(np.array(group.column("embedding").to_pylist(), dtype=np.float64))
        near = (x @ x.T >= cosine) & ~np.eye(len(x), dtype=bool)
        left, _ = _local(len(x), *np.nonzero(near | np.eye(len(x), dtype=bool)), len(x))
        linked = np.flatnonzero(near.any(axis=1))
        return pa.Table.from_arrays([pa.array(cls[linked]), pa.array((near * copies).sum(axis=1)[linked]), pa.array(cls[left[linked]])], schema=schema)

    return run


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, vector: str = "embedding", row_id: str = "vec_id", recall: float = TARGET_RECALL) -> DataFrame:
    """``(row_id, n_links, component_id, kept)`` for each row; links are pairs found with ``cosine`` or more."""
    spark = vectors.sparkSession
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("id").isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(row_id).cast("long").alias("id"), F.col(vector).alias("embedding")).withColumn("usable", usable)
    classes = rows.where("usable").groupBy("embedding").agg(F.min("id").alias("cls"), F.count("*").alias("copies"), F.size("embedding").alias("d"))
    classes = written(classes, "vectors")
    dtype = "<f8" if "double" in vectors.schema[vector].dataType.simpleString() else "<f4"
    lengths = classes.groupBy("d").agg(F.count("*").alias("n"))
    most = lengths.orderBy(F.desc("n"), "d").head(1)
    # No more lengths than classes / INDEX_FROM have an index.
    large = most + [x for x in lengths.where(F.col("n") >= INDEX_FROM).collect() if x["d"] != most[0]["d"]]
    met = spark.createDataFrame([], _MET)
    if large:
        for x in large:
            met = met.union(_indexed(classes.where(F.col("d") == x["d"]), x["n"], cosine, recall, dtype))
        few = classes.where(~F.col("d").isin([x["d"] for x in large]))
        if not few.isEmpty():
            met = met.union(few.groupBy("d").applyInArrow(_compared(cosine), _MET))
        met = written(met, "met")
    links = met.groupBy("cls").agg(F.sum("add").alias("links"))
    components = connected_components(met, "cls", "root").toDF("cls", "component")
    of_class = classes.join(links, "cls", "left").join(components, "cls", "left")
    of_class = written(of_class.select("embedding", F.coalesce("component", "cls").alias("component"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links")), "classes")
    # Vectors that can't link aren't joined, so that they don't meet in one task.
    linked = rows.where("usable").join(of_class, "embedding").select("id", "component", "links")
    alone = rows.where("not usable").select("id", F.col("id").alias("component"), F.lit(0).cast("long").alias("links"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(row_id), F.col("links").cast("long").alias("n_links"), F.col("component").alias("component_id"), (F.col("component") == F.col("id")).alias("kept"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates of all embeddings at a cosine of 0.95."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
