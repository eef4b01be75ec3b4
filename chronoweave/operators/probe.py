"""Grouped classification probes with pyspark.ml, and a tracker that keeps state along each entity's frames."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def impute_and_scale(df: DataFrame, train: str, value: str) -> DataFrame:
    """Training mean for missing values, then unit variance (population); a column without any value is 0 throughout."""
    stats = df.where(F.col(train)).agg(F.avg(value).alias("mu_"), F.stddev_pop(F.col(value)).alias("sd_"))
    filled = F.coalesce(F.col(value), F.col("mu_"), F.lit(0.0))
    sd = F.when(F.coalesce(F.col("sd_"), F.lit(0.0)) > 0, F.col("sd_")).otherwise(1.0)
    return df.join(F.broadcast(stats)).withColumn("scaled", (filled - F.coalesce("mu_", F.lit(0.0))) / sd).drop("mu_", "sd_")


def grouped_probe(df: DataFrame, features: list[str], label: str, fold: str, k: int, c: float = 1.0) -> DataFrame:
    """Out-of-fold predictions of a balanced multinomial logistic probe: mean imputation, scaling, L2 with strength ``c``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler

    out = None
    for i in range(k):
        train, test = df.where(F.col(fold) != i), df.where(F.col(fold) == i)
        counts = {r[0]: r[1] for r in train.groupBy(label).count().collect()}  # a row for each class
        total, n = sum(counts.values()), len(counts)
        weight = F.element_at(F.create_map(*(F.lit(x) for y, m in counts.items() for x in (y, total / (n * m)))), F.col(label))
        names = [f"{f}_filled" for f in features]
        model = Pipeline(stages=[
            Imputer(inputCols=features, outputCols=names), VectorAssembler(inputCols=names, outputCol="raw_"), StandardScaler(inputCol="raw_", outputCol="x_", withMean=True),
            LogisticRegression(featuresCol="x_", labelCol=label, weightCol="weight_", family="multinomial", standardization=False, regParam=1.0 / (c * total)),
        ]).fit(train.withColumn("weight_", weight))
        told = model.transform(test).select(*df.columns, F.col("prediction").cast("int").alias("predicted"))
        out = told if out is None else out.unionByName(told)
    return out


def pca_projection(df: DataFrame, vector: str, k: int) -> DataFrame:
    """The first ``k`` principal components of an array column, each signed so that its largest loading is positive.  Labels aren't used."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    x = df.withColumn("v_", array_to_vector(F.transform(vector, lambda y: y.cast("double"))))
    model = PCA(k=k, inputCol="v_", outputCol="p_").fit(x)
    loadings = model.pc.toArray()
    signs = [float(np.sign(loadings[np.argmax(np.abs(loadings[:, i])), i])) for i in range(k)]
    return model.transform(x).withColumn("p_", vector_to_array("p_")).select(*df.columns, *((F.get("p_", F.lit(i)) * signs[i]).alias(f"pc{i + 1}") for i in range(k)))


def kernel_probe(df: DataFrame, vector: str, label: str, train: str, d: int, gamma: float = 1.0, width: int = 64, seed: int = 0) -> DataFrame:
    """A logistic probe on random Fourier features, which approximate the RBF kernel ``exp(-gamma |x - y|^2)``."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(seed)
    w, b = rng.normal(scale=np.sqrt(2 * gamma), size=(width, d)), rng.uniform(0, 2 * np.pi, width)
    cosines = [F.cos(F.aggregate(F.zip_with(F.col(vector), F.array(*map(F.lit, map(float, row))), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) + float(o)) for row, o in zip(w, b, strict=True)]
    mapped = df.withColumn("z_", array_to_vector(F.array(*cosines)))
    model = LogisticRegression(featuresCol="z_", labelCol=label, family="multinomial", regParam=1e-3).fit(mapped.where(F.col(train)))
    return model.transform(mapped).select(*df.columns, F.col("prediction").cast("int").alias("predicted"))


#: Fixed value: a union of boxes is no smaller.
LEAST_UNION = 1e-12


def track_step(state: np.ndarray | None, boxes: np.ndarray, least: float = 0.2) -> tuple[int | None, bool, np.ndarray | None]:
    """(chosen box, reset, next state): the best overlap with the box before, or else the largest one.

    Without a box before, each box is measured as if it overlapped with all of itself against the least union, ``area / LEAST_UNION``: areas
    that this rounds to the same number tie, and the first such box is taken.
    """
    if not len(boxes):
        return None, False, None
    area = np.clip(boxes[:, 2] - boxes[:, 0], 0, None) * np.clip(boxes[:, 3] - boxes[:, 1], 0, None)
    largest = int(area.argmax())
    if state is None:
        alone = area / LEAST_UNION
        first = int(alone.argmax()) if alone.max() >= least else largest
        return first, False, boxes[first]
    inner = np.clip(np.minimum(boxes[:, 2], state[2]) - np.maximum(boxes[:, 0], state[0]), 0, None) * np.clip(np.minimum(boxes[:, 3], state[3]) - np.maximum(boxes[:, 1], state[1]), 0, None)
    own = max(0.0, state[2] - state[0]) * max(0.0, state[3] - state[1])
    iou = inner / np.maximum(area + own - inner, LEAST_UNION)
    best = int(iou.argmax())
    return (best, False, boxes[best]) if iou[best] >= least else (largest, True, boxes[largest])


class Track:
    """One entity's track: frames in, chosen detections out; a box is all the state."""

    def __init__(self, least: float):
        self.least, self.state = least, None

    def step(self, found: list[tuple]) -> tuple[int, bool, float] | None:
        """(det_idx, reset, quality) of one frame's detections ``(det_idx, l, t, r, b)`` in order, or None in a frame without any."""
        chosen, reset, after = track_step(self.state, np.array([x[1:] for x in found], dtype=float).reshape(len(found), 4), self.least)
        if chosen is None:
            self.state = None
            return None
        ok = bool(np.isfinite(after).all() and after[2] > after[0] and after[3] > after[1])
        self.state = after if ok else self.state
        return found[chosen][0], reset, 1.0 if ok else 0.0


def track_subject(detections: DataFrame, by: list[str], least: float = 0.2) -> DataFrame:
    """Along each entity's frames, the detection that continues the subject: ``(by, pts, det_idx, reset, quality)``.

    ``detections``: pts, det_idx (null in a frame without any), l, t, r, b.  A frame without detection ends the track; a box without
    area is chosen with quality 0 and leaves the track as it was.  Entities are sorted within their partitions and streamed through
    the task, which holds one frame and one box, so an entity may be of any length.
    """
    rows = detections.select(*by, F.col("pts").cast("long").alias("pts"), F.col("det_idx").cast("int").alias("det_idx"), *(F.col(c).cast("double").alias(c) for c in "ltrb"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in by) + ", pts long, det_idx int, reset boolean, quality double"
    width = len(by)

    def run(batches):
        frame = entity = track = out_schema = None
        held: list[tuple] = []
        done: list[tuple] = []

        def close():
            if frame is not None and (got := track.step(held)):
                done.append((*frame, *got))

        def told():
            columns = list(zip(*done, strict=True)) if done else [[]] * (width + 4)
            kinds = [*out_schema, pa.int64(), pa.int32(), pa.bool_(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=[*by, "pts", "det_idx", "reset", "quality"])

        for b in batches:
            out_schema = [b.schema.field(i).type for i in range(width)]
            for row in zip(*(b.column(i).to_pylist() for i in range(width + 6)), strict=True):
                if row[: width + 1] != frame:
                    close()
                    if row[:width] != entity:
                        entity, track = row[:width], Track(least)
                    frame, held = row[: width + 1], []
                if row[width + 1] is not None:
                    held.append(row[width + 1 :])
            yield told()
            done = []
        close()
        if done:
            yield told()

    return rows.repartition(*by).sortWithinPartitions(*by, "pts", "det_idx").mapInArrow(run, schema)
