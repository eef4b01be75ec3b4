"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share; a local one only where the session names none and all runs on this machine."""
    global _own_dir
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="chronoweave-")
    return _own_dir


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/chronoweave/{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage, and survives the loss of executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def hash_share(*cols, seed: int = 0):
    """A uniform number in [0, 1) that only the columns and the seed decide."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 30)) / F.lit(float(1 << 30))


def sliced(batches: Iterable[pa.RecordBatch], rows: int, column: int | None = None, most_bytes: int = 1 << 20) -> Iterable[pa.RecordBatch]:
    """The batches in slices of ``rows`` rows, so that a task holds few texts as Python objects.

    With ``column`` a slice also ends where that column's texts reach ``most_bytes``; a longer text is a slice of its own.
    At the end Arrow's memory goes back to the system, since Python workers are used again.
    """
    for b in batches:
        cuts = np.arange(0, b.num_rows, rows)
        if column is not None and b.num_rows:
            sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes)
            cuts = np.union1d(cuts, np.flatnonzero(np.diff(ends // most_bytes, prepend=0)))
        for low, high in zip(cuts.tolist(), [*cuts[1:].tolist(), b.num_rows], strict=False):
            if high > low:
                yield b.slice(low, high - low)
        del b
    pa.default_memory_pool().release_unused()


def batch(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
