"""Sources and sinks: manifests, file digests, feature tables, JSON, CSV, splits, stacked files, run logs and scoped reports."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: str | None = None


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; below one of this machine only where none is set and all runs here."""
    global _own_dir
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _own_dir = _own_dir or "file://" + tempfile.mkdtemp(prefix="chronoweave-")
        base = _own_dir
    return f"{base.rstrip('/')}/chronoweave/{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str, options: dict | None = None) -> DataFrame:
    """``df`` as a table in a new folder of ``scratch_path``: what is read several times is made once, and survives the loss of executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


MANIFEST_SCHEMA = "video_id string, clip_id string, text string, label double, annotation string"


def legal_id(c: Column) -> Column:
    """No path separators, and neither ``.`` nor ``..``."""
    return F.coalesce(~c.rlike(r"[/\\]") & ~c.isin(".", "..", ""), F.lit(False))


def read_manifest(spark: SparkSession, path: str, fmt: str = "csv", schema: str = MANIFEST_SCHEMA) -> DataFrame:
    """Label sheet with its composite ``key``; check it with ``manifest_violations``."""
    reader = spark.read.schema(schema)
    df = reader.option("header", True).csv(path) if fmt == "csv" else reader.parquet(path)
    return with_key(df)


def with_key(df: DataFrame, video: str = "video_id", clip: str = "clip_id") -> DataFrame:
    return df.withColumn("key", F.concat_ws("__", video, clip))


def manifest_violations(df: DataFrame, required: tuple[str, ...] = ("video_id", "clip_id", "text", "label")) -> DataFrame:
    """``(key, check_id, n)``: missing values, illegal ids, repeated keys."""
    bad = [df.where(F.col(c).isNull()).groupBy("key").agg(F.count("*").alias("n")).select("key", F.lit(f"null_{c}").alias("check_id"), "n") for c in required]
    bad.append(df.where(~legal_id(F.col("video_id")) | ~legal_id(F.col("clip_id"))).groupBy("key").agg(F.count("*").alias("n")).select("key", F.lit("illegal_id").alias("check_id"), "n"))
    bad.append(df.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.lit("repeated_key").alias("check_id"), "n"))
    out = bad[0]
    for b in bad[1:]:
        out = out.unionByName(b)
    return out


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """``(path, length, sha256)`` of every file below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def write_features(df: DataFrame, path: str, modality: str = "modality") -> None:
    df.write.partitionBy(modality).parquet(path)


def read_features(spark: SparkSession, path: str, modality: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if modality is None else df.where(F.col("modality") == modality)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines; refused if a number isn't finite."""
    doubles = [c for c, t in df.dtypes if t in ("double", "float")]
    if doubles:
        bad = F.lit(False)
        for c in doubles:
            bad = bad | F.coalesce(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), F.lit(False))
        if not df.where(bad).isEmpty():
            raise ValueError("JSON can't hold numbers that aren't finite")
    df.write.json(path)


def read_json(spark: SparkSession, path: str, schema: str, whole_files: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", whole_files).json(path)


def write_csv_union(parts: list[DataFrame], path: str) -> None:
    """One CSV whose header is the union of all parts' columns, with a byte order mark."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    first = out.columns[0]
    out.withColumnRenamed(first, "﻿" + first).write.option("header", True).csv(path)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """The rows of one split of a feature table."""
    return spark.read.parquet(path).where(F.col("split") == split)


def stack_files(spark: SparkSession, path: str, name: str = r"([^/]+?)(?:\.[A-Za-z0-9]+)*$") -> DataFrame:
    """All Parquet files of a folder, with the file's stem, or what ``name`` takes of its path, as ``sample_id``."""
    return spark.read.parquet(path).withColumn("sample_id", F.regexp_extract(F.col("_metadata.file_path"), name, 1))


def append_event(df: DataFrame, path: str, stage: str) -> None:
    """Append ``(sample_id, status, seconds, error)`` rows to the run log."""
    df.select(F.current_timestamp().alias("time"), F.lit(stage).alias("stage"), "sample_id", "status", "seconds", "error").write.mode("append").partitionBy("stage").parquet(path)


def write_report(df: DataFrame, path: str, scope: str) -> None:
    """Write one scope's report; other scopes stay as they are."""
    df.withColumn("scope", F.lit(scope)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scope").parquet(path)
    df.sparkSession.catalog.refreshByPath(path)
