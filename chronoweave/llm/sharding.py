"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly.

Rows with equal texts form a group.  Groups are packed in order of size; each goes to the shard where the dot product of its vector
(shares of all bytes, tokens and rows) with the shard's residual capacity is highest.  Groups below ``1/4096`` of all bytes are
packed as bundles that their hash decides, so that the packing step sees at most 4,096 bundles and 4,096 larger groups whatever the
input's size; a group above half a shard's bytes is cut into pieces by row (a hash of the id), since no shard could take it whole and
stay level, and each piece is packed with the size that it really has.

Law ``bytes``: sizes are near equal (a bundle is at most about 0.03 % of a shard's share off the mean, and the last items placed are
the smallest).  Defined results: null text has size 1 and no bytes; nulls and empty texts are one group each (size 1); repeated rows are rows of their own;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, documents, written

BUNDLES = 4096
#: Pieces that a hot group is cut into at most.
PIECES = 1024
CHUNK_ROWS = 20_000
#: Weights of bytes, tokens and rows in the dot product: the law is on bytes.
DIMENSION_WEIGHTS = (4.0, 1.0, 1.0)


def pack(items: list[tuple], shards: int) -> dict:
    """Shard of each item ``(key, bytes, tokens, rows)``: largest first, to the highest dot product with the residual capacity."""
    if not items:
        return {}
    v = np.array([x[1:] for x in items], dtype=float)
    v /= np.maximum(v.sum(axis=0), 1)
    weights = np.array(DIMENSION_WEIGHTS)
    left = np.full((shards, v.shape[1]), 1.0 / shards)
    placed = {}
    for i in sorted(range(len(items)), key=lambda i: (-v[i].max(), items[i][0])):
        scores = left @ (v[i] * weights)
        best = int(np.argmax(scores))
        left[best] -= v[i]
        placed[items[i][0]] = best
    return placed


def shard_documents(docs: DataFrame, shards: int = 8, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` (id and text only) with ``size``, ``text_crc32``, ``n_tokens``, ``shard`` and a gapless ``slot``."""
    spark = docs.sparkSession
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(row_id),
        (F.octet_length(t) + 1).cast("long").alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
        F.regexp_count(t, F.lit(WORD)).cast("long").alias("n_tokens"),
        F.xxhash64(F.col(text), F.length(t)).alias("text_group"),
    )
    groups = rows.groupBy("text_group", "size").agg(F.sum("size").alias("bytes"), F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows"))
    groups = written(groups, "groups")
    total = groups.agg(F.sum("bytes"), F.sum("rows")).first()
    if not total[0]:
        total = (1, 1)
    large_from = max(1, total[0] // BUNDLES)
    groups = groups.withColumn("large", F.col("bytes") > large_from)
    hot_from = total[0] // (2 * shards)
    # At most BUNDLES groups are large, and 2 * shards of them hot, since together they are no larger than the input.
    large = groups.where(F.col("large") & (F.col("bytes") <= hot_from)).select("text_group", "size", "bytes", "tokens", "rows").collect()
    hot = groups.where(F.col("large") & (F.col("bytes") > hot_from)).select("text_group", "size", F.least("rows", F.lit(PIECES)).cast("int").alias("pieces")).collect()
    piece = F.pmod(F.xxhash64(F.lit(12), F.col(row_id)), F.coalesce("pieces", F.lit(1))).cast("int")
    cut = []
    if hot:
        wanted = spark.createDataFrame(hot, "text_group long, size long, pieces int")
        each = rows.join(F.broadcast(wanted), ["text_group", "size"]).withColumn("piece", piece)
        cut = each.groupBy("text_group", "size", "piece").agg(F.sum("size").alias("bytes"), F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")).collect()
    bundle = F.pmod(F.xxhash64(F.lit(11), "text_group", "size"), F.lit(BUNDLES)).cast("int")
    small = groups.where("not large").groupBy(bundle.alias("bundle")).agg(*(F.sum(c).alias(c) for c in ("bytes", "tokens", "rows"))).collect()
    items = [(("b", x["bundle"], 0, 0), x["bytes"], x["tokens"], x["rows"]) for x in small]
    items += [(("g", x["text_group"], x["size"], 0), x["bytes"], x["tokens"], x["rows"]) for x in large]
    items += [(("g", x["text_group"], x["size"], x["piece"]), x["bytes"], x["tokens"], x["rows"]) for x in cut]
    placed = pack(items, shards)
    of_bundle = [(k[1], s) for k, s in placed.items() if k[0] == "b"]
    of_group = [(x["text_group"], x["size"], 1, [placed["g", x["text_group"], x["size"], 0]]) for x in large]
    of_group += [(x["text_group"], x["size"], x["pieces"], [placed.get(("g", x["text_group"], x["size"], k), 0) for k in range(x["pieces"])]) for x in hot]
    bundles = spark.createDataFrame(of_bundle, "bundle int, bundle_shard int")
    groups = spark.createDataFrame(of_group, "text_group long, size long, pieces int, piece_shards array<int>")
    chunks = max(1, -(-total[1] // (CHUNK_ROWS * shards)))
    dealt = (
        rows.withColumn("bundle", bundle)
        .join(F.broadcast(groups), ["text_group", "size"], "left")
        .join(F.broadcast(bundles), "bundle", "left")
        .withColumn("piece", piece)
        .withColumn("shard", F.coalesce(F.get("piece_shards", F.col("piece")), "bundle_shard"))
        .withColumn("chunk", F.pmod(F.xxhash64(F.lit(13), F.col(row_id)), F.lit(max(chunks, 32))).cast("int"))
        .select(row_id, "size", "n_tokens", "text_crc32", "shard", "chunk")
    )
    # Slots without a window over a whole shard: rows are counted by chunk, and numbered within their chunk.
    counts = dealt.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("first_slot", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("shard", "chunk").orderBy(row_id, "text_crc32")
    return (
        dealt.withColumn("rank", F.row_number().over(within) - 1)
        .join(starts, ["shard", "chunk"])
        .withColumn("slot", F.col("first_slot") + F.col("rank"))
        .select(row_id, "size", "n_tokens", "text_crc32", "shard", "slot")
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards under the law ``bytes``."""
    out = shard_documents(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "n_tokens",
    )
