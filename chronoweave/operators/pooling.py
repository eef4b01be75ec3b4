"""Weighted pooling of observations over intervals, token pooling, masks, padding and ragged export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import BUCKET_ROWS, BUCKET_US, novel_start, overlap_join
from .scan import running
from .vectors import vector_moments

#: The largest finite half-precision number.
HALF_MAX = 65504.0
#: Characters of a bucket that spans are joined in.
BUCKET_CHARS = 256


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def valid_observation(features: str, a: str, b: str, q: str) -> Column:
    """All features finite, positive length, finite positive quality."""
    return F.coalesce(F.forall(features, finite) & (F.col(b) > F.col(a)) & finite(F.col(q)) & (F.col(q) > 0), F.lit(False))


def _deviation(m2: Column, weight: Column) -> Column:
    return F.transform(m2, lambda x: F.sqrt(F.greatest(F.lit(0.0), x / weight)))


def interval_pool(
    targets: DataFrame, obs: DataFrame, by: list[str], key: list[str], features: str = "features", q: str = "q", src: str = "src_idx", bucket: int = BUCKET_US
) -> DataFrame:
    """Mean and population deviation of each feature over each target, weighted by overlap times quality.

    Returns a row for each target: ``mean``, ``std`` (arrays), ``mask``, ``coverage`` and ``provenance`` (sources and their weights, in
    source order).  Masked targets have null arrays.  Observations know which part of them none before covers, so a target's coverage is
    a sum; so one join and one aggregate of whole vectors tell all.
    """
    good = novel_start(obs.where(valid_observation(features, "a", "b", q)).select(*by, "a", "b", src, q, features), by, bucket=bucket)
    ids = [*by, *key]
    pairs = overlap_join(targets.select(*ids, "s", "e"), good, by, bucket)
    pairs = pairs.select(*ids, features, (F.col("overlap") * F.col(q)).cast("double").alias("w_"), F.greatest(F.lit(0), F.least("e", "b") - F.greatest("s", "novel_a")).alias("covered_"), F.col(src).alias("src_"))
    pairs = pairs.withColumn("own_", F.col("w_"))
    stats = vector_moments(pairs, ids, features, "w_", ("covered_",), ("src_", "own_"))
    weights = F.array_sort(F.transform(F.arrays_zip("src_", "own_"), lambda x: F.struct(x["src_"].alias("src"), (x["own_"] / F.col("weight")).alias("weight"))))
    told = stats.select(*ids, F.col("mean"), _deviation(F.col("m2"), F.col("weight")).alias("std"), weights.alias("provenance"), "covered_")
    out = targets.join(told, ids, "left").withColumn("coverage", F.when(F.col("e") > F.col("s"), F.coalesce("covered_", F.lit(0.0)) / (F.col("e") - F.col("s"))).otherwise(F.lit(0.0)))
    return out.drop("covered_").withColumn("mask", F.col("mean").isNotNull())


def concat_stats(mean: str, std: str) -> Column:
    """Mean and deviation as one array."""
    return F.concat(mean, std)


def pool_tokens(tokens: DataFrame, words: DataFrame, by: list[str], features: str = "features") -> DataFrame:
    """Unweighted mean of the tokens whose characters overlap a word's; invalid if there are none or one isn't finite.

    ``tokens``: token_idx, char_a, char_b, attention, features; ``words``: word_index, a, b.
    """
    pairs = char_span_join(tokens, words, by).withColumn("one_", F.lit(1.0)).withColumn("bad_", F.when(F.forall(features, finite), 0).otherwise(1))
    stats = vector_moments(pairs, [*by, "word_index"], features, "one_", ("bad_",), ("token_idx",))
    told = stats.select(*by, "word_index", F.col("mean").alias("pooled"), (F.col("bad_") == 0).alias("valid"), F.array_sort("token_idx").alias("members"))
    out = words.select(*by, "word_index").join(told, [*by, "word_index"], "left")
    return out.withColumn("valid", F.coalesce("valid", F.lit(False))).withColumn("pooled", F.when(F.col("valid"), F.col("pooled")))


def char_span_join(tokens: DataFrame, words: DataFrame, by: list[str], bucket: int = BUCKET_CHARS) -> DataFrame:
    """Tokens with attention and characters, and the words whose characters they overlap; long texts are dealt to buckets of characters."""
    return overlap_join(tokens.where(F.col("attention") > 0), words.select(*by, "word_index", "a", "b"), by, bucket, s="char_a", e="char_b").drop("overlap")


def mask_write(features: str, mask: str, width: Column) -> Column:
    """Zeros where the mask is off."""
    return F.when(F.coalesce(F.col(mask), F.lit(False)), F.col(features)).otherwise(F.transform(F.sequence(F.lit(1), width), lambda i: F.lit(0.0)))


def range_violations(df: DataFrame, features: str, limit: float = HALF_MAX) -> DataFrame:
    """Rows with a number that isn't finite or is beyond ``limit``."""
    return df.where(F.exists(features, lambda x: ~finite(x) | (F.abs(x) > limit)))


def duration_pool(positions: DataFrame, by: list[str], value: str, weight: str | None, valid: str, name: str) -> DataFrame:
    """Mean of ``value`` over valid positions, weighted by ``weight`` if given; null where there is none."""
    w = F.when(F.col(valid), F.col(weight) if weight else F.lit(1))
    return positions.groupBy(*by).agg((F.sum(w * F.col(value)) / F.nullif(F.sum(w), F.lit(0))).alias(name))


def _as_array(df: DataFrame, value: str) -> tuple[DataFrame, bool]:
    """``value_`` as an array of numbers, and whether it was one."""
    is_array = df.schema[value].dataType.typeName() == "array"
    return df.withColumn("value_", F.col(value) if is_array else F.array(value)), is_array


def moments(df: DataFrame, by: list[str], value: str, mask: str) -> DataFrame:
    """Mean, deviation (with 1e-8 added to the variance) and share present of masked values; sums are over at least one.

    Of an array column, mean and deviation are arrays, dimension by dimension; empty where nothing is present.
    """
    rows, is_array = _as_array(df, value)
    rows = rows.withColumns({"on_": F.coalesce(F.col(mask), F.lit(False)).cast("double"), "rows_": F.lit(1.0)})
    s = vector_moments(rows, by, "value_", "on_", ("rows_",))
    n = F.greatest(F.col("weight"), F.lit(1.0))
    mean, std = F.col("mean"), F.transform("m2", lambda x: F.sqrt(x / n + 1e-8))
    if not is_array:
        mean, std = F.coalesce(F.get(mean, F.lit(0)), F.lit(0.0)), F.coalesce(F.get(std, F.lit(0)), F.sqrt(F.lit(1e-8)))
    return s.select(*by, mean.alias("mean"), std.alias("std"), (F.col("weight") / F.col("rows_")).alias("present"))


def fit_observed_stats(df: DataFrame, train: Column, value: str, mask: str, floor: float = 1e-5) -> DataFrame:
    """``(dim, mu, sd)``: mean and population deviation, at least ``floor``, of each dimension over the observed training rows."""
    rows, _ = _as_array(df.where(train & F.col(mask)), value)
    s = vector_moments(rows.withColumn("one_", F.lit(1.0)), [], "value_", "one_")  # one row
    each = s.select("weight", F.posexplode(F.arrays_zip("mean", "m2")).alias("dim", "x_"))
    return each.select("dim", F.col("x_.mean").alias("mu"), F.greatest(F.sqrt(F.col("x_.m2") / F.col("weight")), F.lit(floor)).alias("sd"))


def standardise(df: DataFrame, stats: DataFrame, value: str, mask: str, clip: float = 8.0) -> DataFrame:
    """``z``: scores by ``stats`` (of ``fit_observed_stats``), 0 where unobserved, clipped; an array for an array column."""
    # One row: as many pairs as the features have dimensions.
    one = stats.agg(F.array_sort(F.collect_list(F.struct("dim", "mu", "sd"))).alias("stats_"))
    is_array = df.schema[value].dataType.typeName() == "array"
    score = lambda x, st: F.when(F.col(mask), F.greatest(F.lit(-clip), F.least(F.lit(clip), (x - st["mu"]) / st["sd"]))).otherwise(0.0)
    z = F.zip_with(F.col(value), F.col("stats_"), score) if is_array else score(F.col(value), F.get("stats_", F.lit(0)))
    return df.join(F.broadcast(one)).withColumn("z", z).drop("stats_")


def pad_batch(df: DataFrame, by: list[str], arrays: dict[str, object]) -> DataFrame:
    """Arrays padded with their fill, each to its own longest of all rows."""
    longest = df.agg(*(F.max(F.size(c)).alias(f"longest_{c}_") for c in arrays))  # one row
    out = df.join(F.broadcast(longest))
    for c, fill in arrays.items():
        out = out.withColumn(c, F.concat(F.col(c), F.array_repeat(F.lit(fill), F.col(f"longest_{c}_") - F.size(c))))
    return out.drop(*(f"longest_{c}_" for c in arrays))


def csr_offsets(df: DataFrame, by: list[str], order: str, items: str, bucket: int = BUCKET_ROWS) -> DataFrame:
    """``(by, order, from_offset, end_offset)``: where each position's items lie among its entity's, by a running sum."""
    n = F.greatest(F.coalesce(F.size(items), F.lit(0)), F.lit(0))
    rows = running(df.select(*by, order, n.alias("n_")), by, [order], bucket, {"end_": ("sum", "n_", "upto")})
    return rows.select(*by, order, (F.col("end_") - F.col("n_")).cast("int").alias("from_offset"), F.col("end_").cast("int").alias("end_offset"))


def csr_entries(df: DataFrame, by: list[str], order: str, items: str) -> DataFrame:
    """``(by, at, src, weight)``: the items of all positions, each at its place among its entity's."""
    placed = csr_offsets(df, by, order, items).select(*by, order, "from_offset")
    each = df.select(*by, order, F.posexplode(items).alias("i_", "item_")).join(placed, [*by, order])
    return each.select(*by, (F.col("from_offset") + F.col("i_")).alias("at"), "item_.src", "item_.weight")


def export_csr(df: DataFrame, by: list[str], order: str, items: str) -> DataFrame:
    """Ragged lists as offsets, indices and weights by entity; ``items`` holds structs (src, weight), null for an empty list.

    An entity's arrays are one row, as the format wants it; ``csr_offsets`` and ``csr_entries`` are the same as tables.
    """
    ends = csr_offsets(df, by, order, items).groupBy(*by).agg(F.array_sort(F.collect_list("end_offset")).alias("ends_"))
    rows = csr_entries(df, by, order, items).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("at", "src", "weight"))).alias("r_"))
    both = ends.join(rows, by, "left")
    listed = lambda c: F.coalesce(F.transform("r_", lambda x: x[c]), F.array()).alias({"src": "indices", "weight": "weights"}[c])
    return both.select(*by, F.concat(F.array(F.lit(0)), F.col("ends_")).alias("offsets"), listed("src"), listed("weight"))


def query_pool(df: DataFrame, by: list[str], query: list[float], keys: Column, value: Column, mask: str) -> DataFrame:
    """Attention of a given query vector over an entity's positions: softmax of dot / sqrt(d) where the mask is on, and the values' weighted sum."""
    dot = F.aggregate(F.zip_with(keys, F.array(*map(F.lit, query)), lambda x, y: x * y), F.lit(0.0), lambda s, z: s + z) / F.sqrt(F.lit(float(len(query))))
    x = df.where(F.col(mask)).select(*by, dot.alias("s_"), value.alias("x_"))
    top = x.groupBy(*by).agg(F.max("s_").alias("g_"))
    w = F.exp(F.col("s_") - F.col("g_"))
    return x.join(top, by).groupBy(*by).agg((F.sum(w * F.col("x_")) / F.sum(w)).alias("pooled"))


def derive_masks(ids: Column, attention: Column, audio: Column, vision: Column, special: tuple[int, ...] = (0, 101, 102)) -> dict[str, Column]:
    """Masks of a sequence whose inputs carry none: text where attention is on and the id is no special one; a position is valid if it
    has text or any audio or vision that isn't zero; audio and vision are there where they aren't zero and the position is valid."""
    nonzero = lambda c: F.coalesce(F.exists(c, lambda z: z != 0), F.lit(False))
    text = F.coalesce((attention > 0) & ~ids.isin(*special), F.lit(False))
    valid = text | nonzero(audio) | nonzero(vision)
    return {"text": text, "valid": valid, "audio": nonzero(audio) & valid, "vision": nonzero(vision) & valid}


def acoustic_valid(features: str, silent: Column) -> Column:
    """All features finite, and the clip not silent."""
    return F.coalesce(F.forall(features, finite) & ~silent, F.lit(False))


def signal_level(samples: DataFrame, by: list[str], value: str) -> DataFrame:
    """Peak and root mean square by clip."""
    return samples.groupBy(*by).agg(F.max(F.abs(value)).alias("peak"), F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"))


def digital_silence(peak: Column, threshold: float = 1e-4) -> Column:
    """Whether a clip's peak is no more than the threshold."""
    return peak <= threshold


def detection_threshold(detections: DataFrame, score: str, least: float = 0.8) -> DataFrame:
    """Detections whose score reaches ``least``."""
    return detections.where(F.col(score) >= least)


def largest_box(detections: DataFrame, by: list[str], size: Column, index: str) -> DataFrame:
    """``(by, index)`` of the largest box of each group, the first on a tie."""
    return detections.groupBy(*by).agg(F.max_by(index, F.struct(size.alias("size_"), (-F.col(index)).alias("minus_"))).alias(index))
