"""Audit of an exported mapping: what was pooled over each position, against what the raw observations give.

Both sides are compared by fingerprints first: for each entity and bucket of places the number of rows and two sums of hashes, which don't
depend on order.  Values within the tolerance may fall on two sides of a rounding step; that makes two fingerprints differ, never agree.
So only rows of buckets that disagree are joined, and only there a tolerance decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import written
from .audit import violations
from .intervals import BUCKET_ROWS, BUCKET_US
from .pooling import finite, interval_pool
from .scan import running

#: Places of a bucket that has one fingerprint.
BUCKET_PLACES = 256
TOLERANCE = 2e-6


def rounded(x: Column, tolerance: float = TOLERANCE) -> Column:
    """A whole number that is equal only for values within the tolerance; nulls and what isn't finite stay themselves."""
    return F.when(finite(x) & (F.abs(x) < 1e12), F.floor(x * (2 / tolerance)).cast("string")).otherwise(x.cast("string"))


def disagreeing(left: DataFrame, right: DataFrame, by: list[str], place: str, tokens: list[Column], width: int = BUCKET_PLACES) -> DataFrame:
    """``(by, bucket_)`` of the buckets of ``place`` whose rows, as a multiset of ``tokens``, differ.  No row meets another."""

    def side(df: DataFrame, sign: int) -> DataFrame:
        each = df.select(*by, F.floor(F.col(place) / width).alias("bucket_"), F.xxhash64(*tokens).alias("h_"), F.pmod(F.xxhash64(F.lit(1), *tokens), F.lit(1 << 40)).alias("g_"))
        return each.groupBy(*by, "bucket_").agg((F.lit(sign) * F.count("*")).alias("n_"), F.bit_xor("h_").alias("x_"), (F.lit(sign) * F.sum("g_")).alias("s_"))

    both = side(left, 1).unionByName(side(right, -1)).groupBy(*by, "bucket_").agg(F.sum("n_").alias("n_"), F.bit_xor("x_").alias("x_"), F.sum("s_").alias("s_"))
    return both.where("n_ <> 0 or x_ <> 0 or s_ <> 0").select(*by, "bucket_")


def different_rows(left: DataFrame, right: DataFrame, by: list[str], place: str, keys: list[str], tokens: list[Column], width: int = BUCKET_PLACES) -> DataFrame:
    """Rows of both sides, by ``[*by, *keys]``, of the buckets that disagree: columns ``l`` and ``r`` are structs, null where a side has none."""
    bad = disagreeing(left, right, by, place, tokens, width)
    at = F.floor(F.col(place) / width)
    some = lambda df, name: df.withColumn("bucket_", at).join(bad, [*by, "bucket_"], "left_semi").select(*by, *keys, F.struct(*(c for c in df.columns if c not in by)).alias(name))
    return some(left, "l").join(some(right, "r"), [*by, *keys], "full_outer")


def _apart(a: Column, b: Column, tolerance: float) -> Column:
    return ~(a.eqNullSafe(b) | F.coalesce(F.abs(a - b) <= tolerance * (1 + F.abs(b)), F.lit(False)))


def _arrays_apart(a: Column, b: Column, tolerance: float) -> Column:
    pairs = F.arrays_zip(a.alias("x"), b.alias("y"))
    return ~a.isNull().eqNullSafe(b.isNull()) | F.coalesce((F.size(a) != F.size(b)) | F.exists(pairs, lambda p: _apart(p["x"], p["y"], tolerance)), F.lit(False))


def window_violations(exported: DataFrame, raw: DataFrame, by: list[str], src: str = "src_idx") -> DataFrame:
    """Source windows ``(src, a, b)`` that the export changed, lost or made up."""
    side = lambda df: df.select(*by, F.col(src).alias("place"), "a", "b")
    both = different_rows(side(exported), side(raw), by, "place", ["place"], [F.col("place"), F.col("a").cast("string"), F.col("b").cast("string")])
    return violations(both, [*by, "place"], {"window_changed": ~(F.col("l.a").eqNullSafe(F.col("r.a")) & F.col("l.b").eqNullSafe(F.col("r.b")))}, F.lit(None))


def offset_violations(offsets: DataFrame, entries: DataFrame, by: list[str], pos: str = "pos") -> DataFrame:
    """Offsets ``(pos, from_offset, end_offset)`` that aren't the running numbers of the entries."""
    n = entries.groupBy(*by, pos).agg(F.count("*").alias("n_"))
    held = offsets.select(*by, pos, "from_offset", "end_offset").join(n, [*by, pos], "full_outer").withColumn("n_", F.coalesce("n_", F.lit(0)))
    ran = running(held, by, [pos], BUCKET_ROWS, {"before_": ("sum", "n_", "before")}).withColumn("before_", F.coalesce("before_", F.lit(0)))
    wrong = ~(F.col("from_offset").eqNullSafe(F.col("before_")) & F.col("end_offset").eqNullSafe(F.col("before_") + F.col("n_")))
    return violations(ran, [*by, F.col(pos).alias("place")], {"offsets": wrong}, F.lit(None))


def entry_violations(entries: DataFrame, expected: DataFrame, windows: DataFrame, by: list[str], pos: str = "pos", src: str = "src", tolerance: float = TOLERANCE) -> DataFrame:
    """Entries ``(pos, src, weight)``: weights that are no weights, sources beyond the windows, too many or missing, and weights that differ."""
    side = lambda df: df.select(*by, F.col(pos).alias("place"), F.col(src).cast("long").alias("src"), F.col("weight").cast("double").alias("weight"))
    own = side(entries)
    bad = violations(own, [*by, "place"], {"bad_weight": ~finite(F.col("weight")) | (F.col("weight") < 0)}, F.lit(None))
    both = different_rows(own, side(expected), by, "place", ["place", "src"], [F.col("place"), F.col("src"), rounded(F.col("weight"), tolerance)])
    known = windows.groupBy(*by).agg(F.max("src_idx").cast("long").alias("last_"))
    both = both.join(known, by, "left")
    beyond = F.coalesce(~F.col("src").between(0, F.col("last_")), F.lit(True))
    checks = {
        "index_range": F.col("r").isNull() & beyond, "foreign_source": F.col("r").isNull() & ~beyond, "lost_source": F.col("l").isNull(),
        "different_weight": F.col("l").isNotNull() & F.col("r").isNotNull() & _apart(F.col("l.weight"), F.col("r.weight"), tolerance),
    }
    return bad.unionByName(violations(both, [*by, "place"], checks, F.lit(None)))


def statistics_violations(stats: DataFrame, rebuilt: DataFrame, by: list[str], pos: str = "pos", tolerance: float = TOLERANCE) -> DataFrame:
    """Statistics ``(pos, mean, std, mask, coverage)`` that the raw rows don't give again."""
    side = lambda df: df.select(*by, F.col(pos).alias("place"), "mean", "std", F.coalesce("mask", F.lit(False)).alias("mask"), F.col("coverage").cast("double").alias("coverage"))
    whole = lambda c: F.transform(c, lambda x: rounded(x, tolerance))
    both = different_rows(side(stats), side(rebuilt), by, "place", ["place"], [F.col("place"), whole("mean"), whole("std"), F.col("mask"), rounded(F.col("coverage"), tolerance)])
    here = F.col("l").isNotNull() & F.col("r").isNotNull()
    checks = {
        "missing": F.col("l").isNull(), "unexpected": F.col("r").isNull(), "different_mask": here & (F.col("l.mask") != F.col("r.mask")),
        "different_mean": here & _arrays_apart(F.col("l.mean"), F.col("r.mean"), tolerance), "different_std": here & _arrays_apart(F.col("l.std"), F.col("r.std"), tolerance),
        "different_coverage": here & _apart(F.col("l.coverage"), F.col("r.coverage"), tolerance),
    }
    return violations(both, [*by, "place"], checks, F.lit(None))


def check_mapping(
    windows: DataFrame, offsets: DataFrame, entries: DataFrame, stats: DataFrame, targets: DataFrame, obs: DataFrame, by: list[str], pos: str = "pos", bucket: int = BUCKET_US
) -> DataFrame:
    """``(by, place, check_id)`` for all that an exported mapping gets wrong; ``place`` is a position, or a source for its window.

    ``windows``, ``offsets``, ``entries`` and ``stats`` are what was exported; ``targets`` and ``obs`` what ``interval_pool`` takes.
    """
    rebuilt = written(interval_pool(targets, obs, by, [pos], bucket=bucket), "rebuilt")  # fingerprints and rows of both checks read it
    expected = rebuilt.select(*by, pos, F.inline("provenance"))
    parts = [
        window_violations(windows, obs, by), offset_violations(offsets, entries, by, pos), entry_violations(entries, expected, obs, by, pos), statistics_violations(stats, rebuilt, by, pos),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*by, F.col("place").cast("long").alias("place"), "check_id")
