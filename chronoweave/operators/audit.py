"""Data-quality checks: each gives violation rows ``(sample key, check_id, detail)``, summed up to a status for each sample."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import BUCKET_ROWS, running_end
from .scan import running


def violations(df: DataFrame, key: list[str | Column], checks: dict[str, Column], detail: Column) -> DataFrame:
    """A row for each row and check that is true; one scan for all checks."""
    failed = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items())))
    return df.select(*key, F.explode(failed).alias("check_id"), detail.cast("string").alias("detail"))


def word_flags(words: DataFrame, by: list[str], duration: str, silent: str, order: str = "word_index", tolerance_us: int = 1, slack_us: int = 1000, bucket: int = BUCKET_ROWS) -> DataFrame:
    """``flags`` of each word: no length, before the furthest end so far, outside the audio, silent audio; ``time_valid`` without any."""
    df = running_end(words, by, [order], "end_us", "reach_", bucket).withColumn("reach_", F.greatest(F.lit(0), F.coalesce("reach_", F.lit(0))))
    flags = F.array_compact(F.array(
        F.when(F.col("end_us") <= F.col("start_us"), "non_positive_duration"),
        F.when(F.col("start_us") < F.col("reach_") - tolerance_us, "overlap_or_nonmonotonic"),
        F.when((F.col("start_us") < 0) | (F.col("end_us") > F.col(duration) + slack_us), "out_of_audio_bounds"),
        F.when(F.col(silent), "silent_audio"),
    ))
    return df.withColumn("flags", flags).withColumn("time_valid", F.size("flags") == 0).drop("reach_")


def safe_interval(start: str, end: str, duration: str, offset: Column) -> tuple[Column, Column]:
    """Both ends clipped to the audio, then shifted by its offset."""
    clip = lambda c: F.greatest(F.lit(0), F.least(F.col(c), F.col(duration))) + offset
    return clip(start), clip(end)


def monotone_violations(points: DataFrame, by: list[str], t: str = "t", order: str = "src_idx", bucket: int = BUCKET_ROWS) -> DataFrame:
    """Times that aren't after the one before."""
    return running(points, by, [order], bucket, {"before_": ("lag", t)}).where(F.col(t) <= F.col("before_")).drop("before_")


def continuity_violations(chunks: DataFrame, by: list[str], limit_us: int, order: str = "src_idx", bucket: int = BUCKET_ROWS) -> DataFrame:
    """Chunks that begin more than ``limit_us`` off the end of the one before."""
    after = running(chunks, by, [order], bucket, {"before_": ("lag", "b")})
    return after.withColumn("gap_us", F.col("a") - F.col("before_")).where(F.abs("gap_us") > limit_us).drop("before_")


def rebase_time(df: DataFrame, by: list[str], t: str, other_start: str) -> DataFrame:
    """Times from the entity's origin: the earlier of its first time here and its start elsewhere."""
    first = df.groupBy(*by).agg(F.min(t).alias("first_"))
    both = df.alias("d").join(first.alias("f"), [F.col(f"d.{c}").eqNullSafe(F.col(f"f.{c}")) for c in by]).select("d.*", "f.first_")
    return both.withColumn("origin", F.least("first_", other_start)).withColumn(t, F.col(t) - F.col("origin")).drop("first_")


def provenance_order_violations(df: DataFrame, by: list[str], order: str = "word_index", slack: float = 1e-6, bucket: int = BUCKET_ROWS) -> DataFrame:
    """Words whose least, greatest or mean source goes back against the word before.  ``df``: lo, hi, centre."""
    names = ("lo", "hi", "centre")
    seen = running(df, by, [order], bucket, {f"{c}_before_": ("lag", c) for c in names})
    back = reduce(lambda x, y: x | y, (F.col(c) < F.col(f"{c}_before_") - slack for c in names))
    return seen.where(back).drop(*(f"{c}_before_" for c in names))


def index_identity(df: DataFrame, by: list[str], index: str) -> DataFrame:
    """Entities whose indices aren't exactly 0..n-1, once each."""
    s = df.groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct(index).alias("distinct_n"), F.min(index).alias("lo"), F.max(index).alias("hi"))
    return s.where((F.col("lo") != 0) | (F.col("hi") != F.col("n") - 1) | (F.col("n") != F.col("distinct_n")))


def position_checks(features: str, mask: str, width: int, start: str, end: str, duration: str, word_index: str, words: str, slack_us: int = 1) -> dict[str, Column]:
    """What each exported position must hold: a vector of the right width, finite, zero where it is masked; a time inside the clip that has
    length; and a word index of the sample's words, or -1 for a gap."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return {
        "width": F.coalesce(F.size(features), F.lit(-1)) != width,
        "not_finite": F.exists(features, bad),
        "nonzero_where_masked": ~F.coalesce(F.col(mask), F.lit(False)) & F.exists(features, lambda x: x != 0),
        "mask_missing": F.col(mask).isNull(),
        "out_of_time": F.col(start).isNull() | F.col(end).isNull() | (F.col(start) < -slack_us) | (F.col(end) > F.col(duration) + slack_us),
        "no_length": F.col(end) <= F.col(start),
        "word_index": ~F.coalesce(F.col(word_index).between(-1, F.col(words) - 1), F.lit(False)),
    }


def sample_status(samples: DataFrame, found: DataFrame, key: list[str], done: str = "done") -> DataFrame:
    """``ok``, ``invalid`` or ``pending`` for each sample, with the number of its violations."""
    n = found.groupBy(*key).agg(F.count("*").alias("violations"))
    out = samples.join(n, key, "left").fillna(0, ["violations"])
    return out.withColumn("status", F.when(~F.col(done), "pending").when(F.col("violations") > 0, "invalid").otherwise("ok"))


def prediction_checks(p0: str, p1: str, p2: str, cls: str, intensity: str) -> dict[str, Column]:
    """What a final prediction must hold: range, sign, and probabilities that sum to 1."""
    c, x = F.col(cls), F.col(intensity)
    return {
        "intensity_range": ~x.between(-3, 3),
        "sign": ((c == 0) & (x >= 0)) | ((c == 1) & (x != 0)) | ((c == 2) & (x <= 0)),
        "probabilities": F.abs(F.col(p0) + F.col(p1) + F.col(p2) - 1) > 2e-5,
    }


def prediction_file_violations(preds: DataFrame, expected: DataFrame, key: list[str]) -> DataFrame:
    """``(key, check_id)``: ids that come more than once, are missing, or were not asked for."""
    n = preds.groupBy(*key).agg(F.count("*").alias("n_"))
    both = n.join(expected.select(*key).distinct().withColumn("asked_", F.lit(True)), key, "full_outer")
    checks = {"repeated_id": F.col("n_") > 1, "missing_id": F.col("n_").isNull(), "unexpected_id": F.col("asked_").isNull()}
    return violations(both, key, checks, F.lit(None)).drop("detail")


def window_count_violations(explained: DataFrame, evidence: DataFrame, by: list[str], windows: str = "n_windows") -> DataFrame:
    """``(by, check_id)``: samples whose number of windows isn't that of their evidence rows."""
    n = evidence.groupBy(*by).agg(F.count("*").alias("n_"))
    both = explained.select(*by, F.col(windows).alias("told_")).join(n, by, "full_outer")
    return violations(both, by, {"window_rows": F.coalesce("told_", F.lit(0)) != F.coalesce("n_", F.lit(0))}, F.lit(None)).drop("detail")


def availability_violations(rows: DataFrame, told: DataFrame, by: list[str], flag: str) -> DataFrame:
    """``(by, check_id)``: samples whose row says otherwise than the input's audit whether a modality is there."""
    both = rows.select(*by, F.col(flag).alias("row_")).join(told.select(*by, F.col(flag).alias("audit_")), by, "full_outer")
    return violations(both, by, {"availability": ~F.col("row_").eqNullSafe(F.col("audit_"))}, F.lit(None)).drop("detail")


def validation_totals(status: DataFrame, seconds: str, longest: str) -> DataFrame:
    """One row: samples expected and complete, summed seconds of the complete ones, and their longest hole."""
    ok = F.col("status") == "ok"
    return status.agg(
        F.count("*").alias("expected"), F.count_if(ok).alias("complete"), F.coalesce(F.sum(F.when(ok, F.col(seconds))), F.lit(0)).alias("seconds"), F.coalesce(F.max(F.when(ok, F.col(longest))), F.lit(0)).alias("longest")
    )


def validation_lists(status: DataFrame, key: str, flags: dict[str, Column]) -> DataFrame:
    """``(list, key)``: the samples of each named list, and of ``incomplete``, as rows, since a list may be as long as the table."""
    named = F.array_compact(F.array(F.when(F.col("status") != "ok", "incomplete"), *(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in flags.items())))
    return status.select(F.explode(named).alias("list"), key)


def explanation_checks() -> dict[str, Column]:
    """Contributions add up to full minus base, shares to 1."""
    total = F.col("class_t") + F.col("class_a") + F.col("class_v")
    shares = F.col("share_t") + F.col("share_a") + F.col("share_v")
    return {"efficiency": F.abs(total - (F.col("full") - F.col("base"))) > 2e-5, "shares": (F.abs(shares - 1) > 2e-5) & (F.abs(total) > 1e-6)}


def token_identity(given: DataFrame, again: DataFrame, by: list[str], column: str) -> DataFrame:
    """``(by, differs)``: whether given and recomputed token arrays differ, in any place or in length; missing on one side differs."""
    both = given.select(*by, F.col(column).alias("given_")).join(again.select(*by, F.col(column).alias("again_")), by, "full_outer")
    return both.select(*by, (~F.col("given_").eqNullSafe(F.col("again_"))).alias("differs"))


def source_identity(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that aren't what the manifest (path, sha256) says: other content, gone, or not listed."""
    listed = manifest.select("path", F.col("sha256").alias("expected_"))
    both = files.select("path", "sha256", F.col("length").alias("length_")).join(listed, "path", "full_outer")
    checks = {
        "other_content": F.col("sha256") != F.col("expected_"), "gone": F.col("sha256").isNull(), "not_listed": F.col("expected_").isNull(),
    }
    return violations(both, ["path"], checks, F.col("length_"))


def record_digest(df: DataFrame, columns: list[str]) -> Column:
    """SHA-256 of a row's canonical JSON: its columns by name."""
    return F.sha2(F.to_json(F.struct(*(F.col(c) for c in sorted(columns)))), 256)
