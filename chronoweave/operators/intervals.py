"""Interval and timeline algebra on BIGINT microseconds.

Every function takes the columns of the entity as ``by`` and keeps entities apart.  Scans and joins are dealt to buckets of the time axis
as well (``bucket``, in microseconds), so that a long entity isn't one task.  Intervals are half-open ``[a, b)``.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import running

#: Width of the time buckets that interval joins and scans are dealt to, so that a long entity isn't one task: a day.
BUCKET_US = 86_400_000_000


#: The same for scans in order of an index.
BUCKET_ROWS = 4096


def running_end(df: DataFrame, by: list[str], order: list[str], end: str = "b", name: str = "reach", width: int = BUCKET_US) -> DataFrame:
    """``df`` with the largest end of the rows before each (null for the first); a bucket takes ``width`` of the first order column."""
    return running(df, by, order, width, {name: ("max", end, "before")})


def merge_intervals(df: DataFrame, by: list[str], a: str = "a", b: str = "b", bucket: int = BUCKET_US) -> DataFrame:
    """Maximal unions; intervals that touch merge.  Empty or reversed ones are left to ``bad_intervals``.

    An island begins where no earlier interval reaches, and ends at the furthest end before the next one begins.
    """
    good = df.where(F.col(b) > F.col(a)).select(*by, a, b).distinct()  # twins would begin two islands
    seen = running(good, by, [a, b], bucket, {"reach_": ("max", b, "before"), "last_": ("max", b, "all")})
    starts = seen.where(F.col("reach_").isNull() | (F.col(a) > F.col("reach_"))).select(*by, a, "reach_", "last_")
    islands = running(starts, by, [a, "last_"], bucket, {"next_": ("lead", "reach_")})
    return islands.select(*by, a, F.coalesce("next_", "last_").alias(b))


def bad_intervals(df: DataFrame, by: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """Rows that ``merge_intervals`` can't take: no length, or an end missing."""
    return df.where(F.col(a).isNull() | F.col(b).isNull() | (F.col(b) <= F.col(a)))


def novel_start(df: DataFrame, by: list[str], a: str = "a", b: str = "b", bucket: int = BUCKET_US, name: str = "novel_a") -> DataFrame:
    """``df`` with where each interval's part begins that no interval before it covers; it ends with ``b``, and is empty if it begins there.

    These parts are disjoint and make the union of all, so that what the union covers of anything is a plain sum over them.
    """
    reach = running_end(df, by, [a, b], b, "reach_", bucket)
    return reach.withColumn(name, F.least(F.greatest(F.col(a), F.coalesce("reach_", F.col(a))), F.col(b))).drop("reach_")


def union_length(df: DataFrame, by: list[str], a: str = "a", b: str = "b", name: str = "length", bucket: int = BUCKET_US) -> DataFrame:
    """Covered length by entity; rows without length count nothing."""
    good = novel_start(df.where(F.col(b) > F.col(a)).select(*by, a, b), by, a, b, bucket)
    return good.groupBy(*by).agg(F.sum(F.col(b) - F.col("novel_a")).alias(name))


def overlap_join(targets: DataFrame, obs: DataFrame, by: list[str], bucket: int = BUCKET_US, a: str = "a", b: str = "b", s: str = "s", e: str = "e") -> DataFrame:
    """Pairs of targets ``[s, e)`` and observations ``[a, b)`` that overlap, with the overlap in ``overlap``.

    Both sides are dealt to buckets of the axis too, so that one long entity isn't one task; a pair is kept only in the bucket where
    its overlap begins, so nothing has to be made distinct.
    """
    at = lambda x: F.floor(x / bucket)
    parts = lambda low, high: F.explode(F.sequence(at(F.col(low)), at(F.col(high) - 1)))
    t = targets.where(F.col(e) > F.col(s)).withColumn("bucket_", parts(s, e))
    o = obs.where(F.col(b) > F.col(a)).withColumn("bucket_", parts(a, b))
    both = t.join(o, [*by, "bucket_"]).where((F.col(s) < F.col(b)) & (F.col(a) < F.col(e)) & (at(F.greatest(s, a)) == F.col("bucket_")))
    return both.drop("bucket_").withColumn("overlap", F.least(e, b) - F.greatest(s, a))


def intersect_intervals(left: DataFrame, right: DataFrame, by: list[str], bucket: int = BUCKET_US) -> DataFrame:
    """Intersection of two sets of intervals, each merged first; pieces of positive length."""
    both = overlap_join(merge_intervals(left, by, bucket=bucket).withColumnsRenamed({"a": "s", "b": "e"}), merge_intervals(right, by, bucket=bucket), by, bucket)
    return both.select(*by, F.greatest("s", "a").alias("x"), F.least("e", "b").alias("y")).withColumnsRenamed({"x": "a", "y": "b"})


def temporal_support(targets: DataFrame, audio: DataFrame, vision: DataFrame, by: list[str], bucket: int = BUCKET_US) -> DataFrame:
    """Length of the targets' union, and of its parts under audio, vision, either and both, by entity.

    One sweep over the ends of all intervals: how many of each kind are open from one end to the next tells what the piece counts for.
    """
    kinds = {"base": targets, "audio": audio, "vision": vision}
    ends = None
    for name, df in kinds.items():
        good = df.where(F.col("b") > F.col("a"))
        step = F.explode(F.array(F.struct(F.col("a").alias("t"), F.lit(1).alias("d")), F.struct(F.col("b").alias("t"), F.lit(-1).alias("d")))).alias("x")
        some = good.select(*by, step).select(*by, F.col("x.t").alias("t"), *(F.col("x.d").alias(k) if k == name else F.lit(0).alias(k) for k in kinds))
        ends = some if ends is None else ends.unionByName(some)
    # Ends at one time are one row, before the shuffle already.
    steps = ends.groupBy(*by, "t").agg(*(F.sum(k).alias(k) for k in kinds))
    swept = running(steps, by, ["t"], bucket, {"next_": ("lead", "t")} | {f"open_{k}": ("sum", k, "upto") for k in kinds})
    pieces = swept.select(*by, (F.col("next_") - F.col("t")).alias("len_"), *((F.col(f"open_{k}") > 0).alias(k) for k in kinds)).where("base and len_ is not null")
    under = {"total": F.lit(True), "audio": F.col("audio"), "vision": F.col("vision"), "either": F.col("audio") | F.col("vision"), "both": F.col("audio") & F.col("vision")}
    return pieces.groupBy(*by).agg(*(F.sum(F.when(c, F.col("len_")).otherwise(0)).alias(k) for k, c in under.items()))


def make_timeline(words: DataFrame, durations: DataFrame, by: list[str], min_gap_us: int = 80_000, duration: str = "duration", bucket: int = BUCKET_US) -> DataFrame:
    """All words and the gaps between the valid ones, with ``pos`` in the order (start, end, word_index).

    ``words`` has word_index, start_us, end_us, time_valid.  A gap is what is left between the furthest valid end so far (0 at first)
    and the next valid start, or the duration at last, where it is at least ``min_gap_us``.
    """
    cols = [*by, "start_us", "end_us", "word_index", "kind", "time_valid"]
    valid = words.where("time_valid").select(*by, "start_us", "end_us", F.lit(0).alias("last_"))
    # The duration comes after all words, wherever they begin: as what lies beyond the furthest end of all.
    reach = running(valid, by, ["start_us", "end_us", "last_"], bucket, {"reach_": ("max", "end_us", "before")})
    ends = valid.groupBy(*by).agg(F.max("end_us").alias("reach_"))
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"e.{c}")) for c in by]
    tails = durations.alias("d").join(ends.alias("e"), same, "left").select(*(F.col(f"d.{c}").alias(c) for c in by), F.col(f"d.{duration}").alias("start_us"), "reach_")
    from_ = F.greatest(F.lit(0), F.coalesce("reach_", F.lit(0)))
    holes = reach.select(*by, "start_us", "reach_").unionByName(tails).withColumn("from_", from_).where(F.col("start_us") - F.col("from_") >= min_gap_us)
    gaps = holes.select(
        *by, F.lit("unassigned").alias("kind"), F.lit(-1).cast("int").alias("word_index"), F.col("from_").alias("start_us"), F.col("start_us").alias("end_us"), F.lit(True).alias("time_valid")
    )
    all_ = words.select(*by, F.lit("word").alias("kind"), F.col("word_index").cast("int").alias("word_index"), "start_us", "end_us", "time_valid").unionByName(gaps).select(*cols)
    ranked = running(all_.withColumn("one_", F.lit(1)), by, [*cols[len(by) :], "one_"], bucket, {"pos": ("sum", "one_", "before")})
    return ranked.select(*by, "kind", "word_index", "start_us", "end_us", "time_valid", F.coalesce("pos", F.lit(0)).cast("int").alias("pos"))


def longest_unmapped(words: DataFrame, durations: DataFrame, by: list[str], duration: str = "duration") -> DataFrame:
    """The largest hole between valid targets, the ends of the entity included."""
    gaps = make_timeline(words, durations, by, 1, duration).where("kind = 'unassigned'")
    holes = gaps.groupBy(*by).agg(F.max(F.col("end_us") - F.col("start_us")).alias("longest_us"))
    return durations.select(*by).join(holes, by, "left").fillna(0, ["longest_us"])


def sampled_support(points: DataFrame, by: list[str], low: str = "low", high: str = "high", t: str = "t", bucket: int = BUCKET_US) -> DataFrame:
    """Cells ``[a, b)`` around strictly increasing sample times: cut at midpoints, bounded by ``low`` and ``high``."""
    mid = lambda x, y: F.floor((F.col(x) + F.col(y)) / 2).cast("long")
    near = running(points, by, [t], bucket, {"before_": ("lag", t), "after_": ("lead", t)})
    return near.withColumn("a", F.coalesce(mid("before_", t), F.col(low))).withColumn("b", F.coalesce(mid(t, "after_"), F.col(high))).drop("before_", "after_")


def exact_medians(df: DataFrame, by: list[str], value: str, name: str = "median") -> DataFrame:
    """``(by, name)``: the median of whole numbers from 0 on (the two middle ones' mean, rounded down), without an entity's rows in one place.

    Equal values are one row with their number.  Buckets of the value axis, 2048 for each power of two, hold a scan of these numbers, which
    tells the ranks that each value has; the two middle ranks pick theirs.
    """
    values = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("long").alias("v_")).agg(F.count("*").alias("n_"))
    power = F.floor(F.log2(F.greatest(F.col("v_"), F.lit(1)))).cast("int")
    bucket = power * 4096 + F.expr("v_ div shiftleft(1L, greatest(cast(floor(log2(greatest(v_, 1L))) as int) - 11, 0))")
    ranked = running(values, by, ["v_"], bucket, {"before_": ("sum", "n_", "before"), "all_": ("sum", "n_", "all")}).withColumn("before_", F.coalesce("before_", F.lit(0)))
    holds = lambda rank: F.max(F.when((F.col("before_") <= rank) & (rank < F.col("before_") + F.col("n_")), F.col("v_")))
    middle = ranked.groupBy(*by).agg(holds(F.floor((F.col("all_") - 1) / 2)).alias("low_"), holds(F.floor(F.col("all_") / 2)).alias("high_"))
    return middle.select(*by, F.floor((F.col("low_") + F.col("high_")) / 2).cast("long").alias(name))


def frame_intervals(points: DataFrame, by: list[str], t: str = "t", own: str | None = None, bucket: int = BUCKET_US) -> DataFrame:
    """``[t, next t)``; the last one takes its own duration, or the entity's median step."""
    stepped = running(points, by, [t], bucket, {"next_": ("lead", t)})
    medians = exact_medians(stepped.withColumn("step_", F.col("next_") - F.col(t)), by, "step_", "median_")
    out = stepped.alias("p").join(medians.alias("m"), [F.col(f"p.{c}").eqNullSafe(F.col(f"m.{c}")) for c in by], "left").select("p.*", "m.median_")
    last = F.coalesce(F.col(own), "median_") if own else F.col("median_")
    return out.withColumn("a", F.col(t)).withColumn("b", F.coalesce("next_", F.col(t) + F.coalesce(last, F.lit(0)))).drop("next_", "median_")


def position_coverage(targets: DataFrame, obs: DataFrame, by: list[str], key: list[str], bucket: int = BUCKET_US) -> DataFrame:
    """Share of each target ``[s, e)`` that the union of its observations covers; 0 where none does.

    What an observation covers that none before it does is known before the join, so the rest is a sum.
    """
    ids = [*by, *key]
    good = novel_start(obs.where(F.col("b") > F.col("a")).select(*by, "a", "b"), by, bucket=bucket)
    pairs = overlap_join(targets.select(*ids, "s", "e"), good, by, bucket)
    part = F.greatest(F.lit(0), F.least("e", "b") - F.greatest("s", "novel_a"))
    out = targets.join(pairs.groupBy(*ids).agg(F.sum(part).alias("covered_us")), ids, "left").fillna(0, ["covered_us"])
    return out.withColumn("coverage", F.when(F.col("e") > F.col("s"), F.col("covered_us") / (F.col("e") - F.col("s"))).otherwise(F.lit(0.0)))


def thin_by_spacing(points: DataFrame, by: list[str], step_us: int, t: str = "t") -> DataFrame:
    """Greedy thinning in time order: a point stays if it is ``step_us`` or more after the last one that stayed.

    Order-dependent: entities are sorted within their partitions and streamed through the task, which holds the last point alone, so
    an entity may be of any length.
    """
    rows = points.where(F.col(t).isNotNull()).select(*by, F.col(t).cast("long").alias(t))

    def run(batches):
        entity = last = None
        for b in batches:
            keep = []
            for *now, x in zip(*(b.column(i).to_pylist() for i in range(len(by) + 1)), strict=True):
                if now != entity:
                    entity, last = now, None
                keep.append(last is None or x - last >= step_us)
                last = x if keep[-1] else last
            yield b.filter(pa.array(keep, type=pa.bool_()))

    return rows.repartition(*by).sortWithinPartitions(*by, t).mapInArrow(run, rows.schema)
