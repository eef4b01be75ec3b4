"""Scans in buckets against plain windows, on long entities, ties and nulls, and their plans."""

import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoweave.operators import audit, intervals, joins, pooling, scan


def rows(spark, n=400):
    rng = random.Random(1)
    data = [(rng.choice((None, "a", "a", "a", "b")), rng.choice((None, *range(-30, 90))), i, rng.choice((None, *range(20)))) for i in range(n)]
    return spark.createDataFrame(data, "k string, t long, i long, v long")


VALUES = {
    "mb": ("max", "v", "before"), "mu": ("max", "v", "upto"), "na": ("min", "v", "after"), "nf": ("min", "v", "from"), "sb": ("sum", "v", "before"), "su": ("sum", "v", "upto"),
    "sa": ("sum", "v", "after"), "xa": ("max", "v", "all"), "ta": ("sum", "v", "all"), "lg": ("lag", "v"), "ld": ("lead", "v"),
}


@pytest.mark.parametrize("width", [1, 7, 1000])
@pytest.mark.parametrize("payload", [False, True])
def test_running_equals_windows(spark, width, payload):
    df = rows(spark)
    df = df.withColumn("p", F.lit("x")) if payload else df
    w = Window.partitionBy("k").orderBy("t", "i")
    back = Window.partitionBy("k").orderBy(F.desc("t"), F.desc("i"))
    first, here, last = Window.unboundedPreceding, 0, -1
    plain = {
        "mb": F.max("v").over(w.rowsBetween(first, last)), "mu": F.max("v").over(w.rowsBetween(first, here)), "na": F.min("v").over(back.rowsBetween(first, last)), "nf": F.min("v").over(back.rowsBetween(first, here)),
        "sb": F.sum("v").over(w.rowsBetween(first, last)), "su": F.sum("v").over(w.rowsBetween(first, here)), "sa": F.sum("v").over(back.rowsBetween(first, last)), "xa": F.max("v").over(Window.partitionBy("k")),
        "ta": F.sum("v").over(Window.partitionBy("k")), "lg": F.lag("v").over(w), "ld": F.lead("v").over(w),
    }
    got = scan.running(df, ["k"], ["t", "i"], width, VALUES)
    want = df.select("*", *(c.alias(n) for n, c in plain.items()))
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def windows(df):
    """Partition columns of the windows over raw rows in the plan: those that aren't above a carry's aggregate."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [m for line in plan.splitlines() if "Window [" in line and "carry_" not in line for m in re.findall(r"\], \[([^\]]*)\], \[", line)[:1] or re.findall(r"\], \[([^\]]*)\]", line)[:1]]


def test_plans_have_no_window_by_entity_alone(spark):
    words = spark.range(10).selectExpr("string(id % 3) k", "int(id) word_index", "id * 10 start_us", "id * 10 + 5 end_us", "true time_valid", "1000L duration", "false silent")
    spans = words.selectExpr("k", "start_us a", "end_us b")
    by = ["k"]
    frames = {
        "merge": intervals.merge_intervals(spans, by), "union": intervals.union_length(spans, by), "support": intervals.temporal_support(spans, spans, spans, by),
        "timeline": intervals.make_timeline(words, words.select("k", "duration").distinct(), by), "flags": audit.word_flags(words.drop("time_valid"), by, "duration", "silent"),
        "sampled": intervals.sampled_support(words.selectExpr("k", "start_us t", "0L low", "99L high"), by), "frames": intervals.frame_intervals(words.selectExpr("k", "start_us t"), by),
        "monotone": audit.monotone_violations(words, by, "start_us", "word_index"), "continuity": audit.continuity_violations(spans.withColumn("src_idx", F.col("a")), by, 1),
        "order": audit.provenance_order_violations(words.selectExpr("k", "word_index", "start_us lo", "end_us hi", "start_us centre"), by), "csr": pooling.csr_offsets(words.withColumn("p", F.array("start_us")), by, "word_index", "p"),
        "rebase": audit.rebase_time(words, by, "start_us", "duration"), "nearest": joins.nearest(words.selectExpr("k", "start_us when"), words.selectExpr("k", "start_us t", "1D value"), by),
    }
    for name, df in frames.items():
        found = windows(df)
        assert (found or name == "rebase") and all("bucket_" in keys for keys in found), (name, found)


def test_one_entity_is_many_tasks(spark):
    """Half of all rows are one entity's: its scan is dealt to as many tasks as there are."""
    df = spark.range(200_000).selectExpr("if(id % 2 = 0, 'hot', string(id % 1000)) k", "id * 1000000 a", "id * 1000000 + 400000 b")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = scan.running(df, ["k"], ["a", "b"], 1_000_000_000, {"reach": ("max", "b", "before")})
        sizes = out.where("k = 'hot'").groupBy(F.spark_partition_id()).count().collect()
        assert len(sizes) == 4 and max(r["count"] for r in sizes) < 60_000
        assert out.where("reach is null").count() == df.select("k").distinct().count() and out.where("reach >= a").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def plain_merge(spans):
    out = []
    for a, b in sorted(spans):
        if b <= a:
            continue
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("bucket", [3, 50, 10_000])
def test_intervals_across_buckets(spark, bucket):
    rng = random.Random(bucket)
    data = [(k, a, a + rng.choice((-1, 0, 1, 2, 5, 200))) for k in "xyz" for a in rng.choices(range(-100, 400), k=120)]
    df = spark.createDataFrame(data, "k string, a long, b long")
    want = {k: plain_merge([(a, b) for j, a, b in data if j == k]) for k in "xyz"}
    got = sorted(tuple(r) for r in intervals.merge_intervals(df, ["k"], bucket=bucket).collect())
    assert got == sorted((k, *x) for k, v in want.items() for x in v)
    assert {r["k"]: r["length"] for r in intervals.union_length(df, ["k"], bucket=bucket).collect()} == {k: sum(b - a for a, b in v) for k, v in want.items()}
    points = {k: {t for a, b in v for t in range(a, b)} for k, v in want.items()}
    other = df.withColumns({"a": F.col("a") + 37, "b": F.col("b") + 37})
    shifted = {k: {t + 37 for t in v} for k, v in points.items()}
    far = other.withColumns({"a": F.col("a") + 60, "b": F.col("b") + 60})
    third = {k: {t + 60 for t in v} for k, v in shifted.items()}
    for r in intervals.temporal_support(df, other, far, ["k"], bucket=bucket).collect():
        p, q, s = points[r["k"]], shifted[r["k"]], third[r["k"]]
        assert (r["total"], r["audio"], r["vision"], r["either"], r["both"]) == (len(p), len(p & q), len(p & s), len(p & (q | s)), len(p & q & s))


@pytest.mark.parametrize("bucket", [2, 1000])
def test_nearest_across_buckets(spark, bucket):
    rng = random.Random(3)
    points = sorted({("x", rng.randrange(-50, 500)) for _ in range(60)} | {("y", 5)})
    asked = [(k, i, rng.randrange(-80, 560)) for i, k in enumerate("xxxxxyz" * 30)]
    p = spark.createDataFrame([(k, t, float(t) / 2) for k, t in points], "k string, t long, value double")
    q = spark.createDataFrame(asked, "k string, i int, when long")
    for r in joins.nearest(q, p, ["k"], bucket=bucket).collect():
        own = [t for k, t in points if k == r["k"]]
        want = min(own, key=lambda t: (abs(t - r["when"]), t)) if own else None
        assert r["near_t"] == want and r["near_value"] == (None if want is None else want / 2)
    assert joins.nearest(q, p.limit(0), ["k"]).where("near_t is not null").count() == 0


def test_nearest_of_a_long_entity(spark):
    """Linear: 200,000 points and queries of one entity."""
    p = spark.range(200_000).selectExpr("1 k", "id * 10 t", "double(id) value")
    q = spark.range(200_000).selectExpr("1 k", "id * 10 + 4 when")
    out = joins.nearest(q, p, ["k"])
    assert out.where("near_t <> when - 4").count() == 0 and out.count() == 200_000


def test_median_steps(spark):
    """Medians by counting against sorted ones, for odd, even, equal and single steps."""
    rng = random.Random(8)
    times = {k: sorted(rng.sample(range(10_000), n)) for k, n in (("a", 2), ("b", 3), ("c", 40), ("d", 41), ("e", 1))} | {"f": [0, 5, 10, 15], "g": [0, 1, 2**40, 2**40 + 1, 2**41]}
    df = spark.createDataFrame([(k, t) for k, v in times.items() for t in v], "k string, t long")
    got = {(r["k"], r["a"]): r["b"] for r in intervals.frame_intervals(df, ["k"]).collect()}
    for k, v in times.items():
        steps = sorted(y - x for x, y in zip(v, v[1:], strict=False))
        n = len(steps)
        median = 0 if not n else steps[n // 2] if n % 2 else (steps[n // 2 - 1] + steps[n // 2]) // 2
        assert [got[k, t] for t in v] == [*v[1:], v[-1] + median]
