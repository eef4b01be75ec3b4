"""Queries on timelines, intervals, pooling, flags and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fusion
from ..sources import written
from ..operators import audit, intervals, joins, mapping, metrics, pooling, scan
from .registry import query
from .views import GAP_US, view

U = ["user_id"]
STEP_US = 3_600_000_000


def r6(c):
    return F.round(c, 6)


def merged(name: str, src: str) -> str:
    """CTEs of the merged intervals of ``src`` (user_id, a, b)."""
    return f"""
{name}_x AS (SELECT DISTINCT user_id, a, b FROM ({src}) WHERE b > a),
{name}_y AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM {name}_x),
{name}_z AS (SELECT *, sum(CASE WHEN r IS NULL OR a > r THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM {name}_y),
{name} AS (SELECT user_id, min(a) AS a, max(b) AS b FROM {name}_z GROUP BY user_id, g)"""


def crossed(name: str, x: str, y: str) -> str:
    return f"{name} AS (SELECT x.user_id, greatest(x.a, y.a) AS a, least(x.b, y.b) AS b FROM {x} x JOIN {y} y ON x.user_id = y.user_id AND x.a < y.b AND y.a < x.b)"


WORDS = "SELECT user_id, start_us AS a, end_us AS b FROM words_v"
AUDIO, VISION = "SELECT user_id, a, b FROM audio_v", "SELECT user_id, a, b FROM vision_v"
FLAGS = "list_filter([CASE WHEN f_pos THEN 'non_positive_duration' END, CASE WHEN f_over THEN 'overlap_or_nonmonotonic' END, CASE WHEN f_bounds THEN 'out_of_audio_bounds' END, CASE WHEN f_silent THEN 'silent_audio' END], lambda x: x IS NOT NULL)"
TIMELINE = f"""
tl_v AS (SELECT user_id, start_us, end_us, 0 AS l FROM words_v WHERE time_valid UNION ALL SELECT user_id, duration, NULL, 1 FROM dur),
tl_h AS (SELECT *, greatest(0, coalesce(max(end_us) OVER (PARTITION BY user_id ORDER BY l, start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS f FROM tl_v),
tl_a AS (SELECT user_id, 'word' AS kind, word_index, start_us, end_us, time_valid FROM words_v
         UNION ALL SELECT user_id, 'unassigned', -1, f, start_us, true FROM tl_h WHERE start_us - f >= {GAP_US}),
timeline AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY start_us, end_us, word_index) - 1 AS INT) AS pos FROM tl_a)"""
POOLED = TIMELINE + """,
good AS (SELECT * FROM audio_v WHERE b > a AND q > 0),
pairs AS (SELECT t.user_id, t.pos, o.src_idx, o.x, o.q, greatest(t.start_us, o.a) AS ca, least(t.end_us, o.b) AS cb, (least(t.end_us, o.b) - greatest(t.start_us, o.a)) * o.q AS w
          FROM timeline t JOIN good o ON t.user_id = o.user_id AND t.start_us < o.b AND o.a < t.end_us WHERE t.end_us > t.start_us),
mu AS (SELECT user_id, pos, sum(w * x) / sum(w) AS mean, sum(w) AS ws FROM pairs GROUP BY user_id, pos),
sd AS (SELECT p.user_id, p.pos, any_value(mean) AS mean, sqrt(greatest(0.0, sum(w * (x - mean) * (x - mean)) / sum(w))) AS std FROM pairs p JOIN mu ON p.user_id = mu.user_id AND p.pos = mu.pos GROUP BY p.user_id, p.pos),
reach AS (SELECT *, max(cb) OVER (PARTITION BY user_id, pos ORDER BY ca, cb ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM pairs),
cov AS (SELECT user_id, pos, sum(greatest(0, cb - greatest(ca, coalesce(r, ca)))) AS c FROM reach GROUP BY user_id, pos)"""


def words(spark, d):
    return view(spark, d, "words_v")


def spans(df, a="start_us", b="end_us"):
    return df.select("user_id", F.col(a).alias("a"), F.col(b).alias("b"))


def timeline(spark, d):
    w = words(spark, d)
    return intervals.make_timeline(w.select("user_id", "word_index", "start_us", "end_us", "time_valid"), view(spark, d, "dur"), U, GAP_US)


def targets(spark, d):
    return timeline(spark, d).select("user_id", "pos", "kind", "word_index", F.col("start_us").alias("s"), F.col("end_us").alias("e"))


@query("i1_merge_intervals", merged("m", WORDS) + " SELECT user_id, a, b FROM m")
def i1(spark, d):
    return intervals.merge_intervals(spans(words(spark, d)), U)


@query("i1_bad_intervals", "SELECT user_id, start_us AS a, end_us AS b FROM words_v WHERE end_us <= start_us")
def i1_bad(spark, d):
    return intervals.bad_intervals(spans(words(spark, d)), U)


@query("i2_union_length", merged("m", WORDS) + " SELECT user_id, CAST(sum(b - a) AS BIGINT) AS length FROM m GROUP BY user_id")
def i2(spark, d):
    return intervals.union_length(spans(words(spark, d)), U)


@query("i3_intersect_intervals", merged("m", WORDS) + "," + merged("n", AUDIO) + "," + crossed("x", "m", "n") + " SELECT user_id, a, b FROM x")
def i3(spark, d):
    return intervals.intersect_intervals(spans(words(spark, d)), view(spark, d, "audio_v").select("user_id", "a", "b"), U)


@query(
    "i4_temporal_support",
    ",".join([merged("m", WORDS), merged("au", AUDIO), merged("vi", VISION), merged("ei", f"{AUDIO} UNION ALL {VISION}"), crossed("x1", "m", "au"), crossed("x2", "m", "vi"), crossed("x3", "m", "ei"), crossed("x4", "x1", "vi")])
    + """ SELECT m.user_id, CAST(sum(b - a) AS BIGINT) AS total,
      CAST(coalesce((SELECT sum(b - a) FROM x1 WHERE x1.user_id = m.user_id), 0) AS BIGINT) AS audio, CAST(coalesce((SELECT sum(b - a) FROM x2 WHERE x2.user_id = m.user_id), 0) AS BIGINT) AS vision,
      CAST(coalesce((SELECT sum(b - a) FROM x3 WHERE x3.user_id = m.user_id), 0) AS BIGINT) AS either, CAST(coalesce((SELECT sum(b - a) FROM x4 WHERE x4.user_id = m.user_id), 0) AS BIGINT) AS "both"
      FROM m GROUP BY m.user_id""",
)
def i4(spark, d):
    return intervals.temporal_support(spans(words(spark, d)), view(spark, d, "audio_v").select("user_id", "a", "b"), view(spark, d, "vision_v").select("user_id", "a", "b"), U)


@query("i5_timeline", TIMELINE + " SELECT user_id, pos, kind, word_index, start_us, end_us, time_valid FROM timeline")
def i5(spark, d):
    return timeline(spark, d).select("user_id", "pos", "kind", "word_index", "start_us", "end_us", "time_valid")


@query("i6_sampled_support", "SELECT user_id, t, a, b FROM vision_v")
def i6(spark, d):
    p = view(spark, d, "points_v").join(view(spark, d, "dur"), "user_id").withColumn("low", F.lit(0).cast("long"))
    return intervals.sampled_support(p, U, "low", "duration").select("user_id", "t", "a", "b")


@query(
    "i7_frame_intervals",
    """st AS (SELECT user_id, t, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS nx FROM points_v)
    SELECT user_id, t AS a, coalesce(nx, t + coalesce(CAST(trunc(median(nx - t) OVER (PARTITION BY user_id)) AS BIGINT), 0)) AS b FROM st""",
)
def i7(spark, d):
    return intervals.frame_intervals(view(spark, d, "points_v"), U).select("user_id", "a", "b")


@query(
    "i8_longest_unmapped",
    TIMELINE.replace(f">= {GAP_US}", ">= 1") + " SELECT d.user_id, CAST(coalesce(max(end_us - start_us), 0) AS BIGINT) AS longest_us FROM dur d LEFT JOIN (SELECT * FROM timeline WHERE kind = 'unassigned') t ON d.user_id = t.user_id GROUP BY d.user_id",
)
def i8(spark, d):
    return intervals.longest_unmapped(words(spark, d), view(spark, d, "dur"), U)


@query("i9_position_coverage", POOLED + " SELECT t.user_id, t.pos, coalesce(round(c / (t.end_us - t.start_us), 6), 0.0) AS coverage FROM timeline t LEFT JOIN cov ON t.user_id = cov.user_id AND t.pos = cov.pos")
def i9(spark, d):
    obs = view(spark, d, "audio_v").where("q > 0").select("user_id", "a", "b")
    return intervals.position_coverage(targets(spark, d), obs, U, ["pos"]).select("user_id", "pos", r6("coverage").alias("coverage"))


@query("i10_thin_by_spacing", """kp AS (SELECT user_id, min(t) AS t FROM points_v GROUP BY user_id
    UNION ALL SELECT k.user_id, min(p.t) AS t FROM kp k JOIN points_v p ON p.user_id = k.user_id AND p.t >= k.t + 3600000000 GROUP BY k.user_id, k.t) SELECT user_id, t FROM kp""")
def i10(spark, d):
    return intervals.thin_by_spacing(view(spark, d, "points_v"), U, STEP_US)


@query("j1_overlap_join", POOLED + " SELECT user_id, pos, src_idx, cb - ca AS overlap FROM pairs")
def j1(spark, d):
    obs = view(spark, d, "audio_v").where("q > 0")
    return intervals.overlap_join(targets(spark, d), obs, U).select("user_id", "pos", "src_idx", "overlap")


@query("a1_interval_pool", POOLED + """ SELECT t.user_id, t.pos, sd.mean IS NOT NULL AS mask, round(sd.mean, 6) AS mean, round(sd.std, 6) AS std, coalesce(round(c / (t.end_us - t.start_us), 6), 0.0) AS coverage,
    coalesce((SELECT count(*) FROM pairs p WHERE p.user_id = t.user_id AND p.pos = t.pos), 0) AS sources
    FROM timeline t LEFT JOIN sd ON t.user_id = sd.user_id AND t.pos = sd.pos LEFT JOIN cov ON t.user_id = cov.user_id AND t.pos = cov.pos""")
def a1(spark, d):
    out = pooled(spark, d)
    return out.select("user_id", "pos", "mask", r6(F.get("mean", F.lit(0))).alias("mean"), r6(F.get("std", F.lit(0))).alias("std"), r6("coverage").alias("coverage"), F.coalesce(F.size("provenance"), F.lit(0)).cast("long").alias("sources"))


def pooled(spark, d):
    obs = view(spark, d, "audio_v").withColumn("features", F.array("x"))
    return intervals_pool(spark, d, obs)


def intervals_pool(spark, d, obs):
    return pooling.interval_pool(targets(spark, d).select("user_id", "pos", "s", "e"), obs, U, ["pos"])


@query("a3_concat_stats", POOLED + " SELECT user_id, pos, round(mean, 6) AS c0, round(std, 6) AS c1 FROM sd")
def a3(spark, d):
    both = pooled(spark, d).where("mask").withColumn("stats", pooling.concat_stats("mean", "std"))
    return both.select("user_id", "pos", r6(F.get("stats", F.lit(0))).alias("c0"), r6(F.get("stats", F.lit(1))).alias("c1"))


@query("a4_duration_pool", POOLED + " SELECT t.user_id, round(sum(CASE WHEN sd.mean IS NOT NULL THEN (t.end_us - t.start_us) * sd.mean END) / nullif(sum(CASE WHEN sd.mean IS NOT NULL THEN t.end_us - t.start_us END), 0), 6) AS pooled FROM timeline t LEFT JOIN sd ON t.user_id = sd.user_id AND t.pos = sd.pos GROUP BY t.user_id")
def a4(spark, d):
    p = pooled(spark, d).withColumn("w", F.col("e") - F.col("s")).withColumn("m", F.get("mean", F.lit(0)))
    return pooling.duration_pool(p, U, "m", "w", "mask", "pooled").select("user_id", r6("pooled").alias("pooled"))


@query("s10_export_csr", POOLED + """, nn AS (SELECT t.user_id, t.pos, (SELECT count(*) FROM pairs p WHERE p.user_id = t.user_id AND p.pos = t.pos) AS n FROM timeline t)
    SELECT user_id, pos, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY pos) AS INT) AS end_offset FROM nn""")
def s10(spark, d):
    csr = pooling.export_csr(pooled(spark, d), U, "pos", "provenance")
    return csr.select("user_id", F.posexplode(F.slice("offsets", 2, F.size("offsets") - 1)).alias("pos", "end_offset"))


@query("s10_csr_entries", POOLED + """, pl AS (SELECT user_id, pos, src_idx, w / sum(w) OVER (PARTITION BY user_id, pos) AS weight FROM pairs)
    SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY pos, src_idx) - 1 AS INT) AS at, src_idx AS src, round(weight, 6) AS weight FROM pl""")
def s10b(spark, d):
    out = pooling.csr_entries(pooled(spark, d), U, "pos", "provenance")
    return out.select("user_id", "at", "src", r6("weight").alias("weight"))


@query("s9_pad_batch", TIMELINE + ", l AS (SELECT user_id, count(*) AS n FROM timeline GROUP BY user_id) SELECT user_id, (SELECT max(n) FROM l) AS width, (SELECT max(n) FROM l) - n AS filled FROM l")
def s9(spark, d):
    lists = timeline(spark, d).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word_index"))), lambda x: x["word_index"]).alias("idx"), F.count("*").alias("n"))
    out = pooling.pad_batch(lists, U, {"idx": -1})
    return out.select("user_id", F.size("idx").cast("long").alias("width"), (F.size("idx") - F.col("n")).alias("filled"))


@query("p4_word_flags", f"SELECT user_id, word_index, time_valid, array_to_string({FLAGS}, ';') AS flags FROM words_v")
def p4(spark, d):
    out = audit.word_flags(words(spark, d).drop("time_valid"), U, "duration", "silent")
    return out.select("user_id", "word_index", "time_valid", F.array_join("flags", ";").alias("flags"))


@query("p5_safe_interval", "SELECT user_id, word_index, greatest(0, least(start_us, duration)) + 5 AS a, greatest(0, least(end_us, duration)) + 5 AS b FROM words_v")
def p5(spark, d):
    a, b = audit.safe_interval("start_us", "end_us", "duration", F.lit(5))
    return words(spark, d).select("user_id", "word_index", a.alias("a"), b.alias("b"))


REASON = "CASE WHEN f_silent THEN 'silent_audio' WHEN f_bounds THEN 'out_of_audio_bounds' WHEN f_over THEN 'overlap_or_nonmonotonic' WHEN f_pos THEN 'non_positive_duration' ELSE 'other' END"


def flagged(spark, d):
    return audit.word_flags(words(spark, d).drop("time_valid"), U, "duration", "silent")


@query("t9_invalid_reason", f"SELECT user_id, word_index, {REASON} AS reason FROM words_v WHERE NOT time_valid")
def t9(spark, d):
    return flagged(spark, d).where("not time_valid").select("user_id", "word_index", metrics.invalid_reason("flags").alias("reason"))


@query("a8_reason_counts", f"SELECT 'any' AS kind, reason, count(*) AS n FROM (SELECT unnest({FLAGS}) AS reason FROM words_v) GROUP BY reason UNION ALL SELECT 'first', {REASON}, count(*) FROM words_v WHERE NOT time_valid GROUP BY 2")
def a8(spark, d):
    return metrics.reason_counts(flagged(spark, d))


@query("q8_reason_total", "SELECT count(*) AS invalid, count(*) AS by_reason, true AS equal FROM words_v WHERE NOT time_valid")
def q8(spark, d):
    f = flagged(spark, d)
    total = f.agg(F.count_if(~F.col("time_valid")).alias("invalid"))
    first = metrics.reason_counts(f).where("kind = 'first'").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("by_reason"))
    return total.join(F.broadcast(first)).withColumn("equal", F.col("invalid") == F.col("by_reason"))


@query("a7_dataset_rates", """u AS (SELECT user_id, duration, least(duration, 40000000000) AS part FROM dur) SELECT round(sum(part) / nullif(sum(duration), 0), 6) AS covered, CAST(NULL AS DOUBLE) AS none FROM u""")
def a7(spark, d):
    u = view(spark, d, "dur").withColumn("part", F.least("duration", F.lit(40_000_000_000))).withColumn("zero", F.lit(0))
    out = metrics.dataset_rates(u, {"covered": ("part", "duration"), "none": ("part", "zero")})
    return out.select(r6("covered").alias("covered"), F.col("none").cast("double").alias("none"))


@query("a9_availability", POOLED + " SELECT round(count(sd.mean) / count(*), 6) AS audio, round(sum(CASE WHEN kind = 'word' AND time_valid THEN 1 ELSE 0 END) / sum(CASE WHEN kind = 'word' THEN 1 ELSE 0 END), 6) AS words, CAST(sum(CASE WHEN kind <> 'word' THEN 1 ELSE 0 END) AS BIGINT) AS gaps FROM timeline t LEFT JOIN sd ON t.user_id = sd.user_id AND t.pos = sd.pos")
def a9(spark, d):
    p = timeline(spark, d).join(pooled(spark, d).select("user_id", "pos", "mask"), ["user_id", "pos"])
    out = metrics.availability(p, "mask")
    return out.select(r6("available").alias("audio"), r6("words").alias("words"), "gaps")


@query("a10_sample_summary", TIMELINE + """ SELECT user_id, count(*) AS positions, CAST(count_if(kind = 'word') AS BIGINT) AS words, round(count_if(kind = 'word' AND time_valid) / greatest(count_if(kind = 'word'), 1), 6) AS valid_ratio,
    array_to_string(list_filter([CASE WHEN count_if(kind = 'word' AND time_valid) / greatest(count_if(kind = 'word'), 1) < 0.6 THEN 'low_valid_alignment' END], lambda x: x IS NOT NULL), ';') AS reasons FROM timeline GROUP BY user_id""")
def a10(spark, d):
    return metrics.sample_summary(timeline(spark, d), U).withColumn("valid_ratio", r6("valid_ratio"))


@query("w1_running_end", "SELECT user_id, word_index, max(end_us) OVER (PARTITION BY user_id ORDER BY word_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM words_v")
def w1(spark, d):
    return intervals.running_end(words(spark, d).select("user_id", "word_index", "end_us"), U, ["word_index"], "end_us", width=intervals.BUCKET_ROWS).select("user_id", "word_index", "reach")


@query("w3_running_count", TIMELINE + " SELECT user_id, pos, count(*) FILTER (WHERE kind = 'word') OVER (PARTITION BY user_id ORDER BY pos) AS words FROM timeline")
def w3(spark, d):
    flagged = timeline(spark, d).select("user_id", "pos", (F.col("kind") == "word").cast("long").alias("word"))
    return scan.running(flagged, U, ["pos"], intervals.BUCKET_ROWS, {"words": ("sum", "word", "upto")}).select("user_id", "pos", "words")


@query("w5_provenance_order", "w AS (SELECT user_id, word_index, start_us AS lo, lag(start_us) OVER (PARTITION BY user_id ORDER BY word_index) AS lo_before, end_us, lag(end_us) OVER (PARTITION BY user_id ORDER BY word_index) AS hi_before FROM words_v) SELECT user_id, word_index FROM w WHERE lo < lo_before OR end_us < hi_before OR (lo + end_us) / 2 < (lo_before + hi_before) / 2 - 0.000001")
def w5(spark, d):
    w = words(spark, d).select("user_id", "word_index", F.col("start_us").alias("lo"), F.col("end_us").alias("hi"), ((F.col("start_us") + F.col("end_us")) / 2).alias("centre"))
    return audit.provenance_order_violations(w, U).select("user_id", "word_index")


@query("p6_monotone_check", "p AS (SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) SELECT user_id, event_id FROM p WHERE value <= b")
def p6(spark, d):
    return audit.monotone_violations(view(spark, d, "SELECT user_id, event_id, value FROM events"), U, "value", "event_id").select("user_id", "event_id")


@query("p6_audio_continuity", "p AS (SELECT user_id, src_idx, a - lag(b) OVER (PARTITION BY user_id ORDER BY src_idx) AS gap_us FROM audio_v) SELECT user_id, src_idx, gap_us FROM p WHERE abs(gap_us) > 7200000000")
def p6b(spark, d):
    return audit.continuity_violations(view(spark, d, "audio_v"), U, 7_200_000_000).select("user_id", "src_idx", "gap_us")


@query("p7_rebase_time", "SELECT user_id, event_id, t_us - least(min(t_us) OVER (PARTITION BY user_id), 1704067200000000 + user_id) AS t FROM ev")
def p7(spark, d):
    df = view(spark, d, "ev").select("user_id", "event_id", F.col("t_us").alias("t")).withColumn("other", F.lit(1704067200000000) + F.col("user_id"))
    return audit.rebase_time(df, U, "t", "other").select("user_id", "event_id", "t")


@query("p2_valid_observation", "SELECT user_id, src_idx, b > a AND q > 0 AS valid FROM audio_v")
def p2(spark, d):
    o = view(spark, d, "audio_v").withColumn("features", F.array("x"))
    return o.select("user_id", "src_idx", pooling.valid_observation("features", "a", "b", "q").alias("valid"))


@query("p3_digital_silence", "SELECT user_id, max(abs(value)) <= 20 AS silent FROM events GROUP BY user_id")
def p3(spark, d):
    level = pooling.signal_level(view(spark, d, "SELECT user_id, value FROM events"), U, "value")
    return level.select("user_id", pooling.digital_silence(F.col("peak"), 20).alias("silent"))


@query("a18_signal_level", "SELECT user_id, round(max(abs(value)), 6) AS peak, round(sqrt(avg(value * value)), 6) AS rms FROM events GROUP BY user_id")
def a18(spark, d):
    level = pooling.signal_level(view(spark, d, "SELECT user_id, value FROM events"), U, "value")
    return level.select("user_id", r6("peak").alias("peak"), r6("rms").alias("rms"))


@query("p8_range_guard", "SELECT user_id, src_idx FROM audio_v WHERE abs(x * 1000) > 65504")
def p8(spark, d):
    o = view(spark, d, "audio_v").withColumn("features", F.array(F.col("x") * 1000))
    return pooling.range_violations(o, "features").select("user_id", "src_idx")


@query("p9_mask_write", "SELECT user_id, src_idx, CASE WHEN q > 0.5 THEN x ELSE 0.0 END AS x FROM audio_v")
def p9(spark, d):
    o = view(spark, d, "audio_v").withColumn("features", F.array("x")).withColumn("mask", F.col("q") > 0.5)
    return o.select("user_id", "src_idx", F.get(pooling.mask_write("features", "mask", F.lit(1)), F.lit(0)).alias("x"))


@query("p11_acoustic_valid", "SELECT user_id, src_idx, q <> 0 AS valid FROM audio_v")
def p11(spark, d):
    o = view(spark, d, "audio_v").withColumn("features", F.array("x"))
    return o.select("user_id", "src_idx", pooling.acoustic_valid("features", F.col("q") == 0).alias("valid"))


@query("p13_detection_threshold", "SELECT user_id, src_idx FROM audio_v WHERE q >= 0.8")
def p13(spark, d):
    return pooling.detection_threshold(view(spark, d, "audio_v"), "q", 0.8).select("user_id", "src_idx")


@query("j3_gather_by_word", TIMELINE + " SELECT t.user_id, t.pos, t.word_index >= 0 AS mask, CASE WHEN t.word_index >= 0 THEN CAST(w.end_us - w.start_us AS DOUBLE) ELSE 0.0 END AS x FROM timeline t LEFT JOIN words_v w ON t.user_id = w.user_id AND t.word_index = w.word_index")
def j3(spark, d):
    w = words(spark, d).select("user_id", "word_index", F.array((F.col("end_us") - F.col("start_us")).cast("double")).alias("features"))
    out = joins.gather_by_word(timeline(spark, d), w, U, "features", 1)
    return out.select("user_id", "pos", "mask", F.get("features", F.lit(0)).alias("x"))


RULES = "rules AS (SELECT user_id, 'h' || (user_id % 5) AS video_sha256, [1, 3, 5] AS frames FROM dur WHERE user_id % 3 = 0)"


def rules(spark, d):
    return view(spark, d, "dur").where("user_id % 3 = 0").select("user_id", F.concat(F.lit("h"), (F.col("user_id") % 5).cast("string")).alias("video_sha256"), F.array(*map(F.lit, (1, 3, 5))).alias("frames"))


@query("j4_apply_exclusions", RULES + " SELECT user_id, src_idx, CASE WHEN ex THEN 0.0 ELSE q END AS q, q AS raw_quality, ex AS excluded FROM (SELECT *, user_id % 3 = 0 AND src_idx IN (1, 3, 5) AS ex FROM vision_v)")
def j4(spark, d):
    q = view(spark, d, "vision_v").withColumn("q", F.col("q").cast("double"))
    return joins.apply_exclusions(q, rules(spark, d), "user_id", "src_idx", "q").select("user_id", "src_idx", "q", F.col("raw_quality"), "excluded")


@query("j4_exclusion_violations", "SELECT user_id, 'other_video' AS check_id FROM dur WHERE user_id % 3 = 0 AND user_id % 5 <> 2")
def j4v(spark, d):
    hashes = view(spark, d, "dur").select("user_id", F.lit("h2").alias("sha256"))
    return joins.exclusion_violations(rules(spark, d), hashes, "user_id")


@query("j12_nearest_frame", """c AS (SELECT w.user_id, w.word_index, w.start_us, p.t, p.x, row_number() OVER (PARTITION BY w.user_id, w.word_index ORDER BY abs(p.t - w.start_us), p.t) AS r FROM words_v w LEFT JOIN points_v p ON w.user_id = p.user_id)
    SELECT user_id, word_index, t AS near_t, round(x, 6) AS near_value FROM c WHERE r = 1""")
def j12(spark, d):
    q = words(spark, d).select("user_id", "word_index", F.col("start_us").alias("when"))
    out = joins.nearest(q, view(spark, d, "points_v").select("user_id", "t", F.col("x").alias("value")), U)
    return out.select("user_id", "word_index", "near_t", r6("near_value").alias("near_value"))


def faulty_export(own, obs):
    """What ``interval_pool`` gives as an export of four tables, with a fault of each kind at some places."""
    rebuilt = written(pooling.interval_pool(own, obs, U, ["pos"]).select("user_id", "pos", "mean", "std", "mask", "coverage", "provenance"), "export")
    k, pos = F.col("pos") % 12, F.col("pos")
    windows = obs.select("user_id", "src_idx", "a", (F.col("b") + F.when(F.col("src_idx") % 11 == 3, 1).otherwise(0)).alias("b"))
    true = rebuilt.select("user_id", "pos", F.posexplode("provenance").alias("i", "p")).where((k != 2) | (F.col("i") > 0))
    weight = F.when(k == 6, -F.col("p.weight")).when(k == 8, F.col("p.weight") + 0.01).otherwise(F.col("p.weight"))
    made_up = rebuilt.where((k == 4) | (k == 10) & ~F.col("mask")).select("user_id", "pos", F.when(k == 4, 1_000_000).otherwise(0).alias("src"), F.lit(1.0).alias("weight"))
    entries = written(true.select("user_id", "pos", "p.src", weight.alias("weight")).unionByName(made_up), "entries")
    lists = rebuilt.select("user_id", "pos").join(entries.groupBy("user_id", "pos").agg(F.collect_list("src").alias("list")), ["user_id", "pos"], "left")
    offsets = pooling.csr_offsets(lists, U, "pos", "list").withColumn("end_offset", F.col("end_offset") + F.when(pos % 13 == 5, 1).otherwise(0))
    more = lambda c, at, by: F.when(at, F.transform(c, lambda x: x + by)).otherwise(F.col(c)).alias(c)
    stats = rebuilt.select(
        "user_id", "pos", more("mean", pos % 7 == 0, 1), more("std", pos % 11 == 1, 0.5), F.when(pos % 29 == 8, ~F.col("mask")).otherwise(F.col("mask")).alias("mask"),
        F.when(pos % 31 == 9, F.col("coverage") + 0.5).otherwise(F.col("coverage")).alias("coverage"),
    )
    return written(windows, "windows"), written(offsets, "offsets"), entries, written(stats, "stats")


@query("q1_check_mapping", POOLED + """, hs AS (SELECT DISTINCT user_id, pos FROM pairs), au AS (SELECT DISTINCT user_id FROM audio_v), al AS (
    SELECT user_id, src_idx AS place, 'window_changed' AS check_id FROM audio_v WHERE src_idx % 11 = 3
    UNION ALL SELECT user_id, pos, 'offsets' FROM timeline WHERE pos % 13 = 5
    UNION ALL SELECT user_id, pos, 'lost_source' FROM hs WHERE pos % 12 = 2
    UNION ALL SELECT user_id, pos, 'index_range' FROM timeline WHERE pos % 12 = 4
    UNION ALL SELECT user_id, pos, 'bad_weight' FROM pairs WHERE pos % 12 = 6
    UNION ALL SELECT user_id, pos, 'different_weight' FROM pairs WHERE pos % 12 IN (6, 8)
    UNION ALL SELECT t.user_id, t.pos, CASE WHEN au.user_id IS NULL THEN 'index_range' ELSE 'foreign_source' END FROM timeline t LEFT JOIN au ON au.user_id = t.user_id
      WHERE t.pos % 12 = 10 AND NOT EXISTS (SELECT 1 FROM hs s WHERE s.user_id = t.user_id AND s.pos = t.pos)
    UNION ALL SELECT user_id, pos, 'different_mean' FROM mu WHERE pos % 7 = 0
    UNION ALL SELECT user_id, pos, 'different_std' FROM sd WHERE pos % 11 = 1
    UNION ALL SELECT user_id, pos, 'different_mask' FROM timeline WHERE pos % 29 = 8
    UNION ALL SELECT user_id, pos, 'different_coverage' FROM timeline WHERE pos % 31 = 9) SELECT user_id, CAST(place AS BIGINT) AS place, check_id FROM al""")
def q1(spark, d):
    obs = written(view(spark, d, "audio_v").withColumn("features", F.array("x")), "obs")
    own = written(targets(spark, d).select("user_id", "pos", "s", "e"), "targets")
    return mapping.check_mapping(*faulty_export(own, obs), own, obs, U)


@query("q2_check_sample", "SELECT user_id, word_index, CASE WHEN f_pos THEN 'no_length' END AS check_id FROM words_v WHERE f_pos UNION ALL SELECT user_id, word_index, 'late' FROM words_v WHERE end_us > duration UNION ALL SELECT user_id, word_index, 'silent' FROM words_v WHERE silent")
def q2(spark, d):
    checks = {"no_length": F.col("end_us") <= F.col("start_us"), "late": F.col("end_us") > F.col("duration"), "silent": F.col("silent")}
    return audit.violations(words(spark, d), ["user_id", "word_index"], checks, F.col("end_us")).drop("detail")


@query("q2_position_checks", """nw AS (SELECT user_id, count(*) AS n FROM words_v GROUP BY user_id), ps AS (SELECT w.*, nw.n FROM words_v w JOIN nw ON nw.user_id = w.user_id)
    SELECT user_id, word_index, 'width' AS check_id FROM ps WHERE word_index % 9 = 4 UNION ALL SELECT user_id, word_index, 'not_finite' FROM ps WHERE word_index % 13 = 5
    UNION ALL SELECT user_id, word_index, 'nonzero_where_masked' FROM ps WHERE NOT time_valid AND word_index % 11 <> 7 AND (end_us <> start_us OR word_index % 13 = 5 OR word_index % 9 = 4)
    UNION ALL SELECT user_id, word_index, 'nonzero_where_masked' FROM ps WHERE word_index % 11 = 7 AND (end_us <> start_us OR word_index % 13 = 5 OR word_index % 9 = 4)
    UNION ALL SELECT user_id, word_index, 'mask_missing' FROM ps WHERE word_index % 11 = 7 UNION ALL SELECT user_id, word_index, 'out_of_time' FROM ps WHERE start_us < -1 OR end_us > duration + 1
    UNION ALL SELECT user_id, word_index, 'no_length' FROM ps WHERE end_us <= start_us UNION ALL SELECT user_id, word_index, 'word_index' FROM ps WHERE word_index % 17 = 3""")
def q2p(spark, d):
    w = words(spark, d)
    n = w.groupBy("user_id").agg(F.count("*").alias("n"))
    i = F.col("word_index") % 13 == 5
    length = F.when(i, float("inf")).otherwise((F.col("end_us") - F.col("start_us")).cast("double"))
    features = F.when(F.col("word_index") % 9 == 4, F.array(length, F.lit(1.0))).otherwise(F.array(length))
    rows = w.join(n, "user_id").withColumns({"features": features, "mask": F.when(F.col("word_index") % 11 != 7, F.col("time_valid")), "index": F.when(F.col("word_index") % 17 == 3, -2).otherwise(F.col("word_index"))})
    checks = audit.position_checks("features", "mask", 1, "start_us", "end_us", "duration", "index", "n")
    return audit.violations(rows, ["user_id", "word_index"], checks, F.lit(None)).drop("detail")


@query("q3_unrepresented_gap", TIMELINE.replace(f">= {GAP_US}", ">= 1") + f" SELECT user_id, CAST(max(end_us - start_us) AS BIGINT) AS longest_us FROM timeline WHERE kind = 'unassigned' GROUP BY user_id HAVING max(end_us - start_us) > {GAP_US}")
def q3(spark, d):
    return intervals.longest_unmapped(words(spark, d), view(spark, d, "dur"), U).where(F.col("longest_us") > GAP_US)


@query("q7_validate_all", """v AS (SELECT user_id, count(*) AS n FROM words_v WHERE NOT time_valid AND f_pos GROUP BY user_id) SELECT d.user_id, coalesce(n, 0) AS violations, CASE WHEN d.user_id % 10 = 0 THEN 'pending' WHEN coalesce(n, 0) > 0 THEN 'invalid' ELSE 'ok' END AS status FROM dur d LEFT JOIN v ON d.user_id = v.user_id""")
def q7(spark, d):
    found = audit.violations(words(spark, d), ["user_id"], {"no_length": F.col("end_us") <= F.col("start_us")}, F.lit(""))
    return audit.sample_status(view(spark, d, "dur").withColumn("done", F.col("user_id") % 10 != 0), found, U).select("user_id", "violations", "status")


STATUSES = """v AS (SELECT user_id, count(*) AS n FROM words_v WHERE f_pos GROUP BY user_id), sl AS (SELECT user_id, bool_or(silent) AS silent FROM words_v GROUP BY user_id),
    ho AS (SELECT user_id, max(end_us - start_us) AS hole FROM timeline WHERE kind = 'unassigned' GROUP BY user_id),
    st AS (SELECT d.user_id, d.duration, coalesce(ho.hole, 0) AS hole, coalesce(sl.silent, false) AS silent, CASE WHEN d.user_id % 10 = 0 THEN 'pending' WHEN coalesce(v.n, 0) > 0 THEN 'invalid' ELSE 'ok' END AS status
      FROM dur d LEFT JOIN v ON v.user_id = d.user_id LEFT JOIN sl ON sl.user_id = d.user_id LEFT JOIN ho ON ho.user_id = d.user_id)"""


def statuses(spark, d):
    w = words(spark, d)
    found = audit.violations(w, ["user_id"], {"no_length": F.col("end_us") <= F.col("start_us")}, F.lit(""))
    out = audit.sample_status(view(spark, d, "dur").withColumn("done", F.col("user_id") % 10 != 0), found, U)
    holes = intervals.longest_unmapped(w, view(spark, d, "dur"), U)
    silent = w.groupBy("user_id").agg(F.bool_or("silent").alias("silent"))
    return out.join(holes, "user_id").join(silent, "user_id", "left")


@query("q7_validation_totals", TIMELINE.replace(f">= {GAP_US}", ">= 1") + ", " + STATUSES + " SELECT count(*) AS expected, count(*) FILTER (status = 'ok') AS complete, CAST(coalesce(sum(duration) FILTER (status = 'ok'), 0) AS BIGINT) AS seconds, CAST(coalesce(max(hole) FILTER (status = 'ok'), 0) AS BIGINT) AS longest FROM st")
def q7t(spark, d):
    return audit.validation_totals(statuses(spark, d), "duration", "longest_us")


@query("q7_validation_lists", TIMELINE.replace(f">= {GAP_US}", ">= 1") + ", " + STATUSES + " SELECT 'incomplete' AS list, user_id FROM st WHERE status <> 'ok' UNION ALL SELECT 'silent_audio', user_id FROM st WHERE silent UNION ALL SELECT 'long_hole', user_id FROM st WHERE hole > 20000000000")
def q7l(spark, d):
    return audit.validation_lists(statuses(spark, d), "user_id", {"silent_audio": F.col("silent"), "long_hole": F.col("longest_us") > 20_000_000_000})


@query("u2_index_identity", "SELECT user_id FROM (SELECT user_id, count(*) n, count(DISTINCT event_id % 40) c, min(event_id % 40) lo, max(event_id % 40) hi FROM events GROUP BY user_id) WHERE lo <> 0 OR hi <> n - 1 OR n <> c")
def u2(spark, d):
    return audit.index_identity(view(spark, d, "SELECT user_id, event_id % 40 AS i FROM events"), U, "i").select("user_id")


@query("u3_union_of_supports", merged("ei", f"{AUDIO} UNION ALL {VISION}") + " SELECT user_id, CAST(sum(b - a) AS BIGINT) AS length FROM ei GROUP BY user_id")
def u3(spark, d):
    either = view(spark, d, "audio_v").select("user_id", "a", "b").unionByName(view(spark, d, "vision_v").select("user_id", "a", "b"))
    return intervals.union_length(either, U)


@query("o1_timeline_sort", TIMELINE + " SELECT user_id, pos, start_us, end_us, word_index FROM timeline")
def o1(spark, d):
    return timeline(spark, d).select("user_id", "pos", "start_us", "end_us", "word_index")


@query("m1_box_iou", """bx AS (SELECT user_id, src_idx, CAST(q AS DOUBLE) AS q, CAST(lag(q) OVER (PARTITION BY user_id ORDER BY src_idx) AS DOUBLE) AS p FROM vision_v),
    ar AS (SELECT user_id, src_idx, 3 * (2 + q) AS a1, 3 * (2 + p) AS a2, greatest(0, least(q * 10, p * 10) + 3 - greatest(q * 10, p * 10)) * greatest(0, least(q * 7 + 2 + q, p * 7 + 2 + p) - greatest(q * 7, p * 7)) AS i FROM bx WHERE p IS NOT NULL)
    SELECT user_id, src_idx, round(i / greatest(a1 + a2 - i, 0.000000000001), 6) AS iou FROM ar""")
def m1(spark, d):
    v = view(spark, d, "SELECT user_id, src_idx, CAST(q AS DOUBLE) AS q, CAST(lag(q) OVER (PARTITION BY user_id ORDER BY src_idx) AS DOUBLE) AS p FROM vision_v").where("p is not null")
    box = lambda c: {"l": F.col(c) * 10, "t": F.col(c) * 7, "r": F.col(c) * 10 + 3, "b": F.col(c) * 7 + 2 + F.col(c)}
    return v.select("user_id", "src_idx", r6(fusion.box_iou(box("q"), box("p"))).alias("iou"))


@query("m2_largest_box", "SELECT user_id, src_idx FROM (SELECT user_id, src_idx, row_number() OVER (PARTITION BY user_id ORDER BY x DESC, src_idx) AS r FROM vision_v) WHERE r = 1")
def m2(spark, d):
    return pooling.largest_box(view(spark, d, "vision_v"), U, F.col("x"), "src_idx")


@query("m3_relative_landmarks", "SELECT user_id, src_idx, round((x - CAST(q AS DOUBLE)) / greatest(CAST(q AS DOUBLE) * 3, 1.0), 6) AS rel FROM vision_v")
def m3(spark, d):
    q = F.col("q").cast("double")
    return view(spark, d, "vision_v").select("user_id", "src_idx", r6(fusion.relative_landmarks(F.col("x"), q, q * 3)).alias("rel"))


#: Two or three boxes a frame, some without area, some frames without any; the best overlap, or else the largest.
BOXES = """bx AS (SELECT user_id, src_idx, t AS pts, CAST(n AS INT) AS det_idx, CAST(q AS DOUBLE) * 10 + n * 1.5 AS l, CAST(q AS DOUBLE) * 7 + n AS t,
      CAST(q AS DOUBLE) * 10 + n * 1.5 + CASE WHEN (src_idx + n) % 9 = 0 THEN 0 ELSE 2 + x % 3 END AS r, CAST(q AS DOUBLE) * 7 + n + 3 + x % 2 AS b
    FROM vision_v CROSS JOIN (SELECT UNNEST_ AS n) AS nums WHERE src_idx % 8 <> 5 AND n <= 1 + src_idx % 2)"""


def boxes(spark, d):
    text = BOXES.replace("UNNEST_", "explode(array(0, 1, 2))").removeprefix("bx AS (").removesuffix(")")
    found = view(spark, d, text)
    none = view(spark, d, "SELECT user_id, t AS pts FROM vision_v WHERE src_idx % 8 = 5")
    return found.drop("src_idx").unionByName(none, allowMissingColumns=True)


@query("w4_track_subject", BOXES.replace("UNNEST_", "unnest([0, 1, 2])") + """,
    fr AS (SELECT user_id, src_idx, t AS pts, row_number() OVER (PARTITION BY user_id ORDER BY t) AS f FROM vision_v),
    bf AS (SELECT f.user_id, f.f, f.pts, b.det_idx, b.l, b.t, b.r, b.b, greatest(b.r - b.l, 0) * greatest(b.b - b.t, 0) AS area FROM fr f JOIN bx b ON f.user_id = b.user_id AND f.src_idx = b.src_idx),
    big AS (SELECT user_id, f, det_idx FROM bf QUALIFY row_number() OVER (PARTITION BY user_id, f ORDER BY area DESC, det_idx) = 1),
    tr AS (SELECT user_id, CAST(0 AS BIGINT) AS f, CAST(NULL AS BIGINT) AS pts, CAST(NULL AS INT) AS det_idx, false AS reset, CAST(NULL AS DOUBLE) AS quality, CAST(NULL AS DOUBLE) AS l, CAST(NULL AS DOUBLE) AS t, CAST(NULL AS DOUBLE) AS r, CAST(NULL AS DOUBLE) AS b FROM (SELECT DISTINCT user_id FROM fr)
      UNION ALL SELECT user_id, f, pts, det_idx, reset, quality, l, t, r, b FROM (
        SELECT s.user_id, n.f, CASE WHEN c.det_idx IS NULL THEN NULL ELSE n.pts END AS pts, c.det_idx, c.det_idx IS NOT NULL AND s.l IS NOT NULL AND c.iou < 0.2 AS reset,
          CASE WHEN c.r > c.l AND c.b > c.t THEN 1.0 WHEN c.det_idx IS NOT NULL THEN 0.0 END AS quality,
          CASE WHEN c.det_idx IS NULL THEN NULL WHEN c.r > c.l AND c.b > c.t THEN c.l ELSE s.l END AS l, CASE WHEN c.det_idx IS NULL THEN NULL WHEN c.r > c.l AND c.b > c.t THEN c.t ELSE s.t END AS t,
          CASE WHEN c.det_idx IS NULL THEN NULL WHEN c.r > c.l AND c.b > c.t THEN c.r ELSE s.r END AS r, CASE WHEN c.det_idx IS NULL THEN NULL WHEN c.r > c.l AND c.b > c.t THEN c.b ELSE s.b END AS b,
          row_number() OVER (PARTITION BY s.user_id ORDER BY CASE WHEN c.iou >= 0.2 THEN c.iou ELSE -1 END DESC, CASE WHEN c.iou >= 0.2 THEN 0 ELSE -c.area END, c.det_idx) AS k
        FROM tr s JOIN fr n ON n.user_id = s.user_id AND n.f = s.f + 1
        LEFT JOIN LATERAL (SELECT x.*, coalesce(greatest(least(x.r, s.r) - greatest(x.l, s.l), 0) * greatest(least(x.b, s.b) - greatest(x.t, s.t), 0)
            / greatest(x.area + (s.r - s.l) * (s.b - s.t) - greatest(least(x.r, s.r) - greatest(x.l, s.l), 0) * greatest(least(x.b, s.b) - greatest(x.t, s.t), 0), 1e-12), -1) AS iou FROM bf x WHERE x.user_id = n.user_id AND x.f = n.f) c ON true) WHERE k = 1)
    SELECT user_id, pts, det_idx, reset, quality FROM tr WHERE det_idx IS NOT NULL""")
def w4(spark, d):
    from ..operators.probe import track_subject

    return track_subject(boxes(spark, d), U)
