"""Queries on transcripts, texts, manifests, files and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sources
from ..functions import fusion, text
from ..operators import audit, joins, lineage, metrics, pooling, scan
from .interval_queries import r6
from .registry import query
from .views import view

C = ["conv_id", "turn"]
#: The table of word distances of each pair, one anti-diagonal a step: its cells depend on the two before it alone.
CODED = """tw AS (SELECT conv_id, turn, ref, hyp, len(ref) AS n, len(hyp) AS m FROM transcripts_v),
    dg AS (SELECT conv_id, turn, ref, hyp, n, m, 0 AS k, [0] || list_transform(range(n), lambda i: 1000000) AS p1, list_transform(range(n + 1), lambda i: 1000000) AS p2 FROM tw
      UNION ALL SELECT conv_id, turn, ref, hyp, n, m, k + 1, list_transform(range(n + 1), lambda i: CASE WHEN k + 1 - i < 0 OR k + 1 - i > m THEN 1000000 ELSE
        least(coalesce(p1[i + 1], 1000000) + 1, CASE WHEN i > 0 THEN p1[i] + 1 ELSE 1000000 END, CASE WHEN i > 0 AND k + 1 - i > 0 THEN p2[i] + CASE WHEN ref[i] = hyp[k + 1 - i] THEN 0 ELSE 1 END ELSE 1000000 END) END), p1
      FROM dg WHERE k < n + m),
    ds AS (SELECT conv_id, turn, n, m, CAST(p1[n + 1] AS BIGINT) AS distance FROM dg WHERE k = n + m)"""
SILENT, LIMIT, LANG = "conv_id % 11 = 0", "conv_id % 13 = 0", "CASE WHEN conv_id % 7 = 0 THEN 'fr' WHEN conv_id % 17 = 0 THEN NULL ELSE 'en' END"


def transcripts(spark, d):
    return view(spark, d, "transcripts_v")


def compared(spark, d):
    return text.compare(transcripts(spark, d), F.expr(LANG), F.expr(SILENT), F.expr(LIMIT))


STATUS = CODED + f""", st AS (SELECT d.*, {SILENT} AS silent, CASE WHEN {SILENT} THEN 'digital_silence' WHEN array_to_string(t.hyp, ' ') = '' THEN 'insufficient_speech' WHEN {LIMIT.replace('conv_id', 'd.conv_id')} OR ({LANG.replace('conv_id', 'd.conv_id')}) IS NULL THEN 'asr_uncertain'
    WHEN ({LANG.replace('conv_id', 'd.conv_id')}) <> 'en' THEN 'language_difference' WHEN n = 0 THEN 'asr_uncertain' WHEN distance / n <= 0.15 THEN 'mostly_agree' WHEN distance / n <= 0.4 THEN 'moderate_difference' ELSE 'large_difference' END AS status
    FROM ds d JOIN transcripts_v t ON d.conv_id = t.conv_id AND d.turn = t.turn)""".replace("SELECT d.*, conv_id", "SELECT d.*, d.conv_id").replace("CASE WHEN conv_id % 11", "CASE WHEN d.conv_id % 11")


@query("j6_reference_hypothesis", "SELECT conv_id, turn, len(ref) AS n, len(hyp) AS m FROM transcripts_v")
def j6(spark, d):
    pairs = joins.reference_hypothesis(view(spark, d, "turns"), ["conv_id"])
    return pairs.select("conv_id", "turn", F.size("ref").cast("long").alias("n"), F.size("hyp").cast("long").alias("m"))


@query("t6_edit_counts", CODED + " SELECT conv_id, turn, n, m, distance, round(CASE WHEN n > 0 THEN distance / n END, 6) AS wer, round(distance / greatest(n, m, 1), 6) AS normalized, true AS adds_up FROM ds")
def t6(spark, d):
    c = compared(spark, d)
    adds = (F.col("e.s") + F.col("e.d") + F.col("e.i") == F.col("distance")) & (F.col("e.m") + F.col("e.s") + F.col("e.d") == F.col("n")) & (F.col("e.m") + F.col("e.s") + F.col("e.i") == F.col("m"))
    return c.select(*C, F.col("n").cast("long").alias("n"), F.col("m").cast("long").alias("m"), F.col("distance").cast("long").alias("distance"), r6("wer").alias("wer"), r6(text.normalized_distance(F.col("distance"), F.col("n"), F.col("m"))).alias("normalized"), adds.alias("adds_up"))


@query("t7_classify", STATUS + " SELECT conv_id, turn, status FROM st")
def t7(spark, d):
    return compared(spark, d).select(*C, "status")


@query("a11_status_counts", STATUS + " SELECT status, count(*) AS n, CAST(count_if(silent) AS BIGINT) AS silent FROM st GROUP BY status")
def a11(spark, d):
    return metrics.status_counts(compared(spark, d), ["silent"])


RANK = text.STATUS_ORDER


@query("o2_audit_sort", STATUS + " SELECT conv_id, turn, status, row_number() OVER (ORDER BY list_position([" + ", ".join(f"'{s}'" for s in RANK) + "], status), CASE WHEN n > 0 THEN -distance / n ELSE 0 END, conv_id, turn) AS rank FROM st")
def o2(spark, d):
    rows = compared(spark, d).select(*C, "status", "wer")
    return scan.ranked(rows, text.audit_order(C)).select(*C, "status", "rank")


@query("t8_language_supported", f"SELECT conv_id, turn, ({LANG}) IN ('en', 'de') AS supported FROM transcripts_v")
def t8(spark, d):
    c = transcripts(spark, d).withColumn("language", F.expr(LANG))
    return c.select(*C, text.language_supported(F.col("language"), ["en", "de"]).alias("supported"))


# Whole documents are too long for SQL's table of distances; a test holds this query against plain distances.
@query("j5_alternative_matches")
def j5(spark, d):
    words = "split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ')), ' ')"
    docs = view(spark, d, f"SELECT doc_id AS key, lang, {words} AS words FROM documents WHERE text IS NOT NULL")
    out = joins.alternative_matches(docs.withColumn("own", F.lit(1.0)), None, ["lang"])
    return out.select("key", "other", r6("distance").alias("distance"), "rank")


@query("t3_normalize_text")
def t3(spark, d):
    return view(spark, d, "SELECT conv_id, turn, text FROM conversations").select(*C, text.normalize_text(F.col("text")).alias("normal"))


SMALL, TENS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen", "twenty thirty forty fifty sixty seventy eighty ninety"
#: A number below 100 in words.
SAID = "CASE WHEN {x} < 20 THEN split('" + SMALL + "', ' ')[CAST({x} AS INT){o}] WHEN {x} % 10 = 0 THEN split('" + TENS + "', ' ')[CAST({x} AS INT) DIV 10 - 2{o}] ELSE concat(split('" + TENS + "', ' ')[CAST({x} AS INT) DIV 10 - 2{o}], ' ', split('" + SMALL + "', ' ')[CAST({x} AS INT) % 10{o}]) END"


def said(x: str) -> str:
    return SAID.format(x=x, o="")


@query("t4_number_words", "SELECT p_partkey, 'size ' || p_size || ' of ' || (p_size * 7) % 100 || ' and 3rd' AS said FROM part")
def t4(spark, d):
    parts = view(spark, d, f"SELECT p_partkey, concat('size ', {said('p_size')}, ' of ', {said('(p_size * 7) % 100')}, ' and third') AS said FROM part")
    return parts.select("p_partkey", F.array_join(text.number_words(F.split("said", " ")), " ").alias("said"))


@query("t5_scale_words", """SELECT o_orderkey, CAST((1 + o_orderkey % 900) * 1000 + o_custkey % 1000 AS VARCHAR) || ' or ' || CAST((1 + o_custkey % 9) * 100 + o_orderkey % 100 AS VARCHAR) || ' and 1 or 9'
    || repeat('0', CAST(o_orderkey % 40 AS INT)) || '000000 a and 100' AS said FROM orders""")
def t5(spark, d):
    said_ = "concat_ws(' ', 1 + o_orderkey % 900, 'thousand and', o_custkey % 1000, 'or', 1 + o_custkey % 9, 'hundred', o_orderkey % 100, 'and 1 or', concat('9', repeat('0', CAST(o_orderkey % 40 AS INT))), 'million a and hundred')"
    orders = view(spark, d, f"SELECT o_orderkey, {said_} AS said FROM orders")
    return orders.select("o_orderkey", F.array_join(text.scale_words(F.split("said", " ")), " ").alias("said"))


@query("t1_lexical_chars", "SELECT doc_id, length(regexp_replace(text, '[^''\\p{L}\\p{N}]', '', 'g')) AS n FROM documents")
def t1(spark, d):
    return view(spark, d, "SELECT doc_id, text FROM documents").select("doc_id", F.length(text.lexical_chars(F.col("text"))).cast("long").alias("n"))


SPANS = """ws AS (SELECT conv_id, turn, text, unnest(string_split(text, ' ')) AS word, unnest(range(len(string_split(text, ' ')))) AS i FROM conversations WHERE text IS NOT NULL),
    cl AS (SELECT conv_id, turn, i, len(regexp_replace(word, '[^''\\p{L}\\p{N}]', '', 'g')) AS n FROM ws)"""


@query("t2_word_spans", SPANS + " SELECT conv_id, turn, CAST(sum(n) AS BIGINT) AS covered, CAST(count_if(n > 0) AS BIGINT) AS words, true AS full_cover FROM cl GROUP BY conv_id, turn")
def t2(spark, d):
    from ..operators.spans import word_spans

    rows = view(spark, d, "SELECT conv_id, turn, text FROM conversations WHERE text IS NOT NULL").withColumn("words", F.split("text", " "))
    out = word_spans(rows, C, "text", "words")
    return out.groupBy(*C).agg(F.sum("n").alias("covered"), F.count_if(F.col("n") > 0).alias("words"), F.bool_and("ok").alias("full_cover"))


TOKENS = "tk AS (SELECT conv_id, turn, unnest(words) AS w, unnest(range(len(words))) AS i FROM turns)"
#: As many words of seven characters as cover a text's tokens of three.
WD = "wd AS (SELECT conv_id, turn, CAST(unnest(range((len(words) * 3 + 6) // 7)) AS INT) AS word_index FROM turns)"


def tokens(spark, d):
    """Tokens at 3 characters each, words at 7."""
    t = view(spark, d, "turns").select(*C, F.posexplode("words").alias("token_idx", "token"))
    return t.withColumn("char_a", F.col("token_idx") * 3).withColumn("char_b", F.col("char_a") + 3).withColumn("attention", (F.col("token_idx") % 5 != 4).cast("int")).withColumn("features", F.array(F.length("token").cast("double")))


def token_words(spark, d):
    n = F.floor((F.size("words") * 3 + 6) / 7).cast("int")
    w = view(spark, d, "turns").select(*C, F.explode(F.sequence(F.lit(0), n - 1)).alias("word_index"))
    return w.withColumn("a", F.col("word_index") * 7).withColumn("b", F.col("a") + 7).withColumn("start_us", F.col("a") * 1000).withColumn("end_us", F.col("b") * 1000).withColumn("time_valid", F.col("word_index") % 3 != 1)


TW = TOKENS + ", " + WD + """, tp AS (SELECT t.conv_id, t.turn, d.word_index, CAST(t.i AS INT) AS token_idx, length(w) AS x FROM tk t JOIN wd d ON t.conv_id = d.conv_id AND t.turn = d.turn AND t.i * 3 < d.word_index * 7 + 7 AND t.i * 3 + 3 > d.word_index * 7 WHERE t.i % 5 <> 4)"""


@query("j2_char_span_join", TW + " SELECT conv_id, turn, word_index, token_idx FROM tp")
def j2(spark, d):
    return pooling.char_span_join(tokens(spark, d), token_words(spark, d), C).select(*C, "word_index", "token_idx")


@query("a2_pool_tokens", TW + " SELECT d.conv_id, d.turn, d.word_index, count(x) > 0 AS valid, round(avg(x), 6) AS pooled FROM wd d LEFT JOIN tp ON tp.conv_id = d.conv_id AND tp.turn = d.turn AND tp.word_index = d.word_index GROUP BY d.conv_id, d.turn, d.word_index")
def a2(spark, d):
    out = pooling.pool_tokens(tokens(spark, d), token_words(spark, d), C)
    return out.select(*C, "word_index", "valid", r6(F.get("pooled", F.lit(0))).alias("pooled"))


@query("j7_position_time_map", TOKENS + ", " + WD + """, fs AS (SELECT t.conv_id, t.turn, CAST(t.i AS INT) AS token_idx, min(CASE WHEN d.word_index % 3 <> 1 THEN d.word_index END) AS word_index
    FROM tk t LEFT JOIN wd d ON t.conv_id = d.conv_id AND t.turn = d.turn AND t.i * 3 < d.word_index * 7 + 7 AND t.i * 3 + 3 > d.word_index * 7 GROUP BY t.conv_id, t.turn, t.i) SELECT conv_id, turn, token_idx, word_index, word_index * 7000 AS start_us FROM fs""")
def j7(spark, d):
    return joins.position_times(tokens(spark, d), token_words(spark, d), C).select(*C, "token_idx", "word_index", "start_us")


@query("q6_token_identity", "SELECT conv_id, turn, list_filter(words, lambda w: w <> '') IS DISTINCT FROM regexp_extract_all(text, '[A-Za-z0-9]+') AS differs FROM turns")
def q6(spark, d):
    """Tokens as given, in lower case, against those cut anew from the text as it is: texts with capitals differ."""
    turns = view(spark, d, "turns")
    given = turns.select(*C, F.filter("words", lambda w: w != "").alias("ids"))
    again = turns.select(*C, F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), F.lit(0)).alias("ids"))
    return audit.token_identity(given, again, C, "ids")


# Manifests, files and sets, over the documents table.


def manifest(spark, d):
    m = view(spark, d, "SELECT source AS video_id, CAST(doc_id % 700 AS STRING) AS clip_id, text, CAST(n_chars AS DOUBLE) AS label FROM documents")
    return sources.with_key(m)


@query("s1_manifest_violations", "mf AS (SELECT source || '__' || CAST(doc_id % 700 AS VARCHAR) AS key FROM documents) SELECT key, 'repeated_key' AS check_id, count(*) AS n FROM mf GROUP BY key HAVING count(*) > 1")
def s1(spark, d):
    return sources.manifest_violations(manifest(spark, d))


@query("p12_legal_id", "SELECT page_id, false AS legal FROM pages WHERE url LIKE '%/%'")
def p12(spark, d):
    return view(spark, d, "SELECT page_id, url FROM pages").where(~sources.legal_id(F.col("url"))).select("page_id", F.lit(False).alias("legal"))


@query("t10_digest", "SELECT doc_id, sha256('{\"doc_id\":' || doc_id || ',\"source\":\"' || source || '\"}') AS digest FROM documents")
def t10(spark, d):
    docs = view(spark, d, "SELECT doc_id, source FROM documents")
    return docs.select("doc_id", audit.record_digest(docs, docs.columns).alias("digest"))


@query("t11_polarity", "SELECT user_id, event_id, CAST(sign(value - 50) AS INT) AS polarity FROM events")
def t11(spark, d):
    return view(spark, d, "SELECT user_id, event_id, value FROM events").select("user_id", "event_id", fusion.polarity(F.col("value") - 50).alias("polarity"))


@query("p1_select_samples", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def p1(spark, d):
    ids = view(spark, d, "SELECT doc_id, quality FROM labels").where("quality = 0")
    return joins.select_samples(view(spark, d, "SELECT doc_id FROM documents"), ids, "doc_id")


@query("o7_limit", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 5")
def o7(spark, d):
    docs = view(spark, d, "SELECT doc_id FROM documents")
    return joins.select_samples(docs, docs, "doc_id", 5)


@query("u1_set_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def u1(spark, d):
    return joins.unknown_ids(view(spark, d, "SELECT doc_id FROM labels"), view(spark, d, "SELECT doc_id FROM documents"), "doc_id")


@query("j10_manifest_vs_files", "SELECT doc_id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT conv_id FROM conversations) UNION SELECT DISTINCT conv_id, 'right' FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM documents)")
def j10(spark, d):
    return joins.both_ways(view(spark, d, "SELECT doc_id FROM documents"), view(spark, d, "SELECT conv_id AS doc_id FROM conversations"), "doc_id")


@query("j11_pending_work", "SELECT doc_id FROM documents WHERE doc_id % 4 = 0 OR NOT (n_chars % 3 = 0)")
def j11(spark, d):
    docs = view(spark, d, "SELECT doc_id, n_chars % 3 AS signature, n_chars AS hash FROM documents")
    done = docs.where("doc_id % 4 <> 0").withColumn("signature", F.lit(0).cast("long"))
    return joins.pending_work(docs, done, ["doc_id", "signature", "hash"]).select("doc_id")


#: Stages and what each is made from.
UPSTREAM = {"media": (), "align": ("media",), "text": ("align",), "audio": ("media",), "vision": ("media",), "aggregate": ("media", "align", "text", "audio", "vision")}


@query("j11_pending_stages", """SELECT doc_id, unnest(['vision', 'aggregate']) AS stage FROM documents UNION ALL SELECT doc_id, unnest(['media', 'align', 'text']) FROM documents WHERE doc_id % 7 = 3
    UNION ALL SELECT doc_id, 'audio' FROM documents WHERE doc_id % 7 = 3 OR doc_id % 11 = 5""")
def j11s(spark, d):
    """All was done once; then one stage's settings change, some media files change and some audio records are lost."""
    docs = view(spark, d, "SELECT doc_id, n_chars FROM documents")
    settings = {s: f"{s} v1" for s in UPSTREAM}
    records = docs.limit(0).select("doc_id", *(F.lit(None).cast("string").alias(c) for c in ("stage", "signature", "output", "actual")))
    for s in lineage.in_order(UPSTREAM):  # stage after stage, as a run records them
        now = lineage.stage_states(docs, records, "doc_id", "n_chars", UPSTREAM, settings).where(F.col("stage") == s)
        made = now.select("doc_id", "stage", "signature", F.concat_ws(":", "stage", "doc_id").alias("output")).withColumn("actual", F.col("output"))
        records = sources.written(records.unionByName(made), "records")
    changed = records.where("not (stage = 'audio' and doc_id % 11 = 5)").withColumn("actual", F.when((F.col("stage") == "media") & (F.col("doc_id") % 7 == 3), "other").otherwise(F.col("actual")))
    states = lineage.stage_states(docs, changed, "doc_id", "n_chars", UPSTREAM, settings | {"vision": "vision v2"})
    return states.where("pending").select("doc_id", "stage")


@query("j14_annotate_with_audit", STATUS + " SELECT g.doc_id, CASE WHEN s.status IS NULL THEN 'not_comparable' WHEN s.wer > 0.9 THEN 'high_suspect' ELSE 'not_flagged' END AS grp FROM groups_v g LEFT JOIN (SELECT conv_id, any_value(status) AS status, max(CASE WHEN n > 0 THEN distance / n END) AS wer FROM st GROUP BY conv_id) s ON g.doc_id = s.conv_id")
def j14(spark, d):
    found = compared(spark, d).select(F.col("conv_id").alias("doc_id"), "status", "wer")
    return joins.annotate_with_audit(view(spark, d, "groups_v").select("doc_id"), found, "doc_id").select("doc_id", "grp")


# Sources and sinks: what is written is read back.


@query("s5_csv_union", "SELECT doc_id, lang, NULL AS quality FROM documents UNION ALL SELECT doc_id, NULL, quality FROM labels")
def s5(spark, d):
    path = sources.scratch_path(spark, "csv")
    sources.write_csv_union([view(spark, d, "SELECT doc_id, lang FROM documents"), view(spark, d, "SELECT doc_id, quality FROM labels")], path)
    return spark.read.schema("doc_id long, lang string, quality long").option("header", True).csv(path)


@query("s6_read_split", "SELECT vec_id, label FROM embeddings WHERE label = 3")
def s6(spark, d):
    path = sources.scratch_path(spark, "split")
    view(spark, d, "SELECT vec_id, label, CAST(label AS STRING) AS split FROM embeddings").write.parquet(path)
    return sources.read_split(spark, path, "3").select("vec_id", "label")


@query("s3_features", "SELECT vec_id, CASE WHEN label % 2 = 0 THEN 'audio' ELSE 'vision' END AS modality, round(embedding[1], 4) AS x, len(embedding) AS d FROM embeddings WHERE label % 2 = 0")
def s3(spark, d):
    path = sources.scratch_path(spark, "features")
    rows = view(spark, d, "SELECT vec_id, CASE WHEN label % 2 = 0 THEN 'audio' ELSE 'vision' END AS modality, embedding FROM embeddings")
    sources.write_features(rows, path)
    back = sources.read_features(spark, path, "audio")
    return back.select("vec_id", "modality", F.round(F.get("embedding", F.lit(0)), 4).alias("x"), F.size("embedding").cast("long").alias("d"))


@query("s4_json", "SELECT user_id, event_id, value, event_type FROM events")
def s4(spark, d):
    path = sources.scratch_path(spark, "json")
    sources.write_json(view(spark, d, "SELECT user_id, event_id, value, event_type FROM events"), path)
    return sources.read_json(spark, path, "user_id long, event_id long, value double, event_type string")


@query("s8_run_log", "SELECT 'media' AS stage, event_type AS sample_id, CASE WHEN max(value) > 99 THEN 'failed' ELSE 'ok' END AS status, count(*) AS seconds FROM events GROUP BY event_type UNION ALL SELECT 'align', event_type, 'ok', min(event_id) FROM events GROUP BY event_type")
def s8(spark, d):
    path = sources.scratch_path(spark, "log")
    ev = view(spark, d, "SELECT event_type AS sample_id, value, event_id FROM events").groupBy("sample_id")
    none = F.lit(None).cast("string").alias("error")
    sources.append_event(ev.agg(F.when(F.max("value") > 99, "failed").otherwise("ok").alias("status"), F.count("*").alias("seconds"), none), path, "media")
    sources.append_event(ev.agg(F.lit("ok").alias("status"), F.min("event_id").alias("seconds"), none), path, "align")
    return spark.read.parquet(path).select("stage", "sample_id", "status", F.col("seconds").cast("long").alias("seconds"))


@query("s11_scoped_reports", "SELECT 'full' AS scope, source, count(*) AS n FROM documents GROUP BY source UNION ALL SELECT 'selected', source, count(*) FROM documents WHERE lang = 'en' GROUP BY source")
def s11(spark, d):
    """The selected scope is written twice, and the full one stays."""
    path = sources.scratch_path(spark, "report")
    docs = view(spark, d, "SELECT source, lang FROM documents")
    count = lambda df: df.groupBy("source").agg(F.count("*").alias("n"))
    sources.write_report(count(docs), path, "full")
    sources.write_report(count(docs), path, "selected")
    sources.write_report(count(docs.where("lang = 'en'")), path, "selected")
    return spark.read.parquet(path).select("scope", "source", "n")


@query("s2_file_digest")
def s2(spark, d):
    return sources.file_digests(spark, f"{d}/documents.parquet").select("length", "sha256")


@query("s7_stack_files", "SELECT CAST(label AS VARCHAR) AS sample_id, count(*) AS n, sum(vec_id) AS total FROM embeddings GROUP BY label")
def s7(spark, d):
    path = sources.scratch_path(spark, "stack")
    view(spark, d, "SELECT label, label AS part, vec_id FROM embeddings").write.partitionBy("label").parquet(path)
    rows = sources.stack_files(spark, path, r"/label=([^/]+)/")
    return rows.groupBy("sample_id").agg(F.count("*").alias("n"), F.sum("vec_id").alias("total"))


@query("q9_source_identity", "SELECT 'other_content' AS check_id, count(*) AS n FROM (SELECT DISTINCT label FROM embeddings WHERE label % 4 = 1) UNION ALL SELECT 'gone', count(*) FROM (SELECT DISTINCT label FROM embeddings WHERE label % 4 = 2) UNION ALL SELECT 'not_listed', count(*) FROM (SELECT DISTINCT label FROM embeddings WHERE label % 4 = 3)")
def q9(spark, d):
    """A manifest of one file for each label is stored; then some files change, some go and some come."""
    rows = view(spark, d, "SELECT label, vec_id FROM embeddings")
    before, after, listed = (sources.scratch_path(spark, x) for x in ("before", "after", "manifest"))
    put = lambda df, path: df.repartition("label").sortWithinPartitions("label", "vec_id").write.partitionBy("label").parquet(path)
    put(rows.where("label % 4 <> 3"), before)
    put(rows.where("label % 4 <> 2").withColumn("vec_id", F.when(F.col("label") % 4 == 1, F.col("vec_id") + 1).otherwise(F.col("vec_id"))), after)
    place = F.regexp_extract("path", r"(label=[^/]+)/", 1)
    named = lambda df: df.withColumn("path", place)
    named(sources.file_digests(spark, before)).write.parquet(listed)
    found = audit.source_identity(named(sources.file_digests(spark, after)), spark.read.parquet(listed))
    return found.groupBy("check_id").agg(F.count("*").alias("n"))


@query("st_windowed_counts", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def st_windows(spark, d):
    from ..streaming import windowed_counts

    out = windowed_counts(spark.read.parquet(f"{d}/events.parquet"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
