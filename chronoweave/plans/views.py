"""The driver tables seen as words, observations, sequences, predictions and transcripts; one text for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

GAP_US = 1_800_000_000

_SPARK = {
    "T_US": "unix_micros(CAST(ts AS TIMESTAMP))", "K": "get_json_object(props, '$.k')", "MID": "CAST(floor(({x} + {y}) / 2) AS BIGINT)",
    "TOKENS": "split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ')), ' ')", "E": "e.embedding[{i}]", "POS": "explode(sequence(0, 15))", "MOD": "({a}) % {b}",
}
_DUCK = {
    "T_US": "epoch_us(ts)", "K": "json_extract_string(props, '$.k')", "MID": "(({x} + {y}) // 2)",
    "TOKENS": "string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ')", "E": "e.embedding[{i} + 1]", "POS": "unnest(range(0, 16))", "MOD": "({a}) % {b}",
}


def _prelude(d: dict[str, str]) -> str:
    mid_a, mid_b = d["MID"].format(x="lag(t) OVER w", y="t"), d["MID"].format(x="t", y="lead(t) OVER w")
    e = [d["E"].format(i=i) for i in ("4 * p", "4 * p + 1", "4 * p + 2", "4 * p + 3")]
    return f"""
ev AS (SELECT event_id, user_id, event_type, value, {d["T_US"]} AS t_us, CAST({d["K"]} AS INT) AS k FROM events),
evs AS (SELECT *, t_us - min(t_us) OVER (PARTITION BY user_id) AS s FROM ev),
dur AS (SELECT user_id, max(s) + 60000000 AS duration FROM evs GROUP BY user_id),
raw_words AS (
  SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) - 1 AS INT) AS word_index, s AS start_us,
         s + CAST(round(value * 100) AS BIGINT) * 600000 AS end_us, event_type, k
  FROM evs WHERE event_type IN ('click', 'view')),
reach_words AS (
  SELECT w.*, d.duration, k < 5 AS silent,
         greatest(0, coalesce(max(end_us) OVER (PARTITION BY w.user_id ORDER BY word_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS reach
  FROM raw_words w JOIN dur d ON w.user_id = d.user_id),
words_v AS (
  SELECT user_id, word_index, start_us, end_us, duration, silent, event_type,
         end_us <= start_us AS f_pos, start_us < reach - 1 AS f_over, start_us < 0 OR end_us > duration + 1000 AS f_bounds, silent AS f_silent,
         NOT (end_us <= start_us OR start_us < reach - 1 OR start_us < 0 OR end_us > duration + 1000 OR silent) AS time_valid
  FROM reach_words),
audio_v AS (
  SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) - 1 AS INT) AS src_idx, s AS a,
         s + CAST(round(value * 100) AS BIGINT) * 600000 AS b, value AS x, k / 100.0 AS q
  FROM evs WHERE event_type IN ('error', 'signup')),
points_v AS (SELECT user_id, s AS t, min(value) AS x, min(k) / 100.0 AS q FROM evs WHERE event_type = 'purchase' GROUP BY user_id, s),
vision_v AS (
  SELECT p.user_id, CAST(row_number() OVER w - 1 AS INT) AS src_idx, t, coalesce({mid_a}, 0) AS a, coalesce({mid_b}, d.duration) AS b, x, q
  FROM points_v p JOIN dur d ON p.user_id = d.user_id WINDOW w AS (PARTITION BY p.user_id ORDER BY t)),
seq_base AS (SELECT vec_id, label, embedding, {d["POS"]} AS p FROM embeddings),
seq_v AS (
  SELECT vec_id, label % 3 AS class_id, label % 3 - 1 + 0.1 * (label / 3.0) AS reg, CAST(p AS INT) AS pos,
         (vec_id * 7 + p * 3) % 11 <> 0 AS mt, (vec_id + p) % 5 <> 0 AS ma, (vec_id * 3 + p) % 7 <> 0 AS mv,
         CAST({e[0]} + {e[1]} AS DOUBLE) AS t, CAST({e[2]} AS DOUBLE) AS a, CAST({e[3]} AS DOUBLE) AS v
  FROM seq_base e),
turns AS (SELECT conv_id, turn, role, text, {d["TOKENS"]} AS words FROM conversations WHERE text IS NOT NULL),
transcripts_v AS (
  SELECT u.conv_id, u.turn, u.words AS ref, h.words AS hyp
  FROM turns u JOIN turns h ON u.conv_id = h.conv_id AND h.turn = u.turn + 1 WHERE u.role = 'user' AND h.role = 'assistant'),
groups_v AS (SELECT d.doc_id, d.source AS grp, l.quality + l.toxic AS label, d.n_chars, d.lang FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
"""


SPARK_PRELUDE, DUCK_PRELUDE = _prelude(_SPARK), _prelude(_DUCK)
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """``sql`` over the driver tables and the views above."""
    text = "WITH " + SPARK_PRELUDE + sql if sql.lstrip().upper().startswith("SELECT") else "WITH " + SPARK_PRELUDE + f"SELECT * FROM {sql}"
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    for t in TABLES:
        if t in text:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(text)


def duck(sql: str) -> str:
    """The same in DuckDB's SQL; ``sql`` may begin with further CTEs."""
    return "WITH RECURSIVE " + DUCK_PRELUDE + ("" if sql.lstrip().upper().startswith("SELECT") else ", ") + sql
