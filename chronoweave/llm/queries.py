"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import audit, decontam, embed, jaccard, langid, mixing, packing, pii, quality, search, secrets, sharding, tokens

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_secret_scan": secrets.op2_secret_scan,
    "op3_jaccard_join": jaccard.op3_jaccard_join,
    "op4_embedding_dedup": embed.op4_embedding_dedup,
    "op5_token_files": tokens.op5_token_files,
    "op6_quality": quality.op6_quality,
    "op7_sharding": sharding.op7_sharding,
    "op8_mixing": mixing.op8_mixing,
    "op9_decontamination": decontam.op9_decontamination,
    "op10_language_id": langid.op10_language_id,
    "op11_filter_audit": audit.op11_filter_audit,
    "op12_lexical_search": search.op12_lexical_search,
    "op13_packing": packing.op13_packing,
}

#: All pairs of documents that share a shingle, and what is reachable by links.
_JACCARD = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 85 * (na.n + nb.n - i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, (SELECT min(b) FROM r WHERE r.a = d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
"""

#: Each document's failures, each order's steps, and what every step meets.
_AUDIT = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x FROM documents),
w AS (SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY x) AS least FROM t),
f AS (
  SELECT doc_id, part, (CASE WHEN len(w) < 50 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * (length(x) - length(regexp_replace(x, '[A-Z]', '', 'g'))) > 5 * length(x) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN doc_id > least THEN 'E' ELSE '' END) AS failed FROM w),
d AS (
  SELECT f.part, f.failed, count(*) AS n, count(*) FILTER (l.quality = 1) AS n_good, count(*) FILTER (l.toxic = 1) AS n_toxic
  FROM f LEFT JOIN labels l ON l.doc_id = f.doc_id GROUP BY f.part, f.failed),
c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (
  SELECT a.c || b.c || d.c || e.c || g.c AS filter_order FROM c a, c b, c d, c e, c g
  WHERE len(list_distinct([a.c, b.c, d.c, e.c, g.c])) = 5),
s AS (SELECT filter_order, CAST(i AS INT) AS step, filter_order[i] AS f, filter_order[:i - 1] AS b FROM o, range(1, 6) r(i)),
m AS (SELECT d.*, s.*, contains(failed, f) AS here, length(translate(failed, b, '')) < length(failed) AS earlier FROM d, s)
SELECT part, filter_order, step, CAST(coalesce(sum(n) FILTER (NOT here AND NOT earlier), 0) AS BIGINT) AS kept,
  CAST(coalesce(sum(n) FILTER (here AND NOT earlier), 0) AS BIGINT) AS removed, CAST(coalesce(sum(n) FILTER (here AND earlier), 0) AS BIGINT) AS redundant,
  CAST(coalesce(sum(n) FILTER (failed = f), 0) AS BIGINT) AS unique_fails, CAST(coalesce(sum(n_good) FILTER (here AND NOT earlier), 0) AS BIGINT) AS good_lost,
  CAST(coalesce(sum(n_toxic) FILTER (here AND NOT earlier), 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(n * (120 // greatest(length(failed), 1))) FILTER (here), 0) AS BIGINT) AS shapley
FROM m GROUP BY part, filter_order, step
"""

#: All documents that hold a term of an item, scored in whole numbers.
_SEARCH = r"""
WITH t AS (
  SELECT rowid_, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT row_number() OVER () AS rowid_, doc_id, text FROM documents)),
p AS (SELECT rowid_, doc_id, term, count(*) AS tf FROM t GROUP BY rowid_, doc_id, term),
d AS (SELECT rowid_, sum(tf) AS n FROM p GROUP BY rowid_),
c AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM d),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * nn + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term, nn),
s AS (
  SELECT q.item_id, p.rowid_, p.doc_id, CAST(sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (10 + (90 * CAST(d.n AS BIGINT) * c.nn) // c.ll)))) AS BIGINT) AS score
  FROM q JOIN p ON p.term = q.term JOIN w ON w.term = q.term JOIN d ON d.rowid_ = p.rowid_, c GROUP BY q.item_id, p.rowid_, p.doc_id),
r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM r WHERE rank <= 10
"""

#: The other queries are held against plain versions in the tests.
ORACLE_SQL: dict[str, str] = {"op3_jaccard_join": _JACCARD, "op11_filter_audit": _AUDIT, "op12_lexical_search": _SEARCH}
