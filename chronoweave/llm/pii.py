r"""Information-theoretic sanitisation of personal data.

Base patterns find e-mail addresses, IP addresses, card and phone numbers; each distinct value is a protected entity.  Words of the
texts that hold an entity can give it away although no pattern finds them.  The corpus tells how strongly: a term's disclosure of an
entity is the pointwise mutual information of the two over documents, divided by the entity's information content; 1 means that who
knows the term knows the entity.  Terms that occur with an entity in at least ``LEAST_TEXTS`` different texts and disclose ``REMOVE``
or more of it are removed, those that disclose ``GENERALISE`` or more are replaced by their class: wherever they stand in any text, for
once the entity is masked, each of them still tells it.  Where several entities are disclosed, the strongest disclosure decides.

Counts cover all documents and whole texts.  Each text is read where it lies; what is shuffled are the entities and, of the texts that
hold some, the terms that can matter: for an entity in n of N documents no term in more than n^g N^(1-g) documents discloses g of it.

Defined results: null and empty texts hold nothing; repeated rows count as documents of their own and get equal spans; rows with a null
id get their spans too; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, documents, sliced, written

#: The base kinds in their order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits that doesn't begin a match can't begin one further on either.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_]+")

LEAST_TEXTS = 3
GENERALISE, REMOVE = 0.75, 0.9
#: Disclosing terms (their 64-bit hashes) that may be broadcast; more of them are joined to the texts by a shuffle.
BROADCAST_TERMS = 1_000_000
#: Words whose hashes a task keeps.
KNOWN_WORDS = 500_000
#: Rows that a task holds as Python objects at once.
SLICE_ROWS = 256


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: an address begins where the run of characters before its @ begins."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def find_base(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind as listed, then start."""
    found = [(0, a, b) for a, b in _emails(text)]
    found += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x[-12:]) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            found.append((2, m.start(), m.end()))
    if "+" in text:
        found += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


def _hash(s: str) -> int:
    from xxhash import xxh3_64_intdigest

    x = xxh3_64_intdigest(s.encode("utf-8", "surrogatepass"))
    return x - (1 << 64) if x >> 63 else x


def _entity(text: str, kind: int, a: int, b: int) -> str:
    value = text[a:b].lower()
    return f"{KINDS[kind]}:" + (value if kind < 2 else "".join(c for c in value if c.isdigit()))


def find_terms(text: str, base: list[tuple[int, int, int]]) -> list[tuple[str, int, int]]:
    """(word, start, end) of all words outside the base spans."""
    taken: list[list[int]] = []
    for a, b in sorted((a, b) for _, a, b in base):
        if taken and a <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    out, at = [], 0
    for m in _TERM.finditer(text):
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        if at == len(taken) or m.end() <= taken[at][0]:
            out.append((m[0], m.start(), m.end()))
    return out


_HELD = pa.schema([("text_hash", pa.int64()), ("entities", pa.list_(pa.int64())), ("terms", pa.list_(pa.int64()))])
_HELD_SQL = "text_hash long, entities array<long>, terms array<long>"


def _hold(every: bool):
    """Entities and terms of the texts that hold entities, or of ``every`` text."""

    def run(batches):
        for b in sliced(batches, SLICE_ROWS, 0):
            rows = []
            for text in b.column(0).to_pylist():
                base = find_base(text) if text else []
                if base or (every and text):
                    terms = {_hash(w) for w in {w.lower() for w, _, _ in find_terms(text, base)}}
                    rows.append((_hash(text), list({_hash(_entity(text, *x)) for x in base}), list(terms)))
            yield batch(_HELD, zip(*rows, strict=True) if rows else [[] for _ in _HELD])

    return run


def _count_terms(batches):
    """Documents by term, summed in each task."""
    schema = pa.schema([("term", pa.int64()), ("n", pa.int64())])
    known: dict[str, int] = {}
    n: Counter[int] = Counter()
    for b in sliced(batches, SLICE_ROWS, 0):
        for text in b.column(0).to_pylist():
            seen = set()
            for w in set(_TERM.findall(text)) if text else ():
                h = known.get(w)
                if h is None:
                    if len(known) > KNOWN_WORDS:
                        known.clear()
                    h = known[w] = _hash(w.lower())
                seen.add(h)
            n.update(seen)
            if len(n) > 500_000:
                yield batch(schema, (n.keys(), n.values()))
                n.clear()
    yield batch(schema, (n.keys(), n.values()))


_MORE = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("action", pa.string())]))
_FOUND = pa.schema([
    *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_terms", pa.int32()), ("more", _MORE),
    ("text_hash", pa.int64()),
])
_FOUND_SQL = ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_terms int, more array<struct<a:int,b:int,action:string>>, text_hash long"


def _detect(told):
    """Spans of each row; the disclosing terms are ``told`` (sorted hashes, and whether to remove), or else those in the row's own list."""

    def run(batches):
        known: dict[str, str | None] = {}

        def action(word: str) -> str | None:
            h = _hash(word.lower())
            hashes, remove = told.value
            at = int(np.searchsorted(hashes, h))
            if at == len(hashes) or hashes[at] != h:
                return None
            return "removed" if remove[at] else "generalised"

        for b in sliced(batches, SLICE_ROWS, 1):
            rows = []
            lists = b.column(2).to_pylist() if told is None else [None] * b.num_rows
            for text, own in zip(b.column(1).to_pylist(), lists, strict=True):
                text = text or ""
                base = find_base(text)
                said = ",".join(f"{KINDS[k]}:{a}:{e}" for k, a, e in base)
                act: dict[str, str] = {}
                if told is not None or own:
                    here = {x["term"]: "removed" if x["remove"] else "generalised" for x in own or ()}
                    for w in set(_TERM.findall(text)):
                        if told is None:
                            how = here.get(_hash(w.lower()))
                        else:
                            if w not in known:
                                if len(known) > KNOWN_WORDS:
                                    known.clear()
                                known[w] = action(w)
                            how = known[w]
                        if how:
                            act[w] = how
                more = [{"a": a, "b": e, "action": act[w]} for w, a, e in find_terms(text, base) if w in act] if act else []
                spans = ",".join([*([said] if said else []), *(f"term:{x['a']}:{x['b']}" for x in more)])
                counts = [sum(k == i for k, _, _ in base) for i in range(len(KINDS))]
                rows.append((*counts, hashlib.sha256(said.encode()).hexdigest(), spans, len(more), more or None, _hash(text) if spans else None))
            out = batch(_FOUND, zip(*rows, strict=True) if rows else [[] for _ in _FOUND])
            yield pa.RecordBatch.from_arrays([b.column(0), *out.columns], names=["row", *_FOUND.names])

    return run


def _hashed(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([None if t is None else _hash(t) for t in b.column(1).to_pylist()], type=pa.int64())], names=["row", "text", "hash_"])


def disclosing_terms(rows: DataFrame, least_texts: int, generalise: float, remove: float) -> DataFrame:
    """``(term, remove)`` for the terms in the column ``text`` that disclose an entity strongly enough."""
    held = written(rows.select("text").mapInArrow(_hold(False), _HELD_SQL), "held")
    total = float(rows.count())
    # Documents by text and entity: equal texts count as documents of their own, but as one text.
    by_text = held.select("text_hash", F.explode("entities").alias("entity")).groupBy("text_hash", "entity").agg(F.count("*").alias("n"))
    by_entity = by_text.groupBy("entity").agg(F.sum("n").alias("n_entity"), F.count("*").alias("texts")).where(F.col("texts") >= least_texts)
    most = F.pow("n_entity", F.lit(generalise)) * F.lit(total ** (1 - generalise) * (1 + 1e-6))
    by_entity = written(by_entity.select("entity", "n_entity", most.alias("most")), "entities")
    limit = by_entity.agg(F.max("most")).head()[0]
    if limit is None:
        return rows.sparkSession.createDataFrame([], "term long, remove boolean")
    by_term = rows.select("text").mapInArrow(_count_terms, "term long, n long").groupBy("term").agg(F.sum("n").alias("n_term"))
    by_term = written(by_term.where((F.col("n_term") >= least_texts) & (F.col("n_term") <= limit)), "terms")
    terms = held.select("text_hash", F.explode("terms").alias("term")).join(by_term, "term").distinct()
    pairs = by_text.join(by_entity, "entity").join(terms, "text_hash").where(F.col("n_term") <= F.col("most"))
    pairs = pairs.groupBy("entity", "term", "n_entity", "n_term").agg(F.sum("n").alias("n_both"), F.count("*").alias("texts")).where(F.col("texts") >= least_texts)
    content = F.log(F.lit(total) / F.col("n_entity"))
    shared = F.log(F.lit(total) * F.col("n_both") / (F.col("n_term") * F.col("n_entity")))
    told = pairs.withColumn("disclosure", F.when(content > 0, shared / content).otherwise(0.0)).where(F.col("disclosure") >= generalise)
    return written(told.groupBy("term").agg((F.max("disclosure") >= remove).alias("remove")), "told")


def detect(docs: DataFrame, text: str = "text", row_id: str = "doc_id", least_texts: int = LEAST_TEXTS, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """Spans of each row: counts and digest of the base ones, and all of them with what is done to the further terms."""
    spark = docs.sparkSession
    kind = docs.schema[row_id].dataType.simpleString()
    rows = docs.select(F.col(row_id).alias("row"), F.col(text).alias("text"))
    told = disclosing_terms(rows, least_texts, generalise, remove)
    if told.count() <= BROADCAST_TERMS:
        table = told.orderBy("term").toArrow()
        out = rows.mapInArrow(_detect(spark.sparkContext.broadcast((table["term"].to_numpy(), table["remove"].to_numpy()))), f"row {kind}, {_FOUND_SQL}")
    else:
        every = rows.select("text").mapInArrow(_hold(True), _HELD_SQL).select(F.col("text_hash").alias("hash_"), F.explode("terms").alias("term"))
        by_text = every.join(told, "term").groupBy("hash_").agg(F.collect_set(F.struct("term", "remove")).alias("told"))
        both = rows.mapInArrow(_hashed, f"row {kind}, text string, hash_ long").join(by_text, "hash_", "left").select("row", "text", "told")
        out = both.mapInArrow(_detect(None), f"row {kind}, {_FOUND_SQL}")
    return out.withColumnRenamed("row", row_id)


def _rewrite(batches):
    for b in batches:
        out = []
        for text, base, more in zip(*(b.column(c).to_pylist() for c in ("text", "spans", "more")), strict=True):
            cuts = [(int(a), int(e), f"<{k.upper()}>") for k, a, e in (x.split(":") for x in (base or "").split(",") if x) if k in KINDS]
            cuts += [(x["a"], x["b"], "" if x["action"] == "removed" else "<NAME>" if text[x["a"]].isupper() else "<WORD>") for x in more or ()]
            done, at = [], 0
            for a, e, word in sorted(cuts):
                if a >= at:
                    done += [text[at:a], word]
                    at = e
            out.append(None if text is None else "".join([*done, text[at:]]))
        yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(out, type=pa.string())], names=["row", "text"])


def sanitise(docs: DataFrame, text: str = "text", row_id: str = "doc_id", **options) -> DataFrame:
    """``(row_id, text)`` with base spans replaced by their kind, and disclosing terms removed or replaced by their class."""
    spans = detect(docs, text, row_id, **options).where("spans <> ''").select(F.col(row_id).alias("row_"), "spans", "more", "text_hash").dropDuplicates(["row_", "text_hash"])
    kind = docs.schema[row_id].dataType.simpleString()
    rows = docs.select(F.col(row_id).alias("row"), F.col(text).alias("text")).mapInArrow(_hashed, f"row {kind}, text string, hash_ long")
    both = rows.join(spans, rows["row"].eqNullSafe(spans["row_"]) & (rows["hash_"] == spans["text_hash"]), "left").select("row", "text", "spans", "more")
    return both.mapInArrow(_rewrite, f"row {kind}, text string").select(F.col("row").alias(row_id), F.col("text").alias(text))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents, with the terms that disclose it."""
    return detect(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_terms")
