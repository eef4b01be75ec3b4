"""Ranked lexical search over a length-stratified index.

A document's score for a query term depends on its tf and on its normaliser m alone, so documents with equal m form a stratum, whose
postings of a term are runs of equal tf: an impact is computed once for each run.  A stratum is kept in blocks of bounded size.  What a
block can give a query at most is the sum of its terms' impacts at their highest tf in the block; these bounds order the visits.  First the
blocks with the highest bounds are visited for each query, which gives the score that a document must reach; then every block whose bound
reaches that score.  So the result is exact, and no block is scored that can't matter.

The index holds the terms that the queries name, with their document frequencies over all documents; queries come in batches of a bounded
number of items and terms, so what is broadcast has a bound.  Postings lie in the shared folder, and blocks are dealt by ranges of
(m, hash of the document), so that a length that many documents share is many blocks in many tasks.

Defined results: null texts and texts without terms hold nothing and are not counted in N; documents with a null id count in N, L and df,
but are not listed; repeated ids are listed as often as they stand there; repeated items are items of their own; items without terms, or
whose terms nothing holds, list nothing; equal scores go by ascending id; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytescan import Spans, SpanTable, Transducer, in_each, text_buffer
from .common import batch, documents, sliced, written

#: A term: a run of ASCII letters and digits and anything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOP = 10
SLICE_ROWS, SLICE_BYTES = 4096, 1 << 20
#: Documents of a block, and blocks that are visited first for each query.
BLOCK_DOCS, FIRST_VISITS = 2048, 4
#: Items and distinct terms of a batch of queries, and its items that meet a block in one row.
BATCH_ITEMS, BATCH_TERMS, ROW_ITEMS = 4096, 1_000_000, 512
#: Scores that are summed at once.
MOST_SUMS = 1 << 20
_NO_ID = -(1 << 63)

TERMS = Transducer(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
_FOLD = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


def _spans(texts: list[bytes]) -> Spans:
    ends = np.cumsum([len(x) for x in texts])
    return Spans(np.frombuffer(b"".join(texts), np.uint8), ends - [len(x) for x in texts], ends)


_POSTINGS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])
_POSTINGS_SQL = "doc_id long, n long, terms array<int>, tfs array<int>"


def _postings(vocabulary: list[str]):
    """For each text the number of its terms, and those of the vocabulary with their tf."""
    tables: list[SpanTable] = []

    def run(batches):
        if not tables:
            tables.append(SpanTable(_spans([x.encode() for x in vocabulary])))
        for b in sliced(batches, SLICE_ROWS, 1, SLICE_BYTES):
            buf, offsets = text_buffer(b.column(1))
            buf = _FOLD[buf]
            _, starts, ends = TERMS.run(buf, offsets)
            n = in_each(starts, offsets)
            term = tables[0].find(Spans(buf, starts, ends))
            held = np.flatnonzero(term >= 0)
            key, tf = np.unique(np.repeat(np.arange(len(n)), n)[held] * max(1, len(vocabulary)) + term[held], return_counts=True)
            doc, term = np.divmod(key, max(1, len(vocabulary)))
            at = np.searchsorted(doc, np.arange(len(n) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x.astype(np.int32))) for x in (term, tf)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(n, pa.int64()), *lists], schema=_POSTINGS)

    return run


_BLOCKS = pa.schema([("block", pa.int64()), ("m", pa.int64()), *((c, pa.binary()) for c in ("terms", "tops", "runs", "tfs", "run_starts", "members", "docs"))])
_BLOCKS_SQL = "block long, m long, terms binary, tops binary, runs binary, tfs binary, run_starts binary, members binary, docs binary"


def _blocks(block_docs: int):
    """Blocks from rows ``(m, doc_id, terms, tfs)`` in order of m: postings in runs of one term and tf."""

    def block(number: int, m: int, rows: list[pa.RecordBatch]):
        part = pa.Table.from_batches(rows)
        docs = part.column(1).fill_null(_NO_ID).to_numpy()
        sizes = part.column(2).combine_chunks().value_lengths().to_numpy()
        term, tf = (np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in part.column(k).chunks]) for k in (2, 3))
        member = np.repeat(np.arange(len(docs), dtype=np.int32), sizes)
        order = np.lexsort((member, tf, term))
        term, tf, member = term[order], tf[order], member[order]
        begins = np.flatnonzero(np.diff(term, prepend=-1) | np.diff(tf, prepend=-1)).astype(np.int32)
        runs = term[begins]  # a run's term; the last run of a term has its highest tf
        last = np.flatnonzero(np.diff(runs, append=-1))
        cells = (runs[last], tf[begins][last], runs, tf[begins], np.append(begins, len(term)).astype(np.int32), member, docs)
        return batch(_BLOCKS, ([x] for x in (number, m, *(c.tobytes() for c in cells))))

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        m, n = None, 0
        for b in batches:
            at, ms = 0, b.column(0).to_numpy()
            cuts = [*(np.flatnonzero(np.diff(ms)) + 1).tolist(), b.num_rows]
            for end in cuts:
                while at < end:
                    if held and (ms[at] != m or n >= block_docs):
                        yield block(number, m, held)
                        number, held, n = number + 1, [], 0
                    take = min(end - at, block_docs - n)
                    held.append(b.slice(at, take))
                    m, n, at = int(ms[at]), n + take, at + take
        if held:
            yield block(number, m, held)

    return run


def impacts(weight: np.ndarray, tf: np.ndarray, m: int) -> np.ndarray:
    tf = tf.astype(np.int64)
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def _item_terms(items, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the items' terms those that the block holds: number of the item in its row, and place of the term in the block."""
    sizes = items.value_lengths().to_numpy()
    asked = items.flatten().to_numpy()
    at = np.minimum(np.searchsorted(terms, asked), max(0, len(terms) - 1))
    held = terms[at] == asked if len(terms) else np.zeros(len(asked), bool)
    return np.repeat(np.arange(len(sizes)), sizes)[held], at[held]


def _bounds(weights: np.ndarray):
    schema = pa.schema([("block", pa.int64()), ("item", pa.int32()), ("bound", pa.int64())])

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                block, m, terms, tops = (b.column(k)[r].as_py() for k in range(4))
                terms, tops = np.frombuffer(terms, np.int32), np.frombuffer(tops, np.int32)
                numbers, items = b.column(4)[r].values.to_numpy(), b.column(5)[r].values
                item, at = _item_terms(items, terms)
                bound = np.zeros(len(numbers), np.int64)
                np.add.at(bound, item, impacts(weights[terms], tops, m)[at])
                some = np.flatnonzero(bound)
                yield batch(schema, (np.full(len(some), block), numbers[some], bound[some]))

    return run


_SCORES = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])
_SCORES_SQL = "item int, doc_id long, score long"


def _visit(weights: np.ndarray, top: int):
    """The best ``top`` documents of a block for each of its row's items, of those that reach the item's least score."""

    def best(doc, score):
        order = np.lexsort((doc, -score))[:top]
        return doc[order], score[order]

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                row = {c: b.column(k)[r] for k, c in enumerate(b.schema.names)}
                m = row["m"].as_py()
                terms, tops, runs, tfs, run_starts, members = (np.frombuffer(row[c].as_py(), np.int32) for c in ("terms", "tops", "runs", "tfs", "run_starts", "members"))
                docs = np.frombuffer(row["docs"].as_py(), np.int64)
                numbers, least, items = row["numbers"].values.to_numpy(), row["least"].values.to_numpy(), row["items"].values
                item, at = _item_terms(items, terms)
                bound = np.zeros(len(numbers), np.int64)
                np.add.at(bound, item, impacts(weights[terms], tops, m)[at])
                open_ = (bound > 0) & (bound >= least)
                item, at = item[open_[item]], at[open_[item]]
                if not len(item):
                    continue
                each = np.repeat(impacts(weights[runs], tfs, m), np.diff(run_starts))
                first = np.searchsorted(runs, terms)  # a term's first run
                low, high = run_starts[first], run_starts[np.append(first[1:], len(runs))]
                sums = (high - low)[at].astype(np.int64)
                # Items in slices, so that few sums are held at once.
                slices = np.cumsum(sums) // MOST_SUMS
                edges = np.flatnonzero(np.diff(item)) + 1
                cuts = [0, *edges[np.diff(slices[edges], prepend=0) > 0].tolist(), len(item)]
                found: list[tuple] = []
                for x, y in zip(cuts, cuts[1:], strict=False):
                    if x == y:
                        continue
                    part, size = at[x:y], sums[x:y]
                    place = np.repeat(low[part] - np.cumsum(size) + size, size) + np.arange(size.sum())
                    here, of = np.unique(item[x:y], return_inverse=True)
                    score = np.zeros((len(here), len(docs)), np.int64)
                    np.add.at(score.reshape(-1), np.repeat(of, size) * len(docs) + members[place], each[place])
                    for k, i in enumerate(here.tolist()):
                        some = np.flatnonzero((score[k] >= max(1, least[i])) & (docs != _NO_ID))
                        if len(some):
                            doc, s = best(docs[some], score[k][some])
                            found.append((np.full(len(doc), numbers[i]), doc, s))
                if found:
                    yield batch(_SCORES, (np.concatenate(x) for x in zip(*found, strict=True)))

    return run


def _ranked(scores: DataFrame, top: int) -> DataFrame:
    best = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)


def _search(docs: DataFrame, items: list[list[str]], top: int) -> DataFrame:
    """``(item, doc_id, score, rank)`` for one batch of items, each a list of distinct terms."""
    spark = docs.sparkSession
    vocabulary = sorted({t for terms in items for t in terms})
    number = {t: k for k, t in enumerate(vocabulary)}
    postings = written(docs.mapInArrow(_postings(vocabulary), _POSTINGS_SQL), "postings").where("n > 0")
    n_docs, n_terms = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = dict(postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect())  # of the vocabulary, which is bounded
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(k, 0) + 1))) for k in range(len(vocabulary))], dtype=np.int64)
    # Postings by stratum.
    m = F.expr(f"10L + (90L * n * {n_docs}L) div {max(1, n_terms)}L")
    dealt = postings.where(F.size("terms") > 0).select(m.alias("m"), "doc_id", "terms", "tfs")
    parts = max(1, -(-n_docs // (4 * BLOCK_DOCS)))
    by = ("m", F.xxhash64("doc_id", "terms", "tfs"))
    blocks = written(dealt.repartitionByRange(parts, *by).sortWithinPartitions(*by).mapInArrow(_blocks(BLOCK_DOCS), _BLOCKS_SQL), "blocks")
    asked = [(k, sorted(number[t] for t in terms)) for k, terms in enumerate(items)]
    rows = [asked[k : k + ROW_ITEMS] for k in range(0, len(asked), ROW_ITEMS)]
    batches = spark.createDataFrame([([k for k, _ in r], [t for _, t in r]) for r in rows], "numbers array<int>, items array<array<int>>")
    bounds = blocks.select("block", "m", "terms", "tops").crossJoin(F.broadcast(batches)).mapInArrow(_bounds(weights), "block long, item int, bound long")
    first = bounds.withColumn("visit", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "block"))).where(F.col("visit") <= FIRST_VISITS)
    lists = spark.createDataFrame(asked, "item int, terms array<int>")
    first = first.join(F.broadcast(lists.withColumnRenamed("terms", "asked")), "item").groupBy("block").agg(F.collect_list(F.struct("item", "asked")).alias("x"))
    first = first.select("block", F.col("x.item").alias("numbers"), F.col("x.asked").alias("items"), F.transform("x", lambda _: F.lit(1).cast("long")).alias("least"))
    # At most FIRST_VISITS blocks for each of at most BATCH_ITEMS items.
    seen = blocks.join(F.broadcast(written(first, "first")), "block").mapInArrow(_visit(weights, top), _SCORES_SQL)
    least = dict(_ranked(seen, top).where(F.col("rank") == top).select("item", "score").collect())
    rows = [([k for k, _ in r], [t for _, t in r], [least.get(k, 1) for k, _ in r]) for r in rows]
    batches = spark.createDataFrame(rows, "numbers array<int>, items array<array<int>>, least array<long>")
    return _ranked(blocks.crossJoin(F.broadcast(batches)).mapInArrow(_visit(weights, top), _SCORES_SQL), top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, text: str = "text", row_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``top`` documents of each item with a score above 0."""
    spark = docs.sparkSession
    rows = docs.select(F.col(row_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    folded = F.translate(F.col(item_text), UPPER, LOWER)
    asked = items.select(F.col(item_id).alias("item_id"), F.array_distinct(F.regexp_extract_all(folded, F.lit(TERM), F.lit(0))).alias("terms")).where(F.size("terms") > 0)
    asked = written(asked, "items")
    n, terms = asked.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    batches = max(-(-n // BATCH_ITEMS), -(-terms // BATCH_TERMS))
    empty = asked.limit(0).select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    out = empty
    # Batches by a running count that stays in its part: a batch has about BATCH_ITEMS items at most, and so has what is collected of it.
    asked = asked.withColumn("batch", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(max(1, batches))))
    if batches > 1:
        asked = written(asked, "batches")
    for k in range(batches):
        some = asked.where(F.col("batch") == k).select("item_id", "terms").collect()
        if not some:
            continue
        found = _search(rows, [r["terms"] for r in some], top)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(some)], f"item int, item_id {items.schema[item_id].dataType.simpleString()}")
        out = out.unionByName(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return out


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents ranked for each benchmark item."""
    return search(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
