"""Filter interaction audit: what each of five text filters removes in every order of application, and what it shares with the others.

One pass of a table-driven transducer over each text's UTF-8 bytes counts words, capitals, code points and symbols and marks the words'
spans, which go into a verified hash table for the number of distinct ones.  A document then is one narrow row: which filters it fails, and
a digest of its text, by which equal texts meet for the last filter.  Rows become counts of (part, set of failed filters) before anything
is said about orders, so all 120 orders cost the same whatever the input's size.

Filters: A under 50 words; B fewer than 65 distinct words in 100; C more than 5 capitals in 100 code points; D a symbol of ``#$%&*|``;
E a text that a smaller id has, anywhere in the table.

Defined results: a null text is empty, and equals an empty one; null and empty ``source`` are one part; rows with a null id come after all
others, so they fail E where another row with an id has their text, and no two of them fail each other; of rows that repeat an id none is
smaller; labels of repeated ids count as set if any of them is; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytescan import CAPITAL, CONTINUES, SYMBOL, Spans, SpanTable, Transducer, in_each, text_buffer
from .common import documents, sliced, written

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
SYMBOLS = b"#$%&*|"
#: Texts that are scanned at once, by number and by bytes.
SLICE_ROWS, SLICE_BYTES = 4096, 1 << 20

WORDS = Transducer(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D, lambda b: 0x41 <= b <= 0x5A, lambda b: b in SYMBOLS)


def scan(column: pa.Array):
    """For each text ``(words, distinct words, capitals, code points, symbols)``."""
    import numpy as np

    buf, offsets = text_buffer(column)
    out, starts, ends = WORDS.run(buf, offsets)
    words = in_each(starts, offsets)
    owner = np.repeat(np.arange(len(words)), words)
    distinct = np.bincount(owner[SpanTable(Spans(buf, starts, ends, owner)).first], minlength=len(words))
    capitals, symbols, more = (in_each(np.flatnonzero(out & flag), offsets) for flag in (CAPITAL, SYMBOL, CONTINUES))
    return words, distinct, capitals, np.diff(offsets) - more, symbols


_COUNTS = ("n_words", "n_distinct", "n_capitals", "n_points", "n_symbols")


def _scan(schema: pa.Schema):
    def run(batches):
        for b in sliced(batches, SLICE_ROWS, 0, SLICE_BYTES):
            counts = [pa.array(x, type=pa.int64()) for x in scan(b.column(0))]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *counts], schema=schema)

    return run


def text_statistics(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` with ``n_words, n_distinct, n_capitals, n_points, n_symbols`` of the whole text."""
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = docs.select(F.col(text).alias("text"), *keep)
    kept = rows.select(*keep).schema
    schema = pa.schema([*to_arrow_schema(kept), *(pa.field(c, pa.int64()) for c in _COUNTS)])
    for c in _COUNTS:
        kept = kept.add(c, "long")
    return rows.mapInArrow(_scan(schema), kept)


def failed_filters(docs: DataFrame, text: str = "text", row_id: str = "doc_id", source: str = "source") -> DataFrame:
    """``(doc_id, part, text_digest, failed)`` for each row; bit k of ``failed`` is set where filter k of ABCD fails."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(row_id).alias("doc_id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("part"), t.alias("text"), F.unhex(F.sha2(t.cast("binary"), 256)).alias("text_digest")
    )
    seen = text_statistics(rows, ["doc_id", "part", "text_digest"])
    fails = [
        F.col("n_words") < LEAST_WORDS,
        100 * F.col("n_distinct") < LEAST_DISTINCT * F.col("n_words"),
        100 * F.col("n_capitals") > MOST_CAPITALS * F.col("n_points"),
        F.col("n_symbols") > 0,
    ]
    bits = sum((F.when(x, 1 << k).otherwise(0) for k, x in enumerate(fails)), F.lit(0))
    return seen.select("doc_id", "part", "text_digest", bits.cast("int").alias("failed"))


def failure_sets(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """``(part, failed, n, n_good, n_toxic)``: documents of each part by the set of filters that they fail."""
    seen = written(failed_filters(docs, **columns), "failures")  # narrow rows, so that no text is scanned twice
    seen = seen.groupBy("text_digest", "part", "failed", "doc_id").agg(F.count("*").alias("n"))
    said = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    named = seen.where("doc_id is not null").join(said.where("doc_id is not null"), "doc_id", "left")
    nameless = seen.where("doc_id is null").withColumn("good", F.lit(None).cast("boolean")).withColumn("toxic", F.lit(None).cast("boolean"))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    rows = named.unionByName(nameless).select("text_digest", "part", "failed", "doc_id", "n", flag("good"), flag("toxic"))
    # Copies become one row for each kind of them before they meet by their text: how many, and how many of those have the least id.  A text
    # has at most four kinds for each part.
    kinds = rows.groupBy("text_digest", "part", "failed", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_nameless")
    )
    each = kinds.withColumn("text_least", F.min("least").over(Window.partitionBy("text_digest")))
    passes = F.when(F.col("text_least").isNull(), F.col("n_nameless")).when(F.col("least") == F.col("text_least"), F.col("n_least")).otherwise(F.lit(0))
    repeats = 1 << FILTERS.index("E")
    both = each.select("part", "good", "toxic", F.inline(F.array(
        F.struct("failed", passes.cast("long").alias("n")),
        F.struct((F.col("failed") + repeats).alias("failed"), (F.col("n") - passes).cast("long").alias("n")),
    )))
    return both.groupBy("part", "failed").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("n_good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("n_toxic")
    )


def orders(filters: str = FILTERS) -> list[tuple[str, int, int, int]]:
    """``(filter_order, step, bit of its filter, bits of the filters before it)`` for each step of each order."""
    out = []
    for p in permutations(filters):
        before = 0
        for step, f in enumerate(p, 1):
            bit = 1 << filters.index(f)
            out.append(("".join(p), step, bit, before))
            before |= bit
    return out


def audit_filters(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """One row for each part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    spark = docs.sparkSession
    sets = failure_sets(docs, labels, **columns)
    steps = orders()
    cases = sorted({(bit, before) for _, _, bit, before in steps})  # 5 filters and what may come before each: 80
    case = F.explode(F.array(*(F.struct(F.lit(a).alias("bit"), F.lit(b).alias("before")) for a, b in cases)))
    rows = sets.withColumn("case", case).select("part", "failed", "n", "n_good", "n_toxic", "case.bit", "case.before")
    fails, earlier = F.col("failed").bitwiseAND(F.col("bit")) != 0, F.col("failed").bitwiseAND(F.col("before")) != 0
    here = fails & ~earlier
    count = lambda condition, of="n": F.sum(F.when(condition, F.col(of)).otherwise(F.lit(0)))
    share = F.lit(120) / F.greatest(F.bit_count("failed"), F.lit(1))  # each filter that a document fails is the first of them in as many orders
    told = rows.groupBy("part", "bit", "before").agg(
        count(~fails & ~earlier).alias("kept"), count(here).alias("removed"), count(fails & earlier).alias("redundant"), count(F.col("failed") == F.col("bit")).alias("unique_fails"),
        count(here, "n_good").alias("good_lost"), count(here, "n_toxic").alias("toxic_lost"), F.sum(F.when(fails, F.col("n") * share.cast("long")).otherwise(F.lit(0))).alias("shapley"),
    )
    table = spark.createDataFrame(steps, "filter_order string, step int, bit int, before int")  # 600 rows
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return told.join(F.broadcast(table), ["bit", "before"]).select("part", "filter_order", "step", *(F.col(c).cast("long").alias(c) for c in names))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five filters over all documents, in all orders, by source."""
    return audit_filters(documents(spark, sf_dir).select("doc_id", "text", "source"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
