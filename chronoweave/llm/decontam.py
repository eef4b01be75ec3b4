r"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Texts are lower-cased and cut into words (runs of letters and digits, so case and punctuation don't matter), and words are hashed.  A
mask is a pattern of word positions that count and positions that are ignored; at every position of every document and benchmark item
each mask gives one hash of the words that count, so a substituted word spoils only those windows in which it counts.  Joined hashes
are hits.  A hit fixes how document and item lie against each other; around it the stretch with the best score (a match 1, a
mismatch -1) is found, and the pair is an overlap if that score reaches ``least``, or the item's own length if it is shorter.  Hits on
one alignment are verified once.

The benchmark's hashes, and the alignments that are hit, are broadcast only if there are at most ``BROADCAST_ROWS``; beyond that both
sides are joined by a shuffle.
Items with fewer words than every mask spans have a mask of their own length that ignores nothing: they overlap where all of them
stands.  Lengths that no item has cost nothing.

Defined results: null and empty texts overlap with nothing, nor do items of fewer than ``SHORTEST`` words, which identify no passage;
repeated rows and repeated ids are reported once for each (id, item); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, written

#: 1 counts, 0 is ignored.
MASKS = ("1110111", "11011011", "110100111")
LEAST = 8
#: Words that an item must have.
SHORTEST = 3
BROADCAST_ROWS = 1_000_000


def _offsets(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


def _word_hashes(text: str) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.transform(words, lambda w: F.xxhash64(w))


def _windows(words: str, m: int, masks: tuple[str, ...], whole: bool) -> Column:
    """Hashes of one mask at every position; with ``whole``, a mask that ignores nothing is for texts of its own length only."""
    n, mask = F.size(words), masks[m]
    return F.when(
        (n == len(mask)) if whole and "0" not in mask else (n >= len(mask)),
        F.transform(F.sequence(F.lit(0), n - len(mask)), lambda i: F.xxhash64(F.lit(m), *(F.get(F.col(words), i + o) for o in _offsets(mask)))),
    ).otherwise(F.array().cast("array<bigint>"))


def _counted(n: Column, m: int, masks: tuple[str, ...], whole: bool) -> Column:
    counted = F.greatest(n - len(masks[m]) + 1, F.lit(0))
    return F.when(n == len(masks[m]), 1).otherwise(0) if whole and "0" not in masks[m] else counted


def _seeds(df: DataFrame, words: str, key: str, at: str, mask: str, masks: tuple[str, ...], whole: bool = False) -> DataFrame:
    """A row for each mask and position, with its hash."""
    kept = [c for c in df.columns if c != words]
    out = df.withColumn("seeds_", F.concat(*(_windows(words, m, masks, whole) for m in range(len(masks))))).withColumn("n_", F.size(words))
    # The outer form: for the inner one the optimiser infers a filter on the array and computes the array in it once more.
    out = out.select(*kept, "n_", F.posexplode_outer("seeds_").alias("p_", key)).where(F.col(key).isNotNull())
    first = [F.lit(0)]
    for m in range(len(masks)):
        first.append(first[-1] + _counted(F.col("n_"), m, masks, whole))
    which = F.when(F.col("p_") < first[1], 0)
    start = F.when(F.col("p_") < first[1], first[0])
    for m in range(1, len(masks)):
        which, start = which.when(F.col("p_") < first[m + 1], m), start.when(F.col("p_") < first[m + 1], first[m])
    return out.select(*kept, key, which.alias(mask), (F.col("p_") - start).alias(at))


def _best_stretch(least: int) -> Column:
    """The stretch of the item with the best score on the hit's alignment, as (score, start, end) in the item's words."""
    same = lambda i: F.coalesce(F.get(F.col("item_words"), i) == F.get(F.col("doc_words"), i + F.col("shift")), F.lit(False))

    def step(s: Column, i: Column) -> Column:
        fresh = s["now"] <= 0
        now = F.when(fresh, 0).otherwise(s["now"]) + F.when(same(i), 1).otherwise(-1)
        since = F.when(fresh, i).otherwise(s["since"])
        better = now > s["score"]
        return F.struct(
            now.alias("now"), since.alias("since"), F.when(better, now).otherwise(s["score"]).alias("score"),
            F.when(better, since).otherwise(s["start"]).alias("start"), F.when(better, i + 1).otherwise(s["end"]).alias("end"),
        )

    zero = F.struct(*(F.lit(0).alias(c) for c in ("now", "since", "score", "start", "end")))
    return F.aggregate(F.sequence(F.lit(0), F.size("item_words") - 1), zero, step)


def overlaps(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, text: str = "text", row_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """One row for each document and item that overlap: ``(row_id, item_id, score, start, end, item_start, item_end)`` of the best
    stretch, in words, ends exclusive."""
    items = benchmark.select(F.col(item_id).alias("item_id"), _word_hashes(item_text).alias("item_words")).where(F.size("item_words") >= SHORTEST)
    n = F.size("item_words")
    short = items.where(n < min(map(len, MASKS))).select(n.alias("n")).distinct().collect()  # a few lengths
    masks = MASKS + tuple("1" * x["n"] for x in sorted(short))
    tests = written(_seeds(items, "item_words", "seed", "item_at", "mask", masks, whole=True).select("item_id", "seed", "item_at"), "seeds")
    train = docs.select(F.col(row_id).alias("doc_id"), F.col(text).alias("text"))
    # The words don't travel with the seeds: a row for each position would repeat them.
    seeds = _seeds(train.select("doc_id", _word_hashes("text").alias("doc_words")), "doc_words", "seed", "at", "doc_mask", masks).select("doc_id", "seed", "at")
    hits = seeds.join(F.broadcast(tests) if tests.count() <= BROADCAST_ROWS else tests, "seed")
    # Hits that lie on one alignment are one row, before the shuffle already.
    lines = written(hits.select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct(), "hits").withColumnRenamed("doc_id", "hit_id")
    few = lines.count() <= BROADCAST_ROWS
    # A document's words are hashed once, whatever the number of its alignments.
    hit = lines.select(F.col("hit_id").alias("only_id")).distinct()
    words = train.join(F.broadcast(hit) if few else hit, train["doc_id"].eqNullSafe(F.col("only_id")), "left_semi").select("doc_id", _word_hashes("text").alias("doc_words"))
    both = words.join(F.broadcast(lines) if few else lines, words["doc_id"].eqNullSafe(F.col("hit_id"))).drop("hit_id").withColumnRenamed("item_id", "item")
    both = both.join(items, F.col("item").eqNullSafe(F.col("item_id"))).drop("item")
    best = both.select("doc_id", "item_id", "shift", F.size("item_words").alias("n_item"), _best_stretch(least).alias("s"))
    good = best.where(F.col("s.score") >= F.least(F.lit(least), F.col("n_item")))
    told = F.struct(F.col("s.score").alias("score"), (-(F.col("s.start") + F.col("shift"))).alias("minus_start"), (F.col("s.end") + F.col("shift")).alias("end"), F.col("s.start").alias("item_start"), F.col("s.end").alias("item_end"))
    out = good.groupBy("doc_id", "item_id").agg(F.max(told).alias("t"))
    return out.select(
        F.col("doc_id").alias(row_id), "item_id", "t.score", (-F.col("t.minus_start")).alias("start"), "t.end", "t.item_start", "t.item_end"
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, row_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that overlap with no item, all columns kept.  Rows with a null id stay."""
    bad = written(overlaps(docs, benchmark, row_id=row_id, **options).select(row_id).distinct(), "overlaps")
    few = bad.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(bad) if few else bad, row_id, "left_anti")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of all documents with all benchmark items."""
    return overlaps(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
