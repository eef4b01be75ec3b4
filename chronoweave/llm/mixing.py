"""Mixing sources to target weights by Sainte-Laguë apportionment.

Each source's documents, in a seeded order, form one stream of words, cut by shard (a hash of the document) into blocks of equally
many words.  Targets are the weights' shares of the budget, each at most ``max_epochs`` times its source's size; what a cap sets free
is shared again by weight.  Blocks are allocated to sources by highest quotients ``target / (2 s + 1)``, then each source's blocks to
its shards in the same way, which gives integer quotas.  In a shard, ``quota // blocks`` whole passes are taken, and the rest are the
blocks that a seeded permutation puts first.

Defined results: null source is a source of its own, last in order; null or empty texts have size 0 and are never taken; repeated
rows count as rows of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, documents, written

WEIGHTS = (5, 2, 1)
BLOCK_WORDS = 128
SHARDS = 16
#: Rows of a source and shard that one window holds, on average, and the least number of chunks.
CHUNK_ROWS, CHUNKS = 20_000, 32
#: The table of sources is small by contract; more are refused rather than gathered.
MAX_SOURCES = 100_000


def capped_targets(sizes: list[int], weights: list[float], budget: float, max_epochs: float = 2.0) -> list[float]:
    """Shares of ``budget`` by weight, none above ``max_epochs`` times its size; the excess is shared again by weight."""
    targets, open_ = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    left = min(budget, max_epochs * sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total >= max_epochs * sizes[i]]
        if not full:
            for i in open_:
                targets[i] = left * weights[i] / total
            break
        for i in full:
            targets[i] = float(max_epochs * sizes[i])
        left -= sum(targets[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return targets


def sainte_lague(shares: list[float], seats: int, caps: list[int]) -> list[int]:
    """Seats by highest quotients ``share / (2 s + 1)``, none above its cap; ties go to the earlier entry.

    Most seats are given at once from a divisor that gives no one too many; the queue hands out the few that remain.
    """
    seats = min(seats, sum(c for c, x in zip(caps, shares, strict=True) if x > 0))
    total = sum(shares)
    if seats <= 0 or total <= 0:
        return [0] * len(shares)
    low, high = 0.0, 2.0 * (seats + len(shares)) / min(x for x in shares if x > 0)
    given = lambda rate: [min(c, max(0, math.ceil(x * rate - 0.5))) if x > 0 else 0 for x, c in zip(shares, caps, strict=True)]
    for _ in range(200):
        mid = (low + high) / 2
        if sum(given(mid)) <= seats:
            low = mid
        else:
            high = mid
    held = given(low)
    queue = [(-x / (2 * held[i] + 1), i) for i, x in enumerate(shares) if x > 0 and held[i] < caps[i]]
    heapq.heapify(queue)
    for _ in range(seats - sum(held)):
        _, i = heapq.heappop(queue)
        held[i] += 1
        if held[i] < caps[i]:
            heapq.heappush(queue, (-shares[i] / (2 * held[i] + 1), i))
    return held


def _multiplier(blocks: int) -> int:
    """Near the golden section of ``blocks``, and prime to it: neighbours in the stream are far apart in the permutation."""
    a = max(1, round(blocks * 0.6180339887498949))
    while math.gcd(a, blocks) != 1:
        a += 1
    return a


def quotas(cells: list[tuple], seed: int = 0, weights=WEIGHTS, budget_share: float = 1.5, block_words: int = BLOCK_WORDS, max_epochs: int = 2):
    """Rows ``(source, shard, source_size, target, cell_size, blocks, passes, extra, step, shift)`` from ``(source, shard, size)``."""
    by: dict = {}
    for source, shard, size in cells:
        by.setdefault(source, {})[shard] = size
    names = sorted(by, key=lambda s: (s is None, s or ""))
    sizes = [sum(by[s].values()) for s in names]
    targets = capped_targets(sizes, [weights[i % len(weights)] for i in range(len(names))], budget_share * sum(sizes), max_epochs)
    blocks = {s: {k: max(1, round(n / block_words)) if n else 0 for k, n in by[s].items()} for s in names}
    # A seat is one block of a source; sources' blocks differ slightly in words, so seats are shared by target in blocks.
    in_blocks = [t * sum(blocks[s].values()) / n if n else 0.0 for s, t, n in zip(names, targets, sizes, strict=True)]
    caps = [max_epochs * sum(blocks[s].values()) for s in names]
    seats = sainte_lague(in_blocks, round(sum(in_blocks)), caps)
    rows = []
    for s, n, t, q in zip(names, sizes, targets, seats, strict=True):
        shards = sorted(by[s])
        held = sainte_lague([float(by[s][k]) for k in shards], q, [max_epochs * blocks[s][k] for k in shards])
        for k, h in zip(shards, held, strict=True):
            b = blocks[s][k]
            step = _multiplier(b) if b else 1
            rows.append((s, k, n, t, by[s][k], b, h // b if b else 0, h % b if b else 0, step, (seed * 7919 + k * 104729) % b if b else 0))
    return rows


_QUOTAS = "source string, shard int, source_size long, target double, cell_size long, blocks long, passes long, extra long, step long, shift long"


def mix_sources(docs: DataFrame, seed: int = 0, text: str = "text", row_id: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """``(row_id, size, source_size, target, taken)`` for each row: the words that the mix takes of it, repeats counted."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col(row_id).alias("row"),
        F.col(source).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        # The text takes part, so that rows with null or repeated ids don't share one place in the order.
        F.xxhash64(F.lit(seed), F.col(row_id), F.col(source), F.col(text)).alias("order"),
    ).withColumn("shard", F.pmod(F.col("order"), F.lit(SHARDS)).cast("int"))
    rows = written(rows, "sizes")  # without the texts
    known = rows.groupBy("source", "shard").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    if known.select("source").distinct().limit(MAX_SOURCES + 1).count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    cells = known.collect()  # at most MAX_SOURCES * SHARDS rows
    table = spark.createDataFrame(quotas([(x["source"], x["shard"], x["size"]) for x in cells], seed, **options), _QUOTAS)
    chunks = max(CHUNKS, -(-max([x["n"] for x in cells], default=0) // CHUNK_ROWS))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64(F.lit(1), "order"), F.lit(chunks)).cast("int"))
    # A row's place in the stream of its cell: first by chunk, then within the chunk, so that no window holds a whole source.
    before = Window.partitionBy("source", "shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("source", "shard", "chunk").agg(F.sum("size").alias("n"))
    starts = sums.withColumn("chunk_start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("source", "shard", "chunk").orderBy("order", "row", "size").rowsBetween(Window.unboundedPreceding, -1)
    same = lambda a, b, *on: [a[c].eqNullSafe(b[c]) for c in on]
    placed = rows.withColumn("offset", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(starts, same(placed, starts, "source", "shard", "chunk")).select(
        placed["row"], placed["size"], placed["source"], placed["shard"], (F.col("chunk_start") + F.col("offset")).alias("a")
    )
    placed = placed.join(F.broadcast(table), same(placed, table, "source", "shard")).select(
        "row", "size", "source_size", "target", "cell_size", "blocks", "passes", "extra", "step", "shift", "a", (F.col("a") + F.col("size")).alias("b")
    )
    # Block i holds the words [i * cell_size div blocks, (i + 1) * cell_size div blocks).
    taken = F.expr("""
        if(size = 0 or blocks = 0, 0L, passes * size + if(extra = 0, 0L, aggregate(
            sequence(greatest((a * blocks) div cell_size - 1, 0L), least((b * blocks) div cell_size + 1, blocks - 1)), 0L,
            (s, i) -> s + if((i * step + shift) % blocks < extra,
                greatest(0L, least(b, ((i + 1) * cell_size) div blocks) - greatest(a, (i * cell_size) div blocks)), 0L))))""")
    return placed.select(F.col("row").alias(row_id), "size", "source_size", "target", taken.alias("taken"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default mix over all documents."""
    return mix_sources(documents(spark, sf_dir).select("doc_id", "text", "source"))
