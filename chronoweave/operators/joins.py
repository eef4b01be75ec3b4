"""Lookups, exclusions, set checks and nearest matches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import written
from .intervals import BUCKET_US, overlap_join
from .pooling import BUCKET_CHARS
from .scan import running


def select_samples(df: DataFrame, ids: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """The rows whose key is in ``ids``; then, if asked, the first ``limit`` by key."""
    out = df.join(ids.select(key).distinct(), key, "left_semi")
    return out.orderBy(key).limit(limit) if limit else out


def unknown_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return ids.select(key).distinct().join(df.select(key).distinct(), key, "left_anti")


def both_ways(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on one side only: ``(key, side)``."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def gather_by_word(timeline: DataFrame, words: DataFrame, by: list[str], features: str, width: int) -> DataFrame:
    """Each word position's features, zeros and a false mask for gaps and unknown words."""
    out = timeline.join(words.select(*by, "word_index", features), [*by, "word_index"], "left")
    mask = (F.col("word_index") >= 0) & F.col(features).isNotNull()
    return out.withColumn("mask", F.coalesce(mask, F.lit(False))).withColumn(features, F.when(F.col("mask"), F.col(features)).otherwise(F.array_repeat(F.lit(0.0), width)))


def apply_exclusions(obs: DataFrame, rules: DataFrame, key: str, frame: str, quality: str) -> DataFrame:
    """Quality 0 and ``excluded`` for the frames that the rules list; ``raw_quality`` keeps what was measured.

    ``rules``: key and an array ``frames``; a small table, but joined by Spark's own choice.
    """
    listed = rules.select(key, F.explode("frames").alias(frame)).distinct().withColumn("hit_", F.lit(True))
    out = obs.join(listed, [key, frame], "left").withColumn("excluded", F.coalesce("hit_", F.lit(False))).withColumn("raw_quality", F.col(quality))
    return out.withColumn(quality, F.when(F.col("excluded"), F.lit(0.0)).otherwise(F.col(quality))).drop("hit_")


def exclusion_violations(rules: DataFrame, hashes: DataFrame, key: str) -> DataFrame:
    """Keys with several cases, and cases whose video isn't the one that was reviewed."""
    twice = rules.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key, F.lit("several_cases").alias("check_id"))
    other = rules.join(hashes, key).where(F.col("video_sha256") != F.col("sha256")).select(key, F.lit("other_video").alias("check_id"))
    return twice.unionByName(other)


def nearest(queries: DataFrame, points: DataFrame, by: list[str], when: str = "when", t: str = "t", value: str = "value", bucket: int = BUCKET_US) -> DataFrame:
    """The point nearest in time to each query, the earlier on a tie; no pairs are made.

    Points and queries are merged in time order, so each query sees the last point before and the first one after it, also where these
    lie in other buckets of the time axis.  The cost is that of sorting.
    """
    q = queries.withColumn("at_", F.col(when).cast("long")).withColumn("q_", F.lit(1)).withColumn("p_", F.lit(None).cast("struct<t:bigint,value:double>"))
    p = points.groupBy(*by, t).agg(F.first(value).alias(value)).select(
        *by, *(F.lit(None).cast(queries.schema[c].dataType).alias(c) for c in queries.columns if c not in by), F.col(t).cast("long").alias("at_"), F.lit(0).alias("q_"),
        F.struct(F.col(t).cast("long").alias("t"), F.col(value).cast("double").alias("value")).alias("p_"),
    )
    # Points come in order of time, so the last one before is the greatest, the first one after the least.
    both = running(q.unionByName(p), by, ["at_", "q_"], bucket, {"before_": ("max", "p_", "before"), "after_": ("min", "p_", "after")}).where("q_ = 1")
    near = F.when(F.col("after_").isNull() | (F.col("before_").isNotNull() & (F.col("at_") - F.col("before_.t") <= F.col("after_.t") - F.col("at_"))), F.col("before_")).otherwise(F.col("after_"))
    return both.withColumn("near_", near).select(*queries.columns, F.col("near_.t").alias("near_t"), F.col("near_.value").alias("near_value"))


def pending_work(samples: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """Samples without a finished entry of the same key, signature and content hash."""
    return samples.join(done.select(*on).distinct(), on, "left_anti")


def position_times(tokens: DataFrame, words: DataFrame, by: list[str], bucket: int = BUCKET_CHARS) -> DataFrame:
    """For each token the first overlapping word with a valid time, or nulls.  ``words``: word_index, a, b, start_us, end_us, time_valid."""
    good = words.where("time_valid").select(*by, "word_index", "a", "b", "start_us", "end_us")
    pairs = overlap_join(tokens.select(*by, "token_idx", "char_a", "char_b"), good, by, bucket, s="char_a", e="char_b")
    first = pairs.groupBy(*by, "token_idx").agg(F.min(F.struct("word_index", "start_us", "end_us")).alias("w_"))
    out = tokens.join(first, [*by, "token_idx"], "left")
    return out.select(*tokens.columns, "w_.word_index", "w_.start_us", "w_.end_us")


def window_times(windows: DataFrame, times: DataFrame, by: list[str], ids: list[str]) -> DataFrame:
    """Text and time span of position windows ``[start, end)``; ``unresolved`` where no position of it has a time.

    Windows are short, so each names its positions, and positions meet it by equality.
    """
    pos = times.select(*by, F.col("token_idx").alias("pos_"), "token", "start_us", "end_us")
    named = windows.where(F.col("end") > F.col("start")).select(*by, *ids, F.explode(F.sequence("start", F.col("end") - 1)).alias("pos_"))
    out = named.join(pos, [*by, "pos_"]).groupBy(*by, *ids).agg(
        F.min("start_us").alias("from_us"), F.max("end_us").alias("to_us"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos_", "token"))), lambda x: x["token"]), " ").alias("span")
    )
    out = windows.join(out, [*by, *ids], "left")
    return out.withColumn("status", F.when(F.col("from_us").isNotNull(), "aligned").otherwise("unresolved"))


def best_evidence(preds: DataFrame, evidence: DataFrame, by: list[str]) -> DataFrame:
    """The strongest aligned window of the main modality, the earlier on a tie; blanks where there is none."""
    good = evidence.where("status = 'aligned'").join(preds.select(*by, "main"), by).where(F.col("modality") == F.col("main"))
    best = good.groupBy(*by).agg(F.max_by(F.struct("start", "end", "drop"), F.struct("drop", -F.col("start"))).alias("w_"))
    return preds.join(best, by, "left").select(*preds.columns, "w_.start", "w_.end", "w_.drop")


def evidence_cards(evidence: DataFrame, by: list[str], k: int = 5, score: str = "drop", ties: tuple[str, ...] = ("modality", "start")) -> DataFrame:
    """The ``k`` strongest evidences of each sample, with ``rank`` from 1 and their status."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), *ties)
    return evidence.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def evidence_string(evidence: DataFrame, by: list[str]) -> DataFrame:
    """``modality:start-last`` of all windows of a sample, in order, joined by ``;``.  A sample's windows are bounded by its positions."""
    item = F.array_sort(F.collect_list(F.struct("modality", "start", (F.col("end") - 1).alias("last"))))
    text = F.transform(item, lambda x: F.concat(x["modality"], F.lit(":"), x["start"].cast("string"), F.lit("-"), x["last"].cast("string")))
    return evidence.groupBy(*by).agg(F.array_join(text, ";").alias("evidence"))


def reference_hypothesis(turns: DataFrame, by: list[str], turn: str = "turn", role: str = "role", words: str = "words") -> DataFrame:
    """Each user turn as ``ref`` with the assistant turn that follows it as ``hyp``."""
    ref = turns.where(F.col(role) == "user").select(*by, turn, F.col(words).alias("ref"))
    hyp = turns.where(F.col(role) == "assistant").select(*by, (F.col(turn) - 1).alias(turn), F.col(words).alias("hyp"))
    return ref.join(hyp, [*by, turn])


def join_predictions(preds: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Stacked predictions of several models in one row for each sample: how many models, and the mean of each column."""
    return preds.groupBy(*by).agg(F.count("*").alias("models"), *(F.avg(c).alias(c) for c in columns))


def annotate_with_audit(rows: DataFrame, audit: DataFrame, key: str, suspect: float = 0.9) -> DataFrame:
    """``grp`` of each row by its transcript's audit (key, status, wer): not comparable without one, highly suspect above ``suspect``."""
    told = audit.groupBy(key).agg(F.max("wer").alias("wer_"), F.bool_or(F.col("status").isNotNull()).alias("told_"))
    grp = F.when(F.coalesce("told_", F.lit(False)), F.when(F.col("wer_") > suspect, "high_suspect").otherwise("not_flagged")).otherwise("not_comparable")
    return rows.join(told, key, "left").withColumn("grp", grp).drop("wer_", "told_")


#: Words of a passage that two texts must share to be compared, and buckets in which passages are counted, in so many slices.
PASSAGE, BUCKETS, SLICES = 3, 1 << 20, 16
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Words of the texts that are taken at once; texts of such a block have numbers of 16 bits there.
BLOCK_WORDS, BLOCK_TEXTS = 1 << 20, 1 << 16
#: Least and most passages that meet at once, pairs that are made at once, parts of a block of which the range of lengths is told, and places told apart in a text.
LEAST_MEET, MOST_MEET, PIECE_PAIRS, LENGTHS, PLACES = 1 << 16, 1 << 21, 1 << 20, 32, 32
#: Of each text so many of its passages by hash, how many of them other texts must have, and how many texts, for it to be in a group; most texts in groups, and words of a part of one.
TOKENS, SHARED, GROUP, MOST_GROUPED, PART_WORDS = 8, 1, 64, 1 << 20, 3 << 19
#: How texts are written: words come again and again, so dictionaries of up to 16 MB, and what is left in few bytes.
PACKED = {"compression": "zstd", "parquet.dictionary.page.size": 1 << 24}
#: Ids to a string of bits, as Spark's bitmap functions have them.
BITS = 1 << 15


def most_edits(n, most: float):
    """How many edits the longer text of a pair, of n words, is away at most."""
    return np.floor(np.asarray(n) * most + 1e-9).astype(np.int64)


def passage_length(n, most: float):
    """So many words that a text of n words holds more disjoint passages than edits."""
    return np.clip(n // (most_edits(n, most) + 1), 1, PASSAGE)


def taken_passages(n, most: float):
    """How many disjoint passages a text of n words takes: the edits plus some, of which at least the latter are in any text within reach."""
    edits = most_edits(n, most)
    return np.minimum(edits + 1 + edits // 8, n // passage_length(n, most))


def met_lengths(n: np.ndarray, most: float) -> np.ndarray:
    """For texts of n words, whether each length up to ``PASSAGE`` is one that a text may take which is as long or longer and within reach."""
    furthest = np.floor(n / (1 - most) + 1e-9).astype(np.int64)
    taken = passage_length(np.arange(int(furthest.max(initial=0)) + 1), most)
    upto = np.cumsum(taken[:, None] == np.arange(1, PASSAGE + 1), axis=0)
    return upto[furthest] - upto[np.maximum(n - 1, 0)] > 0


def bits_of(ids: DataFrame) -> dict[int, bytes]:
    """The numbers ``id_`` as strings of bits: one bit a number reaches the driver."""
    at = F.col("id_") + 1
    rows = ids.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    return {r["bucket"] - 1: bytes(r["bits"]) for r in rows}


def _among(ids: np.ndarray, bits: dict[int, bytes] | None) -> np.ndarray:
    """Which ids are in ``bits``; all where there are none."""
    out = np.ones(len(ids), dtype=bool)
    for bucket in np.unique(ids // BITS).tolist() if bits is not None else ():
        here = np.flatnonzero(ids // BITS == bucket)
        told = np.unpackbits(np.frombuffer(bits.get(bucket, bytes(BITS // 8)), dtype=np.uint8), bitorder="little")
        out[here] = told[ids[here] % BITS] > 0
    return out


def _blocks(batches, bits: dict[int, bytes] | None):
    """(ids, starts, lengths, words) of blocks of the texts of batches ``(id, start, words)``, ids rising within less than ``BLOCK_TEXTS``."""
    held, words = [], 0

    def told():
        ids, starts, codes = zip(*held, strict=True)
        return np.array(ids), np.array(starts), np.array([len(c) for c in codes]), np.concatenate(codes)

    for b in batches:
        ids, starts, lists = (b.column(i) for i in range(3))
        ids, starts = ids.to_numpy(), starts.to_numpy()
        at, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(_among(ids, bits)).tolist():
            if held and (words >= BLOCK_WORDS or not held[-1][0] < ids[i] < held[0][0] + BLOCK_TEXTS):
                yield told()
                held, words = [], 0
            held.append((ids[i], starts[i], values[at[i] : at[i + 1]].copy()))
            words += len(held[-1][2])
    if held:
        yield told()


def _passages(starts: np.ndarray, n: np.ndarray, codes: np.ndarray, some: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of the passages of ``length`` words of some texts of a block: 64-bit hashes, texts and places."""
    text = np.repeat(np.arange(len(n), dtype=np.int32), n)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(n) - n, n)
    at = np.flatnonzero(some[text] & (place <= n[text] - length))
    text, place = text[at], place[at].astype(np.int32)
    x = starts.view(np.uint64)[text] * _MIX + np.uint64(length)
    for k in range(length):
        x = (x ^ (x >> np.uint64(29)) ^ codes[at + k].view(np.uint64)) * _MIX
    return x ^ (x >> np.uint64(32)), text, place


def _bucket(keys: np.ndarray) -> np.ndarray:
    return (keys % np.uint64(BUCKETS)).astype(np.int64)


def _tokens(keys: np.ndarray, text: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts and hashes: of each text the first ``TOKENS`` passages by hash, of those hashes that are low for its length."""
    low = np.flatnonzero((keys >> np.uint64(32)).astype(np.float64) * n[text] < 4 * TOKENS * 2.0**32)
    order = low[np.lexsort((keys[low], text[low]))]
    k, t = keys[order], text[order]
    once = np.append(True, (k[1:] != k[:-1]) | (t[1:] != t[:-1]))[: len(k)]
    k, t = k[once], t[once]
    first = np.arange(len(t)) - np.searchsorted(t, t) < TOKENS
    return t[first], k[first].view(np.int64)


def passage_counts(texts: DataFrame, most: float, bits: dict[int, bytes] | None = None) -> tuple[np.ndarray, DataFrame]:
    """Of each bucket of passages' hashes, how many texts have one in it, and ``(id_, token_)``: the first passages of each text by hash.

    The buckets are of a fixed number, whatever the texts.
    """
    names = ["id_", "token_", "slice_", "data_"]

    def run(batches):
        total = np.zeros(BUCKETS, dtype=np.int64)
        for ids, starts, n, codes in _blocks(batches, bits):
            own = passage_length(n, most)
            for length in np.unique(own).tolist():
                keys, text, _ = _passages(starts, n, codes, own == length, length)
                both = np.sort(text.astype(np.int64) * BUCKETS + _bucket(keys))
                total += np.bincount(both[np.append(True, both[1:] != both[:-1])[: len(both)]] % BUCKETS, minlength=BUCKETS)
                text, tokens = _tokens(keys, text, n)
                yield pa.RecordBatch.from_arrays([pa.array(ids[text]), pa.array(tokens), pa.nulls(len(text), pa.int32()), pa.nulls(len(text), pa.binary())], names=names)
        data = [_packed([c]) for c in np.split(total, SLICES)]
        yield pa.RecordBatch.from_arrays([pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.int64()), pa.array(range(SLICES), type=pa.int32()), pa.array(data)], names=names)

    def added(batches):
        total = {}
        for b in batches:
            for slice_, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[slice_] = total.get(slice_, 0) + _unpacked(data, BUCKETS // SLICES, 1)[0]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), type=pa.int32()), pa.array([_packed([c]) for c in total.values()], type=pa.binary())], names=names[2:])

    rows = written(texts.mapInArrow(run, "id_ long, token_ long, slice_ int, data_ binary"), "counts", PACKED)
    sums = rows.where("slice_ is not null").select("slice_", "data_").repartition("slice_").mapInArrow(added, "slice_ int, data_ binary")
    out = np.zeros((SLICES, BUCKETS // SLICES), dtype=np.uint32)
    for slice_, data in sums.collect():  # one row a slice
        out[slice_] = _unpacked(bytes(data), BUCKETS // SLICES, 1)[0]
    return out.ravel(), rows.where("id_ is not null").select("id_", "token_")


class _Groups:
    """Texts in groups, by rising id: ``ids``, their ``label`` (from 1), ``sought``, ``offered``, ``rank`` (by key), the ``part`` of their group, and ``cells``: of each part the pairs of parts it is in.

    A part holds some ``PART_WORDS`` words, so what meets at once is bounded however large a group is.
    """

    def __init__(self, ids, label, n, sought, offered, rank, most: float):
        order = np.lexsort((ids, n, label))
        first = np.searchsorted(label[order], label[order])
        words = np.cumsum(n[order])
        place = (words - (words - n[order])[first]) // PART_WORDS
        new = np.append(True, (label[order][1:] != label[order][:-1]) | (place[1:] != place[:-1]))[: len(order)]
        part = np.empty(len(ids), dtype=np.int64)
        part[order] = np.cumsum(new) - 1
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(order))[: len(begin)] - 1
        least, greatest, of = n[order][begin].tolist(), n[order][end].tolist(), label[order][begin].tolist()
        self.cells: list[list[tuple[int, int]]] = [[] for _ in of]
        cell = 0
        for i in range(len(of)):  # lengths rise from part to part of a group
            j = i
            while j < len(of) and of[j] == of[i] and greatest[i] >= (1 - most) * least[j] - 1e-6:
                self.cells[i].append((cell, 0))
                if i != j:
                    self.cells[j].append((cell, 1))
                cell, j = cell + 1, j + 1
        back = np.argsort(ids)
        self.ids, self.label, self.sought, self.offered = ids[back], label[back].astype(np.int32), sought[back], offered[back]
        self.rank, self.part = rank[back].astype(np.int32), part[back].astype(np.int32)

    def find(self, ids: np.ndarray) -> np.ndarray:
        """Where each id stands here, or -1."""
        if not len(self.ids):
            return np.full(len(ids), -1)
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return np.where(self.ids[at] == ids, at, -1)

    def labels(self, ids: np.ndarray) -> np.ndarray:
        """The label of each id, 0 where it is in no group."""
        at = self.find(ids)
        return np.where(at >= 0, self.label[at], 0) if len(self.ids) else np.zeros(len(ids), dtype=np.int32)


def text_groups(tokens: DataFrame, texts: DataFrame, most: float) -> _Groups:
    """Groups of texts that share most of their first passages by hash, the largest ones if they are many.  ``texts``: id_, n_, sought_, offered_, first_ (key).

    Whatever the groups are, no pair is lost: those of one group meet in it (``group_matches``), all others by passages (``passage_pairs``).
    """
    held = tokens.withColumn("c_", F.count("*").over(Window.partitionBy("token_"))).where(F.col("c_") >= GROUP)
    best = held.groupBy("id_").agg(F.count("*").alias("m_"), F.max(F.struct("c_", "token_")).alias("b_")).where(F.col("m_") >= SHARED).select("id_", F.col("b_.token_").alias("best_"))
    # A token stands for the label that most of its holders have.
    votes = held.select("id_", "token_").join(best, "id_").groupBy("token_", "best_").agg(F.count("*").alias("v_"))
    stands = votes.groupBy("token_").agg(F.max(F.struct("v_", "best_")).alias("s_")).select(F.col("token_").alias("best_"), F.col("s_.best_").alias("label_"))
    labels = best.join(stands, "best_").select("id_", "label_").join(texts.select("id_", "n_", "sought_", "offered_", "first_"), "id_")
    size = Window.partitionBy("label_")
    labels = labels.withColumn("size_", F.count("*").over(size)).where(F.col("size_") >= GROUP)
    got = labels.orderBy(F.desc("size_"), "label_").limit(MOST_GROUPED).orderBy("first_").select("id_", "label_", "n_", "sought_", "offered_").toArrow()
    ids, label, n, sought, offered = (got.column(i).to_numpy() for i in range(5))
    return _Groups(ids.astype(np.int64), np.unique(label, return_inverse=True)[1] + 1, n.astype(np.int64), sought.astype(bool), offered.astype(bool), np.arange(len(ids)), most)


def _nearest(ids: list[int], codes: list[np.ndarray], side: np.ndarray, groups: _Groups, most: float, k: int):
    """(h, r, distance) of the ``k`` nearest of each text, by (distance, key), on the other side of a cell or in a cell of one side.

    How many words two texts have in common bounds their distance from below, so only the likeliest ones are compared.  Common words are
    counted by lists of the texts that hold a word; of words that most texts hold, of those that lack it.
    """
    from ..functions.text import distance_within

    count, n = len(ids), np.array([len(c) for c in codes])
    at = groups.find(np.array(ids))
    sought, offered, rank = groups.sought[at], groups.offered[at], groups.rank[at]
    _, word = np.unique(np.concatenate(codes), return_inverse=True)
    both = np.sort(np.repeat(np.arange(count), n) * (int(word.max()) + 1) + word)
    text, word = np.divmod(both, int(word.max()) + 1)
    nth = np.arange(len(both)) - np.searchsorted(both, both)  # the word's first, second, ... time in the text
    _, item, holders = np.unique(word * (int(nth.max()) + 1) + nth, return_inverse=True, return_counts=True)
    common = np.flatnonzero(2 * holders >= count)
    lacks = np.ones((count, len(common)), dtype=bool)
    usual = 2 * holders[item] >= count
    lacks[text[usual], np.searchsorted(common, item[usual])] = False
    lacking = lacks.sum(axis=1)
    some = ~usual & (holders[item] > 1)
    who, which = np.nonzero(lacks)
    text, item = np.concatenate([text[some], who]), np.concatenate([item[some], common[which]])
    order = np.lexsort((text, item))
    posts, listed = text[order], item[order]
    first, until = np.searchsorted(listed, item), np.searchsorted(listed, item, "right")
    order = np.argsort(text, kind="stable")
    first, many = first[order], (until - first)[order]
    mine = np.searchsorted(text[order], np.arange(count + 1))
    told: dict[tuple[int, int], int | None] = {}
    split = side.any()
    for h in np.flatnonzero(sought).tolist():
        f, m = first[mine[h] : mine[h + 1]], many[mine[h] : mine[h + 1]]
        met = np.bincount(posts[np.repeat(f - (np.cumsum(m) - m), m) + np.arange(m.sum())], minlength=count)
        longer = np.maximum(n, n[h])
        least = longer - (met + (len(common) - lacking[h]) - lacking)
        fits = offered & (least <= most_edits(longer, most))
        fits[h] = False
        if split:
            fits &= side != side[h]
        fit = np.flatnonzero(fits)
        bound = least[fit] / longer[fit]
        best: list[tuple[float, int, int]] = []
        for x in np.lexsort((rank[fit], bound)).tolist():
            r = int(fit[x])
            if len(best) == k and (bound[x], rank[r]) > best[-1][:2]:
                break
            pair = (min(h, r), max(h, r))
            if pair not in told:
                if len(told) > PIECE_PAIRS:
                    told.clear()
                told[pair] = distance_within(codes[h], codes[r], int(most_edits(longer[r], most)))
            if told[pair] is not None and told[pair] / int(longer[r]) <= most:
                best = sorted([*best, (told[pair] / int(longer[r]), int(rank[r]), r)])[:k]
        for distance, _, r in best:
            yield ids[h], ids[r], distance


def group_matches(texts: DataFrame, groups: _Groups, most: float, k: int) -> DataFrame:
    """``(h, r, distance)``: of each sought text in a group the offered ones of its group that may be among its ``k`` nearest by (distance, key).

    A cell holds two parts of a group at most; what leaves it is at most ``k`` rows a text, not a row a pair.
    """

    def cells(batches):
        for b in batches:
            at = groups.find(b.column(0).to_numpy())
            rows = [(i, cell, side) for i in np.flatnonzero(at >= 0).tolist() for cell, side in groups.cells[groups.part[at[i]]]]
            if rows:
                i, cell, side = (np.array(c, dtype=t) for c, t in zip(zip(*rows, strict=True), (np.int64, np.int64, np.int32), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(side), b.column(0).take(pa.array(i)), b.column(1).take(pa.array(i))], names=["cell_", "side_", "id_", "codes_"])

    def run(batches):
        held, now = [], None

        def told():
            ids, sides, codes = zip(*held, strict=True)
            rows = list(_nearest(list(ids), list(codes), np.array(sides), groups, most, k))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["h", "r", "distance"])

        for b in batches:
            at, values = b.column(3).offsets.to_numpy(), b.column(3).values.to_numpy(zero_copy_only=False)
            for i, (cell, side, name) in enumerate(zip(*(b.column(c).to_pylist() for c in range(3)), strict=True)):
                if held and cell != now:
                    yield from told()
                    held = []
                now = cell
                held.append((name, side, values[at[i] : at[i + 1]].copy()))
        if held:
            yield from told()

    rows = texts.select("id_", "codes_").mapInArrow(cells, "cell_ long, side_ int, id_ long, codes_ array<long>")
    return rows.repartition("cell_").sortWithinPartitions("cell_").mapInArrow(run, "h long, r long, distance double")


def _rarest(keys: np.ndarray, text: np.ndarray, often: np.ndarray, most_of: np.ndarray) -> np.ndarray:
    """Which passages are among the rarest of their text, as many as ``most_of`` says of each."""
    order = np.lexsort((keys, often[_bucket(keys)], text))
    told = text[order]
    rank = np.arange(len(told)) - np.searchsorted(told, told)
    out = np.zeros(len(keys), dtype=bool)
    out[order] = rank < most_of[told]
    return out


def _packed(columns: list[np.ndarray]) -> bytes:
    """Columns of whole numbers in few bytes: each byte of them by itself, as the high ones are alike."""
    codec, sizes, parts = pa.Codec("zstd", compression_level=1), [], []
    for c in columns:
        planes = (int(c.max(initial=0)).bit_length() + 7) // 8
        sizes.append(planes)
        for plane in np.ascontiguousarray(c, dtype="<u8").view(np.uint8).reshape(-1, 8).T[:planes]:
            raw = plane.tobytes()
            small = codec.compress(raw, asbytes=True)
            sizes.append(len(small) if len(small) < len(raw) else 0)
            parts.append(small if len(small) < len(raw) else raw)
    return np.array(sizes, dtype="<i4").tobytes() + b"".join(parts)


def _unpacked(data: bytes, rows: int, columns: int) -> list[np.ndarray]:
    codec, read, head, out = pa.Codec("zstd"), 0, [], []
    for _ in range(columns):
        planes = int(np.frombuffer(data, "<i4", 1, read)[0])
        head.append(np.frombuffer(data, "<i4", planes, read + 4).tolist())
        read += 4 + 4 * planes
    for sizes in head:
        c = np.zeros((rows, 8), dtype=np.uint8)
        for i, size in enumerate(sizes):
            part = data[read : read + (size or rows)]
            c[:, i] = np.frombuffer(codec.decompress(part, decompressed_size=rows, asbytes=True) if size else part, dtype=np.uint8)
            read += size or rows
        out.append(c.view("<u8")[:, 0])
    return out


def _parts(block, often: np.ndarray, most: float, kept_bits: int, ranges: int):
    """``(range, base, entries, lengths, data)`` of a block: its passages in each range of their hashes' first bits, in few bytes.

    An entry is a passage of a text, once: first bits of its hash, text, first and last place in steps of the text's part of the block,
    how often the text takes it as one of its rarest disjoint ones, and how often it stands there besides, apart from itself.  ``lengths``: least and greatest number of words in parts of the block.
    """
    ids, starts, n, codes = block
    own, met, some = passage_length(n, most), met_lengths(n, most), []
    for length in range(1, PASSAGE + 1):
        keys, text, place = _passages(starts, n, codes, met[:, length - 1], length)
        apart = np.flatnonzero((own == length)[text] & (place % length == 0))
        taken = np.zeros(len(keys), dtype=bool)
        taken[apart] = _rarest(keys[apart], text[apart], often, taken_passages(n, most))
        some.append((keys >> np.uint64(64 - kept_bits), text, place, taken, np.full(len(keys), length, dtype=np.int8)))
    keys, text, place, taken, long = (np.concatenate(c) for c in zip(*some, strict=True))
    number = (ids - ids[0]).astype(np.uint64)
    both = keys << np.uint64(16) | number[text]
    order = np.argsort(both, kind="stable")
    both, place, taken, long = both[order], place[order], taken[order], long[order]
    first = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1]))) if len(both) else np.zeros(0, dtype=np.int64)
    if not len(first):
        return
    low, high, times = np.minimum.reduceat(place, first), np.maximum.reduceat(place, first), np.add.reduceat(taken.astype(np.int32), first)
    # Of those that a text repeats, so many can stand apart.
    spare = np.minimum(np.diff(np.append(first, len(both))) - 1, (high - low) // np.minimum.reduceat(long, first))
    keys, number_ = both[first] >> np.uint64(16), (both[first] & np.uint64(0xFFFF)).astype(np.int64)
    part = number.astype(np.int64) // _part_width(int(number[-1]))
    lengths = np.zeros((2, LENGTHS), dtype="<i4")
    lengths[0] = np.iinfo(np.int32).max
    np.minimum.at(lengths[0], part, n)
    np.maximum.at(lengths[1], part, n)
    step = _steps(lengths[0])[number_ // _part_width(int(number[-1]))]
    low, high = low // step, high // step
    cut = np.searchsorted(keys, _bounds(kept_bits, ranges)).tolist() + [len(keys)]
    for r in np.flatnonzero(np.diff(cut)).tolist():
        x = slice(cut[r], cut[r + 1])
        gap = np.diff(keys[x], prepend=_bounds(kept_bits, ranges)[r])
        yield r, int(ids[0]), int(number[-1]), cut[r + 1] - cut[r], lengths.tobytes(), _packed([gap, number_[x], low[x], (high - low)[x], times[x], spare[x]])


def _part_width(last: int) -> int:
    return last // LENGTHS + 1


def _steps(least: np.ndarray) -> np.ndarray:
    return np.maximum(1, least.astype(np.int64) // PLACES)


def _bounds(kept_bits: int, ranges: int) -> np.ndarray:
    """Where each range of the hashes' first bits begins."""
    return np.array([(r << kept_bits) // ranges for r in range(ranges)], dtype=np.uint64)


PARTS = "range_ int, base_ long, last_ int, entries_ int, lengths_ binary, data_ binary"


def _part_rows(texts: DataFrame, often: np.ndarray, most: float, kept_bits: int, ranges: int, bits: dict[int, bytes] | None) -> DataFrame:
    def run(batches):
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        names = [c.split()[0] for c in PARTS.split(", ")]
        for block in _blocks(batches, bits):
            rows = list(_parts(block, often, most, kept_bits, ranges))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return texts.mapInArrow(run, PARTS)


def _meet(rows: list[dict], most: float, kept_bits: int, ranges: int, groups: _Groups | None):
    """(a, b, times, need) of texts of one range of hashes: a may be the longer one, and so many of the passages that it takes are in b, of ``need`` at least in all.

    Lengths and places are known within bounds alone, so what surely doesn't fit is left out.  Texts of one group don't meet.
    """
    some, starts = [], _bounds(kept_bits, ranges)
    for i, r in enumerate(rows):
        gap, number, low, more, times, spare = _unpacked(r["data_"], r["entries_"], 6)
        part = number.astype(np.int64) // _part_width(r["last_"]) + i * LENGTHS
        some.append((np.cumsum(gap) + starts[r["range_"]], number.astype(np.int64) | i << 16, part.astype(np.int32), low.astype(np.int32), (low + more).astype(np.int32), times.astype(np.int32), spare.astype(np.int32) + 1))
    keys, text, part, low, high, times, spots = (np.concatenate(c) for c in zip(*some, strict=True))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.concatenate(([True], keys[1:] != keys[:-1]))
    first, group = np.flatnonzero(new), np.cumsum(new) - 1
    size = np.diff(np.append(first, len(keys)))
    seek = (times[order] > 0) & (size[group] > 1)
    wanted = np.bincount(group[seek], minlength=len(first)) > 0
    order, group = order[wanted[group]], group[wanted[group]]
    if not len(order):
        return
    base = np.array([r["base_"] for r in rows])
    ids = base[text[order] >> 16] + (text[order] & 0xFFFF)
    label = np.zeros(len(order), dtype=np.int32) if groups is None else groups.labels(ids)
    by = np.lexsort((label, group))
    order, group, ids, label = order[by], group[by], ids[by], label[by]
    text, part, low, high, times, spots = text[order], part[order], low[order], high[order], times[order], spots[order]
    new = np.concatenate(([True], group[1:] != group[:-1]))
    first, group = np.flatnonzero(new), np.cumsum(new) - 1
    size = np.diff(np.append(first, len(group)))
    # What an entry meets: the others of its key before and after those of its own group.
    new |= np.concatenate(([True], label[1:] != label[:-1]))
    alike, of = np.flatnonzero(new), np.cumsum(new) - 1
    ended = np.append(alike[1:], len(label))
    begin, stop = np.where(label > 0, alike[of], first[group] + size[group]), np.where(label > 0, ended[of], first[group] + size[group])
    lengths = np.concatenate([np.frombuffer(r["lengths_"], "<i4").reshape(2, LENGTHS) for r in rows], axis=1).astype(np.int64)
    step = _steps(lengths[0])[part]
    least, greatest = lengths[0][part], lengths[1][part]
    low, high = low * step, (high + 1) * step - 1
    edits = most_edits(greatest, most)
    # The least that any text asks for which is as long or longer.
    n = np.arange(int(greatest.max()) + 1)
    need = np.minimum.accumulate((taken_passages(n, most) - most_edits(n, most))[::-1])[::-1]
    seek = np.flatnonzero(times > 0)
    seek = np.concatenate([seek, seek])
    start = first[group[seek]]
    start[len(seek) // 2 :] = stop[seek[len(seek) // 2 :]]
    met = np.where(np.arange(len(seek)) < len(seek) // 2, begin[seek], (first + size)[group[seek]]) - start
    seek, start, met = seek[met > 0], start[met > 0], met[met > 0]
    until = np.cumsum(met)
    at = 0
    while at < len(seek):
        end = max(at + 1, int(np.searchsorted(until, (until[at - 1] if at else 0) + PIECE_PAIRS, "right")))
        a = seek[at:end]
        many = met[at:end]
        b = np.repeat(start[at:end] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        a = np.repeat(a, many)
        longest, shortest = greatest[a] - least[b], np.maximum(least[a] - greatest[b], 0)  # bounds of how much longer a is
        fits = (text[a] != text[b]) & (longest >= 0) & (shortest <= edits[a]) & (2 * (low[a] - high[b]) <= edits[a] + np.minimum(longest, edits[a])) & (2 * (low[b] - high[a]) <= edits[a] - shortest)
        a, b = a[fits], b[fits]
        # One row for each pair of texts of this piece.
        pair = np.lexsort((text[b], text[a]))
        a, b = a[pair], b[pair]
        if len(a):
            once = np.flatnonzero(np.concatenate(([True], (text[a][1:] != text[a][:-1]) | (text[b][1:] != text[b][:-1]))))
            yield ids[a[once]], ids[b[once]], np.add.reduceat(np.minimum(times[a], spots[b]), once), need[least[a[once]]]
        at = end


def _met_rows(parts: DataFrame, most: float, kept_bits: int, ranges: int, groups: _Groups | None) -> DataFrame:
    """``(a, b, times_, need_)`` of what ``_meet`` tells of each range; a range is in one task, one after another."""

    def run(batches):
        held = []

        def told():
            for a, b, times, need in _meet(held, most, kept_bits, ranges, groups):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(times, type=pa.int32()), pa.array(need, type=pa.int32())], names=["a", "b", "times_", "need_"])

        for batch in batches:
            for r in batch.to_pylist():
                if held and held[0]["range_"] != r["range_"]:
                    yield from told()
                    held = []
                held.append(r)
        if held:
            yield from told()

    return parts.repartition("range_").sortWithinPartitions("range_").mapInArrow(run, "a long, b long, times_ int, need_ int")


def passage_pairs(texts: DataFrame, most: float, bits: dict[int, bytes] | None = None, often: np.ndarray | None = None, groups: _Groups | None = None) -> DataFrame:
    """``(a, b)``: pairs of texts ``(id_, start_, codes_)`` of one start that may be within ``most`` of the longer one's words, ``a`` being the longer one.

    The longer text's rarest passages meet all passages of the shorter one.  A passage that stands as it was has moved by no more than the
    edits before it and the edits after it, so places must fit too.  Of a passage that a text repeats, the first and the last place go along.

    No passage is a row: a block of texts sends its passages in ranges of their hashes, as differences of neighbours, of which only so many
    bits are kept that few passages meet by chance.  So a word of text takes some four bytes of the shuffle.  ``bits``: the texts that count; ``often``:
    how often passages come (``passage_counts``); ``groups``: of which no two texts meet here.
    """
    rows = texts.where("start_ is not null").select("id_", "start_", "codes_")
    often = passage_counts(rows, most, bits)[0] if often is None else often
    total = max(int(often.sum()), 1)
    kept_bits = min(total.bit_length() + 6, 46)
    ranges = -(-total // min(max(total // 64, LEAST_MEET), MOST_MEET))
    met = _met_rows(_part_rows(rows, often, most, kept_bits, ranges, bits), most, kept_bits, ranges, groups)
    met = met.groupBy("a", "b").agg(F.sum("times_").alias("times_"), F.first("need_").alias("need_")).where("times_ >= need_")
    n = texts.select("id_", (F.col("n_") if "n_" in texts.columns else F.size("codes_")).alias("n_"))
    sized = met.join(n.toDF("a", "n_a"), "a").join(n.toDF("b", "n_b"), "b")
    edits = F.floor(F.col("n_a") * most + 1e-9)
    length = F.greatest(F.lit(1), F.least(F.lit(PASSAGE), F.floor(F.col("n_a") / (edits + 1))))
    need = F.least(edits + 1 + F.floor(edits / 8), F.floor(F.col("n_a") / length)) - edits
    longer = (F.col("n_a") > F.col("n_b")) | (F.col("n_a") == F.col("n_b")) & (F.col("a") > F.col("b"))
    return sized.where(longer & (F.col("n_a") - F.col("n_b") <= edits) & (F.col("times_") >= need)).select("a", "b")


def _only(texts: DataFrame, bits: dict[int, bytes]) -> DataFrame:
    """The texts ``(id_, codes_)`` whose number is in ``bits``."""

    def run(batches):
        for b in batches:
            here = _among(b.column(0).to_numpy(), bits)
            if here.any():
                yield b.filter(pa.array(here))

    rows = texts.select("id_", "codes_")
    return rows.mapInArrow(run, rows.schema)


def alternative_matches(hyp: DataFrame, refs: DataFrame | None, block: list[str], least_words: int = 5, most: float = 0.25, gain: float = 0.3, k: int = 3) -> DataFrame:
    """Other references that fit a hypothesis well where its own doesn't: up to ``k`` by (distance, key).

    ``hyp``: key, words, own (own distance); ``refs``: key, words, or None where all of ``hyp`` are the references.  Equal texts are one
    class, of which the first ``k + 1`` keys can be among the best; so copies make no pairs.  Classes are compared where they share enough
    passages (``passage_pairs``), each pair once; within large groups of near copies (``text_groups``) they are compared in memory, the likeliest
    first, until no other can be among the best (``group_matches``).  Words are written once; of them only the texts of pairs and groups are shuffled.
    """
    from ..functions.text import coded, coded_distance_within, normalized_distance

    start = F.when(F.array_position(F.array(F.lit(False), *(F.col(c).isNull() for c in block)), True) == 0, F.xxhash64(F.lit(0), *block))  # no block, no pairs
    own = F.col("own").cast("double")
    sought = F.coalesce(own >= gain, F.lit(False))

    def side(df, own, sought, offered):
        kept = df.where(F.size("words") >= least_words).select(
            "key", own.alias("own"), F.unhex(F.sha2(F.to_json(F.struct(*block, "words")), 256)).alias("cls_"), start.alias("start_"),
            F.size("words").alias("n_"), sought.alias("sought_"), F.lit(offered).alias("offered_"), coded(F.col("words")).alias("codes_"),
        )
        return kept.where("sought_ or offered_")

    rows = side(hyp, own, sought, refs is None)
    if refs is not None:
        rows = rows.unionByName(side(refs, F.lit(None).cast("double"), F.lit(False), True))
    # Texts of like lengths stand together, so a block's numbers of texts and their lengths are told in few bytes.
    texts = written(rows.sortWithinPartitions("n_").withColumn("id_", F.monotonically_increasing_id()), "texts", PACKED)
    classes = written(texts.groupBy("cls_").agg(F.min("id_").alias("id_"), F.first("n_").alias("n_"), F.min(F.when(F.col("offered_"), F.col("key"))).alias("first_"), F.max("sought_").alias("sought_"), F.max("offered_").alias("offered_")), "classes")
    members = texts.select("key", "own", "cls_", F.col("sought_").alias("asks_"), F.col("offered_").alias("gives_")).join(classes.select("cls_", "id_"), "cls_").drop("cls_")
    # The first keys of each class, by rank, so that no class is gathered.
    first = Window.partitionBy("id_").orderBy("key")
    keys = members.where("gives_").select("id_", "key").withColumn("r_", F.row_number().over(first)).where(F.col("r_") <= k + 1).groupBy("id_").agg(F.collect_list("key").alias("keys_"))
    part = lambda x: classes.select(*(F.col(c).alias(f"{c}{x}") for c in ("id_", "sought_", "offered_")))
    bits = bits_of(classes)
    often, tokens = passage_counts(texts.where("start_ is not null").select("id_", "start_", "codes_"), most, bits)
    groups = text_groups(tokens, classes, most)
    both = passage_pairs(texts, most, bits, often, groups).join(part("a"), F.col("a") == F.col("id_a")).join(part("b"), F.col("b") == F.col("id_b"))
    both = both.where("sought_a and offered_b or sought_b and offered_a").select("a", "b", (F.col("sought_a") & F.col("offered_b")).alias("ab"), (F.col("sought_b") & F.col("offered_a")).alias("ba"))
    both = written(both, "pairs")
    these = _only(texts, bits_of(both.select(F.explode(F.array("a", "b")).alias("id_"))))
    both = both.join(these.toDF("a", "codes_a"), "a").join(these.toDF("b", "codes_b"), "b")
    n, m = F.size("codes_a"), F.size("codes_b")
    limit = F.floor(n * most + 1e-9).cast("int")
    far = both.withColumn("distance", normalized_distance(coded_distance_within(F.col("codes_a"), F.col("codes_b"), limit), n, m)).where(F.col("distance") <= most)
    ways = F.array(F.struct(F.col("a").alias("h"), F.col("b").alias("r"), F.col("ab").alias("asked")), F.struct(F.col("b").alias("h"), F.col("a").alias("r"), F.col("ba").alias("asked")))
    far = far.select("distance", F.inline(ways)).where("asked").select("h", "r", "distance")
    same = classes.where("sought_ and offered_").select(F.col("id_").alias("h"), F.col("id_").alias("r"), F.lit(0.0).alias("distance"))
    near = far.unionByName(group_matches(texts, groups, most, k + 1)).unionByName(same).join(keys.withColumnRenamed("id_", "r"), "r").select("h", "distance", F.explode("keys_").alias("other"))
    best = Window.partitionBy("h").orderBy("distance", "other")
    near = near.withColumn("r_", F.row_number().over(best)).where(F.col("r_") <= k + 1).select(F.col("h").alias("id_"), "distance", "other")
    good = members.where("asks_").select("id_", "key", "own").join(near, "id_").where((F.col("key") != F.col("other")) & (F.col("own") - F.col("distance") >= gain))
    w = Window.partitionBy("key").orderBy("distance", "other")
    return good.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("key", "other", "distance", "rank")
