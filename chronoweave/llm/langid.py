"""Language identification by multilingual mixture inference.

Character n-gram models, one for each language, are counted on labelled documents.  A document is taken as a mixture: expectation
maximisation estimates the share of its n-grams that each language gave.  Languages enter the document's set one by one, best first,
as long as the log likelihood gains more than the penalty (the Bayesian information criterion's, scaled), so the set of a document in
one language has one element.

Fitting sees a bounded sample: the labelled documents with the smallest hash of their id, about ``TRAIN_DOCUMENTS`` of them.  The model
holds every language of the sample, as the counts that are not 0; languages are scored in blocks, so their number bounds no memory.

Defined results: null, empty and letterless texts are ``und`` with score 0 (numbers and signs are no letters); null labels are not
learned from; repeated rows get equal results; an empty table gives an empty result, and without any labelled document every text is
``und``; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, documents, sliced

TRAIN_DOCUMENTS = 20_000
BUCKETS = 1 << 16
#: Cells (language, n-gram) of a document that are held at once.
CELLS = 1 << 21
#: Languages that a task counts at once while fitting.
COUNTED = 64
PENALTY = 4.0
ROUNDS = 12
NONE = "und"
#: Rows that a task holds as Python objects at once.
SLICE_ROWS = 128


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _bucket_ids(text: str) -> np.ndarray:
    """Buckets of the text's byte trigrams, case folded, with blanks for all ASCII but letters."""
    raw = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace"), dtype=np.uint8)
    raw = _FOLD[raw].astype(np.uint32)
    a, b, c = raw[:-2], raw[1:-1], raw[2:]
    three = (a * 2654435 + b * 40503 + c * 97) & (BUCKETS - 1)
    return three[(a != 32) | (b != 32)]


_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[128:] = np.arange(128, 256)


def _counted(batches):
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])
    totals: dict[str, np.ndarray] = {}

    def told():
        for lang, n in totals.items():
            at = np.flatnonzero(n)
            yield batch(schema, ([lang] * len(at), at, n[at]))
        totals.clear()

    for b in sliced(batches, SLICE_ROWS, 0):
        for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if lang not in totals:
                totals[lang] = np.zeros(BUCKETS, dtype=np.int64)
            totals[lang] += np.bincount(_bucket_ids(text), minlength=BUCKETS)
            if len(totals) >= COUNTED:
                yield from told()
    yield from told()


class Grams:
    """Log probabilities of buckets by language: those of seen buckets, and one number for all unseen buckets of a language."""

    def __init__(self, languages: int, lang: np.ndarray, bucket: np.ndarray, n: np.ndarray):
        order = np.argsort(bucket, kind="stable")
        self.lang, n = lang[order].astype(np.int32), n[order]
        self.ends = np.cumsum(np.bincount(bucket, minlength=BUCKETS))
        total = np.bincount(self.lang, weights=n, minlength=languages) + 0.5 * BUCKETS
        self.unseen = np.log(0.5 / total)
        self.logs = np.log((n + 0.5) / total[self.lang]).astype(np.float32)

    def __len__(self) -> int:
        return len(self.unseen)

    def of(self, ids: np.ndarray) -> Callable[[int, int], np.ndarray]:
        """A function of (low, high) that gives the log probabilities of ``ids`` in these languages."""
        starts = np.where(ids > 0, self.ends[ids - 1], 0)
        n = self.ends[ids] - starts
        column = np.repeat(np.arange(len(ids)), n)
        at = np.arange(len(column)) + np.repeat(starts - np.cumsum(n) + n, n)
        lang, logs = self.lang[at], self.logs[at]

        def block(low: int, high: int) -> np.ndarray:
            out = np.repeat(self.unseen[low:high, None], len(ids), axis=1)
            here = (lang >= low) & (lang < high)
            out[lang[here] - low, column[here]] = logs[here]
            return out

        return block


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", row_id: str = "doc_id", limit: int = TRAIN_DOCUMENTS) -> tuple[list[str], Grams]:
    """Names of the languages, and the log probabilities of their buckets."""
    usable = labelled.where(F.col(text).isNotNull() & F.col(label).isNotNull())
    n = usable.count()
    if n > limit:
        share = F.pmod(F.xxhash64(F.lit(10), F.col(row_id)), F.lit(1_000_000))
        usable = usable.where(share < int(1_000_000 * limit / n))
    counts = usable.select(text, label).mapInArrow(_counted, "lang string, bucket int, n long")
    table = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # buckets of about TRAIN_DOCUMENTS documents
    langs = table.column("lang").combine_chunks().dictionary_encode()
    names = sorted(langs.dictionary.to_pylist())
    place = {name: i for i, name in enumerate(names)}
    lang = np.array([place[x] for x in langs.dictionary.to_pylist()], dtype=np.int64)[langs.indices.to_numpy()]
    return names, Grams(len(names), lang, table.column("bucket").to_numpy(), table.column("n").to_numpy())


def _mixture(p: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Shares of the rows of ``p`` (language x n-gram) in counts ``n``, and their log likelihood."""
    pi = _shares(lambda: [(0, len(p), p)], len(p), n, rounds)
    return pi, float(np.log(np.maximum(pi @ p, 1e-300)) @ n)


def _shares(blocks: Callable, languages: int, n: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Shares of all languages in counts ``n``; each call of ``blocks`` gives (low, high, probabilities) block by block."""
    pi = np.full(languages, 1.0 / languages)
    if languages > 1:
        for _ in range(rounds):
            given = n / sum(pi[low:high] @ p for low, high, p in blocks())
            pi = np.concatenate([pi[low:high] * (p @ given) for low, high, p in blocks()])
            pi /= pi.sum()
    return pi


def infer(text: str, log_p: Grams, penalty: float = PENALTY) -> list[tuple[int, float]]:
    """(language, share) of the chosen set, largest share first."""
    ids, n = np.unique(_bucket_ids(text), return_counts=True)
    if not len(ids) or not len(log_p):
        return []
    n = n.astype(float)
    logs = log_p.of(ids)
    step = max(1, CELLS // len(ids))
    ranges = [(low, min(low + step, len(log_p))) for low in range(0, len(log_p), step)]
    each = lambda: ((low, high, logs(low, high)) for low, high in ranges)
    alone = np.concatenate([x @ n for _, _, x in each()])
    chosen, pi, best = [int(np.argmax(alone))], np.ones(1), float(alone.max())
    if len(log_p) > 1:
        held = [(low, high, np.exp(x)) for low, high, x in each()] if len(ranges) == 1 else None
        full = _shares(lambda: held or ((low, high, np.exp(x)) for low, high, x in each()), len(log_p), n)
        row = lambda k: np.exp(logs(k, k + 1))[0]
        p, cost = [row(chosen[0])], penalty * np.log(max(n.sum(), 2.0))
        for k in np.argsort(-full, kind="stable").tolist():
            if full[k] < 0.02:
                break
            if k in chosen:
                continue
            trial, gained = _mixture(np.array([*p, row(k)]), n)
            if gained - best <= cost:
                break
            chosen, pi, best, p = [*chosen, k], trial, gained, [*p, row(k)]
    return sorted(((k, float(s)) for k, s in zip(chosen, pi, strict=True)), key=lambda x: (-x[1], x[0]))


_OUT = pa.schema([("lang_pred", pa.string()), ("score", pa.float64()), ("languages", pa.list_(pa.string())), ("shares", pa.list_(pa.float64()))])


def identify(
    docs: DataFrame, model: tuple[list[str], Grams], text: str = "text", keep: tuple[str, ...] = ("doc_id",), penalty: float = PENALTY, least_share: float | None = None
) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``lang_pred``, ``score`` (its share), ``languages`` and ``shares`` of the chosen set.

    With ``least_share`` only the rows whose first language has that share or more leave the task; ``und`` rows never do then.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # the counts of about TRAIN_DOCUMENTS documents
    sent = [*keep, *([] if text in keep else [text])]

    def run(batches):
        names, log_p = shared.value
        for b in sliced(batches, SLICE_ROWS, sent.index(text)):
            rows = []
            for t in b.column(sent.index(text)).to_pylist():
                found = infer(t, log_p, penalty) if has_letter(t) else []
                rows.append((names[found[0][0]], min(1.0, found[0][1]), [names[k] for k, _ in found], [s for _, s in found]) if found else (NONE, 0.0, [], []))
            out = batch(_OUT, zip(*rows, strict=True) if rows else [[] for _ in _OUT])
            told = pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *out.columns], names=[*keep, *_OUT.names])
            if least_share is None:
                yield told
            else:
                yield told.filter(pa.array([r[0] != NONE and r[1] >= least_share for r in rows], type=pa.bool_()))

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*sent).mapInArrow(run, f"{kinds}, lang_pred string, score double, languages array<string>, shares array<double>")


def held_out(row_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(row_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those that are not held out."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out()))
    out = identify(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", F.array_join("languages", ",").alias("languages"))
