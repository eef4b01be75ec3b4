"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or abstain on each document.  Expectation maximisation over the counts of all vote
patterns estimates each labeller's accuracy and the share of good documents, with a class for each kind of fault, and gives every pattern a posterior.  The posteriors of a
bounded sample train a hashed linear scorer (logistic regression on hashed byte trigrams and bucketed statistics, by full-batch
gradient steps in one task), which scores all documents.  Where labels of toxicity are given, words and word beginnings that occur
in toxic documents almost alone are learned from a bounded sample of labelled rows and flag the documents that hold them.

Bounds (documented parameters): ``TRAIN_DOCUMENTS`` for the scorer, ``LABELLED_DOCUMENTS`` for the toxic terms, both by the smallest
hash of the id; the vote patterns are counted over all documents.

Defined results: null and empty texts get the posterior of what the labellers say of an empty text; null ids and null labels are not
sampled; repeated rows get equal results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, documents, sliced

TRAIN_DOCUMENTS = 8_000
LABELLED_DOCUMENTS = 20_000
DIMENSIONS = 1 << 15
ROUNDS = 40
#: A toxic term occurs in so many toxic documents of the sample, and has this share of them among all that hold it.
TERM_LEAST, TERM_SHARE = 5, 0.97

LABELLERS = ("symbols", "capitals", "adjacent", "distinct", "lines", "top_word", "length", "word_length", "digits", "marked", "bare", "runs", "trigrams", "packed")
#: Labellers that look at the same kind of fault.
FAMILIES = (
    ("symbols", "capitals", "marked", "bare", "runs"),
    ("adjacent", "distinct", "lines", "top_word", "trigrams", "packed"),
    ("length", "word_length", "digits"),
)
ABSTAIN, BAD, GOOD = 0, 1, 2

_KIND = np.full(256, 5, dtype=np.uint8)  # 0 lower, 1 upper, 2 digit, 3 white, 4 beyond ASCII, 5 symbol
_KIND[ord("a") : ord("z") + 1] = 0
_KIND[ord("A") : ord("Z") + 1] = 1
_KIND[ord("0") : ord("9") + 1] = 2
_KIND[[9, 10, 11, 12, 13, 32]] = 3
_KIND[128:] = 4
_KIND_SYMBOLS = frozenset(np.flatnonzero(_KIND == 5).tolist())
#: Symbols that prose doesn't end its words with.
_MARKS = frozenset(b"!#$%&*+/<=>@\\^_`|~{}[]")


def statistics(text: bytes) -> tuple[float, ...]:
    """Shares that the labellers look at, in their order, and the number of words."""
    n = max(1, len(text))
    raw = np.frombuffer(text, dtype=np.uint8)
    kind = _KIND[raw]
    kinds = np.bincount(kind, minlength=6)
    doubled = int(((raw[1:] == raw[:-1]) & (kind[1:] == 5)).sum())
    words = text.split()
    m = max(1, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    top = Counter(words).most_common(1)[0][1] if words else 0
    return (
        kinds[5] / n, kinds[1] / max(1, kinds[0] + kinds[1] + kinds[4]), sum(map(eq, words, words[1:])) / m, len(set(words)) / m,
        1 - len(set(lines)) / max(1, len(lines)), top / m, float(len(words)), (n - kinds[3]) / m, kinds[2] / n, float(len(lines)),
        sum(w[-1] in _MARKS for w in words) / m, sum(not w.isalnum() and _KIND_SYMBOLS.issuperset(w) for w in words) / m, doubled / n,
        len(set(zip(words, words[1:], words[2:]))) / max(1, len(words) - 2), len(zlib.compress(text, 1)) / n,
    )


def votes(s: tuple[float, ...]) -> tuple[int, ...]:
    """The vote of each labeller on a document's statistics."""
    symbols, capitals, adjacent, distinct, lines, top, n, length, digits, n_lines, marked, bare, runs, trigrams, packed = s

    def vote(bad: bool, good: bool) -> int:
        return BAD if bad else GOOD if good else ABSTAIN

    return (
        vote(symbols > 0.06, symbols < 0.045) if n >= 8 else ABSTAIN,
        vote(capitals > 0.25, capitals < 0.1) if n >= 8 else ABSTAIN,
        vote(adjacent > 0.15, adjacent < 0.05) if n >= 8 else ABSTAIN,
        vote(distinct < 0.35 and n < 20_000, distinct > 0.5) if n >= 30 else ABSTAIN,
        vote(lines > 0.3, lines < 0.1) if n_lines >= 4 else ABSTAIN,
        vote(top > 0.115, top < 0.1) if n >= 30 else ABSTAIN,
        vote(n < 1, n >= 20),
        vote(not 2.5 <= length <= 16, 3 <= length <= 11),
        vote(digits > 0.25, digits < 0.08),
        vote(marked > 0.2, marked < 0.05) if n >= 8 else ABSTAIN,
        vote(bare > 0.15, bare < 0.04) if n >= 8 else ABSTAIN,
        vote(runs > 0.02, runs < 0.005) if n >= 8 else ABSTAIN,
        vote(trigrams < 0.4, trigrams > 0.75) if n >= 30 else ABSTAIN,
        vote(packed < 0.2, packed > 0.3) if n >= 30 else ABSTAIN,
    )


def pattern(v: tuple[int, ...]) -> int:
    return sum(x * 3**i for i, x in enumerate(v))


def label_model(counts: dict[int, int], rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(shares of the classes, probability of each labeller's vote by class) by expectation maximisation over pattern counts.

    Class 0 is good; a document can be bad in several ways, each a class of its own that starts at one family of labellers, since
    labellers that look at different faults don't agree on which documents are bad.
    """
    codes = np.array(sorted(counts), dtype=np.int64)
    n = np.array([counts[int(c)] for c in codes], dtype=float)
    v = (codes[:, None] // 3 ** np.arange(len(LABELLERS))) % 3
    shares = np.array([0.8] + [0.2 / len(FAMILIES)] * len(FAMILIES))
    p = np.full((1 + len(FAMILIES), len(LABELLERS), 3), (0.3, 0.15, 0.55))
    p[0] = (0.3, 0.04, 0.66)
    for k, family in enumerate(FAMILIES):
        p[k + 1, [LABELLERS.index(x) for x in family]] = (0.3, 0.55, 0.15)
    for _ in range(rounds if len(codes) else 0):
        w = _classes(v, shares, p) * n[:, None]
        shares = np.maximum(w.sum(axis=0) / n.sum(), 1e-4)
        shares /= shares.sum()
        for k in range(3):
            p[:, :, k] = w.T @ (v == k) + 0.5
        p /= p.sum(axis=2, keepdims=True)
    return shares, p


def _classes(v: np.ndarray, shares: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Posterior of each class for rows of votes; an abstention says nothing."""
    told = np.log(p / p[:, :, 1:].sum(axis=2, keepdims=True))
    at = np.arange(v.shape[1])
    logs = np.log(shares) + np.stack([np.where(v > 0, told[c][at, v], 0.0).sum(axis=1) for c in range(len(p))], axis=1)
    logs = np.exp(logs - logs.max(axis=1, keepdims=True))
    return logs / logs.sum(axis=1, keepdims=True)


def _posterior(v: np.ndarray, shares: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Probability that a document with these votes is good."""
    return _classes(v, shares, p)[:, 0]


def features(text: bytes, s: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features: relative weights of byte trigrams, and one for each statistic's bucket."""
    raw = np.frombuffer(b" " + text + b" ", dtype=np.uint8).astype(np.uint32)
    ids, n = np.unique(((raw[:-2] * 2654435) ^ (raw[1:-1] * 40503) ^ (raw[2:] * 97)) % np.uint32(DIMENSIONS - 1024), return_counts=True)
    x = np.sqrt(n / max(1, n.sum())).astype(np.float32)
    shown = np.array([DIMENSIONS - 1024 + (i * 101 + int(min(20, v * 40 if i not in (6, 7, 9) else math.log2(1 + v)))) % 1024 for i, v in enumerate(s)])
    return np.concatenate((ids.astype(np.int32), shown.astype(np.int32))), np.concatenate((x, np.full(len(shown), 0.3, dtype=np.float32)))


def _patterns(batches):
    seen: Counter[int] = Counter()
    for b in sliced(batches, 256, 0):
        for t in b.column(0).cast(pa.binary()).to_pylist():
            seen[pattern(votes(statistics(t or b"")))] += 1
    yield batch(pa.schema([("pattern", pa.int64()), ("n", pa.int64())]), (seen.keys(), seen.values()))


def _rows_of(model):
    prior, p = model
    schema = pa.schema([("target", pa.float64()), ("ids", pa.list_(pa.int32())), ("x", pa.list_(pa.float32()))])

    def run(batches):
        for b in sliced(batches, 256):
            rows = []
            for t in b.column(0).cast(pa.binary()).to_pylist():
                s = statistics(t or b"")
                good = float(_posterior(np.array([votes(s)]), prior, p)[0])
                rows.append((good, *features(t or b"", s)))
            yield batch(schema, zip(*rows, strict=True) if rows else [[], [], []])

    return run


def _trained(rounds: int):
    """Weights after ``rounds`` full-batch gradient steps with momentum over all rows of the (bounded) sample."""
    schema = pa.schema([("weights", pa.list_(pa.float64()))])

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("target", "ascending"), ("key", "ascending")]).combine_chunks()
        target = group.column("target").to_numpy()
        ids, x = (group.column(c).combine_chunks() for c in ("ids", "x"))
        n = np.diff(ids.offsets.to_numpy())
        row = np.repeat(np.arange(len(target)), n)
        ids, x = ids.flatten().to_numpy(), x.flatten().to_numpy().astype(np.float64)
        weights, velocity = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)
        for _ in range(rounds):
            ahead = weights + 0.9 * velocity
            score = np.bincount(row, ahead[ids] * x, minlength=len(target)) + ahead[-1]
            error = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - target
            gradient = np.append(np.bincount(ids, error[row] * x, minlength=DIMENSIONS), error.sum())
            velocity = 0.9 * velocity - 4.0 * gradient / len(target)
            weights += velocity
        return pa.Table.from_arrays([pa.array([weights], type=schema.field(0).type)], schema=schema)

    return run


def fit_scorer(docs: DataFrame, model, text: str = "text", row_id: str = "doc_id", limit: int = TRAIN_DOCUMENTS, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of the linear scorer (the last one is the constant), from the posteriors of about ``limit`` documents.

    The sample is bounded by ``limit``, so one task holds its features and makes all steps.
    """
    n = docs.count()
    share = F.pmod(F.xxhash64(F.lit(6), F.col(row_id)), F.lit(1_000_000))
    # Of the rows of one id, which may be any number, one is taken.
    sample = docs.where(F.col(row_id).isNotNull() & (share < math.ceil(1_000_000 * limit / max(n, limit)))).groupBy(row_id).agg(F.min(text).alias(text)).select(text)
    rows = sample.mapInArrow(_rows_of(model), "target double, ids array<int>, x array<float>").withColumn("key", F.xxhash64("ids", "x"))
    weights = rows.groupBy().applyInArrow(_trained(rounds), "weights array<double>").toArrow().column("weights")
    return np.array(weights[0].as_py()) if len(weights) else np.zeros(DIMENSIONS + 1)


def _terms(text: bytes) -> set[bytes]:
    """Words and word beginnings, in lower case, of a text."""
    words = {w.strip(b".,;:!?\"'()*#$%&|").lower() for w in text.split()}
    return words | {w[:5] + b"*" for w in words if len(w) > 5}


def _term_counts(batches):
    schema = pa.schema([("term", pa.binary()), ("toxic", pa.int64()), ("n", pa.int64())])
    n: Counter[bytes] = Counter()
    toxic: Counter[bytes] = Counter()
    for b in batches:
        for t, flag in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist(), strict=True):
            found = _terms(t or b"")
            n.update(found)
            if flag:
                toxic.update(found)
    yield batch(schema, (n.keys(), [toxic[k] for k in n], n.values()))


def toxic_terms(docs: DataFrame, labels: DataFrame, text: str = "text", row_id: str = "doc_id", limit: int = LABELLED_DOCUMENTS) -> frozenset[bytes]:
    """Terms that mark toxic documents, from at most about ``limit`` labelled ones."""
    known = labels.where(F.col(row_id).isNotNull() & F.col("toxic").isNotNull()).select(F.col(row_id), "toxic")
    n = known.count()
    known = known.where(F.pmod(F.xxhash64(F.lit(7), F.col(row_id)), F.lit(1_000_000)) < math.ceil(1_000_000 * limit / max(n, limit)))
    texts = docs.select(row_id, text).join(F.broadcast(known), row_id).select(text, "toxic")
    counts = texts.mapInArrow(_term_counts, "term binary, toxic long, n long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    marking = counts.where((F.col("toxic") >= TERM_LEAST) & (F.col("toxic") >= TERM_SHARE * F.col("n"))).select("term").toArrow()
    return frozenset(marking.column("term").to_pylist())  # no more terms than a bounded sample holds


_OUT = pa.schema([("n_terms", pa.int64()), ("posterior", pa.float64()), ("score", pa.float64())])


def classify(docs: DataFrame, model, weights: np.ndarray, terms: frozenset[bytes] = frozenset(), text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """``(row_id, posterior, score, n_toxic_terms, toxic, keep)`` for each row."""
    shared = docs.sparkSession.sparkContext.broadcast((model, weights, terms))
    kind = docs.schema[row_id].dataType.simpleString()

    def run(batches):
        (prior, p), w, marked = shared.value
        for b in sliced(batches, 256, 1):
            rows = []
            for t in b.column(1).cast(pa.binary()).to_pylist():
                t = t or b""
                s = statistics(t)
                ids, x = features(t, s)
                score = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(w[ids] @ x + w[-1])))))
                rows.append((len(marked & _terms(t)) if marked else 0, float(_posterior(np.array([votes(s)]), prior, p)[0]), score))
            out = batch(_OUT, zip(*rows, strict=True) if rows else [[] for _ in _OUT])
            yield pa.RecordBatch.from_arrays([b.column(0), *out.columns], names=["row", *_OUT.names])

    scored = docs.select(F.col(row_id).alias("row"), F.col(text)).mapInArrow(run, f"row {kind}, n_terms long, posterior double, score double")
    toxic = F.col("n_terms") > 0
    return scored.select(
        F.col("row").alias(row_id), "posterior", "score", F.col("n_terms").alias("n_toxic_terms"), toxic.alias("toxic"), (((F.col("score") + F.col("posterior")) >= 1.0) & ~toxic).alias("keep")
    )


def fit_labels(docs: DataFrame, text: str = "text"):
    """The label model of all documents of ``docs``."""
    patterns = docs.select(text).mapInArrow(_patterns, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()  # at most 3 ** 14
    return label_model({x["pattern"]: x["n"] for x in patterns})


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality and toxicity of all documents."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = fit_labels(docs)
    weights = fit_scorer(docs, model)
    terms = toxic_terms(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classify(docs, model, weights, terms)
