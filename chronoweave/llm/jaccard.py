"""Set similarity join of word shingles by universe partitioning and the pigeonhole principle.

Two sets whose Jaccard similarity is at least ``percent`` differ in at most ``H`` elements, where ``H`` follows from the larger one's
size.  Sizes are cut into bands.  For each band the universe of shingle hashes is cut into segments whose weights sum to more than
``H``: a segment of weight 1 catches pairs that agree on it, one of weight 2 also those that differ on it by one element, through its
one-deletion neighbourhood.  So a linked pair agrees on some segment's key.  A cost model allocates the weights for each band
(``plan_band``): it counts the keys that a set emits and the keys that are likely to meet by chance.  Segments of few elements meet by
chance too often and are left out; spare weight makes up for them, and a set that leaves out more than the spare weight is keyed again
with another partition of the universe, where the same holds, and at last with one that leaves out nothing.  No linked pair is lost.

That plan gives each segment a weight before anything is counted.  The real numbers then move weights.  A key is hot if its bucket
(a passage that many documents hold) has more than ``LIMIT`` sets beside those of its largest component.  Sets with hot keys take
weight 0 for these segments and weight 2 for all others, by one-deletion neighbourhoods.  Let T segments be used, and let sets X and Y
leave out x and y of them.  If X and Y agree on no usable key, they differ in at least T - x elements, so a set with too small an x
for its size needs nothing more; and if they differ by one on no segment that both use, they differ in at least 2 T - x - y, so a set
with 2 x <= 2 T - H - 1 loses no partner of the same kind.  Of a one-deletion key only pairs of a whole segment with a shortened one
are taken.  Sets that leave out more than that are few (nearly all they hold is shared); they are held against their hot buckets.

Equal sets are one class: its name is a 64-bit hash, and names that stand for several sets by a second one are taken apart.  Within a
bucket, first each class is held against one of the bucket's; the links found, verified exactly on the whole sets, give components,
and where a bucket still holds several of them, this is done once more with another one.  Where a bucket holds several components
even so, its sets beside the largest one's are held against all, in blocks, unless it is hot; parity sketches, which bound the difference of two sets
from below, rule out most pairs, and the rest are verified exactly.  So a group of near copies costs one comparison for each copy, not
one for each pair, and links that matter for the components are never lost.  Each text is shingled for its class and again for its
keys, which is cheaper than to keep the keys on disk; candidates' sets are written once, and all verifications read them.  Equality of shingles is that of 64-bit hashes.

Defined results: null, empty and blank texts have no shingles and link with nothing (component_id is their own id); rows with a null
id link with nothing; repeated rows are one class; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, documents, sliced, written
from .components import connected_components
from .shingles import mix, shingle_set

GROWTH = 1.5
SLICE_ROWS = 256
ROUNDS = 3
#: Sets beside those of its largest component that a bucket may hold before its key is hot.
LIMIT = 256
#: Rows of a bucket that one block holds at most, on average.
BLOCK = 512
#: Rows with one key that a task sees before it deals the key to several partitions.
HOT = 64
#: Open keys of a set up to which its pairs are told by one bucket only; pairs of sets with more may be told repeatedly.
KEYS = 256
PARTS = 61
MARK = -1
#: Ids of documents (8 bytes each) that may be broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def most_different(larger: int, smaller: int, percent: int) -> int:
    """The largest symmetric difference that linked sets of these sizes can have."""
    return (larger + smaller) * (100 - percent) // (100 + percent)


@lru_cache(maxsize=None)
def bands(percent: int) -> list[tuple[int, int]]:
    """Bands of sizes, both ends included."""
    out, low = [], 1
    while low < 1 << 40:
        high = max(low, math.floor(low * GROWTH) - 1)
        out.append((low, high))
        low = high + 1
    return out


def _poisson_at_most(q: int, rate: float) -> float:
    return sum(math.exp(-rate) * rate**i / math.factorial(i) for i in range(q + 1))


@lru_cache(maxsize=None)
def plan_band(low: int, high: int, percent: int) -> tuple[int, int, int, int] | None:
    """(segments of weight 1, of weight 2, spare weight, elements that a segment must exceed), or None if only equal sets link."""
    h = most_different(high, high, percent)
    if h == 0:
        return None
    best = None
    for q in (0, 1, 2):
        for twos in (0, 1, 2, 4):
            if 2 * twos > h + 1:
                continue
            spare = 0
            for _ in range(20):
                total = h + 1 + spare
                rate = low / total
                left_out = (total - 2 * twos) * _poisson_at_most(q, rate) + 2 * twos * _poisson_at_most(q + 1, 2 * rate)
                need = math.ceil(left_out + 1.5 * math.sqrt(left_out))
                if need <= spare:
                    break
                spare = need
                if spare > 2 * (h + 1):
                    break
            if spare > 2 * (h + 1):
                continue
            total = h + 1 + spare
            rate = (low + high) / 2 / total
            ones = total - 2 * twos
            keys = ones * (1 - _poisson_at_most(q, rate)) + twos * (1 + 2 * rate)
            chance = ones * (_poisson_at_most(3, rate) - _poisson_at_most(min(q, 3), rate))
            cost = keys + 0.5 * chance
            if best is None or cost < best[0]:
                best = (cost, (ones, twos, spare, q))
    return best[1] if best else (h + 1, 0, 0, -1)


@lru_cache(maxsize=512)
def _salt(band: int, seed: int, bare: bool, n: int) -> np.ndarray:
    return mix(np.arange(n, dtype=np.uint64) + np.uint64((band << 40) + (seed << 36) + (int(bare) << 35)))


def _segments(h: np.ndarray, band: int, ones: int, twos: int, seed: int = 0, bare: bool = False):
    """What each segment holds of the set (a sum of hashes, and its size), the elements' hashes by segment, where segments end, and their salts."""
    if seed:
        h = np.sort(mix(h + np.uint64((seed * 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)))
    unit = ((h >> np.uint64(32)) * np.uint64(ones + 2 * twos)) >> np.uint64(32)
    unit = unit.astype(np.int64)
    segment = np.where(unit < 2 * twos, unit >> 1, unit - twos) if twos else unit
    n = np.bincount(segment, minlength=ones + twos)
    ends = np.cumsum(n)
    g = mix(h ^ np.uint64(0xD6E8FEB86659FD93))
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(g, dtype=np.uint64)))
    return sums[ends] - sums[ends - n], g, ends, n, _salt(band, seed, bare, ones + twos)


def _keys(h: np.ndarray, band: int, part: tuple[int, int, int, int], seed: int, bare: bool) -> tuple[np.ndarray, bool]:
    """Keys of one set under one partition of the universe, and whether it left out more than the spare weight."""
    ones, twos, spare, q = part
    if bare:
        ones, spare, q = ones - spare, 0, -1
    f, g, ends, n, salt = _segments(h, band, ones, twos, seed, bare)
    held = n > q
    keys = [mix(f[held] ^ salt[held])]
    for i in range(twos):
        if held[i]:
            keys.append(mix((f[i] - g[ends[i] - n[i] : ends[i]]) ^ salt[i]))
    left_out = int((n[twos:] <= q).sum()) + 2 * int((n[:twos] <= q + 1).sum())
    return np.concatenate(keys), not bare and left_out > spare


def _bands_of(size: int, percent: int) -> list[tuple[int, bool, tuple[int, int, int, int]]]:
    """(band, whether it is the set's own, plan) for the band of the set's size, and for those of larger sets that it may link with."""
    out, all_ = [], bands(percent)
    for band in range(bisect_left(all_, size, key=lambda b: b[1]), len(all_)):
        low, high = all_[band]
        if low * percent > 100 * size:
            break
        part = plan_band(low, high, percent)
        if part is not None:
            out.append((band, low <= size, part))
    return out


def signature(h: np.ndarray, percent: int) -> list[tuple[bool, np.ndarray]]:
    """(owner, keys) for the band of the set's own size, and for those of larger sets that it may link with."""
    out = []
    for band, is_owner, part in _bands_of(len(h), percent):
        keys = []
        for seed in range(ROUNDS + 1):
            some, more = _keys(h, band, part, seed, seed == ROUNDS)
            keys.append(some)
            if not more:
                break
        out.append((is_owner, np.concatenate(keys)))
    return out


def set_class(h: np.ndarray, bits: int = 63) -> tuple[int, int]:
    """An even 64-bit number that names the set, of ``bits`` random bits, and a second hash that tells sets of one name apart."""
    from xxhash import xxh3_64_intdigest, xxh64_intdigest

    raw = h.tobytes()
    x, y = (xxh3_64_intdigest(raw) >> (63 - bits)) & ~1, xxh64_intdigest(raw)
    return x - (1 << 64) if x >> 63 else x, y - (1 << 64) if y >> 63 else y


def sketch(h: np.ndarray) -> bytes:
    """Parities of the elements by their low bits: two sketches differ in no more bits than their sets in elements."""
    bits = max(64, 1 << (len(h) - 1).bit_length())
    odd = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches at the width of the narrowest, which is a power of two."""
    width = min(map(len, sketches))
    out = np.empty((len(sketches), width // 8), dtype=np.uint64)
    for i, s in enumerate(sketches):
        x = np.frombuffer(s, dtype=np.uint64)
        out[i] = np.bitwise_xor.reduce(x.reshape(-1, width // 8), axis=0)
    return out


def renamed(name: int, check: int, shared: frozenset[int]) -> int:
    """The class's name; one that several sets share is replaced by a hash of both."""
    if name not in shared:
        return name
    x = mix(np.array([name & (2**64 - 1)], dtype=np.uint64) ^ mix(np.array([check & (2**64 - 1)], dtype=np.uint64)))
    return int(x.view(np.int64)[0]) & ~1


_DOC = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("check", pa.int64()), ("sketch", pa.binary())])
_DOC_SQL = "doc_id long, n long, cls long, check long, sketch binary"


def _classify(k: int, bits: int):
    """Size and class of each row's set; the sketch of sets that are new to the task."""

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for b in sliced(batches, SLICE_ROWS, 1):
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                h = shingle_set(text, k)
                if doc is None or not len(h):
                    rows.append((doc, len(h), None, None, None))
                    continue
                name = set_class(h, bits)
                rows.append((doc, len(h), *name, None if name in seen else sketch(h)))
                seen.add(name)
            yield batch(_DOC, zip(*rows, strict=True) if rows else [[] for _ in _DOC])

    return run


def _rename(shared: frozenset[int]):
    def run(batches):
        for b in batches:
            cls = [None if c is None else renamed(c, x, shared) for c, x in zip(b.column("cls").to_pylist(), b.column("check").to_pylist(), strict=True)]
            yield b.set_column(2, "cls", pa.array(cls, type=pa.int64()))

    return run


_SIG = pa.schema([("key", pa.int64()), ("part", pa.int32()), ("member", pa.int64())])


def _dealt(keys: np.ndarray, members: np.ndarray):
    """Rows of the signature table; keys that are frequent here already are dealt to several partitions, with a mark at the first."""
    order = np.argsort(keys)
    keys, members = keys[order], members[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    n = np.diff(np.concatenate((starts, [len(keys)])))
    part = np.zeros(len(keys), dtype=np.int32)
    hot = n >= HOT
    if hot.any():
        rows = np.repeat(hot, n)
        part[rows] = 1 + (mix(members[rows].view(np.uint64)) % np.uint64(PARTS)).astype(np.int32)
        marks = keys[starts[hot]]
        keys = np.concatenate((keys, marks))
        part = np.concatenate((part, np.zeros(len(marks), dtype=np.int32)))
        members = np.concatenate((members, np.full(len(marks), MARK, dtype=np.int64)))
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part), pa.array(members)], schema=_SIG)


def _sign(k: int, percent: int, bits: int, shared: frozenset[int]):
    """A row for each key of each set."""

    def run(batches):
        seen: set[int] = set()
        keys, members, held = [], [], 0
        for b in sliced(batches, SLICE_ROWS, 1):
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                h = shingle_set(text, k)
                if doc is None or not len(h):
                    continue
                cls = renamed(*set_class(h, bits), shared)
                if cls in seen:
                    continue
                seen.add(cls)
                for owner, some in signature(h, percent):
                    keys.append(some.view(np.int64))
                    members.append(np.full(len(some), cls | owner, dtype=np.int64))
                    held += len(some)
            if held >= 1 << 20:
                yield _dealt(np.concatenate(keys), np.concatenate(members))
                keys, members, held = [], [], 0
        if held:
            yield _dealt(np.concatenate(keys), np.concatenate(members))

    return run


_BUCKET = pa.schema([("key", pa.int64()), ("member", pa.int64())])


def _shared(batches):
    """Of sorted rows, those whose key has several members.  Streams: of a run, only its last row is held."""
    last = None  # (key, part, member, sent): the last row so far
    for b in batches:
        if not b.num_rows:
            continue
        key, part, member = (b.column(i).to_numpy() for i in range(3))
        sent = np.zeros(len(key), dtype=bool)
        if last is not None:
            key, part, member, sent = (np.concatenate((np.array([x], dtype=a.dtype), a)) for x, a in zip(last, (key, part, member, sent), strict=True))
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (part[1:] != part[:-1]) | (member[1:] != member[:-1])
        key, part, member, sent = key[new], part[new], member[new], sent[new]
        with_next = np.zeros(len(key), dtype=bool)
        with_next[:-1] = (key[1:] == key[:-1]) & (part[1:] == part[:-1])
        with_last = np.concatenate(([False], with_next[:-1]))
        out = (with_next | with_last | (part > 0)) & ~sent & (member != MARK)
        yield pa.RecordBatch.from_arrays([pa.array(key[out]), pa.array(member[out])], schema=_BUCKET)
        # The last row waits for the next batch unless it is out already.
        last = (key[-1], part[-1], member[-1], bool(out[-1] | sent[-1] | (member[-1] == MARK)))


def _likely(percent: int):
    """Pairs of different components, of each run of rows with one (key, i, j), that sketches don't rule out.

    Of a pair one must be an owner, and one must be bound to be compared here.
    """
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def told(own: set[int], guest: set[int], other: dict) -> int:
        return min(own.intersection(other["own"]) | own.intersection(other["guest"]) | guest.intersection(other["own"]))

    def pairs(run: list[dict]):
        run.sort(key=lambda r: not r["bound"])
        across, bound = run[0]["i"] != run[0]["j"], sum(r["bound"] for r in run)
        bits = _folded([r["sketch"] for r in run])
        cls, label, n = (np.array([r[c] for r in run], dtype=np.int64) for c in ("cls", "label", "n"))
        owner, block = (np.array([r[c] for r in run]) for c in ("owner", "block"))
        us, vs = [], []
        for x in range(min(bound, len(run) - 1)):
            y = slice(x + 1, None)
            apart = (label[y] != label[x]) & (owner[y] | owner[x])
            if across:
                apart &= block[y] != block[x]
            if not apart.any():
                continue
            at = np.flatnonzero(apart) + x + 1
            least, most = np.minimum(n[at], n[x]), np.maximum(n[at], n[x])
            at = at[(100 * least >= percent * most) & (np.bitwise_count(bits[at] ^ bits[x]).sum(axis=1) <= (n[at] + n[x]) * (100 - percent) // (100 + percent))]
            # A pair that shares several hot keys is told by the least of those in which one of the two is an owner.
            if run[x]["own"] is not None:
                own, guest = set(run[x]["own"]), set(run[x]["guest"])
                at = [y for y in at.tolist() if run[y]["own"] is None or told(own, guest, run[y]) == run[x]["key"]]
            us.append(np.minimum(cls[at], cls[x]))
            vs.append(np.maximum(cls[at], cls[x]))
        return us, vs

    def run(batches):
        held: list[dict] = []
        us: list[np.ndarray] = []
        vs: list[np.ndarray] = []
        for b in batches:
            for r in b.to_pylist():
                if held and any(held[0][c] != r[c] for c in ("key", "i", "j")):
                    for all_, some in zip((us, vs), pairs(held), strict=True):
                        all_ += some
                    held = []
                held.append(r)
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], schema=schema)
                us, vs = [], []
        if held:
            us, vs = pairs(held)
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], schema=schema)

    return run


def _sketched(percent: int):
    """Pairs that sketches don't rule out."""

    def run(batches):
        for b in batches:
            keep = []
            for nu, nv, su, sv in zip(*(b.column(c).to_pylist() for c in ("nu", "nv", "su", "sv")), strict=True):
                ok = 100 * min(nu, nv) >= percent * max(nu, nv)
                if ok:
                    x = _folded([su, sv])
                    ok = int(np.bitwise_count(x[0] ^ x[1]).sum()) <= most_different(nu, nv, percent)
                keep.append(ok)
            out = b.filter(pa.array(keep, type=pa.bool_()))
            yield pa.RecordBatch.from_arrays([out.column("u"), out.column("v")], names=["u", "v"])

    return run


def _sets(k: int, bits: int, shared: frozenset[int]):
    schema = pa.schema([("cls", pa.int64()), ("elements", pa.binary())])

    def run(batches):
        for b in sliced(batches, SLICE_ROWS, 0):
            rows = []
            for text in b.column(0).cast(pa.binary()).to_pylist():
                h = shingle_set(text, k)
                if len(h):
                    rows.append((renamed(*set_class(h, bits), shared), h.tobytes()))
            yield batch(schema, zip(*rows, strict=True) if rows else [[], []])

    return run


def neighbours(h: np.ndarray, percent: int, hot: np.ndarray) -> tuple[list[tuple[bool, np.ndarray, np.ndarray]], bool]:
    """(owner, whole keys, one-deletion keys) of a set in each of its bands, hot keys left out; and whether that loses no partner."""
    out, whole = [], True
    for band, is_owner, part in _bands_of(len(h), percent):
        ones, twos, _, q = part
        if twos:  # their neighbourhoods are indexed already; what is hot among them is compared in blocks
            whole = False
            continue
        f, g, ends, n, salt = _segments(h, band, ones, 0)
        held = n > q
        full = mix(f ^ salt)
        held &= ~np.isin(full, hot)
        left_out = ones - int(held.sum())
        high = bands(percent)[band][1]
        if left_out < ones - most_different(min(high, 100 * len(h) // percent), len(h), percent):
            continue
        whole &= 2 * left_out <= 2 * ones - most_different(high, high, percent) - 1
        shorter = np.repeat(held & (n > q + 1), n)
        segment = np.repeat(np.arange(len(n)), n)
        out.append((is_owner, full[held], mix((f[segment] - g)[shorter] ^ salt[segment[shorter]])))
    return out, whole


#: 64-bit words of the sketch that goes with each row of a segment.
WORDS = 4
_NEAR = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("member", pa.int64()), ("label", pa.int64()), ("n", pa.int64()), *((f"s{i}", pa.int64()) for i in range(WORDS))])
_NEAR_SQL = "kind int, key long, member long, label long, n long, " + ", ".join(f"s{i} long" for i in range(WORDS))
FULL, DELETED, BOUND = 0, 1, 2


def short_sketch(h: np.ndarray) -> np.ndarray:
    """Parities of the elements by their low bits, at one width for all sets: bounds a difference from below as ``sketch`` does."""
    odd = np.bincount((h & np.uint64(64 * WORDS - 1)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _not_ruled_out(percent: int) -> str:
    """Join condition on sides u and v: sizes and short sketches allow a link."""
    apart = " + ".join(f"bit_count(u_s{i} ^ v_s{i})" for i in range(WORDS))
    return f"100 * least(u_n, v_n) >= {percent} * greatest(u_n, v_n) and {apart} <= (u_n + v_n) * {100 - percent} div {100 + percent}"


def _neighbour_rows(percent: int):
    """Rows of whole and of shortened segments with their set's label, size and short sketch, and a row for each set that must be held against its buckets."""

    def run(batches):
        for b in sliced(batches, SLICE_ROWS, 1):
            kinds, keys, members, of_set = [], [], [], []

            def told(kind: int, some: np.ndarray, member: int):
                kinds.append(np.full(len(some), kind, dtype=np.int32))
                keys.append(some.view(np.int64))
                members.append(np.full(len(some), member, dtype=np.int64))
                of_set.append(np.tile(facts, (len(some), 1)))

            for cls, raw, hot, label in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                h = np.frombuffer(raw, dtype=np.uint64)
                facts = np.concatenate((np.array([label, len(h)], dtype=np.int64), short_sketch(h)))
                by_band, whole = neighbours(h, percent, np.array(hot, dtype=np.int64).view(np.uint64))
                for is_owner, full, shorter in by_band:
                    told(FULL, full, cls | is_owner)
                    told(DELETED, np.unique(shorter), cls | is_owner)
                if not whole:
                    told(BOUND, np.zeros(1, dtype=np.uint64), cls)
            if kinds:
                columns = [*(np.concatenate(x) for x in (kinds, keys, members)), *np.concatenate(of_set).T]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in columns], schema=_NEAR)

    return run


def _verified(percent: int):
    def run(batches):
        for b in batches:
            keep = []
            for a, c in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True):
                x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(c, dtype=np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            out = b.filter(pa.array(keep, type=pa.bool_()))
            yield pa.RecordBatch.from_arrays([out.column("u"), out.column("v")], names=["u", "v"])

    return run


def _few(ids: DataFrame, most: int) -> DataFrame:
    """Ids to be broadcast, if ``most``, which is at least their number, allows it."""
    return F.broadcast(ids) if most <= BROADCAST_IDS else ids


def _classes(rows: DataFrame) -> DataFrame:
    of_class = rows.where("cls is not null").groupBy("cls").agg(
        F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.first("sketch", True).alias("sketch"), (F.min("check") != F.max("check")).alias("several")
    )
    return written(of_class, "classes")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, text: str = "text", row_id: str = "doc_id", name_bits: int = 63) -> DataFrame:
    """``(row_id, n_shingles, component_id)`` for each row: sets of ``k``-word shingles link at Jaccard ``percent`` or more.

    ``name_bits`` are the random bits of a class's name; names that several sets share are taken apart, so they decide nothing.
    """
    docs = docs.select(F.col(row_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = written(docs.mapInArrow(_classify(k, name_bits), _DOC_SQL), "sets")
    classes = _classes(rows)
    # Names that chance gave to several sets: some hundreds among 10 ** 11.
    shared = frozenset(x["cls"] for x in classes.where("several").select("cls").collect())
    if shared:
        rows = written(rows.mapInArrow(_rename(shared), _DOC_SQL), "sets")
        classes = _classes(rows)

    keyed = docs.mapInArrow(_sign(k, percent, name_bits, shared), "key long, part int, member long")
    sorted_ = keyed.repartition("key", "part").sortWithinPartitions("key", "part", "member")
    buckets = written(sorted_.mapInArrow(_shared, "key long, member long"), "buckets")
    cls, owner = F.col("member").bitwiseAND(-2).alias("cls"), (F.col("member").bitwiseAND(1) == 1).alias("owner")

    # The sets of all candidates, once.
    candidates = buckets.select(cls).distinct()
    ids = classes.join(candidates, "cls").select(F.col("rep").alias("doc_id")).distinct()
    sets = docs.join(_few(ids, classes.count()), "doc_id", "left_semi").select("text").mapInArrow(_sets(k, name_bits, shared), "cls long, elements binary")
    sets = written(sets.groupBy("cls").agg(F.first("elements").alias("elements")), "candidate_sets")
    known = classes.select("cls", "n", "sketch")

    def verified(pairs: DataFrame) -> DataFrame:
        """Of pairs of classes, those that link, by their whole sets."""
        pairs = written(pairs, "pairs")
        needed = pairs.select("u").union(pairs.select("v")).distinct().withColumnRenamed("u", "cls")
        some = sets.join(_few(needed, 2 * pairs.count()), "cls", "left_semi")
        both = pairs.join(some.toDF("u", "a"), "u").join(some.toDF("v", "b"), "v").select("u", "v", "a", "b")
        return written(both.mapInArrow(_verified(percent), "u long, v long"), "links")

    def checked(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct()
        pairs = pairs.join(known.toDF("u", "nu", "su"), "u").join(known.toDF("v", "nv", "sv"), "v")
        return verified(pairs.mapInArrow(_sketched(percent), "u long, v long"))

    def still_open(links: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Labels of the components of ``links``, and the rows of the buckets that hold several components."""
        labels = connected_components(links).toDF("cls", "label")
        rows = buckets.select("key", cls, owner).join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
        rows = written(rows, "labelled")
        open_ = rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size"), F.max("owner").alias("any"))
        return labels, written(rows.join(open_.where("low <> high and any").select("key", "size"), "key"), "open")

    # First each member against one owner of its bucket: the first, then, where that left several components, any other.
    first = buckets.where(owner).groupBy("key").agg(F.min(cls).alias("v"))
    links = checked(buckets.join(first, "key").select(cls.alias("u"), "v"))
    _, rest = still_open(links)
    other = rest.where("owner").groupBy("key").agg(F.min_by(F.struct("cls", "label"), F.xxhash64("key", "cls")).alias("c"))
    more = rest.join(other, "key").where(F.col("label") != F.col("c.label")).select(F.col("cls").alias("u"), F.col("c.cls").alias("v"))
    links = links.union(checked(more))

    labels, rest = still_open(links)
    of_label = rest.groupBy("key", "label").agg(F.count("*").alias("n"))
    top = of_label.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("top"), (F.sum("n") - F.max("n") > LIMIT).alias("hot"))
    rest = written(rest.join(top, "key").withColumn("bound", F.col("label") != F.col("top")), "open")

    # Hot keys: whole segments against shortened ones.
    hot = rest.where("hot").select("cls", "key")
    own_hot = written(hot.groupBy("cls").agg(F.collect_set("key").alias("hot")), "hot")
    tied = None
    if not own_hot.isEmpty():
        labelled = sets.join(own_hot, "cls").join(labels, "cls", "left").select("cls", "elements", "hot", F.coalesce("label", "cls").alias("label"))
        near = written(labelled.mapInArrow(_neighbour_rows(percent), _NEAR_SQL), "neighbours")
        # Of a pair of two components, one set at least stands beside the key's largest component; a key that lies in one component makes none.
        of_label = near.where(F.col("kind") != BOUND).groupBy("key", "label").agg(F.count("*").alias("n"), F.min("kind").alias("low"), F.max("kind").alias("high"))
        of_key = of_label.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("top"), F.count("*").alias("labels"), F.min("low").alias("low"), F.max("high").alias("high"))
        several = of_key.where((F.col("labels") > 1) & (F.col("low") == FULL) & (F.col("high") == DELETED)).select("key", "top")
        mixed = written(near.where(F.col("kind") != BOUND).join(several, "key").withColumn("beside", F.col("label") != F.col("top")).drop("top"), "mixed")
        facts = {"cls": cls, "owner": owner} | {c: F.col(c) for c in ("label", "beside", *_NEAR.names[4:])}
        whole, shorter = (mixed.where(F.col("kind") == kind).select("key", *(c.alias(f"{name}_{as_}") for as_, c in facts.items())) for kind, name in ((FULL, "u"), (DELETED, "v")))
        # What sizes and short sketches rule out is never a row.
        apart = F.expr(f"(u_owner or v_owner) and u_label <> v_label and {_not_ruled_out(percent)}")

        def meet(u: DataFrame, v: DataFrame) -> DataFrame:
            return u.join(v, (u["key"] == v["key"]) & apart).select(F.col("u_cls").alias("u"), F.col("v_cls").alias("v"))

        met = meet(whole, shorter.where("v_beside")).union(meet(whole.where("u_beside"), shorter.where("not v_beside")))
        links = links.union(checked(met.distinct()))
        bound = written(near.where(F.col("kind") == BOUND).select(cls).distinct().withColumn("tied", F.lit(True)), "bound")
        if not bound.isEmpty():
            tied = rest.where("hot").join(bound, "cls", "left").withColumn("bound", F.coalesce("tied", F.lit(False))).drop("tied")
            tied = written(tied.join(tied.where("bound").select("key").distinct(), "key", "left_semi"), "tied")

    # The others: what stands beside the largest component is held against all of its bucket, and so is what is bound to hot ones.
    columns = ["key", "i", "j", "block", "cls", "label", "owner", "bound"]
    own_block = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    all_blocks = F.sequence(F.lit(0), F.col("blocks") - 1)
    left = rest.where("not hot").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    left = left.withColumn("block", F.explode(F.when(F.col("bound"), all_blocks).otherwise(F.array(own_block)))).withColumns({"i": F.col("block"), "j": F.col("block")})
    left = left.select(*columns).join(known, "cls").withColumns({c: F.lit(None).cast("array<bigint>") for c in ("own", "guest")})
    if tied is not None:
        own, guest = (F.when(F.count("*") <= KEYS, F.collect_list(F.when(F.col("owner") == is_own, F.col("key")))) for is_own in (True, False))
        lists = tied.groupBy("cls").agg(own.alias("own"), guest.alias("guest"))
        tied = tied.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("block", own_block).withColumn("other", F.explode(all_blocks))
        tied = tied.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).select(*columns)
        left = left.unionByName(tied.join(known, "cls").join(lists, "cls"))
    left = left.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "cls")
    more = verified(left.mapInArrow(_likely(percent), "u long, v long").distinct())

    components = connected_components(links.union(more)).toDF("cls", "component")
    of_class = classes.select("cls", "rep").join(components, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = of_class.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_class = written(of_class.join(least, "component").select("cls", "component_id"), "components")
    out = rows.select("doc_id", "n", "cls").join(of_class, "cls", "left")
    return out.select(F.col("doc_id").alias(row_id), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates of all documents: four words, 85 %."""
    return near_duplicates(documents(spark, sf_dir), k=4, percent=85)
