"""Packing documents into sequences of a fixed number of tokens by best-fit decreasing.

A document is its ids and an end id.  Documents are packed where they lie, a partition at a time and in units of about ``UNIT_WINDOWS``
windows, so nothing is shuffled and a task holds one unit's ids at most.  Full windows are cut off an overlong document first.  What is left
of the unit's documents goes, longest first, each into the open window with the least room that holds it, which a segment tree over the
remaining capacities finds.  Then the emptiest windows are poured into the gaps of the others, so that gaps of ``LEAST_GAP`` tokens and more
are filled by cuts; what finds no gap goes to the next unit, and at a partition's end into windows of powers of two, which need no padding.

A sequence's id is its partition and its number there, so a task that is run again gives the same result.

Defined results: null and empty texts are the end id alone; repeated ids are documents of their own; an empty table gives no sequence; other
columns are ignored.  Texts of any length are read whole.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections import defaultdict
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, documents, sliced

LENGTH, END_ID = 4096, 2
UNIT_WINDOWS, LEAST_GAP = 1024, 64
SLICE_ROWS = 64
#: Words and pieces whose ids a worker keeps; longer words are not kept.
CACHE_WORDS, CACHE_PIECES, LONG_WORD = 500_000, 800_000, 64
#: Fixed value: how the vocabulary's tokenizer cuts pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class RoomTree:
    """Open windows by the room that is left in them; a segment tree over the rooms tells the least one that is enough."""

    def __init__(self, length: int):
        self.leaves = 1 << length.bit_length()
        self.open = [0] * (2 * self.leaves)  # windows below each node
        self.windows: dict[int, list[int]] = defaultdict(list)

    def _count(self, room: int, by: int) -> None:
        node = self.leaves + room
        while node:
            self.open[node] += by
            node >>= 1

    def put(self, room: int, window: int) -> None:
        if room:
            self.windows[room].append(window)
            self._count(room, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """The window with the least room of at least ``size``, taken out, and that room."""
        node = self.leaves + size
        if not self.open[node]:
            # Up to the first node that is a left child and has windows to its right, then down to the leftmost of those.
            while node > 1 and (node & 1 or not self.open[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.open[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._count(room, -1)
        return self.windows[room].pop(), room


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Windows of at most ``length``, each the numbers of the items that it takes, in order; no item is longer than a window."""
    tree, windows = RoomTree(length), []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.take(sizes[i])
        window, room = found or (len(windows), length)
        if not found:
            windows.append([])
        windows[window].append(i)
        tree.put(room - sizes[i], window)
    return windows


#: A piece: number of its document in the unit, first id and end.
Piece = tuple[int, int, int]


def pour(windows: list[list[Piece]], length: int, least_gap: int = LEAST_GAP) -> tuple[list[list[Piece]], list[Piece]]:
    """The emptiest windows' pieces cut into the gaps of the fullest of those with ``least_gap`` or more; and what finds no gap."""
    fill = [sum(e - s for _, s, e in w) for w in windows]
    loose = sorted((w for w in range(len(windows)) if length - fill[w] >= least_gap), key=lambda w: (fill[w], w))
    done = sorted(set(range(len(windows))).difference(loose))
    low, high, left = 0, len(loose) - 1, []
    while left or low < high:
        if not left:
            left, low = windows[loose[low]][::-1], low + 1
        if low > high:
            break
        w = loose[high]
        doc, s, e = left.pop()
        cut = min(e, s + length - fill[w])
        windows[w].append((doc, s, cut))
        fill[w] += cut - s
        if cut < e:
            left.append((doc, cut, e))
        if fill[w] == length:
            done.append(w)
            high -= 1
    if low == high:
        left += windows[loose[low]][::-1]
    return [windows[w] for w in done], left[::-1]


def in_powers(pieces: list[Piece]) -> list[list[Piece]]:
    """The pieces, cut, in windows whose lengths are powers of two, largest first."""
    total, out = sum(e - s for _, s, e in pieces), []
    pieces = pieces[::-1]
    while total:
        room, window = 1 << total.bit_length() - 1, []
        total -= room
        while room:
            doc, s, e = pieces.pop()
            cut = min(e, s + room)
            window.append((doc, s, cut))
            room -= cut - s
            if cut < e:
                pieces.append((doc, cut, e))
        out.append(window)
    return out


def _byte_letters() -> dict[int, str]:
    """Latin letters beyond ASCII to what stands for their two bytes in a byte-level vocabulary."""
    printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printed)]
    stands = {b: chr(b) for b in printed} | {b: chr(256 + k) for k, b in enumerate(others)}
    return {c: "".join(stands[b] for b in chr(c).encode()) for c in range(0xC0, 0x100) if chr(c).isalpha()}


class WordEncoder:
    """The tokenizer's ids of a text as bytes, with bounded caches of words and of the pieces that words are cut into.

    The tokenizer drops white space and merges nothing across it, so a text's ids are those of its words.  A word of ASCII and Latin letters,
    digits and marks is cut into lower-case pieces here, and pieces that are new go to the same BPE model together; the end of a piece is the
    id of a token with the vocabulary's word end.  Other words, and all texts if the file's rules are others, go through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.model = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.model.normalizer, self.model.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        rules = json.loads(self.tokenizer.to_str())
        kinds = [x["type"] for x in (rules["normalizer"] or {}).get("normalizers", [])]
        cuts = [x.get("pattern", {}).get("Regex") for x in (rules["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.known = kinds == ["NFC", "Replace", "Lowercase"] and cuts == [PIECES, None] and rules["model"]["end_of_word_suffix"] == "</w>"
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.letters = _byte_letters()
        self.plain = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
        letter = "a-z\u00df-\u00f6\u00f8-\u00ff"
        self.cut = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[0-9]|[^{letter}0-9]+")
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _bytes(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_pieces(self, new: list[str], at_once: int = 2000) -> None:
        for k in range(0, len(new), at_once):
            some = new[k : k + at_once]
            text = " ".join([p if p.isascii() else p.translate(self.letters) for p in some])
            ids = np.asarray(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cuts) != len(some):
                raise AssertionError("each piece ends with one word end")
            raw = ids.tobytes()
            self.pieces.update((p, raw[x:y]) for p, x, y in zip(some, [0, *cuts], cuts, strict=False))

    def _learn(self, new: list[str]) -> None:
        split, odd = {}, []
        for w in new:
            if w.isascii() and w.isalpha():
                split[w] = (w.lower(),)
            elif self.plain.fullmatch(w) and "<|" not in w:
                split[w] = self.cut.findall(w.lower())
            else:
                odd.append(w)
        if len(self.pieces) > CACHE_PIECES:
            self.pieces.clear()
        self._learn_pieces(list(filterfalse(self.pieces.__contains__, set().union(*split.values()))))
        self.words.update((w, b"".join(map(self.pieces.__getitem__, ps))) for w, ps in split.items())
        if odd:
            self.words.update(zip(odd, self._bytes(odd), strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if not self.known:
            return self._bytes([t or "" for t in texts])
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        # The separators \x1c to \x1f are white space for split(), but not for the tokenizer.
        whole = [t is not None and any(c in t for c in "\x1c\x1d\x1e\x1f") for t in texts]
        parts = [t.split() if t and not w else [] for t, w in zip(texts, whole, strict=True)]
        new = list(filterfalse(self.words.__contains__, set().union(*parts)))
        self._learn(new)
        out = [self._bytes([t])[0] if w else b"".join(map(self.words.__getitem__, words)) for t, w, words in zip(texts, whole, parts, strict=True)]
        for w in new:
            if len(w) > LONG_WORD:
                del self.words[w]
                self.pieces.pop(w.lower(), None)
        return out


_encoders: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    """One for each Python worker, which tasks use again."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


_ROWS = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()),
])
_ROWS_SQL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def _pack(path: str, length: int, end_id: int, with_ids: bool):
    end = np.uint32(end_id).astype("<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext

        encoder, sequence = _encoder(path), TaskContext.get().partitionId() << 33
        docs: list[tuple] = []  # (doc_id, tokens, first id that is held, held ids) of the unit
        pieces: list[Piece] = []
        rows: list[tuple] = []
        waiting = 0

        def tell(windows: list[list[Piece]]) -> None:
            nonlocal sequence
            for window in windows:
                offset = 0
                for d, s, e in window:
                    doc_id, n, base, raw = docs[d]
                    ids = raw[4 * (s - base) : 4 * (e - base)]
                    rows.append((doc_id, s, e - s, zlib.crc32(ids), n, sequence, offset, ids if with_ids else None))
                    offset += e - s
                sequence += 1

        def unit(last: bool) -> None:
            nonlocal docs, pieces, waiting
            packed = best_fit_decreasing([e - s for _, s, e in pieces], length)
            full, left = pour([[pieces[i] for i in w] for w in packed], length)
            tell(full + (in_powers(left) if last else []))
            kept = {} if last else {d: k for k, d in enumerate(dict.fromkeys(d for d, _, _ in left))}
            docs = [docs[d] for d in kept]
            pieces = [(kept[d], s, e) for d, s, e in left] if kept else []
            waiting = sum(e - s for _, s, e in pieces)

        def told():
            nonlocal rows
            some, rows = rows, []
            return batch(_ROWS, zip(*some, strict=True))

        for b in sliced(batches, SLICE_ROWS, 1):
            for doc_id, ids in zip(b.column(0).to_pylist(), encoder.encode(b.column(1).to_pylist()), strict=True):
                raw = ids + end
                n = len(raw) // 4
                rest = n - n % length
                docs.append((doc_id, n, 0, raw))
                for s in range(0, rest, length):
                    tell([[(len(docs) - 1, s, s + length)]])
                    if len(rows) >= 4096:
                        yield told()
                if rest < n:
                    docs[-1] = (doc_id, n, rest, raw[4 * rest :])
                    pieces.append((len(docs) - 1, rest, n))
                    waiting += n - rest
                else:
                    docs.pop()
            if waiting >= UNIT_WINDOWS * length:
                unit(False)
            if len(rows) >= 4096:
                yield told()
        unit(True)
        if rows:
            yield told()

    return run


def pack_documents(docs: DataFrame, vocabulary: str, length: int = LENGTH, end_id: int = END_ID, text: str = "text", row_id: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """A row for each piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, if wanted, its ids (little-endian, 32 bits)."""
    rows = docs.select(F.col(row_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = rows.mapInArrow(_pack(vocabulary, length, end_id, with_ids), _ROWS_SQL)
    return out if with_ids else out.drop("ids")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens."""
    return pack_documents(documents(spark, sf_dir).select("doc_id", "text"), default_vocabulary(), with_ids=False)
