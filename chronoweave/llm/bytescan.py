"""A table-driven transducer over UTF-8 bytes, and a verified hash table of the spans that it marks.

The transducer has two states, between words and in a word.  A table gives what a byte puts out in either state: a word begins here, the
byte is a capital, a symbol, or continues a code point.  Which state a byte leaves behind depends on the byte alone, so the state before
each byte is that table read one place further left, and a slice of texts is run as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BEGINS, CAPITAL, SYMBOL, CONTINUES = 1, 2, 4, 8
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
#: Bytes of a word beyond which it is hashed and compared on its own and not eight bytes at a time with the others.
LONG_WORD = 64
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


class Transducer:
    """``in_word``, ``capital`` and ``symbol`` are rules from a byte to whether it is one."""

    def __init__(self, in_word, capital=lambda b: False, symbol=lambda b: False):
        self.inside = np.array([in_word(b) for b in range(256)], dtype=np.uint8)
        out = [CAPITAL * capital(b) | SYMBOL * symbol(b) | CONTINUES * (b & 0xC0 == 0x80) for b in range(256)]
        between = [o | BEGINS * bool(w) for o, w in zip(out, self.inside, strict=True)]
        self.out = np.array(between + out, dtype=np.uint8)

    def run(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(output of each byte, starts of words, ends of words)``; text i is ``buf[offsets[i]:offsets[i + 1]]``."""
        inside = self.inside[buf]
        state = np.zeros(len(buf) + 1, dtype=np.uint8)
        state[1:] = inside
        state[offsets] = 0  # each text begins between words
        out = self.out[buf + (state[:-1].astype(np.uint16) << 8)]
        ending = inside.copy()
        ending[:-1] &= 1 - inside[1:]
        cut = offsets[(offsets > 0) & (offsets <= len(buf))] - 1
        ending[cut] = inside[cut]
        return out, np.flatnonzero(out & BEGINS), np.flatnonzero(ending) + 1


def in_each(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of the sorted positions lie in each text."""
    return np.diff(np.searchsorted(positions, offsets))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts, one after the other, and where each begins; nulls are empty."""
    if column.type not in (pa.string(), pa.large_string()):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    wide = np.int64 if column.type == pa.large_string() else np.int32
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, dtype=wide)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


class Spans:
    """Spans of a buffer that can be hashed and compared all at once."""

    def __init__(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray | None = None):
        self.buf = np.concatenate([buf, np.zeros(8, np.uint8)])
        self.loads = np.ndarray((len(buf) + 1,), dtype="<u8", buffer=self.buf, strides=(1,))  # the eight bytes from each place on
        self.starts, self.lengths = starts, ends - starts
        self.owner = np.zeros(len(starts), np.int64) if owner is None else owner
        self.first = self.eight(np.arange(len(starts)), 0)
        self.hash = self._hashes()

    def __len__(self) -> int:
        return len(self.starts)

    def eight(self, which: np.ndarray, at: int) -> np.ndarray:
        """Bytes ``at`` to ``at + 8`` of each span, zero beyond its end."""
        return self.loads[self.starts[which] + at] & _LOW_BYTES[np.clip(self.lengths[which] - at, 0, 8)]

    def of(self, i: int) -> bytes:
        return self.buf[self.starts[i] : self.starts[i] + self.lengths[i]].tobytes()

    def _longer(self, which: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each further eight bytes, those of ``which`` that reach them and aren't long."""
        at, which = 8, which[(self.lengths[which] > 8) & (self.lengths[which] <= LONG_WORD)]
        while len(which):
            yield at, which
            at += 8
            which = which[self.lengths[which] > at]

    def _hashes(self) -> np.ndarray:
        h = self.first ^ (self.lengths.astype(np.uint64) * _MIX[1]) ^ (self.owner.astype(np.uint64) * _MIX[0])
        h = (h ^ (h >> np.uint64(29))) * _MIX[0]
        for at, which in self._longer(np.arange(len(self))):
            x = (h[which] ^ self.eight(which, at)) * _MIX[1]
            h[which] = x ^ (x >> np.uint64(31))
        for i in np.flatnonzero(self.lengths > LONG_WORD).tolist():
            h[i] = np.uint64((hash(self.of(i)) ^ int(h[i])) & 0xFFFFFFFFFFFFFFFF)  # of one worker and slice only, so the seed of hash() is no matter
        return h ^ (h >> np.uint64(32))

    def same(self, mine: np.ndarray, other: Spans, theirs: np.ndarray) -> np.ndarray:
        """Whether spans are of one owner and equal byte by byte."""
        equal = (self.lengths[mine] == other.lengths[theirs]) & (self.first[mine] == other.first[theirs]) & (self.owner[mine] == other.owner[theirs])
        left = np.flatnonzero(equal & (self.lengths[mine] > 8))
        long = self.lengths[mine[left]] > LONG_WORD
        for k in left[long].tolist():
            equal[k] = self.of(mine[k]) == other.of(theirs[k])
        left, at = left[~long], 8
        while len(left):
            equal[left] &= self.eight(mine[left], at) == other.eight(theirs[left], at)
            at += 8
            left = left[equal[left] & (self.lengths[mine[left]] > at)]
        return equal


class SpanTable:
    """Open addressing over spans, filled for all of them at once; a slot is taken for a span's own only after their bytes agree."""

    def __init__(self, spans: Spans):
        self.spans = spans
        size = 1 << max(3, (2 * len(spans)).bit_length())
        self.mask, self.slots = np.uint64(size - 1), np.full(size, -1, dtype=np.int64)
        #: Whether a span is the one that stands for all its equals.
        self.first = np.zeros(len(spans), dtype=bool)
        todo, at = np.arange(len(spans)), (spans.hash & self.mask).astype(np.int64)
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]
            held = self.slots[at]
            own = held == todo
            self.first[todo[own]] = True
            more = ~own
            more[more] = ~spans.same(todo[more], spans, held[more])
            todo, at = todo[more], (at[more] + 1) & int(self.mask)

    def find(self, spans: Spans) -> np.ndarray:
        """The span of the table that equals each of ``spans``, or -1."""
        found = np.full(len(spans), -1, dtype=np.int64)
        todo, at = np.arange(len(spans)), (spans.hash & self.mask).astype(np.int64)
        while len(todo):
            held = self.slots[at]
            taken = held >= 0
            todo, at, held = todo[taken], at[taken], held[taken]
            same = spans.same(todo, self.spans, held)
            found[todo[same]] = held[same]
            todo, at = todo[~same], (at[~same] + 1) & int(self.mask)
        return found
