"""Word shingles of whole texts as sorted arrays of 64-bit hashes, for code that runs inside tasks."""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bytes of a text that are hashed at once; a longer word is hashed on its own.
BLOCK_BYTES = 1 << 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_INSIDE = np.ones(256, dtype=bool)
_INSIDE[[9, 10, 11, 12, 13, 32]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


#: A random number for each byte, and the powers of an odd number and of its inverse, up to the longest block.
_OF_BYTE = mix(np.arange(256, dtype=np.uint64) * _ODD + _M1)
_BASE = 0xD1342543DE82EF97
_POWERS, _INVERSE = (np.cumprod(np.array([1] + [x] * (2 * BLOCK_BYTES), dtype=np.uint64), dtype=np.uint64) for x in (_BASE, pow(_BASE, -1, 1 << 64)))


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each word, in order.  A-Z is lower-cased; words are runs of anything but ASCII white space.

    A word's bytes are the coefficients of a polynomial, taken at one number: the difference of two running sums, moved to place 0.
    """
    raw = np.full(len(text) + 2, 32, dtype=np.uint8)
    raw[1:-1] = _LOWER[np.frombuffer(text, dtype=np.uint8)]
    inside = _INSIDE[raw]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    if len(raw) <= BLOCK_BYTES or not len(starts):
        return _hashed(raw, starts, ends)
    cuts = np.flatnonzero(np.diff(starts // BLOCK_BYTES, prepend=-1)).tolist()
    out = []
    for a, b in zip(cuts, [*cuts[1:], len(starts)], strict=True):
        # At most the last word of a block goes on beyond it.
        long = int(ends[b - 1] - starts[b - 1]) > BLOCK_BYTES
        at = starts[a]
        out.append(_hashed(raw[at : ends[b - 1 - long]] if b - long > a else raw[:0], starts[a : b - long] - at, ends[a : b - long] - at))
        if long:
            out.append(np.array([_long(raw[starts[b - 1] : ends[b - 1]].tobytes())], dtype=np.uint64))
    return np.concatenate(out)


def _hashed(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_OF_BYTE[raw] * _POWERS[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _INVERSE[starts] + (ends - starts).astype(np.uint64) * _ODD)


def _long(word: bytes) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(word)


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles; the whole sequence is one where there are fewer words."""
    w = word_hashes(text) if text else np.empty(0, dtype=np.uint64)
    n = len(w)
    if not n:
        return w
    width = min(k, n)
    h = w[: n - width + 1] + np.uint64(width)
    for j in range(1, width):
        h = mix(h * _ODD + w[j : n - width + 1 + j])
    h = np.sort(mix(h))
    return h[np.concatenate(([True], h[1:] != h[:-1]))]
