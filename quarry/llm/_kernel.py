"""Vectorised word and window hashing over Arrow text columns.

Words are maximal runs of bytes other than ASCII white space (0x20, 0x09-0x0D), which for
UTF-8 is exactly ``[^\\x20\\x09-\\x0D]+``.  Everything here works on one Arrow batch (or one
bounded group) at a time with numpy; no Python loop runs per word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_U = np.uint64
# Odd multipliers; their inverses modulo 2**64 let a prefix sum be shifted back to position 0.
_MULT = (0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1, 0xC2B2AE3D27D4EB4F | 1, 0xA0761D6478BD642F | 1)
_BYTES = [np.random.Generator(np.random.PCG64(91 + i)).integers(0, 2**64, 256, dtype=_U) | _U(1) for i in range(4)]
_powers: dict[tuple[int, bool], np.ndarray] = {}


def _power(seed: int, n: int, inverse: bool = False) -> np.ndarray:
    """P**0 .. P**(n-1) modulo 2**64, or of the inverse of P; grown by doubling and kept."""
    have = _powers.get((seed, inverse))
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        base = pow(_MULT[seed], -1, 1 << 64) if inverse else _MULT[seed]
        have = np.ones(1, _U)
        while len(have) < size:
            have = np.concatenate([have, have * _U(pow(base, len(have), 1 << 64))])
        if size <= 1 << 22:  # longer tables serve one very long text only
            _powers[seed, inverse] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every output bit depends on every input bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@dataclass
class Words:
    """Byte spans of the words of some texts: word w of text i lies at first[i] <= w < first[i+1]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, end to end, and the offsets of its texts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def split_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """The words of texts laid end to end; no word crosses from one text into the next."""
    solid = ~_SPACE[data]
    begin, stop = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    stop[:-1] &= ~solid[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    begin[edge] = solid[edge]
    stop[edge - 1] = solid[edge - 1]
    start = np.flatnonzero(begin)
    return Words(data, start, np.flatnonzero(stop) + 1, np.searchsorted(start, offsets))


def hash_words(words: Words, seed: int = 0, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over random byte values, then mixed."""
    if not len(words.start):
        return np.zeros(0, _U)
    table = _BYTES[seed][_LOWER] if lower else _BYTES[seed]
    total = np.empty(len(words.data) + 1, _U)
    total[0] = 0
    np.multiply(table[words.data], _power(seed, len(words.data)), out=total[1:])
    np.cumsum(total, out=total)
    raw = (total[words.end] - total[words.start]) * _power(seed, len(words.data), True)[words.start]
    return mix(raw + (words.end - words.start).astype(_U))


def hash_windows(word_hashes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A hash for each run of ``size`` hashes; empty if there are fewer."""
    n = len(word_hashes) - size + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = word_hashes[:n].copy()
    for k in range(1, size):
        out *= _U(_MULT[3 - seed])
        out += word_hashes[k : k + n]
    return mix(out)


def window_starts(words: Words, size: int) -> np.ndarray:
    """Indexes of the words that begin a window of ``size`` words inside one text."""
    n = len(words.start) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    inside = np.ones(len(words.start), bool)
    last = words.first[1:]
    for k in range(1, size):  # the size-1 last words of a text begin none
        at = last - k
        inside[at[at >= words.first[:-1]]] = False
    return np.flatnonzero(inside[:n])


def pieces(offsets: np.ndarray, size: int):
    """Runs (lo, hi) of texts of about ``size`` bytes in all, at least one text each."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)
