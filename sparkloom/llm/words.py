"""Words of whole UTF-8 texts as numpy arrays.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return;
A-Z are lower-cased first. Texts are taken from Arrow buffers without decoding and cut into slices of
whole texts of about SLICE bytes, so memory does not follow the batch size (one text larger than that
is a slice by itself). Null texts count as empty ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
_U = np.uint64
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**64, 256, dtype=np.uint64) | _U(1)
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(base: int, n: int) -> np.ndarray:
    got = _powers.get(str(base))
    if got is None or len(got) < n:
        got = np.full(max(n, SLICE + 1), base, np.uint64)
        got[0] = 1
        got = np.multiply.accumulate(got)
        if n <= 2 * SLICE:  # longer texts are rare, and their powers aren't worth keeping
            _powers[str(base)] = got
    return got


def power(n: int) -> np.ndarray:
    return _power(_P, n)


def unpower(n: int) -> np.ndarray:
    return _power(_P_INV, n)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; text i is bytes[offsets[i]:offsets[i + 1]]."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most limit bytes, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


@dataclass
class Words:
    """The words of some texts in order: bytes [start, end), the row each is in, a 64-bit hash of each."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    first: np.ndarray  #: of each row the index of its first word; one more at the end


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    base = int(offsets[0])
    text = _LOWER[data[base : int(offsets[-1])]]
    at = (offsets - base).astype(np.int64)
    n = len(text)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(text, none, none, none, np.zeros(0, np.uint64), np.zeros(len(at), np.int64))
    inside = ~_SPACE[text]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = at[:-1][at[:-1] < at[1:]]
    begins[heads] = inside[heads]
    ends = np.zeros(n + 1, bool)
    ends[1:] = inside
    ends[1:-1] &= ~inside[1:]
    tails = heads[1:]
    ends[tails] = inside[tails - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[text] * _power(_P, n)[:n], out=total[1:])
    hashed = mix((total[end] - total[start]) * _power(_P_INV, n)[start])
    first = np.searchsorted(start, at)
    row = np.repeat(np.arange(len(at) - 1), np.diff(first))
    return Words(text, start, end, row, hashed, first)


def count_words(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The number of words of each text, without more than that."""
    inside = ~_SPACE[data[int(offsets[0]) : int(offsets[-1])]]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    at = (offsets - offsets[0]).astype(np.int64)
    heads = at[:-1][at[:-1] < at[1:]]
    begins[heads] = inside[heads]
    return np.diff(np.searchsorted(np.flatnonzero(begins), at))


def hash_word(word: str) -> int:
    """The hash that words_of gives to one word."""
    raw = word.encode()
    return int(words_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).hash[0])


def count_by(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and how often each occurs (or the sum of its weights)."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    if weights is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[heads], np.add.reduceat(weights, heads)


class Tally:
    """Sums by 64-bit key with bounded memory: full() says that it should be emptied."""

    def __init__(self, limit: int = 1_500_000):
        self.limit, self.parts, self.size = limit, [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.size += len(keys)
        if self.size > self.limit and len(self.parts) > 1:
            self.parts = [self.merged()]
            self.size = len(self.parts[0][0])

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return count_by(np.concatenate([k for k, _ in self.parts]), np.concatenate([c for _, c in self.parts]))

    def full(self) -> bool:
        return self.size > self.limit

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out = self.merged()
        self.parts, self.size = [], 0
        return out
