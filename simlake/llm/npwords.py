"""Vectorised tokenisation of Arrow string columns.

The operators of this subpackage see words as 64-bit hashes. A chunk of UTF-8 bytes is classified through a table, word
edges are found from the class changes, and each word's hash is the difference of two prefix sums of a polynomial hash, so
no Python object is made for a word. A word is a maximal run of ASCII letters and digits and of bytes of other scripts;
Latin-1 signs (U+0080-U+00BF), U+2000-U+2BFF, U+3000-U+303F and four-byte sequences (emoji) separate words; an ideograph or
kana is a word of its own. Null and empty texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15 | 1)
_INV = U(pow(int(_BASE), -1, 1 << 64))
_pow: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]

_WORD = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (0xC3, 0xF0)):
    _WORD[_a:_b] = True
_WORD[0x80:0xC0] = True  # continuation bytes follow their lead byte's class, put right below
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.int64).astype(U) * U(2) + U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection of 64-bit integers."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if len(_pow[0]) < n:
        for k, b in enumerate((_BASE, _INV)):
            p = np.full(1 << (n - 1).bit_length(), b, U)
            p[0] = 1
            _pow[k] = np.cumprod(p, dtype=U)
    return _pow[0][:n], _pow[1][:n]


def span_hashes(values: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hash of values[s:e] for each span; equal contents have equal hashes wherever they stand."""
    p, inv = powers(len(values) + 1)
    total = np.empty(len(values) + 1, U)
    total[0] = 0
    np.cumsum(values * p[:-1], out=total[1:])
    return mix((total[e] - total[s]) * inv[s] + (e - s).astype(U) * U(0xD6E8FEB86659FD93))


@dataclass
class Chunk:
    """Some rows of a column: their bytes, word spans, word hashes; word_at[i] is the first word of row lo + i."""

    lo: int
    hi: int
    data: np.ndarray
    offs: np.ndarray
    s: np.ndarray
    e: np.ndarray
    h: np.ndarray
    word_at: np.ndarray

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(self.hi - self.lo), np.diff(self.word_at))


def texts(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one large_string array with nulls made empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def raw_chunks(column: pa.Array, target: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows of about target bytes; a longer text is a run of its own."""
    n = len(column)
    if not n:
        return
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = min(n, lo + 60_000, max(lo + 1, int(np.searchsorted(offs, offs[lo] + target, "right")) - 1))
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = _WORD[data]
    lone = None
    if (data >= 0x80).any():
        nxt = np.append(data[1:], np.uint8(0))
        two = np.flatnonzero(data == 0xC2)
        three = np.flatnonzero(((data == 0xE2) & (nxt < 0xB0)) | ((data == 0xE3) & (nxt == 0x80)))
        four = np.flatnonzero(data >= 0xF0)
        for at, w in ((two, 2), (three, 3), (four, 4)):
            for k in range(w):
                word[np.minimum(at + k, n - 1)] = False
        lone = ((data >= 0xE4) & (data <= 0xE9)) | ((data == 0xE3) & (nxt > 0x80) & (nxt < 0x84))
    first = np.zeros(n + 1, bool)
    first[offs] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | first[1:n]
    if lone is not None and lone.any():
        start |= lone
        after = np.flatnonzero(lone) + 3
        after = after[after < n]
        start[after] |= word[after]
    cut = np.empty(n, bool)  # the next byte isn't of this word
    cut[:-1] = ~word[1:] | start[1:]
    cut[-1] = True
    return np.flatnonzero(start), np.flatnonzero(word & cut) + 1


def chunks(column: pa.Array | pa.ChunkedArray, target: int = 1 << 20, lower: bool = True) -> Iterator[Chunk]:
    """The column's words, lower-cased first unless told otherwise. Byte offsets refer to the lower-cased bytes."""
    column = texts(column)
    if lower:
        column = pc.utf8_lower(column)
    for lo, hi, data, offs in raw_chunks(column, target):
        s, e = word_spans(data, offs)
        yield Chunk(lo, hi, data, offs, s, e, span_hashes(_BYTE[data], s, e), np.searchsorted(s, offs))


def ngrams(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of words within a row, and the index of each one's first word."""
    if len(h) < n:
        return np.zeros(0, U), np.zeros(0, np.int64)
    at = np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :])
    g = h[at]
    for k in range(1, n):
        g = mix(g * U(3) + h[at + k])
    return g, at


def seg_sum(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of x[at[i]:at[i + 1]]; empty segments give 0."""
    out = np.zeros((len(at) - 1, *x.shape[1:]), x.dtype)
    some = np.flatnonzero(at[1:] > at[:-1])
    if len(some):
        out[some] = np.add.reduceat(x, at[some], axis=0)
    return out


def find(sorted_keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Index of each h in sorted_keys, -1 where it is not."""
    if not len(sorted_keys):
        return np.full(len(h), -1, np.int64)
    i = np.searchsorted(sorted_keys, h)
    i[i == len(sorted_keys)] = 0
    return np.where(sorted_keys[i] == h, i, -1)


class Table:
    """A compact open-addressed hash table from 64-bit keys to small integers; looked up for whole arrays at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.shift = U(64 - bits)
        size = 1 << bits
        self.keys, self.values = np.zeros(size + 64, U), np.full(size + 64, -1, np.int32)
        used = np.zeros(size + 64, bool)
        left_k, left_v = np.asarray(keys, U), np.asarray(values, np.int32)
        slot = (left_k * _BASE >> self.shift).astype(np.int64)
        self.probes = 0
        while len(left_k):
            self.probes += 1
            if slot.max() >= len(used):
                grow = len(used)
                used, self.keys, self.values = np.append(used, np.zeros(grow, bool)), np.append(self.keys, np.zeros(grow, U)), np.append(self.values, np.full(grow, -1, np.int32))
            free = ~used[slot]
            _, first = np.unique(slot[free], return_index=True)
            put = np.flatnonzero(free)[first]
            used[slot[put]], self.keys[slot[put]], self.values[slot[put]] = True, left_k[put], left_v[put]
            rest = np.ones(len(slot), bool)
            rest[put] = False
            left_k, left_v, slot = left_k[rest], left_v[rest], slot[rest] + 1
        self.used = used

    def get(self, h: np.ndarray) -> np.ndarray:
        """The value of each h, -1 where there is none."""
        slot = (h * _BASE >> self.shift).astype(np.int64)
        out = np.where(self.keys[slot] == h, self.values[slot], -1)
        left = np.flatnonzero((self.keys[slot] != h) & self.used[slot])
        for k in range(1, self.probes):
            if not len(left):
                break
            at = slot[left] + k
            hit = self.keys[at] == h[left]
            out[left[hit]] = self.values[at[hit]]
            left = left[~hit & self.used[at]]
        return out
