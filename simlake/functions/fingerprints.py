"""Signatures straight from texts, in one Arrow pass: tokens, shingles, weights, element hashes and minima, as text.py and signature.py define them.

Spark's optimiser merges chains of array functions and then computes shared parts again inside lambdas, or refuses a Python function over them; one
function per batch does each step once. Tests hold the two forms together. Element hashes and minima are taken by numpy for many texts at once, in
blocks that fit the processor's caches, and a piece of a batch at a time, so that memory doesn't follow the batch.
"""

from __future__ import annotations

import ctypes
import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..params import PRIME, SearchParams, permutations
from .text import ASM, NUMBER, WORD
from .vocabulary import COMMON, RARE, REGISTERS, SIZES

_asm, _word, _number = re.compile(ASM, re.ASCII), re.compile(WORD), re.compile(NUMBER)
_registers, _sizes, _rare, _common = frozenset(REGISTERS), frozenset(SIZES), frozenset(RARE), frozenset(COMMON)
U32, U64 = np.uint32, np.uint64
#: Elements whose hashes and minima are taken at once; bytes of text in a piece; entries of a worker's memory of tokens, of elements and of token sequences.
BLOCK, PIECE, KNOWN = 1 << 14, 1 << 20, 1 << 16


def _asm_token(t: str) -> str | None:
    if t[0] in ";%":
        return None
    low = t.lower()
    return "REG" if low in _registers else "IMM" if _number.match(t) else "LABEL" if t[-1] == ":" else "MEM_SIZE" if low in _sizes else t.upper()


def asm_token_list(code: str, known: dict[str, str | None] | None = None) -> list[str]:
    known = {} if known is None else known
    if len(known) > KNOWN:
        known.clear()
    out = []
    for t in _asm.findall(code):
        if t not in known:
            known[t] = _asm_token(t)
        if (own := known[t]) is not None:
            out.append(own)
    return out


def token_list(text: str, tokenizer: str) -> list[str]:
    return asm_token_list(text) if tokenizer == "asm" else _word.findall(text.lower())


def shingle_list(tokens: list[str], n: int) -> list[str]:
    if len(tokens) < n:
        return [" ".join(tokens)] if tokens else []
    return list(dict.fromkeys(" ".join(tokens[i : i + n]) for i in range(len(tokens) - n + 1)))


def weight(shingle: str) -> int:
    parts = shingle.split(" ")
    return 3 if not _rare.isdisjoint(parts) else 1 if not shingle or _common.issuperset(parts) else 2


def _weighted(shingles: list[str]) -> list[str]:
    return [e for s in shingles for w in [weight(s)] for e in ([s] if w == 1 else [f"{s}|{k}" for k in range(w)])]


def element_list(text: str, p: SearchParams) -> list[str]:
    sh = shingle_list(token_list(text, p.tokenizer), p.ngram)
    return _weighted(sh) if p.tokenizer == "asm" else sh


_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4


def _md5_heads(m: np.ndarray) -> np.ndarray:
    """The first four bytes, as a number with the first byte highest, of the MD5 of messages of one block each, which are m's columns of 16 words."""
    a, b, c, d = (np.full(m.shape[1], x, U32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    f, g = np.empty_like(a), np.empty_like(a)
    for i, (sine, turn) in enumerate(zip(_SINES, _TURNS)):
        if i < 16:
            k = i
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            k = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            k = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            k = 7 * i % 16
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        f += U32(sine)
        f += m[k]
        np.right_shift(f, U32(32 - turn), out=g)
        f <<= U32(turn)
        f |= g
        f += b
        a, d, c, b, f = d, c, b, f, a
    return (a + U32(0x67452301)).byteswap()


def _span_hashes(data: np.ndarray, lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """element hashes of the bytes from lo on; data ends with 64 more bytes."""
    out = np.empty(len(lo), U32)
    window = np.lib.stride_tricks.sliding_window_view(data, 64)
    place = np.arange(64)
    for i in range(0, len(lo), BLOCK):
        at, n = lo[i : i + BLOCK], size[i : i + BLOCK]
        block = window[at]
        block *= place < n[:, None]
        short = n < 56  # a message of one block
        block[np.flatnonzero(short), n[short]] = 0x80
        words = block.view("<u4")
        words[:, 14] = n * 8
        out[i : i + BLOCK] = _md5_heads(np.ascontiguousarray(words.T))
        for k in np.flatnonzero(~short).tolist():
            out[i + k] = int.from_bytes(hashlib.md5(data[at[k] : at[k] + n[k]]).digest()[:4], "big")
    return out % U32(PRIME)


_IN_WORD = np.zeros(256, bool)
_IN_WORD[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True


def _word_hashes(texts: list[str], ngram: int) -> tuple[np.ndarray, np.ndarray]:
    """Element hashes of all texts one after another, with repetitions, which change no minimum; how many each has."""
    raw = [t.lower().encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    word = _IN_WORD[data]
    turn = np.flatnonzero(np.diff(word, prepend=False))
    s, e = turn[::2], turn[1::2]
    edge = np.cumsum([0, *(len(r) + 1 for r in raw)])
    first = np.searchsorted(s, edge)
    words = np.diff(first)
    word[e] = True  # the words, with one byte behind each
    plain = np.append(data[word], np.zeros(64, np.uint8))
    end = np.cumsum(e - s + 1)
    plain[end - 1] = 32
    n = np.where(words > 0, np.maximum(1, words - ngram + 1), 0)
    lo = np.repeat(first[:-1] - np.cumsum(n) + n, n) + np.arange(n.sum())
    hi = np.minimum(lo + ngram, np.repeat(first[1:], n)) - 1
    start = end[lo] - (e - s)[lo] - 1
    return _span_hashes(plain, start, end[hi] - 1 - start), n


def _minima(hashes: np.ndarray, n: np.ndarray, p: SearchParams) -> np.ndarray:
    """(texts, num_perm): minima of (a h + b) mod PRIME over each text's hashes."""
    out = np.full((len(n), p.num_perm), PRIME, U32)
    # Twice the value, so that its upper and lower 31 bits are two words of 32.
    a, b = (2 * np.array(x, U64) for x in permutations(p.num_perm, p.seed))
    some = np.flatnonzero(n)
    begin = (np.cumsum(n) - n)[some]
    for i in range(0, len(hashes), BLOCK):
        h = hashes[i : i + BLOCK].astype(U64)
        k0, k1 = int(np.searchsorted(begin, i, "right")) - 1, int(np.searchsorted(begin, i + len(h)))
        at = np.maximum(begin[k0:k1] - i, 0)
        x, y, z = np.empty(len(h), U64), np.empty(len(h), U32), np.empty(len(h), U32)
        low, high = x.view("<u4")[::2], x.view("<u4")[1::2]
        least = np.empty((p.num_perm, len(at)), U32)
        for k in range(p.num_perm):
            np.multiply(h, a[k], out=x)
            np.add(x, b[k], out=x)
            np.right_shift(low, U32(1), out=y)
            np.add(y, high, out=y)
            np.subtract(y, U32(PRIME), out=z)  # below zero becomes large
            np.minimum(y, z, out=y)
            np.minimum.reduceat(y, at, out=least[k])
        rows = some[k0:k1]
        out[rows] = np.minimum(out[rows], least.T)
    return out


class _Known:
    """What a worker has seen of assembly: normalised tokens, element hashes, and signatures by token sequence, of which listings have few."""

    def __init__(self):
        self.tokens, self.hashes, self.rows = {}, {}, {}

    def minima(self, texts: list[str], p: SearchParams) -> np.ndarray:
        keys = ["\n".join(asm_token_list(t, self.tokens)) for t in texts]
        new = [k for k in dict.fromkeys(keys) if k not in self.rows]
        parts = [self.of(k.split("\n") if k else [], p) for k in new]
        made = _minima(np.concatenate([np.zeros(0, U32), *parts]), np.array([len(x) for x in parts], np.int64), p)
        own = dict(zip(new, made))
        out = np.stack([own[k] if k in own else self.rows[k] for k in keys])
        if len(self.rows) + len(own) > KNOWN >> 4:
            self.rows.clear()
        self.rows.update((k, v.copy()) for k, v in list(own.items())[: KNOWN >> 4])
        return out

    def of(self, tokens: list[str], p: SearchParams) -> np.ndarray:
        if len(self.hashes) > KNOWN:
            self.hashes.clear()
        es = _weighted(shingle_list(tokens, p.ngram))
        for e in es:
            if e not in self.hashes:
                self.hashes[e] = int.from_bytes(hashlib.md5(e.encode("utf-8", "replace")).digest()[:4], "big") % PRIME
        return np.fromiter((self.hashes[e] for e in es), U32, len(es))


def signature_rows(texts: list[str], p: SearchParams, known: _Known | None = None) -> np.ndarray:
    """(texts, num_perm): all PRIME for a text without elements."""
    if not texts:
        return np.zeros((0, p.num_perm), U32)
    return (known or _Known()).minima(texts, p) if p.tokenizer == "asm" else _minima(*_word_hashes(texts, p.ngram), p)


def signatures(texts, p: SearchParams) -> list[np.ndarray | None]:
    """All PRIME for a text without elements, None for None."""
    texts = list(texts)
    rows = iter(signature_rows([t for t in texts if t is not None], p).astype(np.int64))
    return [None if t is None else next(rows) for t in texts]


def pieces(size: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Runs of rows of about `most` bytes, or of one row."""
    total = np.cumsum(size)
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


def give_back() -> None:
    """A worker is kept for later tasks, and an allocator what a task has freed; here it goes back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc alone
        trim(0)


def text_sizes(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def signature_udf(p: SearchParams):
    """Not deterministic for the optimiser, which would otherwise take it once for each filter and each column above it."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def signature(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = _Known()
        try:
            for texts in batches:
                valid = texts.is_valid().to_numpy(zero_copy_only=False)
                values = np.empty((int(valid.sum()), p.num_perm), np.int64)
                at = 0
                for lo, hi in pieces(text_sizes(texts)):
                    rows = signature_rows([t for t in texts.slice(lo, hi - lo).to_pylist() if t is not None], p, known)
                    values[at : at + len(rows)] = rows
                    at += len(rows)
                offs = np.append(0, np.cumsum(valid * p.num_perm)).astype(np.int32)
                yield pa.ListArray.from_arrays(pa.array(offs), pa.array(values.ravel()), mask=pa.array(~valid) if not valid.all() else None)
                del values, texts
        finally:
            give_back()

    return signature.asNondeterministic()
