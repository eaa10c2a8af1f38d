"""Token counts of a byte-level BPE by a map-side two-tier lookup of pre-token lengths.

A text's tokens are the sum over its pre-tokens (the pieces that the vocabulary's pattern splits it into). The first tier is a compact hash table
from 64-bit hashes of frequent pre-tokens to their lengths in tokens, broadcast; its size is bounded by `frequent`. The
second tier is each worker's cache: what the table lacks is encoded once by the worker and remembered, for up to `cache`
pre-tokens. No pre-token is shuffled: frequent ones are found by summaries of bounded size, one per task, over all documents, merged on the way.
Pre-tokens are cut and hashed as numpy arrays of code points; the pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

is followed exactly, by a table of character classes.

Defined cases: null text gives null counts, empty text 0; repeated rows are each counted; a table of another size changes no count.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import npwords as W
from .tables import with_text

U = W.U
#: Parameters of production. VOCABULARY is a path to a rank file; another may be given.
VOCABULARY, FREQUENT, PER_TASK, CACHE = "/opt/tokenizers/byte_bpe_50k.tiktoken", 1 << 16, 1 << 13, 1 << 19
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """The class of every code point, by the Unicode tables of the regex package."""
    global _classes
    if _classes is None:
        import regex

        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        _classes = np.zeros(0x110000, np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(pattern, every):
                a, z = (x + 0x800 * (x >= 0xD800) for x in (m.start(), m.end() - 1))
                _classes[a : z + 1] = kind
    return _classes


def pretokens(cp: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens of the texts cp[offs[i]:offs[i + 1]]."""
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = classes()[cp]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    start = np.ones(n, bool)
    start[1:] = (kind[1:] != kind[:-1]) | edge[1:n]
    run = np.flatnonzero(start)
    end = np.append(run[1:], n)
    space = kind[run] == SPACE
    # A run of white space before other characters leaves its last one: a blank joins what follows, another stands alone.
    follows = ~edge[end]
    last = end[space & follows] - 1
    start[last] = True
    blank = last[cp[last] == 32]
    start[blank + 1] = False
    # Contractions: an apostrophe alone in its run that no blank has joined, before certain letters.
    q = run[(cp[run] == 39) & (end - run == 1) & start[run]]
    if len(q):
        c1 = np.where((q + 1 < n) & ~edge[np.minimum(q + 1, n)], cp[np.minimum(q + 1, n - 1)], 0)
        c2 = np.where((c1 > 0) & (q + 2 < n) & ~edge[np.minimum(q + 2, n)], cp[np.minimum(q + 2, n - 1)], 0)
        one = np.isin(c1, [ord(x) for x in "stmd"])
        two = ((c1 == ord("r")) & (c2 == ord("e"))) | ((c1 == ord("v")) & (c2 == ord("e"))) | ((c1 == ord("l")) & (c2 == ord("l")))
        for at, w in ((q[one], 1), (q[two], 2)):
            start[at + 1] = False
            after = at + 1 + w
            start[after[after < n]] = True
    s = np.flatnonzero(start)
    return s, np.append(s[1:], n)


def points(text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, code points, offsets) of runs of rows."""
    for lo, hi, data, offs in W.raw_chunks(text, 1 << 19):
        cp = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        count = np.append(0, np.cumsum((data & 0xC0) != 0x80))
        yield lo, hi, cp, count[offs]


def _hashes(cp: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    return W.span_hashes(W.mix(cp.astype(U) + U(0x51ED27)), s, e)


class Encoder:
    """The second tier: a worker's vocabulary and its cache of lengths."""

    _of: dict[str, Encoder] = {}

    def __init__(self, vocabulary: str, cache: int = CACHE):
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("lengths", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.single = {k for k in ranks}
        self.cache, self.room = {}, cache
        self.encoded = 0

    @classmethod
    def of(cls, vocabulary: str, cache: int = CACHE) -> Encoder:
        if vocabulary not in cls._of:
            cls._of[vocabulary] = cls(vocabulary, cache)
        return cls._of[vocabulary]

    def length(self, token: str) -> int:
        raw = token.encode()
        if raw in self.single:
            return 1
        self.encoded += 1
        return len(self.encoding.encode_ordinary(token))

    def fill(self, h: np.ndarray, cp: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Lengths of distinct pre-tokens, from the cache or encoded."""
        out = np.empty(len(h), np.int64)
        raw = cp.tobytes()
        for i, k in enumerate(h.tolist()):
            n = self.cache.get(k)
            if n is None:
                n = self.length(raw[4 * s[i] : 4 * e[i]].decode("utf-32-le"))
                if len(self.cache) >= self.room:
                    self.cache.clear()
                self.cache[k] = n
            out[i] = n
        return out

    def lengths(self, text: pa.Array, table: W.Table | None = None):
        """(first row, end row, code points, offsets, starts, ends, tokens of each pre-token) of runs of rows."""
        for lo, hi, cp, offs in points(text):
            s, e = pretokens(cp, offs)
            h = _hashes(cp, s, e)
            n = np.full(len(h), -1, np.int64) if table is None else table.get(h).astype(np.int64)
            miss = np.flatnonzero(n < 0)
            if len(miss):
                u, first, inv = np.unique(h[miss], return_index=True, return_inverse=True)
                n[miss] = self.fill(u, cp, s[miss[first]], e[miss[first]])[inv]
            yield lo, hi, cp, offs, s, e, n


_SUMMARY = np.dtype([("h", "<u8"), ("n", "<i8"), ("len", "<i4")])


def _merge(parts: list[np.ndarray], keep: int) -> np.ndarray:
    every = np.concatenate(parts) if parts else np.zeros(0, _SUMMARY)
    u, first, inv = np.unique(every["h"], return_index=True, return_inverse=True)
    out = np.empty(len(u), _SUMMARY)
    out["h"], out["n"], out["len"] = u, np.bincount(inv, every["n"], len(u)).astype(np.int64), every["len"][first]
    return out[np.lexsort((out["h"], -out["n"]))[:keep]]


def frequent_lengths(docs: DataFrame, frequent: int = FREQUENT, per_task: int = PER_TASK, vocabulary: str = VOCABULARY) -> W.Table:
    """The table of the most frequent pre-tokens of all documents. Each task sums up its own and passes on its per_task most frequent."""

    def count(batches):
        enc = Encoder.of(vocabulary)
        total = np.zeros(0, _SUMMARY)
        for b in batches:
            parts = [total]
            for *_, cp, offs in points(W.texts(b.column(0))):
                s, e = pretokens(cp, offs)
                u, first, n = np.unique(_hashes(cp, s, e), return_index=True, return_counts=True)
                often = n > 1  # within half a megabyte
                p = np.empty(int(often.sum()), _SUMMARY)
                p["h"], p["n"] = u[often], n[often]
                at = first[often]
                p["len"] = enc.fill(p["h"], cp, s[at], e[at])
                parts.append(p)
            total = _merge(parts, 4 * per_task)
        yield pa.RecordBatch.from_arrays([pa.array([total[:per_task].tobytes()], pa.binary())], ["summary"])

    def join(batches):
        total = np.zeros(0, _SUMMARY)
        for b in batches:
            total = _merge([total, *(np.frombuffer(x.as_buffer() or b"", _SUMMARY) for x in b.column(0))], 2 * frequent)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["summary"])

    own = with_text(docs, "text").mapInArrow(count, "summary binary")
    merged = own.repartition(8).mapInArrow(join, "summary binary")
    total = _merge([np.frombuffer(r[0], _SUMMARY) for r in merged.toLocalIterator()], frequent)
    return W.Table(total["h"], total["len"])


def token_counts(docs: DataFrame, frequent: int = FREQUENT, per_task: int = PER_TASK, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, n_pretokens) of each row."""
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, frequent, per_task, vocabulary))

    def each(batches):
        enc = Encoder.of(vocabulary)
        for b in batches:
            tokens, pre = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for lo, hi, _, offs, s, _, n in enc.lengths(W.texts(b.column(1)), table.value):
                at = np.searchsorted(s, offs)
                tokens[lo:hi], pre[lo:hi] = W.seg_sum(n, at), np.diff(at)
            null = np.asarray(b.column(1).is_null())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tokens, mask=null), pa.array(pre, mask=null)], ["doc_id", "n_tokens", "n_pretokens"])

    return with_text(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(each, "doc_id bigint, n_tokens bigint, n_pretokens bigint")
