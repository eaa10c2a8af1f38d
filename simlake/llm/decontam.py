"""Benchmark decontamination by a generalised suffix automaton over the words of the test items.

The automaton of all normalised items is built once on the driver (the benchmark's size is checked first) and broadcast. A
map-only pass then streams each document's words and tracks the longest match that ends at each word. Stepping the automaton
is Python work, so words that can't be part of a match of MIN_MATCH words are skipped in bulk: such a match consists of
consecutive benchmark trigrams, and only runs of those are walked, which changes no result.

A maximal match is removed if it has at least max_words words, or at least min_words words and max_coverage of the shortest
item that contains it. Removed spans with at most `bridge` words between them are removed as one.

Defined cases: null, empty and word-less texts have no spans and stay; null or word-less items match nothing; equal items count
as one (the smallest item_id is named); repeated documents are each treated; an empty benchmark leaves all as it was; a
document of which no letter or digit is left goes. A benchmark of more words than broadcast_words is worked off in slices of items, one
map step per slice, which only note their matches; what is maximal among all of them is then decided as if there were one automaton.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import npwords as W
from .tables import fresh, released, replace_text, with_text

#: Parameters of production.
MAX_WORDS, MIN_WORDS, MAX_COVERAGE, BRIDGE, BROADCAST_WORDS = 13, 8, 0.5, 2, 4_000_000
SPANS = "doc_id bigint, span int, start int, end int, n_words int, item_id bigint, coverage double, passage string"


class Automaton:
    """Generalised suffix automaton. State 0 is the root; item[q] and size[q] are the shortest item that contains q's strings."""

    def __init__(self, items: list[tuple[int, list[int]]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.item, self.size = [-1], [1 << 30]
        for item, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        for item, words in sorted(items, key=lambda x: (-len(x[1]), -x[0])):  # the shortest, then smallest id, comes last and wins
            q = 0
            for w in words:
                q = self.next[q][w]
                p = q
                while p > 0 and self.item[p] != item:
                    self.item[p], self.size[p] = item, len(words)
                    p = self.link[p]

    def _state(self, length: int, nxt: dict[int, int], link: int) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        self.item.append(-1)
        self.size.append(1 << 30)
        return len(self.next) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        c = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def _extend(self, p: int, w: int) -> int:
        q = self.next[p].get(w)
        if q is not None:
            return q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        cur = self._state(self.length[p] + 1, {}, -1)
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p < 0:
            self.link[cur] = 0
        else:
            q = self.next[p][w]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return cur

    def matches(self, words: list[int]) -> list[tuple[int, int, int, int]]:
        """Maximal matches as (first word, end word, item, the item's length): of each end the longest, if it can't go on."""
        q = n = 0
        out = []
        for i, w in enumerate(words):
            if w in self.next[q]:
                q, n = self.next[q][w], n + 1
                continue
            if n:
                out.append((i - n, i, self.item[q], self.size[q]))
            while q > 0 and w not in self.next[q]:
                q = self.link[q]
                n = self.length[q]
            if w in self.next[q]:
                q, n = self.next[q][w], n + 1
            else:
                q = n = 0
        if n:
            out.append((len(words) - n, len(words), self.item[q], self.size[q]))
        return out


class Detector:
    def __init__(self, items: list[tuple[int, str]], max_words: int, min_words: int, max_coverage: float, bridge: int):
        self.max_words, self.min_words, self.max_coverage, self.bridge = max_words, min_words, max_coverage, bridge
        words: dict[bytes, tuple[int, np.ndarray]] = {}
        for c in W.chunks(pa.array([t for _, t in items], pa.string())):
            for r in range(c.hi - c.lo):
                h = c.h[c.word_at[r] : c.word_at[r + 1]]
                if len(h):
                    item = items[c.lo + r][0]
                    words[h.tobytes()] = (min(item, words.get(h.tobytes(), (item,))[0]), h)
        each = list(words.values())
        self.vocab = np.unique(np.concatenate([h for _, h in each])) if each else np.zeros(0, W.U)
        self.ids = W.Table(self.vocab, np.arange(len(self.vocab)))
        self.auto = Automaton([(i, np.searchsorted(self.vocab, h).tolist()) for i, h in each])
        # The shortest match that any rule can remove; runs of its trigrams are walked.
        self.least = max(1, min(max_words, min_words))
        self.gram = min(3, self.least)
        grams = [W.ngrams(h, np.zeros(len(h), np.int8), self.gram)[0] for _, h in each if len(h) >= self.gram]
        self.grams = W.Table(g := np.unique(np.concatenate(grams)), np.zeros(len(g))) if grams else None

    def matches(self, c: W.Chunk) -> dict[int, list[tuple[int, int, int, int]]]:
        """Of each row of the chunk with any: the maximal matches that may count (first word, end word, item, its length)."""
        if self.grams is None or not len(c.h):
            return {}
        known = self.ids.get(c.h)
        row, k = c.rows(), self.gram
        ok = known >= 0
        run = ok[: len(ok) - k + 1].copy() if len(ok) >= k else np.zeros(0, bool)
        for j in range(1, k):
            run &= ok[j : len(ok) - k + 1 + j]
        at = np.flatnonzero(run)
        at = at[row[at] == row[at + k - 1]]
        g = c.h[at]
        for j in range(1, k):
            g = W.mix(g * W.U(3) + c.h[at + j])
        at = at[self.grams.get(g) >= 0]
        if not len(at):
            return {}
        edge = np.flatnonzero((np.diff(at) != 1) | (row[at[1:]] != row[at[:-1]]))
        first, last = at[np.append(0, edge + 1)], at[np.append(edge, len(at) - 1)] + k
        out: dict[int, list] = {}
        for a, b in zip(first[keep := last - first >= self.least].tolist(), last[keep].tolist()):
            r = int(row[a])
            base = a - int(c.word_at[r])
            for s, e, item, size in self.auto.matches(known[a:b].tolist()):
                if e - s >= self.least:
                    out.setdefault(r, []).append((base + s, base + e, item, size))
        return out

    def spans(self, found: list) -> list[tuple[int, int, int, int]]:
        """Of one text's matches with all slices: those that no other contains and that the limits remove, joined, in order and apart."""
        out: list = []
        reach = -1
        for s, e, size, item in sorted(((s, e, size, item) for s, e, item, size in found), key=lambda x: (x[0], -x[1], x[2], x[3])):
            if e <= reach:
                continue
            reach = e
            if e - s < self.max_words and (e - s < self.min_words or e - s < self.max_coverage * size):
                continue
            if out and s - out[-1][1] <= self.bridge:
                p = out[-1]
                best = (item, size) if e - s > p[1] - p[0] else p[2:]
                out[-1] = (p[0], e, *best)
            else:
                out.append((s, e, item, size))
        return out


def _char(data: np.ndarray, lo: int, at: int) -> int:
    """Code points between the bytes lo and at."""
    return int(((data[lo:at] & 0xC0) != 0x80).sum())


def _places(c: W.Chunk, r: int, spans: list) -> list[tuple[int, int]]:
    """Spans of words as spans of the original text's characters, of which each has just one in lower case."""
    w, lo = int(c.word_at[r]), int(c.offs[r])
    return [(_char(c.data, lo, int(c.s[w + a])), _char(c.data, lo, int(c.e[w + b - 1]))) for a, b, *_ in spans]


def _slices(benchmark: DataFrame, broadcast_words: int) -> list[list[tuple[int, str]]]:
    """The items as lists of at most about broadcast_words words each (an item alone may have more)."""
    items = with_text(benchmark, "item_id", "text").where("text is not null")
    total = items.agg(F.sum(F.length("text")), F.max(F.length("text"))).first()[0] or 0
    parts = int(total // (6 * broadcast_words)) + 1
    if parts == 1:
        return [[(-1 if r[0] is None else int(r[0]), r[1]) for r in items.collect()]]
    own: list[list[tuple[int, str]]] = [[] for _ in range(parts)]
    for r in items.select("item_id", "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)).cast("int")).toLocalIterator():
        own[r[2]].append((-1 if r[0] is None else int(r[0]), r[1]))
    return own


def _found(docs: DataFrame, benchmark: DataFrame, finish, schema, max_words, min_words, max_coverage, bridge, broadcast_words) -> DataFrame:
    """finish(batch of docs, texts, [(row, words of its chunk, row in it, spans)]) in place of each batch. The last slice's step
    decides, on what the steps before it have noted in a column of their own."""
    slices = _slices(benchmark, broadcast_words)
    noted = fresh(docs, "matches")
    kept = T.StructType([*docs.schema.fields, T.StructField(noted, T.BinaryType())])
    at = docs.columns.index("text")
    for k, items in enumerate(slices):
        shared = docs.sparkSession.sparkContext.broadcast(Detector(items, max_words, min_words, max_coverage, bridge))
        first, last = k == 0, k == len(slices) - 1

        def each(batches, shared=shared, first=first, last=last):
            for b in batches:
                text = W.texts(b.column(at))
                before: list[bytes | None] = [None] * b.num_rows if first else b.column(b.num_columns - 1).to_pylist()
                own = b if first else pa.RecordBatch.from_arrays(b.columns[:-1], b.schema.names[:-1])
                rows = []
                for c in W.chunks(text):
                    new = shared.value.matches(c)
                    for r in range(c.hi - c.lo) if not first else new:
                        found = [tuple(x) for x in np.frombuffer(before[c.lo + r] or b"", np.int64).reshape(-1, 4).tolist()] + new.get(r, [])
                        if not found:
                            continue
                        if not last:
                            before[c.lo + r] = np.array(found, np.int64).tobytes()
                        elif spans := shared.value.spans(found):
                            rows.append((c.lo + r, spans, _places(c, r, spans)))
                if not last:
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(before, pa.binary())], [*own.schema.names, noted])
                elif (out := finish(own, text, rows)) is not None:
                    yield out

        docs = docs.mapInArrow(released(each), schema if last else kept)
    return docs


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, max_words: int = MAX_WORDS, min_words: int = MIN_WORDS, max_coverage: float = MAX_COVERAGE, bridge: int = BRIDGE, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """A row for each span to be removed: its document, number, place in characters, words, the item matched and how much of it."""

    def finish(b, text, found):
        ids, rows = b.column(0).to_pylist(), []
        for i, spans, places in found:
            t = text[i].as_py()
            for k, ((a, z), (s, e, item, size)) in enumerate(zip(places, spans)):
                rows.append((ids[i], k, a, z, e - s, None if item < 0 else item, min(1.0, (e - s) / size), t[a:z]))
        if not rows:
            return None
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], ["doc_id", "span", "start", "end", "n_words", "item_id", "coverage", "passage"])

    return _found(with_text(docs, "doc_id", "text"), benchmark, finish, SPANS, max_words, min_words, max_coverage, bridge, broadcast_words)


def decontaminate(docs: DataFrame, benchmark: DataFrame, max_words: int = MAX_WORDS, min_words: int = MIN_WORDS, max_coverage: float = MAX_COVERAGE, bridge: int = BRIDGE, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """docs without the spans; n_chars follows the text. A text that is left without a letter or digit by this goes; others keep their rows."""

    def finish(b, text, found):
        if not found:
            return b
        new: dict[int, str] = {}
        for i, _, places in found:
            t, parts, last = text[i].as_py(), [], 0
            for a, z in places:
                parts.append(t[last:a])
                last = z
            new[i] = "".join([*parts, t[last:]])
        old = b.column(b.schema.names.index("text")).to_pylist()
        gone = [i in new and not any(ch.isalnum() for ch in new[i]) for i in range(len(old))]
        b = replace_text(b, [new.get(i, t) for i, t in enumerate(old)])
        return b.filter(pa.array([not g for g in gone]))

    return _found(docs, benchmark, finish, docs.schema, max_words, min_words, max_coverage, bridge, broadcast_words)
