"""Licence scan: units of a text against licence templates, by the Dice coefficient over sets of word bigrams.

Units are each line, each paragraph (a run of lines between blank ones) of several lines, the whole text if it has several
paragraphs, and each run of consecutive sentences, within a line or over lines and paragraphs. Sentences end at '.', '!', '?', ':' or ';' before
white space, and at line ends. Dice(A, B) = 2 |A & B| / (|A| + |B|). Since it is at most 2 min / (|A| + |B|), only templates whose number of
bigrams lies in [a t / (2 - t), a (2 - t) / t] of a unit's number a can reach the threshold t; units that share no bigram with any
template are passed over in bulk. The best template of a unit is reported (highest coefficient, then name); a larger unit
only where it is a better match than any unit within it. A run is reported where no better unit of the same licence overlaps it, nor a
better one of another licence of which it shares at least half.

Defined cases: null and empty texts, and units of fewer than two words, match nothing; repeated documents are each reported;
templates may be given as (name, text) pairs, of which null or one-word texts match nothing and equal ones tie by name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import npwords as W
from .licence_texts import TEMPLATES
from .tables import with_text

#: Parameter of production.
THRESHOLD = 0.8
MATCHES = "doc_id bigint, unit string, first_line int, last_line int, licence string, dice double, n_bigrams int"


class Scanner:
    def __init__(self, templates: list[tuple[str, str]], threshold: float):
        if not 0 < threshold <= 1:
            raise ValueError("the threshold lies in (0, 1]")
        self.t = threshold
        self.sets: list[tuple[int, str, np.ndarray]] = []
        for c in W.chunks(pa.array([x for _, x in templates], pa.string())):
            for r in range(c.hi - c.lo):
                h = c.h[c.word_at[r] : c.word_at[r + 1]]
                g = np.unique(W.ngrams(h, np.zeros(len(h), np.int8), 2)[0])
                if len(g):
                    self.sets.append((len(g), templates[c.lo + r][0], g))
        self.sets.sort(key=lambda x: (x[0], x[1]))
        self.sizes = np.array([x[0] for x in self.sets])
        every = np.unique(np.concatenate([x[2] for x in self.sets])) if self.sets else np.zeros(0, W.U)
        self.known = W.Table(every, np.arange(len(every))) if len(every) else None
        self.member = np.array([np.isin(every, x[2]) for x in self.sets]).reshape(len(self.sets), len(every))

    def best(self, grams: np.ndarray) -> tuple[float, str] | None:
        """Of one unit's distinct bigrams, sorted."""
        a = len(grams)
        lo = np.searchsorted(self.sizes, a * self.t / (2 - self.t) - 1e-9)
        hi = np.searchsorted(self.sizes, a * (2 - self.t) / self.t + 1e-9, "right")
        top = None
        for n, name, g in self.sets[lo:hi]:
            d = 2 * len(np.intersect1d(grams, g, assume_unique=True)) / (a + n)
            if d >= self.t - 1e-12 and (top is None or (-d, name) < (-top[0], top[1])):
                top = (d, name)
        return top

    def runs(self, g: np.ndarray, known: np.ndarray, atom: np.ndarray) -> list[tuple[float, str, int, int, int]]:
        """(dice, licence, first word, last word, bigrams) of runs of sentences of one text; known are the bigrams' numbers or -1, atom the words' sentences."""
        some = np.unique(known[known >= 0])
        least = self.sizes * self.t / (2 - self.t) - 1e-9  # of shared bigrams, at any size of unit
        start = np.flatnonzero(np.append(True, atom[1:] != atom[:-1]))
        end = np.append(start[1:], len(atom)) - 1  # last words
        out = []
        for k in np.flatnonzero(self.member[:, some].sum(1) >= least).tolist():
            n, name, _ = self.sets[k]
            most = n * (2 - self.t) / self.t + 1e-9
            mine = (known >= 0) & self.member[k, known]
            hits = np.append(0, np.cumsum(mine))
            for i in np.flatnonzero(hits[np.minimum(end + 1, len(g))] > hits[np.minimum(start, len(g))]).tolist():
                a, reach = int(start[i]), 2 * n + 64
                while True:
                    part = g[a : a + reach]
                    new = np.zeros(len(part), bool)
                    new[np.unique(part, return_index=True)[1]] = True
                    size = np.cumsum(new)
                    if size[-1] > most or a + reach >= len(g):
                        break
                    reach *= 2
                shared = np.cumsum(new & mine[a : a + reach])
                last = end[i:][(end[i:] > a) & (end[i:] <= a + len(part))] - a - 1  # the last bigram within each run
                d = 2 * shared[last] / (size[last] + n)
                if len(d) and d.max() >= self.t - 1e-12:
                    j = last[np.argmax(d)]
                    out.append((float(d.max()), name, a, int(a + j + 1), int(size[j])))
        return sorted(out, key=lambda x: (-x[0], x[1], x[2]))

    def scan(self, c: W.Chunk) -> list[tuple[int, str, int, int, str, float, int]]:
        if self.known is None or len(c.h) < 2:
            return []
        row = c.rows()
        g, at = W.ngrams(c.h, row, 2)
        known = self.known.get(g)
        hit = known >= 0
        if not hit.any():
            return []
        out = []
        newline = np.flatnonzero(c.data == 10)
        stop = np.isin(c.data, np.frombuffer(b".!?:;", np.uint8))
        stop[:-1] &= np.isin(c.data[1:], np.frombuffer(b" \t\r\n", np.uint8))
        atom = np.append(0, np.cumsum(stop | (c.data == 10) | (c.data == 13)))[c.s]
        for r in np.unique(row[at[hit]]).tolist():
            a, z = int(c.offs[r]), int(c.offs[r + 1])
            nl = newline[np.searchsorted(newline, a) : np.searchsorted(newline, z)]
            edges = np.concatenate([[a], nl + 1, [z + 1]])  # line k is [edges[k], edges[k + 1])
            w0, w1 = int(c.word_at[r]), int(c.word_at[r + 1])
            of = np.searchsorted(edges, c.s[w0:w1], "right") - 1
            words = np.bincount(of, minlength=len(edges) - 1)
            i0, i1 = np.searchsorted(at, w0), np.searchsorted(at, w1)
            own, first = g[i0:i1], of[at[i0:i1] - w0]
            last, mine = of[at[i0:i1] + 1 - w0], hit[i0:i1]
            found = []
            # Lines with a shared bigram, paragraphs with one, the text.
            units = [("line", k, k) for k in np.unique(first[mine & (first == last)]).tolist()]
            blank = np.flatnonzero(words == 0)
            starts = np.concatenate([[0], blank + 1])
            paras = [(int(s), int(e)) for s, e in zip(starts, np.concatenate([blank, [len(words)]]) - 1) if e > s]
            hits = np.cumsum(np.append(0, np.bincount(first[mine], minlength=len(words))))
            units += [("paragraph", s, e) for s, e in paras if hits[e + 1] > hits[s]]
            full = np.flatnonzero(words)
            if (words[full[0] : full[-1] + 1] == 0).any():
                units.append(("text", int(full[0]), int(full[-1])))
            for kind, s, e in units:
                i = np.unique(own[np.searchsorted(first, s) : np.searchsorted(first, e, "right")][last[np.searchsorted(first, s) : np.searchsorted(first, e, "right")] <= e])
                if (top := self.best(i)) and not any(s <= f[1] and f[2] <= e and f[4] >= top[0] for f in found):
                    found.append((kind, s, e, top[1], top[0], len(i)))
            place = [(f[4], f[3], *np.searchsorted(of, (f[1], f[2] + 1)).tolist()) for f in found]
            for d, name, a, z, n in self.runs(own, known[i0:i1], atom[w0:w1]):
                shares = [(m, min(z + 1, y) - max(a, x), max(z + 1 - a, y - x)) for e, m, x, y in place if e >= d - 1e-12]
                if not any(both > 0 and (m == name or 2 * both >= longer) for m, both, longer in shares):
                    found.append(("run", int(of[a]), int(of[z]), name, d, n))
                    place.append((d, name, a, z + 1))
            out += [(r, *f) for f in found]
        return out


def licence_matches(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each unit of each document that matches a licence."""
    scanner = docs.sparkSession.sparkContext.broadcast(Scanner([(n, t or "") for n, t in (TEMPLATES if templates is None else templates)], threshold))

    def each(batches):
        for b in batches:
            ids, rows = b.column(0).to_pylist(), []
            for c in W.chunks(b.column(1)):
                rows += [(ids[c.lo + r], *x) for r, *x in scanner.value.scan(c)]
            if rows:
                kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], ["doc_id", "unit", "first_line", "last_line", "licence", "dice", "n_bigrams"])

    return with_text(docs, "doc_id", "text").mapInArrow(each, MATCHES)
