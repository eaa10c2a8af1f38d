"""Toxicity by multiple-instance learning: a document is a bag of sentences and only the document is labelled.

A sentence's score is a logistic function of the distinct hashed words, and word beginnings of four and five bytes, that it has; a
document's is the noisy-or 1 - prod(1 - score). The weights are fitted to document labels by gradient steps on the likelihood of the noisy-or,
over a bounded sample of labelled documents (`sample`, the one bound here), so that blame goes to the sentences that
explain the label. In scoring, what a sentence adds is its score beyond that of a sentence without weighted features, so that length alone adds
nothing. The fit is first with an L1 penalty, which leaves few features, then those alone with the bias held low, since the
noisy-or would otherwise add up the bias of a long text's many sentences. Scoring is one map-only pass of sparse numpy batches over
whole texts. A document at or over `threshold` is toxic; its offending sentences are those whose own score is at least
`sentence_threshold`, and its highest sentence in any case.

Sentences end at '.', '!' or '?' before white space, and at line ends. Defined cases: null, empty and word-less texts have score 0; null labels
and null ids are left out of the fit; repeated (doc_id, toxic) labels count once, contradictory ones as toxic; repeated
documents are each scored; without a document of either class nothing is learnt and nothing is toxic.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import npwords as W
from .tables import released, same_columns, with_text

#: Parameters of production. FEATURES is a power of two.
SAMPLE, FEATURES, EPOCHS, MIN_DOCS, L1, BIAS, THRESHOLD, SENTENCE_THRESHOLD = 10_000, 1 << 18, 60, 5, 3e-4, -10.0, 0.5, 0.5
SENTENCES = "doc_id bigint, doc_score double, sentence int, start int, end int, score double, sentence_text string"


def _sentences(c: W.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """The number of each word's sentence, counted through the chunk, and the bytes where sentences end."""
    d = c.data
    stop = (d == 46) | (d == 33) | (d == 63)
    stop[:-1] &= (d[1:] == 32) | (d[1:] == 10) | (d[1:] == 13) | (d[1:] == 9)
    ends = np.flatnonzero(stop | (d == 10) | (d == 13)) + 1
    ends = np.union1d(ends, c.offs[1:])
    return np.searchsorted(ends, c.s, "right"), ends


def _features(c: W.Chunk) -> np.ndarray:
    """Three rows of feature numbers, a column for each word; 0 stands for none."""
    values = W._BYTE[c.data]
    out = np.zeros((3, len(c.h)), np.int64)
    for k, h in enumerate((c.h, *(W.mix(W.span_hashes(values, c.s, np.minimum(c.e, c.s + n)) + W.U(n)) for n in (4, 5)))):
        f = 1 + (h % W.U(FEATURES - 1)).astype(np.int64)
        out[k] = np.where(c.e - c.s > 3 + k, f, 0) if k else f
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    threshold: float
    sentence_threshold: float

    def scores(self, c: W.Chunk):
        """Of each sentence with a weighted feature: its row, its number in the chunk, its score; then each row's score; then sentence ends."""
        sent, ends = _sentences(c)
        n_rows = c.hi - c.lo
        if not len(sent):
            return sent, sent, np.zeros(0), np.zeros(n_rows), ends
        f = _features(c)
        k, at = np.nonzero(self.weights[f])
        pair = np.unique(sent[at] * FEATURES + f[k, at])
        own, first = np.unique(pair // FEATURES, return_index=True)
        p = _sigmoid(np.add.reduceat(self.weights[pair % FEATURES], first) + self.bias) if len(pair) else np.zeros(0)
        row = np.searchsorted(c.offs, ends[own], "left") - 1
        base = np.log1p(-_sigmoid(np.array(self.bias)))
        none = np.zeros(n_rows)
        np.add.at(none, row, np.minimum(np.log1p(-np.minimum(p, 1 - 1e-12)) - base, 0))
        return row, own, p, -np.expm1(none), ends


def _labelled(docs: DataFrame, labels: DataFrame, sample: int) -> list[tuple[int, bytes]]:
    """(toxic, sentences of hashed words) of at most about `sample` labelled documents, drawn by a hash of the id."""
    own = with_text(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = own.count()
    if n > sample:
        own = own.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) < int(sample / n * (1 << 30)))

    def each(batches):
        for b in batches:
            feats: list[bytes] = [b""] * b.num_rows
            for c in W.chunks(b.column(1)):
                sent, _ = _sentences(c)
                f = _features(c)
                for r in range(c.hi - c.lo):
                    a, z = c.word_at[r], c.word_at[r + 1]
                    pair = np.unique(((sent[a:z] - (sent[a] if z > a else 0)) * FEATURES + f[:, a:z])[f[:, a:z] > 0])
                    feats[c.lo + r] = np.stack([pair % FEATURES, pair // FEATURES]).astype(np.uint32).tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(feats, pa.binary())], ["toxic", "feats"])

    # The sample's ids are bounded by the parameter, so their side may be broadcast.
    joined = with_text(docs, "doc_id", "text").join(F.broadcast(own), "doc_id").select("toxic", "text")
    return [(int(r[0]), bytes(r[1])) for r in joined.mapInArrow(released(each), "toxic int, feats binary").collect()]


#: Documents whose sentences are held as arrays at a time while fitting.
BLOCK = 250


@dataclass
class Block:
    """Some bags: the features of their sentences, the sentences, their documents, the labels."""

    word: np.ndarray
    sent: np.ndarray
    doc_of: np.ndarray
    y: np.ndarray

    def only(self, index: np.ndarray) -> Block:
        keep = index[self.word] >= 0
        return Block(index[self.word[keep]].astype(np.int32), self.sent[keep], self.doc_of, self.y)


def _block(bags: list[tuple[int, bytes]]) -> Block:
    each = [np.frombuffer(f, np.uint32).reshape(2, -1) for _, f in bags]
    sizes = np.array([int(f[1].max()) + 1 for f in each])
    base = np.cumsum(np.append(0, sizes))
    return Block(np.concatenate([f[0] for f in each]).astype(np.int32), np.concatenate([f[1] + k for f, k in zip(each, base)]).astype(np.int32), np.repeat(np.arange(len(each)), sizes), np.array([y for y, _ in bags], float))


def _descend(blocks: list[Block], n: int, l1: float, bias: float, epochs: int, rate: float = 1.0, v=None, free: bool = True):
    """Proximal AdaGrad on the negative mean log-likelihood of the noisy-or. Returns the weights and the bias."""
    v, g2, gb2 = np.zeros(n) if v is None else v, np.full(n, 1e-8), 1e-8
    total = sum(len(b.y) for b in blocks)
    for _ in range(epochs):
        g, gb = np.zeros(n), 0.0
        for b in blocks:
            p = _sigmoid(np.bincount(b.sent, v[b.word], len(b.doc_of)) + bias)
            none = np.bincount(b.doc_of, np.log1p(-np.minimum(p, 1 - 1e-9)), len(b.y))
            some = np.maximum(-np.expm1(none), 1e-9)
            dz = np.where(b.y[b.doc_of] > 0, p * ((1 - some) / some)[b.doc_of], -p)
            g += np.bincount(b.word, dz[b.sent], n) / total
            gb += dz.sum() / total
        g2 += g * g
        step = rate / np.sqrt(g2)
        v = v + step * g
        v = np.sign(v) * np.maximum(np.abs(v) - step * l1, 0)
        if free:
            gb2 += gb * gb
            bias = min(-3.0, bias + 0.2 * gb / np.sqrt(gb2))
    return v, bias


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, epochs: int = EPOCHS, min_docs: int = MIN_DOCS, l1: float = L1, bias: float = BIAS, threshold: float = THRESHOLD, sentence_threshold: float = SENTENCE_THRESHOLD) -> Model:
    """The model of a sample's labels. Features of fewer than min_docs documents of the sample have no weight."""
    weights = np.zeros(FEATURES)
    bags = sorted(x for x in _labelled(docs, labels, sample) if x[1])
    positive = sum(y for y, _ in bags)
    if 0 < positive < len(bags):
        seen = np.zeros(FEATURES, np.int64)
        for _, f in bags:
            seen[np.unique(np.frombuffer(f, np.uint32)[: len(f) // 8])] += 1
        used = np.flatnonzero(seen >= min(min_docs, max(1, positive // 4)))
        index = np.full(FEATURES, -1, np.int64)
        index[used] = np.arange(len(used))
        blocks = []
        while bags:
            blocks.append(_block(bags[-BLOCK:]).only(index))
            del bags[-BLOCK:]
        v, _ = _descend(blocks, len(used), l1, -6.0, epochs)
        kept = np.flatnonzero(np.abs(v) > 0.5)
        if len(kept):
            index = np.full(len(used), -1, np.int64)
            index[kept] = np.arange(len(kept))
            blocks = [b.only(index) for b in blocks]
            v, _ = _descend(blocks, len(kept), l1 / 30, bias, 2 * epochs, v=v[kept] + (-bias - 6) * (v[kept] > 0), free=False)
            weights[used[kept]] = v
    return Model(weights, bias, threshold, sentence_threshold)


def offending_sentences(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """A row for each offending sentence of each toxic document: its place in characters, its score and its document's."""
    m = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **how))

    def each(batches):
        for b in batches:
            ids, text, rows = b.column(0).to_pylist(), W.texts(b.column(1)), []
            for c in W.chunks(text):
                row, sent, p, doc, ends = m.value.scores(c)
                for r in np.flatnonzero(doc >= m.value.threshold).tolist():
                    own = np.flatnonzero(row == r)
                    if not len(own):
                        continue
                    t = text[c.lo + r].as_py()
                    raw = t.encode()
                    same = len(raw) == c.offs[r + 1] - c.offs[r]
                    before = int(np.searchsorted(ends, c.offs[r], "right"))
                    for j in own[(p[own] >= m.value.sentence_threshold) | (p[own] == p[own].max())].tolist():
                        k = int(sent[j])
                        a = int(ends[k - 1] if k and ends[k - 1] > c.offs[r] else c.offs[r]) - int(c.offs[r])
                        z = int(ends[k]) - int(c.offs[r])
                        if not same:  # lower case has other lengths: the place is counted in the lower-cased text
                            raw = c.data[c.offs[r] : c.offs[r + 1]].tobytes()
                        start = len(raw[:a].decode(errors="replace"))
                        said = raw[a:z].decode(errors="replace")
                        rows.append((ids[c.lo + r], float(doc[r]), k - before, start, start + len(said), float(p[j]), said.strip()))
            if rows:
                kinds = (pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], ["doc_id", "doc_score", "sentence", "start", "end", "score", "sentence_text"])

    return with_text(docs, "doc_id", "text").mapInArrow(released(each), SENTENCES)


def reject_toxic(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """docs without the toxic documents, in one pass that keeps all columns."""
    m = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **how))

    def each(b):
        keep = np.ones(b.num_rows, bool)
        for c in W.chunks(b.column(b.schema.names.index("text"))):
            keep[c.lo : c.hi] = m.value.scores(c)[3] < m.value.threshold
        return b.filter(pa.array(keep))

    return same_columns(docs, each)
