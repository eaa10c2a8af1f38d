"""Language-model scoring by a hashed maximum-entropy model with a class-factored softmax.

The vocabulary is the most frequent words of all documents, in order of frequency, and one unknown word; CLASSES classes of equal size are
runs of that order. Any other word of the corpus has a part of the unknown word's probability: its own share of all occurrences of such words, counted
exactly, however many there are. So a text of rare words has the price of picking them out, and the rarer the dearer. P(word | context) = P(class | context) P(word | class, context), both softmaxes of sums of weight
rows that features of the context select by hash: a bias, the last word, the last two words, and the skip feature of the word before the
last. A row holds the weights of all classes, or of all words of a class, so that a batch of tokens is a few gathers and sums. Tokens of a batch
with the same two words before them share the sums of classes, and those whose class is the same, too, the sums of words.

Every document is trained on once. The documents are split by a hash into `rounds` parts; in each round every task starts from the shared weights,
takes AdaGrad steps over the batches of its documents of that part, and emits its change of each row. Changes are averaged over the tasks that touched the row, by the tokens that did, and added.
Which documents a task has depends on how the table is split, so scores differ slightly (in the third digit) between clusters. Word counts, rare words of texts and changes go through the shuffle in packed blocks, so what is gathered grows with the corpus; what reaches the driver is one model.

Defined cases: null, empty and word-less texts have 0 tokens and a null score; repeated rows are scored alike; a corpus without words gives
null scores; the first word of a text has a context of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import npwords as W
from .neargroups import PACKED, block_count, pack, packed_batch
from .tables import with_text

U = W.U
#: Parameters of production.
VOCABULARY, CLASSES, CLASS_ROWS, WORD_ROWS, ROUNDS, RATE, BATCH = 4096, 64, 1 << 13, 1 << 14, 3, 1.0, 8192
_COUNT = np.dtype([("h", "<u8"), ("n", "<i8")])
#: A rare word of a text and how often it stands there.
_RARE = np.dtype([("h", "<u8"), ("text", "<i8"), ("n", "<u4")])
#: Rows of weights in one emitted block.
_BLOCK = 256
#: Occurrences of rare words that one task prices.
RARE_PER_TASK = 4_000_000


def _sum_counts(parts: list[np.ndarray]) -> np.ndarray:
    every = np.concatenate(parts) if parts else np.zeros(0, _COUNT)
    u, inv = np.unique(every["h"], return_inverse=True)
    out = np.empty(len(u), _COUNT)
    out["h"], out["n"] = u, np.bincount(inv, every["n"], len(u)).astype(np.int64)
    return out


def word_counts(docs: DataFrame, size: int) -> tuple[np.ndarray, int, int]:
    """The `size` most frequent words of all documents, most frequent first, ties by hash; how many words there are in all, and how often the others occur, which rare_prices() gives their shares.
    Tasks sum up what they have, some words at a time."""
    blocks = block_count(docs.sparkSession)

    def count(batches):
        parts: list[np.ndarray] = []
        held = 0

        def out():
            total = _sum_counts(parts)
            return packed_batch(list(pack(total["h"], total, blocks))) if len(total) else None

        for b in batches:
            for c in W.chunks(b.column(0)):
                u, n = np.unique(c.h, return_counts=True)
                p = np.empty(len(u), _COUNT)
                p["h"], p["n"] = u, n
                parts.append(p)
                held += len(u)
                if held > 1_500_000:
                    parts = [_sum_counts(parts)]
                    held = len(parts[0])
                    if held > 1_000_000:
                        yield out()
                        parts, held = [], 0
        if parts and (rest := out()) is not None:
            yield rest

    def top(batches):
        total = _sum_counts([np.frombuffer(x.as_buffer() or b"", _COUNT) for b in batches for x in b.column(1)])
        best = total[np.lexsort((total["h"], -total["n"]))[:size]]
        yield pa.RecordBatch.from_arrays([pa.array([best.tobytes()], pa.binary()), pa.array([len(total)], pa.int64()), pa.array([int(total["n"].sum())], pa.int64())], ["top", "n", "tokens"])

    total, types, tokens = np.zeros(0, _COUNT), 0, 0
    for best, n, some in with_text(docs, "text").mapInArrow(count, PACKED).repartition("pid").mapInArrow(top, "top binary, n bigint, tokens bigint").toLocalIterator():
        total = np.concatenate([total, np.frombuffer(best, _COUNT)])
        total, types = total[np.lexsort((total["h"], -total["n"]))[:size]], types + n
        tokens += some
    return total["h"].copy(), types, tokens - int(total["n"].sum())


@dataclass
class Model:
    words: np.ndarray
    a: np.ndarray
    b: np.ndarray
    classes: int
    #: Distinct words of the corpus, those of the vocabulary included.
    types: int = 0
    #: Occurrences of all words that aren't of the vocabulary.
    rare: int = 0

    def __post_init__(self):
        self.table = W.Table(self.words, np.arange(len(self.words)))
        self.per = self.b.shape[1]
        self.unknown = self.classes * self.per - 1

    def ids(self, c: W.Chunk) -> np.ndarray:
        got = self.table.get(c.h).astype(np.int64)
        return np.where(got < 0, self.unknown, got)

    def features(self, ids: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Hashes of the four features of each token, from the words before it in its text."""
        start = self.unknown + 1
        one = np.full(len(ids), start)
        two = one.copy()
        if len(ids) > 1:
            one[1:] = np.where(row[1:] == row[:-1], ids[:-1], start)
        if len(ids) > 2:
            two[2:] = np.where(row[2:] == row[:-2], ids[:-2], start)
        one, two = one.astype(U), two.astype(U)
        return np.stack([np.zeros(len(ids), U), W.mix(one + U(1 << 40)), W.mix(one + (two << U(20)) + U(1 << 41)), W.mix(two + U(1 << 42))])

    def class_rows(self, f: np.ndarray) -> np.ndarray:
        """The class rows that features select; the bias has a row of its own, which comes first."""
        fa = 1 + (f % U(len(self.a) - 1)).astype(np.int64)
        fa[0] = 0
        return fa

    def word_rows(self, f: np.ndarray, klass: np.ndarray) -> np.ndarray:
        """The word rows that features and classes select; each class's bias has a row of its own, which come first."""
        fb = self.classes + (W.mix(f + klass.astype(U) * U(0x9E3779B97F4A7C15)) % U(len(self.b) - self.classes)).astype(np.int64)
        fb[0] = klass
        return fb

    def log_probability(self, ids: np.ndarray, f: np.ndarray, gradient: bool = False):
        """Log-probability of each token; with gradient also, for classes and for words, the rows that tokens of one context (and class) have, the number of such tokens,
        and the derivatives of their loss by the rows' weights."""
        k, w = ids // self.per, ids % self.per
        _, first, context = np.unique(f[2], return_index=True, return_inverse=True)
        _, both, pair = np.unique(context * self.classes + k, return_index=True, return_inverse=True)
        total, grads = np.zeros(len(ids)), []
        for table, rows, of, hit in ((self.a, self.class_rows(f[:, first]), context, k), (self.b, self.word_rows(f[:, both], k[both]), pair, w)):
            z = np.take(table, rows[0], axis=0)
            for r in rows[1:]:
                z += np.take(table, r, axis=0)
            z -= z.max(1, keepdims=True)
            at = of * z.shape[1] + hit
            total += z.ravel()[at]
            e = np.exp(z, out=z)
            s = e.sum(1)
            total -= np.log(s)[of]
            if gradient:
                n = np.bincount(of, minlength=len(e)).astype(np.float32)
                e *= (n / s)[:, None]
                np.subtract.at(e.ravel(), at, np.float32(1))
                grads.append((rows, n, e))
        return (total, grads) if gradient else total


def sums_of_runs(g: np.ndarray, source: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the rows g[source[at[i] : at[i + 1]]], the last to the end. Runs are cut to powers of two, so that those of one length are summed together."""
    left = np.diff(np.append(at, len(source)))
    out = np.zeros((len(at), g.shape[1]), g.dtype)
    who, at, size = np.arange(len(at)), at.copy(), 1
    while len(who):
        odd = np.flatnonzero(left & 1)
        if len(odd):
            rows = np.take(g, source[(at[odd][:, None] + np.arange(size)).ravel()], axis=0)
            out[who[odd]] += rows.reshape(len(odd), size, -1).sum(1) if size > 1 else rows
            at[odd] += size
        left >>= 1
        more = left > 0
        who, at, left, size = who[more], at[more], left[more], size * 2
    return out


class Trainer:
    """AdaGrad with one accumulator per row, on a task's own copy of the weights."""

    def __init__(self, m: Model, sums: list[np.ndarray], rate: float):
        self.m = Model(m.words, m.a.copy(), m.b.copy(), m.classes, m.types, m.rare)
        self.sums, self.rate = [s.copy() for s in sums], rate
        self.touched = [np.zeros(len(m.a), np.float32), np.zeros(len(m.b), np.float32)]

    def step(self, ids: np.ndarray, f: np.ndarray) -> None:
        for k, (rows, n, g) in enumerate(self.m.log_probability(ids, f, True)[1]):
            table = (self.m.a, self.m.b)[k]
            flat = rows.ravel()
            flat = flat.astype(np.uint16) if len(table) <= 1 << 16 else flat  # which numpy sorts by digits
            order = np.argsort(flat, kind="stable")
            some = flat[order]
            order %= len(g)
            at = np.flatnonzero(np.append(True, some[1:] != some[:-1]))
            u = some[at].astype(np.int64)
            n = np.add.reduceat(n[order], at)
            total = sums_of_runs(g, order, at)
            total /= np.sqrt(n)[:, None]
            self.sums[k][u] += np.einsum("ij,ij->i", total, total)
            self.touched[k][u] += n
            total *= (self.rate / np.sqrt(self.sums[k][u] + 1e-3))[:, None]
            table[u] -= total


def train(docs: DataFrame, vocabulary: int = VOCABULARY, classes: int = CLASSES, class_rows: int = CLASS_ROWS, word_rows: int = WORD_ROWS, rounds: int = ROUNDS, rate: float = RATE, batch: int = BATCH) -> Model:
    """The model of all documents."""
    if vocabulary % classes or classes % 2 or vocabulary // classes % 2:
        raise ValueError("classes divide the vocabulary, into classes of even size, and are even themselves")
    spark = docs.sparkSession
    words, types, rare = word_counts(docs, vocabulary - 1)
    m = Model(words, np.zeros((class_rows, classes), np.float32), np.zeros((word_rows + classes, vocabulary // classes), np.float32), classes, types, rare)
    sums = [np.zeros(len(m.a), np.float32), np.zeros(len(m.b), np.float32)]
    if not len(words):
        return m
    text = with_text(docs, "text").where("text is not null and text != ''")
    for part in range(rounds):
        shared = spark.sparkContext.broadcast((m, sums))

        def learn(batches, shared=shared):
            model, start = shared.value
            t = Trainer(model, start, rate)
            rest_ids, rest_f = [np.zeros(0, np.int64)], [np.zeros((4, 0), U)]
            for b in batches:
                for c in W.chunks(b.column(0)):
                    ids = model.ids(c)
                    rest_ids.append(ids)
                    rest_f.append(model.features(ids, c.rows()))
                    ids, f = np.concatenate(rest_ids), np.concatenate(rest_f, 1)
                    whole = len(ids) // batch * batch
                    for i in range(0, whole, batch):
                        t.step(ids[i : i + batch], f[:, i : i + batch])
                    rest_ids, rest_f = [ids[whole:]], [f[:, whole:]]
            if len(ids := np.concatenate(rest_ids)):
                t.step(ids, np.concatenate(rest_f, 1))
            out = []
            for k, (new, old) in enumerate(((t.m.a, model.a), (t.m.b, model.b))):
                for i in range(0, len(new), _BLOCK):
                    n = t.touched[k][i : i + _BLOCK]
                    if n.any():
                        delta = (new[i : i + _BLOCK] - old[i : i + _BLOCK]) * n[:, None]
                        out.append((k << 24 | i, np.concatenate([delta.ravel(), n, t.sums[k][i : i + _BLOCK] - start[k][i : i + _BLOCK]]).astype(np.float32).tobytes()))
            if out:
                yield packed_batch(out)

        def add(batches):
            total: dict[int, np.ndarray] = {}
            for b in batches:
                for p, x in zip(b.column(0).to_pylist(), b.column(1)):
                    v = np.frombuffer(x.as_buffer(), np.float32).astype(float)
                    total[p] = total[p] + v if p in total else v
            if total:
                yield packed_batch([(p, v.astype(np.float32).tobytes()) for p, v in total.items()])

        own = text.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == part) if rounds > 1 else text
        a, b, new_sums = m.a.copy(), m.b.copy(), [s.copy() for s in sums]
        for p, x in own.mapInArrow(learn, PACKED).repartition("pid").mapInArrow(add, PACKED).toLocalIterator():
            k, i = p >> 24, p & 0xFFFFFF
            table = (a, b)[k]
            n_rows = len(table[i : i + _BLOCK])
            v = np.frombuffer(x, np.float32)
            cells = n_rows * table.shape[1]
            n = v[cells : cells + n_rows]
            table[i : i + _BLOCK] += v[:cells].reshape(n_rows, -1) / np.maximum(n, 1)[:, None]
            new_sums[k][i : i + _BLOCK] += v[cells + n_rows :]
        m, sums = Model(words, a, b, classes, types, rare), new_sums
    return m


def rare_prices(rows: DataFrame, shared, rare: int) -> DataFrame:
    """(key, price) of each distinct text of rows (key, text), where it has words that aren't of the vocabulary: the sum of the logarithms of their shares of all `rare` occurrences of such words.
    Rows of one key are one text."""
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rare // RARE_PER_TASK))
    blocks = max(block_count(spark), 4 * tasks)

    def find(batches):
        parts: list[np.ndarray] = []

        def out():
            every = np.concatenate(parts)
            return packed_batch(list(pack(every["h"], every, blocks)))

        for b in batches:
            key = np.asarray(b.column(0))
            for c in W.chunks(b.column(1)):
                some = np.flatnonzero(shared.value.table.get(c.h) < 0)
                h, row = c.h[some], c.rows()[some]
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                at = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))) if len(h) else np.zeros(0, np.int64)
                p = np.empty(len(at), _RARE)
                p["h"], p["text"], p["n"] = h[at], key[c.lo + row[at]], np.diff(np.append(at, len(h)))
                parts.append(p)
                if sum(map(len, parts)) > 1_000_000:
                    yield out()
                    parts = []
        if sum(map(len, parts)):
            yield out()

    def price(batches):
        parts = [np.frombuffer(x.as_buffer() or b"", _RARE) for b in batches for x in b.column(1)]
        if not parts:
            return
        rec = np.concatenate(parts)
        del parts
        rec = rec[np.lexsort((rec["text"], rec["h"]))]
        at = np.flatnonzero(np.append(True, rec["h"][1:] != rec["h"][:-1]))
        share = np.log(np.add.reduceat(rec["n"], at, dtype=np.int64) / rare)
        share = np.repeat(share, np.diff(np.append(at, len(rec))))
        # A text that several rows have counts as often in the shares, and once in its own sum.
        once = np.append(True, (rec["h"][1:] != rec["h"][:-1]) | (rec["text"][1:] != rec["text"][:-1]))
        key, of = np.unique(rec["text"][once], return_inverse=True)
        paid = np.bincount(of, share[once] * rec["n"][once], len(key))
        for i in range(0, len(key), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(key[i : i + 100_000]), pa.array(paid[i : i + 100_000])], ["key", "price"])

    return rows.select("key", "text").mapInArrow(find, PACKED).repartition(tasks, "pid").mapInArrow(price, "key bigint, price double").groupBy("key").agg(F.sum("price").alias("price"))


def score(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, n_tokens, log_probability, perplexity) of each row, by a model trained on all rows."""
    model = train(docs, **how)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches):
        for b in batches:
            n, total = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
            m = shared.value
            for c in W.chunks(b.column(2)):
                n[c.lo : c.hi] = np.diff(c.word_at)
                if not len(c.h) or not len(m.words):
                    continue
                ids, row = m.ids(c), c.rows()
                f = m.features(ids, row)
                some = 16 * BATCH  # the more tokens, the more of them share a context
                log_p = np.concatenate([m.log_probability(ids[i : i + some], f[:, i : i + some]) for i in range(0, len(ids), some)])
                total[c.lo : c.hi] = np.bincount(row, log_p, c.hi - c.lo)
            none = (n == 0) | (len(m.words) == 0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), pa.array(total, mask=none)], ["key", "doc_id", "n_tokens", "total"])

    rows = with_text(docs, "doc_id", "text").select(F.xxhash64("text").alias("key"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    out = rows.mapInArrow(each, "key bigint, doc_id bigint, n_tokens bigint, total double")
    if model.rare:
        out = out.join(rare_prices(rows, shared, model.rare), "key", "left").withColumn("total", F.col("total") + F.coalesce("price", F.lit(0.0)))
    return out.select("doc_id", "n_tokens", F.round("total", 4).alias("log_probability"), F.round(F.exp(-F.col("total") / F.col("n_tokens")), 4).alias("perplexity"))
