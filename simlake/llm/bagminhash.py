"""MinHash near-duplicates of documents as multisets of word bigrams, by BagMinHash.

Each distinct bigram carries its count as a weight, discretised to unit levels. The levels are split into dyadic intervals
[0, 1), [1, 2), [2, 4), ... of which a weight needs those below it; an interval carries a Poisson process as fast as it is long. A process
gives its first point, a time and a slot of the signature, and is then split: one half inherits the point, the other draws its own. Intervals
above the weight are dropped, and so is any process whose next point is later than all slots of its document. A slot keeps its earliest
point, so two documents agree in a slot with the probability of their weighted Jaccard similarity sum(min) / sum(max), without bias. All
randomness is a hash of bigram, interval and point, and all documents of a chunk advance together as numpy arrays.

Bands of ROWS slots name buckets; verified_groups() connects documents whose multisets overlap by at least `threshold`. Recall
of a pair with similarity s is 1 - (1 - s**ROWS)**BANDS at least.

Defined cases: a text of one word has that word as its only feature; null, empty and word-less texts are in no group and stay; equal
multisets are one node, so repeated rows and exact copies group; a group keeps the row of the smallest doc_id, null ids last, and
just one of rows equal in doc_id. Bigrams are told apart by 48 bits of hash when signed and by 32 when overlap is verified.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import npwords as W
from .neargroups import PACKED, Membership, block_count, pack, packed_batch, regroup, verified_groups
from .tables import cut, fresh, released, with_text

U = W.U
#: Parameters of production.
BANDS, ROWS, THRESHOLD = 32, 4, 0.5
_KEY = np.dtype([("key", "<u8"), ("id", "<i8")])


def features(c: W.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, bigrams (48 bits) and counts, sorted by row and bigram."""
    row = c.rows()
    g, at = W.ngrams(c.h, row, 2)
    r = row[at]
    lone = np.flatnonzero(np.diff(c.word_at) == 1)
    g, r = np.concatenate([g, W.mix(c.h[c.word_at[lone]] ^ U(1))]), np.concatenate([r, lone])
    key, n = np.unique((r.astype(U) << U(48)) | (g >> U(16)), return_counts=True)
    return (key >> U(48)).astype(np.int64), key & U((1 << 48) - 1), n


def identities(row: np.ndarray, g: np.ndarray, n: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit id of each row's multiset, and whether it has any element."""
    at = np.searchsorted(row, np.arange(rows + 1))
    total = W.seg_sum(W.mix(W.mix(g) + n.astype(U) * U(0xD1342543DE82EF95)), at)
    return W.mix(total + (at[1:] - at[:-1]).astype(U)).view(np.int64), at[1:] > at[:-1]


def signatures(row: np.ndarray, g: np.ndarray, n: np.ndarray, rows: int, m: int = BANDS * ROWS) -> np.ndarray:
    """BagMinHash signatures, rows x m; infinity where a row has no element. m is a power of two."""
    sig = np.full(rows * m, np.inf)
    if not len(g):
        return sig.reshape(rows, m)
    mass = np.bincount(row, n, rows)
    depth = int(n.max() - 1).bit_length() + 1
    rs, es, ws, los, sizes = [], [], [], [], []
    for j in range(depth):  # roots [0, 1), [1, 2), [2, 4), ...
        lo, size = (0, 1) if j == 0 else (1 << (j - 1), 1 << (j - 1))
        k = np.flatnonzero(n > lo)
        rs.append(row[k])
        es.append(g[k])
        ws.append(n[k])
        los.append(np.full(len(k), lo))
        sizes.append(np.full(len(k), size))
    r, e, w, lo, size = map(np.concatenate, (rs, es, ws, los, sizes))

    def draw(e, lo, size, count):
        h = W.mix(W.mix(e + lo.astype(U) * U(0x9FB21C651E98DF25) + size.astype(U) * U(0xC2B2AE3D27D4EB4F)) + count.astype(U))
        return -np.log(((h >> U(11)).astype(float) + 0.5) * 2.0**-53) / size, (h & U(m - 1)).astype(np.int64)

    def put(r, k, x):
        at = r * m + k
        ok = x < sig[at]
        np.minimum.at(sig, at[ok], x[ok])

    x, k = draw(e, lo, size, np.zeros(len(e), np.int64))
    count = np.ones(len(e), np.int64)
    while len(r):
        full = lo + size <= w
        put(r[full], k[full], x[full])
        latest = sig.reshape(rows, m).max(1)
        big = size > 1
        # A process of one level goes on; several points at a time where a document has few elements to fill its slots.
        one = np.flatnonzero(~big & (x <= latest[r]))
        many = np.clip(np.where(np.isinf(latest[r[one]]), m * (np.log(m) + 4) / mass[r[one]], 1), 1, 2048).astype(np.int64)
        new = [[], [], [], [], [], [], [], []]
        for b in np.unique(many):
            i = one[many == b]
            steps = count[i][:, None] + np.arange(b)
            dx, kk = draw(np.repeat(e[i], b), np.repeat(lo[i], b), np.ones(len(i) * b), steps.ravel())
            xs = x[i][:, None] + np.cumsum(dx.reshape(-1, b), 1)
            rr = np.repeat(r[i], b)
            if b > 1:
                put(rr, kk, xs.ravel())
            for dst, v in zip(new, (r[i], e[i], w[i], lo[i], size[i], xs[:, -1], kk.reshape(-1, b)[:, -1], count[i] + b)):
                dst.append(v)
        i = np.flatnonzero(big & (x <= latest[r]))
        if len(i):
            half = size[i] >> 1
            right = (W.mix(e[i] ^ (lo[i].astype(U) << U(20)) ^ size[i].astype(U)) >> U(63)).astype(np.int64)
            chosen, other = lo[i] + right * half, lo[i] + (1 - right) * half
            zero = np.zeros(len(i), np.int64)
            dx, kk = draw(e[i], other, half, zero)
            for at, xx, k2 in ((chosen, x[i], k[i]), (other, x[i] + dx, kk)):
                ok = at < w[i]
                for dst, v in zip(new, (r[i], e[i], w[i], at, half, xx, k2, zero + 1)):
                    dst.append(v[ok])
        if not new[0]:
            break
        r, e, w, lo, size, x, k, count = map(np.concatenate, new)
        live = x <= latest[r]
        r, e, w, lo, size, x, k, count = (v[live] for v in (r, e, w, lo, size, x, k, count))
    return sig.reshape(rows, m)


def _band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    bits = np.ascontiguousarray(sig).view(U).reshape(len(sig), bands, sig.shape[1] // bands)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=U) * U(0xA0761D6478BD642F), bits.shape[:2])
    for j in range(bits.shape[2]):
        key = W.mix(key * U(3) + bits[:, :, j])
    return key


def _buckets(rec: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rec = rec[np.lexsort((rec["id"], rec["key"]))]
    rec = rec[np.append(True, (rec["key"][1:] != rec["key"][:-1]) | (rec["id"][1:] != rec["id"][:-1]))]
    size = np.diff(np.flatnonzero(np.concatenate([[True], rec["key"][1:] != rec["key"][:-1], [True]])))
    return rec["id"][np.repeat(size > 1, size)], size[size > 1]


def _ids_of(c: W.Chunk) -> tuple:
    f = features(c)
    return *f, *identities(*f, c.hi - c.lo)


def multiset_groups(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """(id, root): the multisets in groups of two or more near ones."""
    blocks = block_count(docs.sparkSession)

    def sign(batches):
        for b in batches:
            out: list = []
            for c in W.chunks(b.column(0)):
                row, g, n, ids, has = _ids_of(c)
                sig = signatures(row, g, n, c.hi - c.lo, bands * rows)[has]
                rec = np.empty((int(has.sum()), bands), _KEY)
                rec["key"], rec["id"] = _band_keys(sig, bands), ids[has][:, None]
                out.append(rec.ravel())
            if out:
                rec = np.concatenate(out)
                if len(rec):
                    yield packed_batch(list(pack(rec["key"], rec, blocks)))

    text = with_text(docs, "text")

    def fetch(ids: DataFrame) -> DataFrame:
        some = ids.sparkSession.sparkContext.broadcast(Membership.of(ids, "id"))

        def feats(batches):
            for b in batches:
                keys, bags = [], []
                for c in W.chunks(b.column(0)):
                    row, g, n, own, has = _ids_of(c)
                    at = np.searchsorted(row, np.arange(c.hi - c.lo + 1))
                    for r in np.flatnonzero(has & some.value.has(own)).tolist():
                        s = slice(at[r], at[r + 1])
                        keys.append(own[r])
                        bags.append(np.sort(np.repeat((g[s] >> U(16)).astype(np.uint32), n[s])).tobytes())
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(bags, pa.binary())], ["id", "thing"])

        return text.mapInArrow(released(feats), "id bigint, thing binary").dropDuplicates(["id"])

    def holds(both: DataFrame) -> DataFrame:
        def overlap(batches):
            for b in batches:
                keep = []
                for x, y in zip(b.column(2), b.column(3)):
                    x, y = np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)
                    keep.append(min(len(x), len(y)) >= threshold * max(len(x), len(y)) and overlap_of(x, y) >= threshold)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

        return both.mapInArrow(released(overlap), "a bigint, b bigint")

    return verified_groups(lambda: regroup(text.mapInArrow(released(sign), PACKED), _KEY, _buckets), fetch, holds)


def overlap_of(x: np.ndarray, y: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted multisets."""
    both = np.concatenate([x, y])
    side = np.concatenate([np.ones(len(x), np.int32), np.full(len(y), -1, np.int32)])
    order = np.argsort(both, kind="stable")
    both = both[order]
    at = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
    apart = np.abs(np.add.reduceat(side[order], at)).sum()
    total = len(x) + len(y)
    return (total - apart) / (total + apart)


def _with_id(docs: DataFrame, name: str, among=None) -> DataFrame:
    """docs and the multiset id of each text; null where there is none, or where it isn't among the given ones."""

    def each(batches):
        for b in batches:
            at = b.schema.names.index("text")
            out = np.zeros(b.num_rows, np.int64)
            ok = np.zeros(b.num_rows, bool)
            for c in W.chunks(b.column(at)):
                *_, ids, has = _ids_of(c)
                out[c.lo : c.hi], ok[c.lo : c.hi] = ids, has if among is None else has & among.value.has(ids)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, mask=~ok)], [*b.schema.names, name])

    return docs.mapInArrow(released(each), T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def _members(docs: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows' (doc_id, id, root), and the roots of two rows or more with their smallest doc_id."""
    own = cut(_with_id(with_text(docs, "doc_id", "text"), "id").where("id is not null").select("doc_id", "id"))
    own = own.join(groups, "id", "left").select("doc_id", "id", F.coalesce("root", "id").alias("root"))
    many = own.groupBy("root").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("group_id")).where("n_docs > 1")
    return own, many


def near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """A row for each document that is in a group of two or more: its group, named by the smallest doc_id, and the group's size."""
    own, many = _members(docs, multiset_groups(docs, **how))
    return own.join(many, "root").select("doc_id", "group_id", "n_docs", (F.col("doc_id") == F.col("group_id")).alias("is_kept"))


def drop_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """docs with one row of each group. Only rows of groups are shuffled; the others pass straight through."""
    own, many = _members(docs, multiset_groups(docs, **how))
    keys = cut(own.join(many.select("root"), "root", "left_semi").select("id", "root").distinct())
    some = docs.sparkSession.sparkContext.broadcast(Membership.of(keys, "id"))
    name, root, rank = (fresh(docs, x) for x in ("multiset_id", "multiset_root", "multiset_rank"))
    every = _with_id(docs, name, some)
    rest = every.where(F.col(name).isNull())
    hit = every.where(F.col(name).isNotNull()).join(keys.select(F.col("id").alias(name), F.col("root").alias(root)), name, "left")
    first = Window.partitionBy(F.coalesce(root, name)).orderBy(F.col("doc_id").asc_nulls_last(), name)
    hit = hit.withColumn(rank, F.row_number().over(first)).where(F.col(rank) == 1)
    cols = [f"`{c}`" for c in docs.columns]
    return rest.select(*cols).unionByName(hit.select(*cols))
