"""Groups of things that a verified relation connects, from candidate buckets.

Both near-duplicate operators end here. Things have 64-bit ids that stand for their content, so equal contents are one thing.
Their bucket keys move between tasks as packed byte blocks, many records to a row. A bucket's members are candidates for each
other. Verifying every pair of a hot bucket would cost the square of its size, so the connected groups are found in two rounds:
members are held against their buckets' leaders; then, of each bucket that still spans several groups, the pairs across groups.
Where there is an exact bound, pairs that can't be near are left out by sketches before any thing is fetched, in both rounds, and pairs
meet in blocks: those of overlapping buckets, which share their least member, fall into one block, and a thing moves to a block once, not once for each pair. A pair within one
group needs no verdict. So the groups are those of all verified candidate pairs, and no bucket has a limit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import npwords as W
from .components import connected_components, roots
from .tables import cut, released

PACKED = "pid int, blob binary"


def block_count(spark: SparkSession) -> int:
    """Blocks that the packed records fall into: some for each shuffle partition, which AQE joins up by size."""
    return max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def pack(keys: np.ndarray, records: np.ndarray, blocks: int) -> Iterator[tuple[int, bytes]]:
    """The records as one byte string per block of their keys."""
    pid = (W.mix(keys) % W.U(blocks)).astype(np.uint16 if blocks <= 1 << 16 else np.int32)  # short numbers sort by digits
    order = np.argsort(pid, kind="stable")
    pid, records = pid[order], records.view(f"V{records.itemsize}")[order]  # moved as bytes, not field by field
    at = np.flatnonzero(np.append(True, pid[1:] != pid[:-1])) if len(pid) else []
    for a, z in zip(at, np.append(at[1:], len(pid)) if len(pid) else []):
        yield int(pid[a]), records[a:z].tobytes()


def packed_batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["pid", "blob"])


def regroup(packed: DataFrame, dtype: np.dtype, fn: Callable[[np.ndarray], tuple[np.ndarray, ...]], places: bool = False) -> DataFrame:
    """members array<bigint>: fn gets all records of some blocks at once and returns buckets of distinct ids, as ids and sizes; with `places`, where in
    each member stands what the bucket has in common, too, as numbers of 16 bits: places binary."""
    schema = "members array<bigint>" + ", places binary" * places

    def each(batches):
        parts = [np.frombuffer(x.as_buffer(), dtype) for b in batches for x in b.column(1)]
        if parts:
            flat, sizes, *more = fn(np.concatenate(parts))
            offs = np.append(0, np.cumsum(sizes))
            for i in range(0, len(sizes), 20_000):
                o = offs[i : i + 20_001]
                cols = [pa.ListArray.from_arrays(pa.array(o - o[0], pa.int32()), pa.array(flat[o[0] : o[-1]].astype(np.int64)))]
                for place in more:
                    edge = ((o - o[0]) * 2).astype(np.int32)
                    cols.append(pa.Array.from_buffers(pa.binary(), len(o) - 1, [None, pa.py_buffer(edge), pa.py_buffer(place[o[0] : o[-1]].astype("<u2"))]))
                yield pa.RecordBatch.from_arrays(cols, ["members", "places"][: len(cols)])

    return packed.repartition("pid").mapInArrow(released(each), schema)


class Membership:
    """A Bloom filter of ids, used to leave most rows out of a shuffle; an exact join follows, so its errors cost only time."""

    MAX_BITS = 27

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    @staticmethod
    def _at(ids: np.ndarray, bits: int) -> list[np.ndarray]:
        h = W.mix(ids.view(W.U) ^ W.U(0x5BF03635))
        return [(h >> W.U(64 - bits)).astype(np.int64), ((h * W._BASE) >> W.U(64 - bits)).astype(np.int64), (W.mix(h) >> W.U(64 - bits)).astype(np.int64)]

    @classmethod
    def of(cls, df: DataFrame, column: str) -> Membership:
        """Each task fills a bitmap; the driver joins the bitmaps, one by one. Their size is bounded by MAX_BITS."""
        n = df.count()
        bits = min(cls.MAX_BITS, max(13, int(np.ceil(np.log2(max(1, n) * 10)))))

        def each(batches):
            bitmap = np.zeros(1 << bits, bool)
            for b in batches:
                for at in cls._at(np.asarray(b.column(0)).astype(np.int64), bits):
                    bitmap[at] = True
            yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bitmap).tobytes()], pa.binary())], ["bitmap"])

        out = np.zeros((1 << bits) // 8, np.uint8)
        for row in df.select(column).repartition(max(1, -(-n // 4_000_000))).mapInArrow(released(each), "bitmap binary").toLocalIterator():
            out |= np.frombuffer(row[0], np.uint8)
        return cls(bits, out)

    def has(self, ids: np.ndarray) -> np.ndarray:
        ok = np.ones(len(ids), bool)
        for at in self._at(np.ascontiguousarray(ids).astype(np.int64), self.bits):
            ok &= (self.words[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0
        return ok


def enough(near: Callable[[np.ndarray, np.ndarray], np.ndarray], i: np.ndarray, j: np.ndarray, x: np.ndarray | None = None, y: np.ndarray | None = None) -> np.ndarray:
    """Near pairs that connect all that the near ones of the pairs i, j do; x and y are the groups of i and j. Of each two groups one pair gets its verdict, then four of those that still
    are two, and so on; a pair that near ones have brought into one group needs none. Without groups, all near pairs."""
    if x is None or y is None:
        return near(i, j)
    ok, left, most = np.zeros(len(i), bool), np.arange(len(i)), 1
    nodes, flat = np.unique(np.concatenate([x, y]), return_inverse=True)
    x, y = flat[: len(i)], flat[len(i) :]
    while len(left := left[x[left] != y[left]]):
        lo, hi = np.minimum(x[left], y[left]), np.maximum(x[left], y[left])
        order = np.lexsort((hi, lo))
        start = np.flatnonzero(np.append(True, (lo[order][1:] != lo[order][:-1]) | (hi[order][1:] != hi[order][:-1])))
        rank = np.empty(len(left), np.int64)
        rank[order] = np.arange(len(left)) - np.repeat(start, np.diff(np.append(start, len(left))))
        now, left = left[rank < most], left[rank >= most]
        ok[now] = near(i[now], j[now])
        now = now[ok[now]]
        if len(now):
            own, root = roots(x[now], y[now])
            group = np.arange(len(nodes))
            group[own] = root
            x, y = group[x], group[y]
        most *= 4
    return ok


#: Pairs of one leader that fall into one block; more are dealt out to several, by both their things.
PAIRS_PER_LEADER = 50_000


def met(pairs: DataFrame, things: DataFrame, column: str, near: Callable[[pa.Array, np.ndarray, np.ndarray], np.ndarray], per_leader: int = PAIRS_PER_LEADER) -> DataFrame:
    """Those (a, b) of the pairs (a, b, lead) that are near: near(values, i, j) tells it of the pairs of values i and j, values the column of things (id, column). If the pairs have their
    groups, root_a and root_b, near gets them, too, and may leave out pairs that others connect."""
    spark = pairs.sparkSession
    groups = [c for c in ("root_a", "root_b") if c in pairs.columns]
    hot = pairs.groupBy("lead").agg(F.ceil(F.sqrt(F.count("*") / per_leader)).alias("ways")).where("ways > 1")
    ways = F.coalesce("ways", F.lit(1))
    part = F.xxhash64("lead", F.pmod(F.xxhash64("a"), ways), F.pmod(F.xxhash64("b"), ways))
    pairs = pairs.join(hot, "lead", "left").select(F.pmod(part, F.lit(block_count(spark))).cast("int").alias("pid"), "a", "b", *groups)
    asked = pairs.select("pid", F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.collect_set("pid").alias("pids"))
    moved = asked.join(things.select("id", column), "id").select(F.explode("pids").alias("pid"), "id", *(F.lit(None).cast("bigint").alias(c) for c in ["b", *groups]), F.col(column).alias("value"))
    rows = pairs.select("pid", F.col("a").alias("id"), "b", *groups, F.lit(None).cast(things.schema[column].dataType).alias("value")).unionAll(moved)

    def each(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts)
        del parts
        large = pa.large_string() if pa.types.is_string(t.schema.field("value").type) else pa.large_binary()
        asks, has = t.filter(pc.is_valid(t["b"])), t.filter(pc.is_null(t["b"]))
        del t
        ids, first = np.unique(has["id"].to_numpy(), return_index=True)  # of several blocks a thing is there several times
        values = has["value"].cast(large).take(pa.array(first)).combine_chunks()
        values = values if isinstance(values, pa.Array) else pa.concat_arrays(values.chunks)
        del has
        a, b = asks["id"].to_numpy(), asks["b"].to_numpy()
        ok = near(values, np.searchsorted(ids, a), np.searchsorted(ids, b), *(asks[c].to_numpy() for c in groups))
        yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], ["a", "b"])

    return rows.repartition("pid").mapInArrow(released(each), "a bigint, b bigint")


def verified_groups(candidates: Callable[[], DataFrame], fetch: Callable[[DataFrame], DataFrame], holds: Callable, bound: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, slack: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None) -> DataFrame:
    """(id, root) of all ids in groups of two or more. candidates makes the buckets (members); fetch gives (id, thing) of ids (id); holds gives those (a, b) of pairs (a, b, x, y), y the thing of b,
    that are near. With `bound`, buckets have places, things have a binary sketch of one length that begins with the thing's length in four bytes, and bound(x, y) tells which rows of sketches may
    be those of near things; holds(pairs) of pairs (a, b, lead) is a function that gives those that are near from the things, as met() does; slack(m, n) tells which lengths allow it, and how far apart in the two things may be what they have in common."""
    how = [F.count("*").alias("times")] + ([F.collect_list("places").alias("places")] if bound else [])
    buckets = cut(candidates().groupBy("members").agg(*how))
    things = cut(fetch(buckets.select(F.explode("members").alias("id")).distinct()))

    def verify(pairs: DataFrame) -> DataFrame:
        if bound is not None:
            return cut(holds(pairs)(things))
        both = pairs.join(things.select(F.col("id").alias("b"), F.col("thing").alias("y")), "b").join(things.select(F.col("id").alias("a"), F.col("thing").alias("x")), "a")
        return cut(holds(both.select("a", "b", "x", "y")))

    def allowed(pairs: DataFrame) -> DataFrame:
        def may(values, i, j):
            raw = np.frombuffer(b"".join(values.to_pylist()), np.uint8).reshape(len(values), -1)
            return np.concatenate([np.zeros(0, bool), *(bound(raw[i[k : k + 25_000]], raw[j[k : k + 25_000]]) for k in range(0, len(i), 25_000))])

        return cut(met(pairs, things, "sketch", may)).withColumn("lead", F.col("a"))

    star = buckets.select(F.explode(F.slice("members", 2, F.size("members") - 1)).alias("b"), F.col("members")[0].alias("a"), "times")
    star = cut(star.groupBy("a", "b").agg(F.sum("times").alias("times")))
    # A member of many buckets has many leaders: first the one of most of them, then those that are not of its group yet.
    one = star.groupBy("b").agg(F.max_by("a", F.struct("times", -F.col("a"))).alias("a")).select("a", "b", F.col("a").alias("lead"))
    if bound is not None:
        one = cut(one)
    edges = verify(one if bound is None else allowed(one))
    groups = connected_components(edges)

    numbered = buckets.select(F.xxhash64("members").alias("n"), F.explode("members").alias("id"))
    spans = cut(numbered.join(groups, "id", "left").select("n", "id", F.coalesce("root", "id").alias("root")))
    several = spans.groupBy("n").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("n")
    spans = spans.join(several, "n", "left_semi")
    if bound is None:
        # First members with their leaders, which leaves fewer buckets that span groups.
        ends = [groups.select(F.col("id").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab"]
        apart = star.select("a", "b").join(one, ["a", "b"], "left_anti").join(ends[0], "a", "left").join(ends[1], "b", "left")
        rest = cut(apart.where("coalesce(root_a, a) != coalesce(root_b, b)").select("a", "b"))
        if not rest.isEmpty():
            edges = cut(edges.union(verify(rest)))
            groups = connected_components(edges)
            spans = spans.select("n", "id").join(groups, "id", "left").select("n", "id", F.coalesce("root", "id").alias("root"))
        spans = spans.withColumn("sketch", F.lit(None).cast("binary"))
        tried = star.select("a", "b")
    else:
        spans = spans.join(things.select("id", "sketch"), "id")
        tried = one.select("a", "b")
    several = spans.groupBy("n").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.collect_list(F.struct("id", "root", "sketch")).alias("m")).where("lo != hi").select("n", F.col("m.id").alias("ids"), F.col("m.root").alias("roots"), F.col("m.sketch").alias("sketches"))
    if bound is not None:
        several = several.join(buckets.select(F.xxhash64("members").alias("n"), "places"), "n")
    several = several.drop("n")

    def across(batches):
        for b in batches:
            if not b.num_rows:
                continue
            ids, roots, kept = (b.column(k) for k in range(3))
            bucket = np.repeat(np.arange(b.num_rows), np.asarray(pc.list_value_length(ids)))
            ids, roots = np.asarray(ids.flatten()), np.asarray(roots.flatten())
            order = np.lexsort((roots, bucket))
            ids, roots, bucket = ids[order], roots[order], bucket[order]
            if bound is not None:
                raw = np.frombuffer(b"".join(kept.flatten().to_pylist()), np.uint8).reshape(len(ids), -1)[order]
                length = np.ascontiguousarray(raw[:, :4]).view("<u4")[:, 0].astype(np.int64)
                # A bucket has places for each time it was found; those of a member are the first time's, from `at_first` on, and then in steps of the bucket's size.
                several_times = b.column(3)
                place = np.frombuffer(b"".join(several_times.flatten().to_pylist()), "<u2").astype(np.int64)
                times, many = np.asarray(pc.list_value_length(several_times)), np.bincount(bucket)
                rank = np.empty(len(ids), np.int64)
                rank[np.lexsort((ids, bucket))] = np.arange(len(ids)) - np.repeat(np.cumsum(many) - many, many)  # members ascend
                at_first = (np.cumsum(times * many) - times * many)[bucket] + rank
            # A member's partners are those of its bucket's later groups; some pairs at a time.
            new = np.append(np.flatnonzero((bucket[1:] != bucket[:-1]) | (roots[1:] != roots[:-1])) + 1, len(ids))
            end = new[np.searchsorted(new, np.arange(len(ids)), "right")]
            n = np.searchsorted(bucket, bucket, "right") - end
            reach = np.cumsum(n)
            lead = np.minimum.reduceat(ids, np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])))
            lead = lead[np.cumsum(np.append(0, bucket[1:] != bucket[:-1]))]
            found: list[tuple[np.ndarray, ...]] = []
            at = 0
            while at < len(ids):
                to = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + 25_000, "right")))
                w = n[at:to]
                i = np.repeat(np.arange(at, to), w)
                j = np.arange(len(i)) + np.repeat(end[at:to] - np.cumsum(w) + w, w)
                at = to
                if bound is not None and len(i):
                    ok, far = slack(length[i], length[j])
                    i, j, far = i[ok], j[ok], far[ok]
                    ok = np.zeros(len(i), bool)
                    for t in range(int(times[bucket[i]].max()) if len(i) else 0):
                        left = np.flatnonzero(~ok & (times[bucket[i]] > t))
                        step = many[bucket[i[left]]] * t
                        ok[left] = np.abs(place[at_first[i[left]] + step] - place[at_first[j[left]] + step]) <= far[left]
                    i, j = i[ok], j[ok]
                    ok = bound(raw[i], raw[j])
                    i, j = i[ok], j[ok]
                if len(i):
                    up = ids[i] < ids[j]
                    found.append((np.where(up, ids[i], ids[j]), np.where(up, ids[j], ids[i]), lead[i], np.where(up, roots[i], roots[j]), np.where(up, roots[j], roots[i])))
                if sum(len(f[0]) for f in found) > 1_000_000:
                    yield pairs_of(found)
                    found = []
            if found:
                yield pairs_of(found)

    def pairs_of(found):
        a, b, lead, *both = (np.concatenate([f[k] for f in found]) for k in range(5))
        order = np.lexsort((lead, b, a))
        a, b, lead, *both = (v[order] for v in (a, b, lead, *both))
        once = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
        return pa.RecordBatch.from_arrays([pa.array(x[once]) for x in (a, b, lead, *both)], ["a", "b", "lead", "root_a", "root_b"])

    # Of the buckets in which a pair is found the one with the least leader, which overlapping buckets share, says where it is verified.
    cross = several.mapInArrow(released(across), "a bigint, b bigint, lead bigint, root_a bigint, root_b bigint").groupBy("a", "b").agg(F.min("lead").alias("lead"), F.min("root_a").alias("root_a"), F.min("root_b").alias("root_b"))
    cross = cut(cross.join(tried, ["a", "b"], "left_anti"))
    if cross.isEmpty():
        return groups
    return connected_components(edges.union(verify(cross)))
