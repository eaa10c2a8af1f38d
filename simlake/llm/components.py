"""Connected components of a distributed edge list."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import cut, released

#: Edges that one task contracts.
EDGES_PER_TASK = 2_000_000


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct nodes of the edges, and the smallest node of each one's component."""
    ids, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    parent = np.arange(len(ids))
    while len(x):
        px, py = parent[x], parent[y]
        hi, lo = np.maximum(px, py), np.minimum(px, py)
        apart = hi != lo
        if not apart.any():
            break
        x, y = x[apart], y[apart]
        np.minimum.at(parent, hi[apart], lo[apart])
        while not np.array_equal(up := parent[parent], parent):
            parent = up
    return ids, ids[parent]


def _contract(edges: DataFrame) -> DataFrame:
    def each(batches):
        parts = [(np.asarray(b.column(0)), np.asarray(b.column(1))) for b in batches if b.num_rows]
        if parts:
            ids, root = roots(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(root)], ["id", "root"])

    return edges.mapInArrow(released(each), "id bigint, root bigint")


def connected_components(edges: DataFrame, edges_per_task: int = EDGES_PER_TASK) -> DataFrame:
    """(id, root) of every node of edges (a, b): root is the smallest id of its component.

    Each task contracts its share of the edges to stars. If there is one share that is the result; else large-star and
    small-star steps alternate on what remains until nothing changes, with the lineage cut after each.
    """
    n = edges.count()
    parts = max(1, -(-n // edges_per_task))
    stars = _contract(edges.select("a", "b").repartition(parts))
    if parts == 1:
        return cut(stars)
    e = stars.where("id != root").select(F.col("id").alias("u"), F.col("root").alias("v"))
    before = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = F.least(F.min("v").over(Window.partitionBy("u")), F.col("u"))
        large = both.withColumn("m", m).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        small = low.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        e = cut(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    every = e.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return cut(every.union(every.select(F.col("root").alias("id"), "root").distinct()))
