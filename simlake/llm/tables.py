"""What the operators share on the Spark side: shared folders, columns passed through Python, sized broadcasts."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, the folder that all executors share; where it is unset, as in tests on one machine, one of our own is set."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not given:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        if have.isDefined():
            return have.get()
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("on a cluster spark.checkpoint.dir names the folder that all executors share")
        given = tempfile.mkdtemp(prefix="simlake-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(given)
    return given


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut, kept in the shared folder; a lost executor doesn't take them away."""
    shared_folder(df.sparkSession)
    out = df.checkpoint()
    # Shuffle files go when the driver collects what refers to them, which it would do too late to save disk.
    del df
    gc.collect()
    out.sparkSession.sparkContext._jvm.System.gc()
    return out


def fresh(df: DataFrame, name: str) -> str:
    """The name, or one like it that no column of df has in any case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def released(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """fn for mapInArrow. Spark keeps a task's Python process for later tasks, and an allocator keeps what the task has freed; here it goes back to the system when fn ends,
    so that stages don't add up to more than the largest of them needs."""

    def each(batches):
        try:
            yield from fn(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
            if trim:
                trim(0)

    return each


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch] | None], schema) -> DataFrame:
    """mapInArrow of a function of one batch, which gives a batch, several or none."""

    def each(batches):
        for b in batches:
            out = fn(b)
            if isinstance(out, pa.RecordBatch):
                yield out
            elif out is not None:
                yield from out

    return df.mapInArrow(released(each), schema)


def with_text(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, which are all that an operator reads; text is cast to string. Column names are matched exactly."""
    return docs.select(*(docs[f"`{n}`"].cast("string").alias(n) if n == "text" else docs[f"`{n}`"] for n in names))


def same_columns(docs: DataFrame, fn) -> DataFrame:
    """docs with fn(batch) in place of each Arrow batch; fn keeps the columns, so that extra ones of any name pass through."""
    return arrow_map(docs, fn, docs.schema)


def replace_text(batch: pa.RecordBatch, new: list[str | None]) -> pa.RecordBatch:
    """The batch with new texts, and n_chars, where it has such an integer column, put right; null n_chars stay null."""
    cols = list(batch.columns)
    names = batch.schema.names
    at = names.index("text")
    cols[at] = pa.array(new, batch.schema.field(at).type)
    if "n_chars" in names and pa.types.is_integer(batch.schema.field("n_chars").type):
        k = names.index("n_chars")
        cols[k] = pa.array([None if o is None else len(t or "") for o, t in zip(cols[k].to_pylist(), new)], batch.schema.field(k).type)
    return pa.RecordBatch.from_arrays(cols, schema=batch.schema)
