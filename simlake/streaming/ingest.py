"""Structured Streaming ingest: what a batch import does, for files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import store as S
from ..params import SearchParams


def stream_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def ingest(stream: DataFrame, store_path: str, checkpoint: str, p: SearchParams, available_now: bool = True) -> StreamingQuery:
    """Each micro-batch (ord, name, code, ...) is added to the store as a new generation, store_path/gen=<batch id + 1>.

    A batch that is replayed after a failure reads the generation before it and writes its own again, so ingest is exactly-once.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        old = spark.read.schema(S.SNIPPETS).parquet(f"{store_path}/gen={batch_id}") if batch_id else S.empty(spark)
        S.add_batch(old, df, p).write.mode("overwrite").parquet(f"{store_path}/gen={batch_id + 1}")

    w = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def arrival_counts(stream: DataFrame, time: str, lateness: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Snippets per window of event time, with late rows dropped after the watermark."""
    return stream.withWatermark(time, lateness).groupBy(F.window(time, window)).agg(F.count("*").alias("n"))
