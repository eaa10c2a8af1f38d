"""Tables that several parts of a plan read."""

from __future__ import annotations

import gc
import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame


def once(df: DataFrame) -> DataFrame:
    """The same rows, computed now and kept, for plans that read them several times: in the folder that spark.checkpoint.dir names, on one machine in one of our own. A cluster without such a folder keeps
    them on its executors' disks."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        given = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not given and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            return df.persist(StorageLevel.DISK_ONLY)
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="simlake-"))
    out = df.checkpoint()
    # Shuffle files go when the driver collects what refers to them.
    del df
    gc.collect()
    sc._jvm.System.gc()
    return out
