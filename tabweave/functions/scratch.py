"""Tables that one job writes and a later step reads: in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` if the session names one; else, where all runs on one machine, a folder of our own."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str = "table") -> DataFrame:
    """Write and reread ``df``: iterative jobs cut their lineage here, and a lost executor costs a reread."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, name: str = "rows", rows: int = 1 << 20, least: int = 1 << 12) -> DataFrame:
    """As ``settled``, in parts of ``rows`` rows at most and ``least`` at least, a part a core if it can be: iterations over few files would leave cores idle."""
    out = settled(df, name)
    n = out.count()
    parts = max(1, -(-n // rows), min(df.sparkSession.sparkContext.defaultParallelism, n // least))
    return settled(out.repartition(parts).sortWithinPartitions(*out.columns), name)  # sorted: what draws rows in their order draws the same ones each time
