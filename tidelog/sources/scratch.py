"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession) -> str:
    """A new path under ``spark.checkpoint.dir``; only where that is unset and all runs on this machine, under a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


_kept: list[str] = []


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet under the shared folder and read back: what follows may read it several times, and a lost executor costs single tasks. ``clear`` removes such tables."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path, compression="zstd")
    _kept.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Remove the tables of ``stored``, once all results that read them have been written."""
    while _kept:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_kept.pop())
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
