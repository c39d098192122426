"""Tables that cut lineage, in the folder that the driver and all executors share, and checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table up to which it is broadcast.
BROADCAST_ROWS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. A new local folder stands for it only on one machine; elsewhere its lack is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="parcelyard-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Scratch:
    """Tables that one computation stores as Parquet in the shared folder and reads again: later uses don't compute them anew.

    As a context manager it deletes them at the end, but for those stored with ``keep``, which the lazy result reads.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, f"{shared_folder(spark)}/parcelyard-{uuid.uuid4().hex}", 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.clear()

    def store(self, df: DataFrame, keep: bool = False) -> DataFrame:
        self.n += 1
        path = f"{self.folder}/{'kept' if keep else 'used'}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        """Delete the tables that no result reads."""
        delete(self.spark, f"{self.folder}/used")


def delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder of any file system that Spark reads, if it is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The frame, marked for broadcast if it has been counted and is within the bound; beyond it Spark joins as it sees fit."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
