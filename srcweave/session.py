"""Table access and lineage cutting shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; only a local session without one gets its own."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    master = spark.sparkContext.master
    if master.startswith("local[") or master == "local":
        return os.path.join(tempfile.gettempdir(), "srcweave-shared")
    raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


class Scratch:
    """Tables written to the shared folder to cut lineage.

    Unlike a checkpoint, a written table has true size statistics, so later joins broadcast only
    what is known to be small, and it survives the loss of executors. The folder goes with the session's JVM.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/srcweave-{uuid.uuid4().hex}"
        self.n = 0
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def write(self, df: DataFrame) -> str:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        return path

    def write_some(self, df: DataFrame) -> str | None:
        """Like ``write``, but None if there were no rows; they are counted while they are written."""
        seen = Observation()
        path = self.write(df.observe(seen, F.count(F.lit(1)).alias("n")))
        n = seen.get.get("n")
        if n or n is None and not self.read(df.schema, path).isEmpty():
            return path
        self.drop(path)
        return None

    def read(self, schema: T.StructType, *paths: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths)

    def keep(self, df: DataFrame) -> DataFrame:
        return self.read(df.schema, self.write(df))

    def drop(self, *paths: str) -> None:
        """Delete tables that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for p in paths:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)
