"""Cutting lineage in loops: tables written to the shared checkpoint folder of the session."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset a local session gets a temporary one, and a cluster, whose machines would not share it, an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("treeledger.scratch", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="treeledger-")
        spark.conf.set("treeledger.scratch", base)
    return base.rstrip("/")


class Scratch:
    """Tables of one job, so that lineage ends there: a lost executor costs nothing that was written."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{folder(spark)}/treeledger-{uuid.uuid4().hex}"
        self.names: set[str] = set()

    def table(self, df: DataFrame, name: str, compression: str = "none") -> DataFrame:
        """Write df and read it back. Hashes and counters don't compress, and codecs hold memory outside the heap; texts should be compressed."""
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").option("compression", compression).parquet(path)
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def read(self, schema: StructType, *names: str) -> DataFrame:
        """Tables of one schema as one."""
        return self.spark.read.schema(schema).parquet(*(f"{self.base}/{name}" for name in names))

    def drop(self, *names: str) -> None:
        """Remove tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            self.names.discard(name)

    def release(self) -> None:
        """Let go of shuffle files that nothing needs any more: Spark removes them when the driver collects its garbage, which it seldom does by itself."""
        gc.collect()
        for _ in range(2):  # one collection leaves shuffles of the job that has just ended
            time.sleep(0.3)  # what Python let go of is told to the JVM by a thread that looks every tenth of a second
            self.spark.sparkContext._jvm.System.gc()

    def clear(self, *kept: str) -> None:
        """Remove all tables but those named."""
        self.drop(*(self.names - set(kept)))


def written(df: DataFrame, compression: str = "none") -> DataFrame:
    """df, written once and read back, so that a loop's plan stays short."""
    return Scratch(df.sparkSession).table(df, "loop", compression)
