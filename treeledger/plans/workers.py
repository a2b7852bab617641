"""Settings of Python workers."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: The directory that holds this package; workers import the package from there in local runs.
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Workers hand freed memory back to the system, as many of them share an executor's.
WORKER_ENV = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "1", "MALLOC_TRIM_THRESHOLD_": "131072", "MALLOC_MMAP_THRESHOLD_": "131072"}


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package and bound the bytes of an Arrow batch.

    On a cluster the package is installed or shipped (``--py-files``); the path set here only
    helps local runs, where driver and workers see the same folder.
    """
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (ROOT, os.environ.get("PYTHONPATH", "")) if x)
    for name, value in WORKER_ENV.items():
        env.setdefault(name, value)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    return spark
