"""Disk usage by ref and by directory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.functions import paths as P


def du(snapshots: DataFrame, blobs: DataFrame) -> DataFrame:
    """(ref_name, bytes) from (snapshot, hash, kind): stored bytes of each ref's distinct blobs, head tree only, largest first."""
    sizes = blobs.select("hash", "length").dropDuplicates(["hash"])
    used = snapshots.where("kind in ('regular', 'symlink')").select(F.col("snapshot").alias("ref_name"), "hash").distinct()
    sums = used.join(sizes, "hash", "left").groupBy("ref_name").agg(F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("bytes"))
    names = snapshots.select(F.col("snapshot").alias("ref_name")).distinct()
    return names.join(sums, "ref_name", "left").select("ref_name", F.coalesce("bytes", F.lit(0)).alias("bytes")).orderBy(F.desc("bytes"), "ref_name")


def du_tree(paths: DataFrame, blobs: DataFrame, depth: int) -> DataFrame:
    """(path, bytes) down to depth, largest first.

    A directory at that depth counts its distinct blobs; one above sums what lies in it without looking for repeats; entries at
    that depth that are no directory are listed too. Kinds without a blob count nothing.
    """
    sizes = blobs.select("hash", "length").dropDuplicates(["hash"])
    rows = P.with_place(paths.where("path <> ''"))
    files = rows.where("kind <> 'directory'").join(sizes, "hash", "left").withColumn("bytes", F.when(F.col("kind").isin("regular", "symlink"), F.coalesce("length", F.lit(0))).otherwise(0))
    cut = F.array_join(F.slice("parts", 1, depth), "/")
    deep = files.where(F.col("depth") > depth).select(cut.alias("path"), "hash", "bytes").where("hash is not null").distinct().groupBy("path").agg(F.sum("bytes").alias("bytes"))
    units = files.where(F.col("depth") <= depth).select("path", "bytes").unionByName(deep)
    spread = units.select(F.explode(F.concat(P.ancestors("path"), F.array("path"))).alias("path"), "bytes").groupBy("path").agg(F.sum("bytes").cast("long").alias("bytes"))
    listed = rows.where((F.col("depth") <= depth) & ((F.col("kind") == "directory") | (F.col("depth") == depth))).select("path")
    return listed.join(spread, "path", "left").select("path", F.coalesce("bytes", F.lit(0)).alias("bytes")).orderBy(F.desc("bytes"), "path")


def top(sizes: DataFrame, n: int = 20) -> tuple[DataFrame, int]:
    """The first n rows and how many more there are."""
    return sizes.limit(n), max(0, sizes.count() - n)
