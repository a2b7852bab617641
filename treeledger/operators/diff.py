"""What changed between two snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeledger.functions import paths as P
from treeledger.plans.scratch import written

META = ("size", "sparse_map", "target_path", "major", "minor", "uid", "gid", "mode", "xattrs")
DIRECTORY_META = ("uid", "gid", "mode", "xattrs")
#: How the command line shows the kinds of change.
SIGNS = {"A": "+", "D": "-", "M": "M", "m": "m"}


def _differs(names) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | ~F.col(f"a_{n}").eqNullSafe(F.col(f"b_{n}"))
    return out


def compared(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change, swap) for every path that differs; swap where a directory stands against something else."""
    side = lambda df, p: df.where("path <> ''").select("path", *(F.col(c).alias(f"{p}_{c}") for c in ("kind", "hash", *META)))
    rows = side(old, "a").join(side(new, "b"), "path", "full_outer")
    directory = (F.col("a_kind") == "directory") & (F.col("b_kind") == "directory")
    change = (
        F.when(F.col("a_kind").isNull(), F.lit("A"))
        .when(F.col("b_kind").isNull(), F.lit("D"))
        .when(directory, F.when(_differs(DIRECTORY_META), F.lit("m")))
        .when(F.col("a_kind") != F.col("b_kind"), F.lit("M"))
        .when(~F.col("a_hash").eqNullSafe(F.col("b_hash")), F.lit("M"))
        .when(_differs(META), F.lit("m"))
    )
    swap = F.coalesce((F.col("a_kind") == "directory") != (F.col("b_kind") == "directory"), F.lit(False))
    return rows.select("path", change.alias("change"), swap.alias("swap"), F.col("a_kind").alias("old_kind"), F.col("b_kind").alias("new_kind")).where("change is not null")


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, kind): A, D, M (kind or content) or m (the rest). Below a directory that became something else, or the reverse, nothing is listed.

    One full outer join on path, whose result, the changes only, is written once. What to suppress is found by joining their ancestors
    with the few swapped paths.
    """
    rows = written(compared(old, new))
    swapped = rows.where("swap").select(F.col("path").alias("up"))
    hidden = rows.where(F.col("change").isin("A", "D")).select("path", F.explode(P.ancestors("path")).alias("up")).join(swapped, "up", "left_semi").select("path")
    return rows.join(hidden, "path", "left_anti").select("path", F.col("change").alias("kind")).orderBy("path")


def pruned(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both snapshots without what lies below directories of equal path and hash; those can't differ.

    Needs directory hashes (``merkle``). Worth it when most directories are unchanged.
    """
    same = old.where("kind = 'directory'").select("path", "hash").intersect(new.where("kind = 'directory'").select("path", "hash")).select(F.col("path").alias("up"))

    def cut(df: DataFrame) -> DataFrame:
        below = df.select("path", F.explode(P.ancestors("path")).alias("up")).join(same, "up", "left_semi").select("path").distinct()
        return df.join(below, "path", "left_anti")

    return cut(old), cut(new)


def summary(changes: DataFrame) -> DataFrame:
    """(kind, n)."""
    return changes.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).orderBy("kind")
