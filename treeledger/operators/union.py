"""Merging several snapshots into one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.errors import InvalidRef, UnionConflict, UnionTypeConflict
from treeledger.functions import paths as P
from treeledger.functions.text import policy
from treeledger.schema import PAYLOAD_COLUMNS


def stacked(layers: list[DataFrame]) -> DataFrame:
    """All entries with the number of their input."""
    if not layers:
        raise InvalidRef("a union needs a ref")
    return reduce(DataFrame.unionByName, [df.where("path <> ''").select("path", *PAYLOAD_COLUMNS, F.lit(i).alias("idx")) for i, df in enumerate(layers)])


def grouped(layers: list[DataFrame]) -> DataFrame:
    """By path: n inputs, whether all or any are directories, and the first and last entry."""
    entry = F.struct(*PAYLOAD_COLUMNS)
    is_dir = F.col("kind") == "directory"
    return stacked(layers).groupBy("path").agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_and(is_dir).alias("all_dirs"),
        F.bool_or(is_dir).alias("any_dir"),
        F.min_by(entry, "idx").alias("first"),
        F.max_by(entry, "idx").alias("last"),
    )


def type_conflicts(groups: DataFrame) -> DataFrame:
    """Paths that are a directory in one input and something else in another, unless one above them is."""
    return _topmost(groups.where("any_dir and not all_dirs").select("path"))


def conflicts(groups: DataFrame) -> DataFrame:
    """Paths that several inputs hold and that are no directory; equal entries are no exception."""
    return groups.where("n > 1 and not any_dir").select("path").orderBy("path")


def _topmost(paths: DataFrame) -> DataFrame:
    above = paths.select(F.col("path").alias("up"))
    hidden = paths.select("path", F.explode(P.ancestors("path")).alias("up")).join(above, "up", "left_semi").select("path")
    return paths.join(hidden, "path", "left_anti").orderBy("path")


def first_conflict(groups: DataFrame, on_conflict: str) -> tuple[str, bool] | None:
    """(path, is a type conflict) of the conflict that comes first in order of components."""
    bad = groups.where("any_dir and not all_dirs" + (" or n > 1 and not any_dir" if on_conflict == "error" else ""))
    row = bad.orderBy(P.parts("path")).select("path", "any_dir").first()
    return (row[0], row[1]) if row else None


def union(layers: list[DataFrame], on_conflict: str = "error") -> DataFrame:
    """The merged paths. Directories merge, with the metadata of the last; otherwise the policy decides; a directory against anything else always raises."""
    how = policy(on_conflict)
    groups = grouped(layers)
    found = first_conflict(groups, how)
    if found:
        raise (UnionTypeConflict if found[1] else UnionConflict)(found[0].rpartition("/")[2])
    return resolved(groups, how)


def resolved(groups: DataFrame, how: str) -> DataFrame:
    pick = F.when(F.col("all_dirs") | F.lit(how != "first"), F.col("last")).otherwise(F.col("first"))
    return groups.select("path", pick.alias("e")).select("path", "e.*")
