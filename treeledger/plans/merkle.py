"""Tree hashes from the leaves up, and back from tree objects to paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.functions import paths as P
from treeledger.functions.hashing import as_bytes, entry_line, name_bucket
from treeledger.plans.scratch import Scratch, written
from treeledger.schema import EMPTY_TREE, PAYLOAD_COLUMNS


def tree_hashes(children: DataFrame, parent: str = "parent_path") -> DataFrame:
    """(parent, tree_hash, n_entries) from rows of children: name and payload.

    Entries are hashed in buckets by name and the buckets in order; so a directory that holds a third of all entries is spread
    over many groups, and only bucket hashes meet.
    """
    lines = children.select(parent, name_bucket("name").alias("bucket"), F.struct("name", entry_line().alias("line")).alias("e"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["line"]), "\n")
    buckets = lines.groupBy(parent, "bucket").agg(F.sha2(as_bytes(text), 256).alias("h"), F.count(F.lit(1)).alias("n"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "h"))), lambda e: F.concat(e["bucket"], F.lit(":"), e["h"])), "\n")
    return buckets.groupBy(parent).agg(F.sha2(as_bytes(whole), 256).alias("tree_hash"), F.sum("n").cast("long").alias("n_entries"))


def merkle(paths: DataFrame) -> DataFrame:
    """paths with the hash of every directory, and the root as path ''.

    One aggregation for each level, deepest first; directories without entries have the hash of an empty tree.
    """
    rows = written(P.with_place(paths))
    levels = rows.agg(F.max("depth")).first()[0] or 0
    done: list[DataFrame] = []
    below = None
    for level in range(levels, -1, -1):
        here = rows.where(F.col("depth") == level)
        if level == 0:
            here = paths.sparkSession.createDataFrame([("", "directory")], "path string, kind string")
            for c in PAYLOAD_COLUMNS[1:]:
                here = here.withColumn(c, F.lit(None).cast(rows.schema[c].dataType))
            here = P.with_place(here)
        if below is not None:
            joined = here.drop("hash").join(tree_hashes(below).withColumnRenamed("parent_path", "path"), "path", "left")
        else:
            joined = here.drop("hash").withColumns({"tree_hash": F.lit(None).cast("string"), "n_entries": F.lit(0).cast("long")})
        directory = joined.where("kind = 'directory'").withColumn("hash", F.coalesce("tree_hash", F.lit(EMPTY_TREE)))
        leaves = here.where("kind <> 'directory'").withColumn("n_entries", F.lit(None).cast("long"))
        columns = ["path", *PAYLOAD_COLUMNS, "parent_path", "name", "depth", "n_entries"]
        below = written(directory.select(columns).unionByName(leaves.select(columns)))
        done.append(below)
    return reduce(DataFrame.unionByName, done)


def tree_entries(merkled: DataFrame) -> DataFrame:
    """The rows of tree objects, each tree once however many directories share it."""
    owners = merkled.where("kind = 'directory'").select(F.col("path").alias("parent_path"), F.col("hash").alias("tree_hash"))
    first = owners.groupBy("tree_hash").agg(F.min("parent_path").alias("parent_path"))
    return merkled.where("path <> ''").join(first, "parent_path").select("tree_hash", "name", *PAYLOAD_COLUMNS)


def flatten(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """(snapshot, path, payload) from tree objects and (snapshot, tree_hash).

    Directories are found level by level over the directory entries alone, which are written once; then all entries are joined to them in one pass.
    """
    scratch = Scratch(entries.sparkSession)
    folders = scratch.table(entries.where("kind = 'directory'").select("tree_hash", "name", "hash"), "folders")
    front = scratch.table(roots.select("snapshot", F.lit("").alias("prefix"), "tree_hash"), "level-0")
    found = [front]
    while True:
        below = front.join(folders, "tree_hash").select("snapshot", P.join("prefix", "name").alias("prefix"), F.col("hash").alias("tree_hash"))
        front = scratch.table(below, f"level-{len(found)}")
        if front.isEmpty():
            break
        found.append(front)
    scratch.drop("folders")
    return reduce(DataFrame.unionByName, found).join(entries, "tree_hash").select("snapshot", P.join("prefix", "name").alias("path"), *PAYLOAD_COLUMNS)
