"""From source files to a snapshot: ids, hardlinks, blobs, trees, a commit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.functions.hashing import as_bytes, blob_hash, commit_hash, symlink_hash
from treeledger.schema import PATHS, PAYLOAD_COLUMNS, SYMLINK_MODE


def hardlinks(files: DataFrame) -> DataFrame:
    """files with first_path: for regular files with several links, the smallest path of their (dev, ino); else null."""
    shared = files.where("file_type = 'regular' and nlink > 1")
    first = shared.groupBy("dev", "ino").agg(F.min("path").alias("first_path"), F.count(F.lit(1)).alias("links")).where("links > 1")
    joined = files.join(first, ["dev", "ino"], "left")
    return joined.withColumn("first_path", F.when((F.col("file_type") == "regular") & (F.col("nlink") > 1) & (F.col("first_path") != F.col("path")), F.col("first_path"))).drop("links")


def sparse_total(regions) -> F.Column:
    """Where the last region ends."""
    return F.coalesce(F.array_max(F.transform(regions, lambda r: r["offset"] + r["length"])), F.lit(0))


def data_bytes(content, regions) -> F.Column:
    """The bytes of content that lie in regions, one after another; all of it if regions is null."""
    cut = F.aggregate(F.transform(regions, lambda r: F.substring(content, (r["offset"] + 1).cast("int"), r["length"].cast("int"))), F.unhex(F.lit("")), lambda a, b: F.concat(a, b))
    return F.when(regions.isNull(), content).otherwise(cut)


def restored_bytes(stored, regions, size) -> F.Column:
    """A sparse file's full content: stored data at its offsets, zeros between, up to size."""
    zeros = lambda n: F.unhex(F.repeat(F.lit("00"), n.cast("int")))
    start = F.struct(F.unhex(F.lit("")).alias("out"), F.lit(0).cast("long").alias("used"))

    def add(acc, r):
        gap = zeros(F.greatest(r["offset"] - F.octet_length(acc["out"]), F.lit(0)))
        return F.struct(F.concat(acc["out"], gap, F.substring(stored, (acc["used"] + 1).cast("int"), r["length"].cast("int"))).alias("out"), (acc["used"] + r["length"]).alias("used"))

    filled = F.aggregate(F.array_sort(regions), start, add)["out"]
    return F.when(regions.isNull(), stored).otherwise(F.concat(filled, zeros(F.greatest(size - F.octet_length(filled), F.lit(0)))))


def snapshot(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paths, blobs) of source files (schema.SOURCE_FILES, ids already inside). Directories have no hash yet.

    Content goes to the blobs only; the paths carry hashes.
    """
    rows = hardlinks(files)
    regular = (F.col("file_type") == "regular") & F.col("first_path").isNull()
    link = F.col("file_type") == "symlink"
    data = data_bytes(F.coalesce("content", F.unhex(F.lit(""))), F.col("sparse_map"))
    rows = rows.withColumn("data", F.when(regular, data).when(link, as_bytes("link_target")))
    hashed = rows.withColumn("hash", F.when(regular, blob_hash("uid", "gid", "mode", "data", "xattrs")).when(link, symlink_hash("uid", "gid", "link_target", "xattrs")))
    owned = ~F.col("file_type").isin("regular", "symlink")
    device = F.col("file_type").isin("block_device", "char_device")
    named = {
        "kind": F.when(F.col("first_path").isNotNull(), F.lit("hardlink")).otherwise(F.col("file_type")),
        "size": F.when(regular, F.col("size")),
        "sparse_map": F.when(regular, F.col("sparse_map")),
        "target_path": F.col("first_path"),
        **{c: F.when(device, F.col(c)) for c in ("major", "minor")},
        **{f"e_{c}": F.when(owned, F.col(c)) for c in ("uid", "gid", "mode")},
        "xattrs": F.when(F.col("first_path").isNull(), F.col("xattrs")),
    }
    out = hashed.withColumns(named)
    paths = out.select("path", *(F.col(f"e_{c}").alias(c) if c in ("uid", "gid", "mode") else F.col(c) for c in PAYLOAD_COLUMNS))
    blob_mode = F.when(F.col("kind") == "symlink", F.lit(SYMLINK_MODE)).otherwise(F.col("mode"))
    stored = out.where("hash is not null").select("hash", "uid", "gid", blob_mode.cast("long").alias("mode"), F.octet_length("data").cast("long").alias("length"), F.col("data").alias("content"))
    return paths.select([F.col(f.name).cast(f.dataType) for f in PATHS]), stored.dropDuplicates(["hash"])


def with_parents(paths: DataFrame, uid: int = 0, gid: int = 0, mode: int = 0o40755, among: DataFrame | None = None) -> DataFrame:
    """paths with a directory row for every proper prefix that has none. ``among``, if given, holds the same path column more cheaply."""
    from treeledger.functions.paths import ancestors

    names = (paths if among is None else among).select("path")
    ups = names.select(F.explode(ancestors("path")).alias("path")).distinct().join(names, "path", "left_anti")
    fixed = {"kind": F.lit("directory"), "uid": F.lit(uid).cast("long"), "gid": F.lit(gid).cast("long"), "mode": F.lit(mode).cast("long")}
    return paths.unionByName(ups.withColumns(fixed), allowMissingColumns=True)


def new_blobs(blobs: DataFrame, stored: DataFrame) -> DataFrame:
    """Blobs that aren't stored yet, each once."""
    return blobs.dropDuplicates(["hash"]).join(stored.select("hash"), "hash", "left_anti")


def dedup_ratio(entries: DataFrame) -> DataFrame:
    """One row: entries, distinct blobs, bytes of all and of the distinct ones, from (hash, length)."""
    once = entries.dropDuplicates(["hash"]).agg(F.count(F.lit(1)).alias("distinct_blobs"), F.sum("length").cast("long").alias("stored_bytes"))
    return entries.agg(F.count(F.lit(1)).alias("entries"), F.sum("length").cast("long").alias("total_bytes")).crossJoin(once)


def commit_row(spark, tree: str, parents: list[str], author: str, timestamp: int, message: str, metadata: dict[str, str]) -> DataFrame:
    """One commit with its hash."""
    shape = "tree string, parents array<string>, author string, timestamp long, message string, metadata map<string,string>"
    return spark.createDataFrame([(tree, parents, author, timestamp, message, metadata)], shape).withColumn("hash", commit_hash())
