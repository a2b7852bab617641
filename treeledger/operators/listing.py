"""ls-tree, cat-file and export: what a snapshot holds, line by line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeledger.errors import InvalidObjectType, PathNotFound
from treeledger.functions import paths as P
from treeledger.functions.text import long_line, short_line
from treeledger.operators.remap import translated
from treeledger.schema import SYMLINK_MODE


def children(paths: DataFrame, path: str | None = None) -> DataFrame:
    """The entries of a directory, the entry itself if it is none, nothing if it is missing."""
    at = P.clean(path or "")
    here = F.col("path") == at
    under = P.parent("path") == at
    return paths.where((under | (here & (F.col("kind") != "directory"))) & (F.col("path") != "")).orderBy("path")


def recursive(paths: DataFrame) -> DataFrame:
    """All entries in order of components: a directory, then what it holds."""
    return paths.where("path <> ''").withColumn("parts", P.parts("path")).orderBy("parts").drop("parts")


def with_metadata(paths: DataFrame, blobs: DataFrame, maps: DataFrame | None = None) -> DataFrame:
    """Adds m_uid, m_gid, m_mode, m_size: of files and links from their blob (zero owners if it is missing; links have the one mode of links), of others from the entry, of hardlinks none.

    With maps the ids of files and links are shown as outside ids; entries keep theirs.
    """
    known = blobs.select("hash", F.col("uid").alias("b_uid"), F.col("gid").alias("b_gid"), F.col("mode").alias("b_mode"), F.col("length").alias("b_size")).dropDuplicates(["hash"])
    if maps is not None:
        known = translated(translated(known, maps, "uid", "b_uid", "b_uid", outward=True), maps, "gid", "b_gid", "b_gid", outward=True)
    rows = paths.join(known, "hash", "left")
    stored, link = F.col("kind").isin("regular", "symlink"), F.col("kind") == "hardlink"

    def pick(blob: str, own: Column) -> Column:
        return F.when(link, F.lit(None).cast("long")).when(stored, F.coalesce(F.col(blob), F.lit(0))).otherwise(own).cast("long")

    type_bits = {"directory": 0o040000, "block_device": 0o060000, "char_device": 0o020000, "fifo": 0o010000, "socket": 0o140000}
    bits = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in type_bits.items()], F.lit(0))
    own_mode = bits.bitwiseOR(F.coalesce(F.col("mode"), F.lit(0)).bitwiseAND(0o7777))
    mode = F.when(F.col("kind") == "symlink", F.lit(SYMLINK_MODE)).when(F.col("kind") == "regular", F.coalesce("b_mode", F.lit(0))).otherwise(own_mode)
    size = F.when(F.col("kind") == "regular", F.coalesce("size", F.lit(0))).when(F.col("kind") == "symlink", F.coalesce("b_size", F.lit(0))).otherwise(0)
    none = F.lit(None).cast("long")
    shown = {"m_uid": pick("b_uid", F.col("uid")), "m_gid": pick("b_gid", F.col("gid")), "m_mode": F.when(link, none).otherwise(mode.cast("long")), "m_size": F.when(link, none).otherwise(size.cast("long"))}
    return rows.withColumns(shown).drop("b_uid", "b_gid", "b_mode", "b_size")


def lines(paths: DataFrame, blobs: DataFrame | None = None, long: bool = False, human: bool = False) -> DataFrame:
    """(path, line) in the short or long format."""
    if not long:
        return paths.select("path", short_line().alias("line"))
    return with_metadata(paths, blobs).select("path", long_line(human).alias("line"))


def cat(paths: DataFrame, blobs: DataFrame, path: str) -> DataFrame:
    """(path, kind, shown) of one path: a file's text, a link's target, a hardlink's arrow, else the kind; a directory lists its entries."""
    at = P.clean(path)
    found = paths.where(F.col("path") == at)
    first = found.select("kind").first()
    if first is None:
        raise PathNotFound(path)
    if first[0] == "directory":
        return children(paths, at).select("path", "kind", short_line().alias("shown"))
    return contents(found, blobs)


def contents(paths: DataFrame, blobs: DataFrame) -> DataFrame:
    """(path, kind, shown): a file's text, a link's target, a hardlink's arrow, else the kind."""
    text = blobs.select("hash", F.decode("content", "utf-8").alias("text")).dropDuplicates(["hash"])
    shown = F.when(F.col("kind").isin("regular", "symlink"), F.col("text")).when(F.col("kind") == "hardlink", F.concat(F.lit("-> "), F.col("target_path"))).otherwise(F.col("kind"))
    return paths.join(text, "hash", "left").select("path", "kind", shown.alias("shown"))


def exportable(paths: DataFrame, path: str | None = None) -> DataFrame:
    """(path, kind, hash, xattrs, sparse_map, size) of files and links, a hardlink taken one hop to its target.

    With a path, that one only: missing, or of a kind that can't be exported, raises.
    """
    rows = paths if path is None else paths.where(F.col("path") == P.clean(path))
    payload = ["kind", "hash", "size", "sparse_map", "xattrs"]
    target = paths.select(F.col("path").alias("target_path"), *(F.col(c).alias(f"t_{c}") for c in payload))
    link = F.col("kind") == "hardlink"
    rows = rows.join(target, "target_path", "left").select("path", *(F.when(link, F.col(f"t_{c}")).otherwise(F.col(c)).alias(c) for c in payload))
    if path is not None:
        first = rows.select("kind").first()
        if first is None:
            raise PathNotFound(path)
        if first[0] not in ("regular", "symlink"):
            raise InvalidObjectType(f"{path}: {first[0]}")
    return rows.where(F.col("kind").isin("regular", "symlink"))
