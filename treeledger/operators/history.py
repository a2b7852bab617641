"""Log, ancestry and truncation of commits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeledger.errors import MetadataKeyNotFound, ObjectNotFound
from treeledger.functions.hashing import commit_hash, short
from treeledger.functions.text import log_text
from treeledger.plans.closure import SENT_EDGES, Reach, edges_of, reachable, tested
from treeledger.plans.joins import matched


def is_root() -> Column:
    return F.size("parents") == 0


def is_merge() -> Column:
    return F.size("parents") > 1


def ancestors(commits: DataFrame, heads: DataFrame, sent_edges: int = SENT_EDGES) -> DataFrame:
    """(root, node) for heads (root, node): all commits reachable through parents, heads included."""
    return reachable(edges_of(commits), heads, sent_edges)


def log(commits: DataFrame, head: str, limit: int | None = None) -> DataFrame:
    """Commits reachable from head, newest first; of equal times the smaller hash comes first. A missing commit raises."""
    spark = commits.sparkSession
    reach = Reach(edges_of(commits), spark.createDataFrame([(head,)], "hash string"))
    gone = reach.missing.first()
    if gone:
        raise ObjectNotFound(gone[0])
    rows = reach.inside(commits).orderBy(F.desc("timestamp"), "hash")
    return rows if limit is None else rows.limit(limit)


def log_lines(commits: DataFrame) -> DataFrame:
    return commits.select("hash", log_text().alias("text"))


def is_ancestor(commits: DataFrame, pairs: DataFrame, sent_edges: int = SENT_EDGES) -> DataFrame:
    """pairs (old, new) with ok: whether old can be reached from new. A commit is its own ancestor; commits that can't be read are no one else's."""
    answer = tested(edges_of(commits), pairs, sent_edges)
    stored = matched(answer.select(F.col("old").alias("hash")).distinct(), commits, "left_semi")
    answer = answer.join(stored.select(F.col("hash").alias("old"), F.lit(True).alias("stored")), "old", "left")
    ok = F.col("ok") & (F.col("stored").isNotNull() | (F.col("old") == F.col("new")))
    return pairs.join(answer.select("old", "new", ok.alias("ok")), ["old", "new"], "left").select("old", "new", F.coalesce("ok", F.lit(False)).alias("ok"))


def truncated(commits: DataFrame, refs: DataFrame) -> DataFrame:
    """(name, old_hash, hash, tree, author, timestamp, message, metadata) for refs (name, hash) whose head has parents: a copy of the head without them."""
    heads = refs.join(commits, "hash").where(~is_root())
    bare = heads.withColumnRenamed("hash", "old_hash").withColumn("parents", F.array().cast("array<string>"))
    return bare.select("name", "old_hash", commit_hash().alias("hash"), "tree", "parents", "author", "timestamp", "message", "metadata")


def truncate_stats(commits: DataFrame, refs: DataFrame) -> DataFrame:
    """One row: refs processed and refs truncated."""
    heads = refs.join(commits.select("hash", "parents"), "hash")
    return heads.agg(F.count(F.lit(1)).alias("refs_processed"), F.count_if(F.size("parents") > 0).alias("refs_truncated"))


def metadata(commits: DataFrame, hash_: str, key: str) -> str:
    """One metadata value of a commit."""
    row = commits.where(F.col("hash") == hash_).select(F.col("metadata")[key]).first()
    if row is None:
        raise ObjectNotFound(hash_)
    if row[0] is None:
        raise MetadataKeyNotFound(key)
    return row[0]


def with_metadata(commits: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """Commits with more metadata; a later value of a key wins. Hashes are made anew."""
    keys = list(pairs)
    rest = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(keys) if keys else F.lit(True))
    more = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]) if pairs else F.create_map().cast("map<string,string>")
    return commits.withColumn("metadata", F.map_concat(rest, more)).withColumn("hash", commit_hash())


def shown(commits: DataFrame) -> DataFrame:
    """Fields of commits with short hashes and metadata as text."""
    pairs = F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return commits.select("hash", short("hash").alias("short"), "tree", F.concat_ws(",", "parents").alias("parents"), "author", "timestamp", "message", F.concat_ws(";", pairs).alias("metadata"))
