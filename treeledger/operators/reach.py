"""Marking: which objects refs lead to, and what follows for collection, checks and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.errors import ObjectNotFound
from treeledger.functions.hashing import blob_hash, commit_hash
from treeledger.plans.closure import SENT_EDGES, Reach, edges_of
from treeledger.plans.joins import matched
from treeledger.plans.merkle import tree_hashes
from treeledger.plans.scratch import Scratch
from treeledger.schema import EMPTY_TREE


def marked_commits(commits: DataFrame, heads: DataFrame, sent_edges: int = SENT_EDGES) -> DataFrame:
    """(hash) of commits that heads (hash) lead to, missing ones too."""
    return Reach(edges_of(commits), heads, sent_edges).hashes(commits)


class Marked(dict):
    """Marked hashes by type, with ``reach``: which commits of the same store they are."""

    reach: Reach


def marked_trees(commits: DataFrame, entries: DataFrame, reach: Reach) -> DataFrame:
    """(hash) of trees below reached commits, level by level, each tree once; only directory entries are read again for each level."""
    scratch = Scratch(commits.sparkSession)
    children = scratch.table(entries.where("kind = 'directory'").select("tree_hash", "hash").distinct(), "children")
    own = reach.inside(commits.select("hash", "tree"), lambda df: df.select("tree").distinct())
    front = seen = scratch.table(own.select(F.col("tree").alias("hash")).distinct(), "level-0")
    level = 0
    while True:
        level += 1
        below = children.join(front.withColumnRenamed("hash", "tree_hash"), "tree_hash", "left_semi").select("hash").distinct()
        new = scratch.table(below.join(seen, "hash", "left_anti"), f"level-{level}")
        if new.isEmpty():
            scratch.drop("children")
            return seen
        seen, front = seen.union(new), new


def blob_uses(entries: DataFrame, trees: DataFrame) -> DataFrame:
    """(hash, tree_hash, name) for each entry of marked trees that names a blob."""
    return entries.where("kind in ('regular', 'symlink')").join(trees.withColumnRenamed("hash", "tree_hash"), "tree_hash", "left_semi").select("hash", "tree_hash", "name")


def mark(commits: DataFrame, entries: DataFrame, heads: DataFrame, trees: DataFrame | None = None, strict: bool = True) -> Marked:
    """Marked hashes by type. Strict: a missing commit or tree raises, as collection and statistics must not guess."""
    reach = Reach(edges_of(commits), heads)
    if strict and (gone := reach.missing.first()):
        raise ObjectNotFound(gone[0])
    reached = marked_trees(commits, entries, reach)
    if strict:
        if trees is not None:
            gone = reached.where(F.col("hash") != EMPTY_TREE).join(trees, "hash", "left_anti").first()
        if gone:
            raise ObjectNotFound(gone[0])
    out = Marked({"commit": reach.hashes(commits), "tree": reached, "blob": blob_uses(entries, reached).select("hash").distinct()})
    out.reach = reach
    return out


def swept(stored: dict[str, DataFrame], marked: Marked) -> dict[str, DataFrame]:
    """What collection removes, by type: stored (hash, length) that isn't marked. Stored commits are those of the store that was marked."""
    rows = {k: df.select("hash", "length") for k, df in stored.items() if k in marked}
    return {k: marked.reach.outside(df) if k == "commit" else matched(df, marked[k], "left_anti") for k, df in rows.items()}


def gc_stats(stored: dict[str, DataFrame], marked: Marked) -> DataFrame:
    """(object_type, removed, bytes)."""
    gone = swept(stored, marked)
    rows = None
    for k, df in gone.items():
        one = df.agg(F.lit(k).alias("object_type"), F.count(F.lit(1)).alias("removed"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("bytes"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.orderBy("object_type")


def fsck(commits: DataFrame, entries: DataFrame, trees: DataFrame, blobs: DataFrame, heads: DataFrame, verify_blobs: bool = False, statuses: tuple[str, ...] = ("corrupt", "missing", "dangling")) -> DataFrame:
    """(status, object_type, hash, detail): corrupt, missing or dangling objects.

    A missing commit or tree is listed once, a missing blob once for each entry that names it. Corrupt commits and trees are those whose
    content doesn't give their hash. Blob content is verified only if asked for, as attributes are part of it. Only what ``statuses`` names is looked for.
    """
    reach = Reach(edges_of(commits), heads)
    reached = marked_trees(commits, entries, reach)
    uses = blob_uses(entries, reached)
    stored = {"tree": trees.select("hash"), "blob": blobs.select("hash")}
    marked = {"tree": reached, "blob": uses.select("hash").distinct()}
    row = lambda df, status, kind, detail=None: df.select(F.lit(status).alias("status"), F.lit(kind).alias("object_type"), "hash", (detail if detail is not None else F.lit("")).alias("detail"))
    out = row(commits.where(commit_hash() != F.col("hash")), "corrupt", "commit")
    made = entries.select(F.col("tree_hash").alias("stored"), *(c for c in entries.columns if c != "tree_hash"))
    made = tree_hashes(made, "stored").where("stored <> tree_hash").select(F.col("stored").alias("hash"))
    out = out.unionByName(row(made, "corrupt", "tree"))
    if "missing" in statuses:
        out = out.unionByName(row(reach.missing.where(F.col("hash") != EMPTY_TREE), "missing", "commit"))
        out = out.unionByName(row(matched(reached.where(F.col("hash") != EMPTY_TREE), stored["tree"], "left_anti"), "missing", "tree"))
    gone = uses.join(stored["blob"], "hash", "left_anti")
    out = out.unionByName(row(gone, "missing", "blob", F.concat_ws("/", "tree_hash", "name")))
    if "dangling" in statuses:
        out = out.unionByName(row(reach.outside(commits.select("hash")), "dangling", "commit"))
    for kind in stored if "dangling" in statuses else ():
        out = out.unionByName(row(matched(stored[kind], marked[kind], "left_anti"), "dangling", kind))
    if verify_blobs:
        # Attributes are part of a blob's hash and kept by its entries, all with the same ones.
        more = entries.where("kind in ('regular', 'symlink')").groupBy("hash").agg(F.first("xattrs").alias("xattrs"))
        out = out.unionByName(row(blobs.join(more, "hash", "left").where(blob_hash("uid", "gid", "mode", "content", "xattrs") != F.col("hash")), "corrupt", "blob"))
    return out.where(F.col("status").isin(*statuses))


def fsck_counts(report: DataFrame, commits: DataFrame, trees: DataFrame, blobs: DataFrame) -> DataFrame:
    """One row: objects_checked, all that is stored, and the objects of a report by status."""
    stored = commits.select("hash").unionAll(trees.select("hash")).unionAll(blobs.select("hash")).agg(F.count(F.lit(1)).alias("objects_checked"))
    found = report.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("corrupt", "missing", "dangling")))
    return stored.join(found)


def is_ok(report: DataFrame) -> bool:
    """Dangling objects are no fault."""
    return report.where("status <> 'dangling'").isEmpty()


def stats(commits: DataFrame, entries: DataFrame, trees: DataFrame, blobs: DataFrame, refs: DataFrame) -> DataFrame:
    """One row of counters: stored objects and bytes by type, referenced ones, unreachable blob bytes, refs."""
    marked = mark(commits, entries, refs.select("hash"), trees)
    parts = []
    for kind, df in (("blob", blobs), ("tree", trees), ("commit", commits)):
        parts.append(df.agg(F.count(F.lit(1)).alias(f"{kind}s"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias(f"{kind}_bytes")))
        parts.append(marked[kind].agg(F.count(F.lit(1)).alias(f"reachable_{kind}s")))
    parts.append(blobs.select("hash", "length").join(marked["blob"], "hash", "left_anti").agg(F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("unreachable_bytes")))
    parts.append(refs.agg(F.count(F.lit(1)).alias("refs")))
    values = {k: v for p in parts for k, v in p.first().asDict().items()}  # one-row counters
    return commits.sparkSession.createDataFrame([tuple(values.values())], ", ".join(f"{k} long" for k in values))
