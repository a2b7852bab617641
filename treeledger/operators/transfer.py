"""Push and pull between two stores, as set differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.errors import CorruptObject, InvalidEntryName, NotFastForward, RefNotFound
from treeledger.functions.hashing import commit_hash
from treeledger.functions.text import entry_name_ok
from treeledger.operators.history import is_ancestor
from treeledger.operators.reach import mark
from treeledger.operators.refs import HEADS, current
from treeledger.plans.joins import matched
from treeledger.plans.merkle import tree_hashes


def needed(marked: dict[str, DataFrame], there: dict[str, DataFrame]) -> DataFrame:
    """(object_type, hash): what the heads lead to and the destination lacks."""
    out = None
    for kind, df in marked.items():
        one = matched(df, there[kind], "left_anti").select(F.lit(kind).alias("object_type"), "hash")
        out = one if out is None else out.unionByName(one)
    return out


def shallow(commits: DataFrame, heads: DataFrame) -> DataFrame:
    """The heads' own commits, without parents."""
    return commits.join(heads.select("hash"), "hash", "left_semi")


def fast_forward(commits: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(name, old, new, ok) for refs (name, hash): ok if the destination has no such ref or its head is an ancestor of ours."""
    pairs = ours.select("name", F.col("hash").alias("new")).join(theirs.select("name", F.col("hash").alias("old")), "name", "left")
    known = pairs.where("old is not null").select("old", "new").distinct()
    answer = is_ancestor(commits, known)
    return pairs.join(answer, ["old", "new"], "left").select("name", "old", "new", F.coalesce("ok", F.lit(True)).alias("ok"))


def push(source, destination, name: str, force: bool = False, dry_run: bool = False) -> dict:
    """Send a ref: objects the destination lacks, then the ref. Not an ancestor and not forced raises."""
    mine = current(source.table("refs_log")).where((F.col("namespace") == HEADS) & (F.col("name") == name)).select("name", "hash")
    if mine.isEmpty():
        raise RefNotFound(name)
    if not force:
        theirs = current(destination.table("refs_log")).where(F.col("namespace") == HEADS).select("name", "hash")
        if not fast_forward(source.table("commits"), mine, theirs).first()["ok"]:
            raise NotFastForward(name)
    return _send(source, destination, name, mine, dry_run, set_ref=True)


def pull(source, destination, name: str, fetch_only: bool = False, dry_run: bool = False) -> dict:
    """Fetch a ref from source; no ancestry is asked for."""
    mine = current(source.table("refs_log")).where((F.col("namespace") == HEADS) & (F.col("name") == name)).select("name", "hash")
    if mine.isEmpty():
        raise RefNotFound(name)
    return _send(source, destination, name, mine, dry_run, set_ref=not fetch_only)


def _send(source, destination, name: str, head: DataFrame, dry_run: bool, set_ref: bool) -> dict:
    marked = mark(source.table("commits"), source.table("tree_entries"), head.select("hash"), source.table("trees"))
    there = {k: destination.table(t) for k, t in (("commit", "commits"), ("tree", "trees"), ("blob", "blobs"))}
    lacking = needed(marked, there)
    total = sum(df.count() for df in marked.values())
    count = lacking.count()
    lengths = [source.table(t).select(F.lit(k).alias("object_type"), "hash", "length") for k, t in (("blob", "blobs"), ("tree", "trees"), ("commit", "commits"))]
    size = lacking.join(reduce(DataFrame.unionByName, lengths), ["object_type", "hash"]).agg(F.sum("length")).first()[0] or 0
    result = {"bytes": size, "hash": head.first()["hash"], "objects_to_transfer": count if dry_run else 0, "copied": 0 if dry_run else count, "skipped": total - count}
    if dry_run:
        return result
    want = {k: lacking.where(F.col("object_type") == k).select("hash") for k in marked}
    rows = {
        "blobs": source.table("blobs").join(want["blob"], "hash", "left_semi"),
        "tree_entries": source.table("tree_entries").join(want["tree"].withColumnRenamed("hash", "tree_hash"), "tree_hash", "left_semi"),
        "trees": source.table("trees").join(want["tree"], "hash", "left_semi"),
        "commits": source.table("commits").join(want["commit"], "hash", "left_semi"),
    }
    wrong = rows["tree_entries"].where(~entry_name_ok("name")).select("name").first()
    if wrong:
        raise InvalidEntryName(wrong[0])
    made = rows["tree_entries"].select(F.col("tree_hash").alias("stored"), *(c for c in rows["tree_entries"].columns if c != "tree_hash"))
    bad = rows["commits"].where(commit_hash() != F.col("hash")).select("hash").first() or tree_hashes(made, "stored").where("stored <> tree_hash").select("stored").first()
    if bad:
        raise CorruptObject(bad[0])
    destination.append_all(rows)
    if set_ref:
        destination.write_ref(name, result["hash"])
    return result
