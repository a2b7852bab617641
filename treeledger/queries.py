"""One query for each operator, on the fixtures. ``oracle`` has the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeledger import fixtures as X
from treeledger.functions.hashing import artifact_hash, as_bytes, blob_hash, commit_hash, hash_path, symlink_hash
from treeledger.functions.text import human_size, long_line, short_line
from treeledger.operators import diff as D
from treeledger.operators import history as H
from treeledger.operators import ingest as I
from treeledger.operators import listing as L
from treeledger.operators import reach as R
from treeledger.operators import refs as N
from treeledger.operators import remap as M
from treeledger.operators import transfer as T
from treeledger.operators import union as U
from treeledger.operators import usage as Z
from treeledger.plans.merkle import flatten, merkle, tree_entries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LAST_SYNC = "2024-01-15"
NAMES = ("main", "a/b", "", "/start", "end/", "double//slash", "with/./dot", "with/../dotdot", "nul\0here", "ok-1.0", "..", "a/..b")
SIZES = (0, 500, 1023, 1024, 1536, 10240, 1048576, 1073741824, 1610612736, 5 * 1024**4)


def query(f: Callable[[SparkSession, str], DataFrame]):
    QUERIES[f.__name__] = f
    return f



def _owner():
    return F.lit(1000).cast("long")


@query
def blob_hashes(s, d):
    docs = X.read(s, d, "documents")
    return docs.select("doc_id", blob_hash(_owner(), _owner(), F.lit(33188), as_bytes("text")).alias("hash"))


@query
def symlink_hashes(s, d):
    docs = X.read(s, d, "documents")
    return docs.select("doc_id", symlink_hash(_owner(), _owner(), F.concat(F.lit("../"), F.col("doc_id").cast("string"))).alias("hash"))


@query
def hash_paths(s, d):
    """Where a store of files would keep each document's blob."""
    return blob_hashes(s, d).select("doc_id", hash_path("hash").alias("place"))


@query
def log_positions(s, d):
    """The newest 500 entries in the order in which the log gives them; its order, not only its rows."""
    history, head = _head(s, d, 7)
    rows = [r["hash"] for r in H.log(history, head, 500).select("hash").collect()]
    return s.createDataFrame([(i, h) for i, h in enumerate(rows, 1)], "pos long, hash string")


@query
def blob_dedup(s, d):
    return X.hashed(X.files_v1(s, d)).groupBy("hash").agg(F.max("length").alias("length"), F.count(F.lit(1)).alias("n"))


@query
def dedup_ratio(s, d):
    return I.dedup_ratio(X.hashed(X.files_v1(s, d)).select("hash", "length"))


@query
def new_blobs(s, d):
    return I.new_blobs(X.blobs_of(X.files_v2(s, d)).drop("content"), X.hashed(X.files_v1(s, d))).select("hash", "length")


@query
def tree_hash_by_dir(s, d):
    return merkle(X.v1(s, d)).where("kind = 'directory'").select("path", "hash", F.coalesce("n_entries", F.lit(0)).alias("n_entries"))


@query
def root_hash(s, d):
    return merkle(X.v2(s, d)).where("path = ''").select("hash")


@query
def diff(s, d):
    return D.diff(X.v1(s, d), X.v2(s, d))


@query
def diff_summary(s, d):
    return D.summary(D.diff(X.v1(s, d), X.v2(s, d)))


@query
def diff_identical(s, d):
    return D.diff(X.v1(s, d), X.v1(s, d))


@query
def diff_type_change(s, d):
    return D.compared(X.v1(s, d), X.v2(s, d)).where("swap").select("path", "old_kind", "new_kind")


@query
def diff_metadata_only(s, d):
    return D.diff(X.v1(s, d), X.v2(s, d)).where("kind = 'm'")


@query
def diff_pruned(s, d):
    return D.diff(*D.pruned(merkle(X.v1(s, d)), merkle(X.v2(s, d))))


@query
def ls_tree_root(s, d):
    return L.children(X.v1(s, d)).select("path", "kind")


@query
def ls_tree_path(s, d):
    return L.children(X.v1(s, d), "en/src3").select("path", "kind", "hash", "size")


@query
def ls_tree_recursive(s, d):
    return L.recursive(merkle(X.v1(s, d))).select("path", short_line().alias("line"))


@query
def ls_tree_long(s, d):
    return L.with_metadata(L.recursive(X.v2(s, d)), X.blobs_of(X.files_v2(s, d))).select("path", long_line().alias("line"))


@query
def human_sizes(s, d):
    few = s.createDataFrame([(n,) for n in SIZES], "size long")
    some = X.read(s, d, "documents").select(F.octet_length("text").cast("long").alias("size")).where("size is not null")
    return few.unionByName(some).distinct().select("size", human_size("size").alias("text"))


@query
def cat_file(s, d):
    return L.contents(X.v2(s, d), X.blobs_of(X.files_v2(s, d))).select("path", "kind", F.sha2(as_bytes("shown"), 256).alias("shown_hash"))


@query
def export_hardlink(s, d):
    return L.exportable(X.v1(s, d)).select("path", "kind", "hash", "size")


@query
def union_first(s, d):
    return U.union(X.layers(s, d), "first").select("path", "kind", "hash", "mode")


@query
def union_last(s, d):
    return U.union(X.layers(s, d), "last").select("path", "kind", "hash", "mode")


@query
def union_conflicts(s, d):
    return U.conflicts(U.grouped(X.layers(s, d)))


@query
def union_type_conflicts(s, d):
    return U.type_conflicts(U.grouped(X.layers(s, d, type_conflict=True)))


@query
def union_dir_meta(s, d):
    return U.union(X.layers(s, d), "last").where("kind = 'directory'").select("path", "mode")


@query
def union_root_hash(s, d):
    return merkle(U.union(X.layers(s, d), "last")).where("path = ''").select("hash")


def _head(s, d, user: int) -> tuple[DataFrame, str]:
    history = X.commits(s, d, once=True)
    row = X.heads(history).where(F.col("name") == f"users/{user}").first()
    return history, row["hash"] if row else "0" * 64


@query
def log(s, d):
    history, head = _head(s, d, 7)
    return H.log(history, head).select("hash", "timestamp", "author", "message")


@query
def log_limit(s, d):
    history, head = _head(s, d, 7)
    return H.log(history, head, 10).select("hash", "timestamp")


@query
def log_text(s, d):
    return H.log_lines(X.commits(s, d))


@query
def merge_commits(s, d):
    return X.commits(s, d).where(H.is_merge()).select("hash", F.col("parents")[0].alias("first"), F.col("parents")[1].alias("second"))


@query
def root_commits(s, d):
    return X.commits(s, d).where(H.is_root()).select("hash", "author")


@query
def commit_metadata(s, d):
    return H.shown(X.commits(s, d)).select("hash", "short", "metadata")


@query
def is_ancestor(s, d):
    """Every head against the first commits of its user and the next, both ways round."""
    history = X.commits(s, d, once=True)
    heads = X.heads(history).select(F.col("hash").alias("new"), F.regexp_extract("name", "[0-9]+$", 0).cast("long").alias("user"))
    firsts = history.groupBy("user_id").agg(F.min_by("hash", F.struct("ts", "event_id")).alias("old"))
    near = heads.withColumn("user_id", F.explode(F.array("user", F.col("user") + 1)))
    pairs = near.join(firsts, "user_id").select("old", "new").distinct()
    back = pairs.select(F.col("new").alias("old"), F.col("old").alias("new"))
    return H.is_ancestor(history, pairs.union(back).distinct())


def _full(s, d, once: bool = True) -> dict[str, DataFrame]:
    """The store without missing commits and trees."""
    history = X.commits(s, d, once)
    out = X.store(s, d, history)
    out["commits"] = history
    out["trees"] = out["tree_entries"].groupBy(F.col("tree_hash").alias("hash")).agg(F.count(F.lit(1)).alias("length"))
    return out


@query
def reachable_commits(s, d):
    full = _full(s, d)
    return R.marked_commits(full["commits"], full["refs"])


@query
def reachable_commits_doubled(s, d):
    """By doubling, as a graph too large to send is closed."""
    full = _full(s, d)
    return R.marked_commits(full["commits"], full["refs"], sent_edges=0)


@query
def flatten_tree(s, d):
    """Paths to tree objects and back."""
    full = merkle(X.v1(s, d))
    roots = full.where("path = ''").select(F.lit("v1").alias("snapshot"), F.col("hash").alias("tree_hash"))
    return flatten(tree_entries(full), roots).select("path", "kind", "hash")


@query
def fsck_nested(s, d):
    """Damage among directories in directories: corrupt, missing and dangling trees and blobs."""
    x = X.nested(s, d, damaged=True)
    return R.fsck(x["commits"], x["tree_entries"], x["trees"], x["blobs"], x["refs"])


@query
def fsck_counts(s, d):
    x = X.nested(s, d, damaged=True)
    return R.fsck_counts(R.fsck(x["commits"], x["tree_entries"], x["trees"], x["blobs"], x["refs"]), x["commits"], x["trees"], x["blobs"])


@query
def gc_nested(s, d):
    """Two snapshots of which a ref leads to one: what only the other holds goes."""
    x = X.nested(s, d)
    stored = {"commit": x["commits"].select("hash", F.lit(1).cast("long").alias("length")), "tree": x["trees"], "blob": x["blobs"]}
    return R.gc_stats(stored, R.mark(x["commits"], x["tree_entries"], x["refs"], x["trees"]))


@query
def gc_dry_run(s, d):
    full = _full(s, d)
    marked = R.mark(full["commits"], full["tree_entries"], full["refs"], full["trees"])
    stored = {"commit": full["commits"].select("hash", F.lit(1).cast("long").alias("length")), "tree": full["trees"], "blob": full["blobs"]}
    return R.gc_stats(stored, marked)


@query
def stats(s, d):
    full = _full(s, d)
    return R.stats(full["commits"].withColumn("length", F.lit(1).cast("long")), full["tree_entries"], full["trees"], full["blobs"], full["refs"])


def _fsck(s, d, status: str) -> DataFrame:
    x = X.store(s, d, X.commits(s, d, once=True))
    return R.fsck(x["commits"], x["tree_entries"], x["trees"], x["blobs"], x["refs"], statuses=(status,))


@query
def fsck_missing(s, d):
    return _fsck(s, d, "missing").select("object_type", "hash", "detail")


@query
def fsck_dangling(s, d):
    return _fsck(s, d, "dangling").select("object_type", "hash")


@query
def fsck_corrupt(s, d):
    history = X.commits(s, d)
    stored = history.withColumn("hash", F.when(F.col("event_id") % 101 == 0, F.sha2(as_bytes(F.concat(F.lit("bad "), F.col("event_id").cast("string"))), 256)).otherwise(commit_hash()))
    empty = X.store(s, d)
    none = {k: empty[k].limit(0) for k in ("tree_entries", "trees", "blobs", "refs")}
    return R.fsck(stored, none["tree_entries"], none["trees"], none["blobs"], none["refs"]).where("status = 'corrupt'").select("object_type", "hash")


def _there(full) -> dict[str, DataFrame]:
    old = full["commits"].where(F.col("ts") < F.lit(LAST_SYNC).cast("timestamp"))
    trees = old.select(F.col("tree").alias("hash")).distinct()
    entries = full["tree_entries"]
    return {"commit": old, "tree": trees, "blob": R.blob_uses(entries, trees).select("hash").distinct()}


@query
def transfer_needed(s, d):
    full = _full(s, d)
    return T.needed(R.mark(full["commits"], full["tree_entries"], full["refs"], full["trees"]), _there(full))


@query
def transfer_shallow(s, d):
    full = _full(s, d, once=False)
    return T.shallow(full["commits"], full["refs"]).select("hash", "tree")


@query
def fast_forward(s, d):
    """Every head against the heads at the last sync, one of them moved."""
    history = X.commits(s, d, once=True)
    theirs = X.heads(history.where(F.col("ts") < F.lit(LAST_SYNC).cast("timestamp")))
    other = theirs.where("name = 'users/2'").select("hash").first()
    moved = theirs.withColumn("hash", F.when(F.col("name") == "users/11", F.lit(other[0] if other else None)).otherwise(F.col("hash")))
    return T.fast_forward(history, X.heads(history), moved).select("name", "ok")


@query
def truncate_history(s, d):
    history = X.commits(s, d)
    return H.truncated(history, X.heads(history)).select("name", "old_hash", "hash")


@query
def truncate_stats(s, d):
    history = X.commits(s, d)
    return H.truncate_stats(history, X.heads(history))


def _usage(s, d) -> tuple[DataFrame, DataFrame]:
    full = _full(s, d, once=False)
    trees = full["refs"].join(full["commits"].select("hash", "tree"), "hash").select(F.col("name").alias("snapshot"), F.col("tree").alias("tree_hash"))
    return trees.join(full["tree_entries"], "tree_hash").select("snapshot", "kind", "hash"), full["blobs"]


@query
def du_refs(s, d):
    return Z.du(*_usage(s, d))


@query
def du_refs_glob(s, d):
    used, blobs = _usage(s, d)
    names = N.matching(X.store(s, d)["refs"].withColumn("namespace", F.lit("heads")), "users/1*").select(F.col("name").alias("snapshot"))
    return Z.du(used.join(names, "snapshot", "left_semi"), blobs)


def _du_tree(depth: int):
    def f(s, d):
        return Z.du_tree(*X.hierarchy(s, d), depth)

    f.__name__ = f"du_tree_{depth}"
    return query(f)


for _depth in (1, 2, 3):
    _du_tree(_depth)


@query
def outside_to_inside(s, d):
    return M.translated(X.owners(s, d), X.id_maps(s), "uid", "uid", "inside").select("doc_id", "inside")


@query
def inside_to_outside(s, d):
    rows = X.read(s, d, "documents").select("doc_id", (F.col("doc_id") * 977 % 70000).alias("uid"))
    return M.translated(rows, X.id_maps(s), "uid", "uid", "outside", outward=True).select("doc_id", "outside")


@query
def remap(s, d):
    return M.remapped(X.owners(s, d), X.id_maps(s), X.id_maps(s, 100000)).select("doc_id", "new_uid", "new_gid", "outcome")


@query
def remap_stats(s, d):
    return M.remap_stats(M.remapped(X.owners(s, d), X.id_maps(s), X.id_maps(s, 100000)))


@query
def refs_list(s, d):
    return N.listed(N.current(X.refs_log(s, d)))


@query
def refs_glob(s, d):
    return N.matching(N.current(X.refs_log(s, d)), "users/[!2-9]?")


@query
def latest_ref(s, d):
    return N.current(X.refs_log(s, d))


@query
def ref_validate(s, d):
    return N.valid_names(s.createDataFrame([(n,) for n in NAMES], "name string")).select(F.hex("name").alias("name_hex"), "ok")


@query
def resolve_ref(s, d):
    asked = s.createDataFrame([("users/7",), ("users/10",), ("A" * 64,), ("nope",)], "spec string")
    return N.resolved(asked, N.current(X.refs_log(s, d)))


@query
def hardlink_groups(s, d):
    return I.hardlinks(X.inodes(s, d)).where("first_path is not null").select("path", "first_path")


@query
def sparse_layout(s, d):
    docs = X.read(s, d, "documents")
    region = F.array(*(F.struct(F.lit(a).cast("long").alias("offset"), F.lit(n).cast("long").alias("length")) for a, n in ((0, 10), (40, 20))))
    rows = docs.select("doc_id", as_bytes("text").alias("content"), F.when(F.col("doc_id") % 3 != 0, region).alias("regions"))
    rows = rows.withColumn("data", I.data_bytes(F.col("content"), F.col("regions")))
    return rows.select("doc_id", I.sparse_total(F.col("regions")).alias("total"), F.octet_length("data").cast("long").alias("stored"), F.sha2("data", 256).alias("data_hash"))


@query
def artifact_hashes(s, d):
    return X.artifacts(s, d).select("path", artifact_hash().alias("hash"))


@query
def artifact_refs_glob(s, d):
    refs = X.artifacts(s, d).select(F.lit("artifacts").alias("namespace"), F.col("path").alias("name"), "hash")
    return N.matching(refs, "Brand-1*/*/*7", "artifacts")
