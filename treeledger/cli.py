"""Command line: ``python -m treeledger.cli --repo FOLDER COMMAND ...``."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import functions as F

from treeledger.errors import LedgerError
from treeledger.functions.text import short_line
from treeledger.functions.hashing import checked_hash
from treeledger.operators import checkout, diff, history, listing, reach, refs, remap, transfer, usage
from treeledger.operators.refs import ARTIFACTS, HEADS
from treeledger.store import Store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="treeledger")
    p.add_argument("--repo", default=".")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *args: str, **options) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a)
        for k, v in options.items():
            flag = "--" + k.replace("_", "-")
            c.add_argument(flag, action="store_true") if v is False else c.add_argument(flag, default=v, type=type(v) if v is not None else str)
        return c

    command("init")
    command("commit", "source", "ref", message="", author="unknown", metadata="")
    command("checkout", "ref", "target", force=False)
    command("checkout-tree", "tree", "target", force=False)
    command("log", "ref", max_count=0)
    command("ls-tree", "ref", path=None, recursive=False, long=False, human=False)
    command("diff", "old", "new")
    command("union", "output", refs=None, on_conflict="error", message="", author="unknown")
    command("union-checkout", "target", refs=None, on_conflict="error", force=False)
    command("fsck", blobs=False)
    command("gc", dry_run=False)
    command("stats")
    command("du", pattern="*", ref=None, depth=1, limit=20)
    command("truncate-history", dry_run=False)
    command("remap", "old_uid_map", "old_gid_map", "new_uid_map", "new_gid_map", force=False, dry_run=False)
    command("push", "other", "ref", force=False, dry_run=False)
    command("pull", "other", "ref", fetch_only=False, dry_run=False)
    command("refs", pattern="*")
    command("show-ref", pattern="*")
    command("delete-ref", "ref")
    command("delete-refs", "pattern")
    command("delete-artifacts", "pattern")
    command("cat-file", "spec")
    command("rev-parse", "spec", short=False)
    command("show", "ref", key=None)
    command("remote", "action", "name", url=None)
    return p


def run(spark, argv: list[str]) -> int:
    a = parser().parse_args(argv)
    if a.command == "init":
        Store.create(spark, a.repo)
        return 0
    store = Store(spark, a.repo)
    return _COMMANDS[a.command](spark, store, a) or 0


def _show(df, *columns: str) -> None:
    for row in df.select(*columns).toLocalIterator():
        print(" ".join("" if x is None else str(x) for x in row))


def _commit(spark, store, a):
    from treeledger.sources.directory import read_folder

    pairs = dict(p.split("=", 1) for p in a.metadata.split(",") if p)
    print(store.commit(read_folder(spark, a.source), a.ref, a.message, a.author, int(time.time()), pairs))


def _checkout(spark, store, a):
    checkout.write(checkout.manifest(store.paths(a.ref), store.table("blobs")), a.target, a.force)


def _checkout_tree(spark, store, a):
    checkout.write(checkout.manifest(store.paths_of_tree(checked_hash(a.tree)), store.table("blobs")), a.target, a.force)


def _log(spark, store, a):
    for row in history.log_lines(history.log(store.table("commits"), store.resolve(a.ref), a.max_count or None)).collect():
        print(row["text"])


def _ls_tree(spark, store, a):
    paths = store.paths(a.ref)
    rows = listing.recursive(paths) if a.recursive else listing.children(paths, a.path)
    _show(listing.lines(rows, store.table("blobs"), a.long, a.human), "line")


def _diff(spark, store, a):
    signs = F.create_map(*[F.lit(x) for kv in diff.SIGNS.items() for x in kv])
    _show(diff.diff(store.paths(a.old), store.paths(a.new)).withColumn("sign", signs[F.col("kind")]), "sign", "path")


def _union(spark, store, a):
    print(store.union((a.refs or "").split(",") if a.refs else [], a.output, a.on_conflict, a.message, a.author, int(time.time())))


def _union_checkout(spark, store, a):
    layers = [store.paths(r) for r in a.refs.split(",")]
    checkout.union_write(layers, store.table("blobs"), a.target, a.on_conflict, a.force)


def _fsck(spark, store, a):
    report = store.fsck(a.blobs)
    _show(report, "status", "object_type", "hash", "detail")
    return 0 if reach.is_ok(report) else 1


def _stats(spark, store, a):
    row = reach.stats(store.table("commits"), store.table("tree_entries"), store.table("trees"), store.table("blobs"), store.refs()).first()
    for k, v in row.asDict().items():
        print(k, v)


def _du(spark, store, a):
    blobs = store.table("blobs")
    if a.ref:
        sizes, label = usage.du_tree(store.paths(a.ref), blobs, a.depth), "path"
    else:
        names = [r[0] for r in refs.matching(refs.current(store.table("refs_log")), a.pattern).collect()]
        parts = [store.paths(n).select(F.lit(n).alias("snapshot"), "kind", "hash") for n in names]
        if not parts:
            return
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        sizes, label = usage.du(whole, blobs), "ref_name"
    rows, more = usage.top(sizes, a.limit)
    for r in rows.collect():
        print(f"{r['bytes'] / 1e6:10.1f} MB  {r[label]}")
    if more:
        print(f"... and {more} more")


def _remap(spark, store, a):
    from treeledger.sources.directory import parse_id_map

    maps = [parse_id_map(spark, u, "uid").unionByName(parse_id_map(spark, g, "gid")) for u, g in ((a.old_uid_map, a.old_gid_map), (a.new_uid_map, a.new_gid_map))]
    blobs, stats = remap.remap(store.table("blobs"), *maps, force=a.force)
    _show(stats, "outcome", "n")
    if not a.dry_run:
        store.replace("blobs", blobs)


def _cat_file(spark, store, a):
    ref, _, path = a.spec.partition(":")
    if path:
        _show(listing.cat(store.paths(ref), store.table("blobs"), path), "shown")
    else:
        _show(history.shown(store.table("commits").where(F.col("hash") == store.resolve(ref))), "hash", "tree", "parents", "author", "timestamp", "message", "metadata")


def _show_commit(spark, store, a):
    hash_ = store.resolve(a.ref)
    if a.key:
        print(history.metadata(store.table("commits"), hash_, a.key))
    else:
        _show(history.shown(store.table("commits").where(F.col("hash") == hash_)), "hash", "tree", "author", "timestamp", "message", "metadata")
        _show(listing.children(store.paths(hash_)).select(short_line().alias("line")), "line")


def _remote(spark, store, a):
    if a.action == "add":
        store.add_remote(a.name, a.url)
    elif a.action == "remove":
        store.remove_remote(a.name)
    else:
        print(store.remote(a.name))


def _names(spark, store, a):
    _show(refs.matching(refs.current(store.table("refs_log")), a.pattern), "hash", "name")


_COMMANDS = {
    "commit": _commit, "checkout": _checkout, "checkout-tree": _checkout_tree, "log": _log, "ls-tree": _ls_tree, "diff": _diff, "union": _union, "union-checkout": _union_checkout, "fsck": _fsck,
    "gc": lambda s, store, a: _show(store.gc(a.dry_run), "object_type", "removed", "bytes"), "stats": _stats, "du": _du,
    "truncate-history": lambda s, store, a: print(store.truncate_history(a.dry_run)), "remap": _remap,
    "push": lambda s, store, a: print(transfer.push(store, Store(s, a.other), a.ref, a.force, a.dry_run)),
    "pull": lambda s, store, a: print(transfer.pull(Store(s, a.other), store, a.ref, a.fetch_only, a.dry_run)),
    "refs": _names, "show-ref": _names, "delete-ref": lambda s, store, a: store.delete_ref(a.ref),
    "delete-refs": lambda s, store, a: print("\n".join(store.delete_refs(a.pattern, HEADS))), "delete-artifacts": lambda s, store, a: print("\n".join(store.delete_refs(a.pattern, ARTIFACTS))),
    "cat-file": _cat_file, "rev-parse": lambda s, store, a: print(store.resolve(a.spec)[: 12 if a.short else 64]), "show": _show_commit, "remote": _remote,
}


def main() -> int:
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("treeledger").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        return run(spark, sys.argv[1:])
    except LedgerError as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
