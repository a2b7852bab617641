"""Operators on small snapshots."""

import hashlib
import os
import struct

import pytest
from pyspark.sql import functions as F

from treeledger import errors as E
from treeledger.functions.hashing import artifact_hash, blob_hash, symlink_hash
from treeledger.functions.text import entry_name_ok, glob_regex, human_size, permissions, policy, ref_name_ok
from treeledger.operators import checkout, diff, history, ingest, listing, reach, refs, remap, transfer, union, usage
from treeledger.plans.closure import edges_of, reachable
from treeledger.plans.merkle import flatten, merkle, tree_entries
from treeledger.schema import PATHS, SOURCE_FILES
from treeledger.sources.directory import id_map_rows, read_folder
from treeledger.store import Store

FILE, DIR = 0o100644, 0o040755


def paths(spark, rows):
    """(path, kind, hash, more...) as paths."""
    names = [f.name for f in PATHS]
    full = []
    for path, kind, hash_, *more in rows:
        r = dict.fromkeys(names)
        r |= {"path": path, "kind": kind, "hash": hash_} | (more[0] if more else {})
        if kind == "directory":
            r |= {"uid": r["uid"] or 0, "gid": r["gid"] or 0, "mode": r["mode"] or DIR}
        full.append(tuple(r[n] for n in names))
    return spark.createDataFrame(full, PATHS)


def changes(a, b):
    return [tuple(r) for r in diff.diff(a, b).collect()]


def test_hashes_match_plain_python(spark):
    xattrs = [("user.b", b"2"), ("user.a", b"1")]
    df = spark.createDataFrame([(1, 4294967295, FILE, bytearray(b"hi"), [(n, bytearray(v)) for n, v in xattrs])], "u long, g long, m long, c binary, x array<struct<name:string,value:binary>>")
    got = df.select(blob_hash("u", "g", "m", "c"), blob_hash("u", "g", "m", "c", "x"), symlink_hash("u", "g", F.lit("/t"))).first()
    head = struct.pack("<III", 1, 4294967295, FILE)
    attrs = b"".join(struct.pack("<I", len(n)) + n.encode() + struct.pack("<I", len(v)) + v for n, v in sorted(xattrs))
    assert got[0] == hashlib.sha256(head + struct.pack("<I", 0) + b"hi").hexdigest()
    assert got[1] == hashlib.sha256(head + struct.pack("<I", 2) + attrs + b"hi").hexdigest()
    assert got[2] == hashlib.sha256(struct.pack("<IIII", 1, 4294967295, 0o120777, 0) + b"/t").hexdigest()


def test_artifact_hash_depends_on_output(spark):
    df = spark.createDataFrame([("a", "b", "bundles/dev"), ("a", "b", "bundles/dev"), ("a", "b", "bundles/full")], "tree string, manifest_hash string, output string")
    assert df.select(artifact_hash()).distinct().count() == 2


def test_human_sizes_and_permissions(spark):
    want = {0: "    0", 500: "  500", 1024: "1.0K", 1536: "1.5K", 10240: "  10K", 1 << 20: "1.0M", 1 << 30: "1.0G"}
    df = spark.createDataFrame([(k,) for k in want], "n long")
    assert {r[0]: r[1] for r in df.select("n", human_size("n")).collect()} == want
    modes = {0o100755: "-rwxr-xr-x", 0o040700: "drwx------", 0o120777: "lrwxrwxrwx", 0o104644: "-rw-r--r--"}
    df = spark.createDataFrame([(k,) for k in modes], "m long")
    assert {r[0]: r[1] for r in df.select("m", permissions("m")).collect()} == modes


def test_names_and_globs(spark):
    bad = ["", "/start", "end/", "double//slash", "with/./dot", "with/../dotdot", "nul\0"]
    df = spark.createDataFrame([(n,) for n in [*bad, "ok", "a/b.c"]], "n string")
    assert [r[0] for r in df.where(ref_name_ok("n")).collect()] == ["ok", "a/b.c"]
    df = spark.createDataFrame([(n,) for n in ["", ".", "..", "a/b", "a", "a.b"]], "n string")
    assert [r[0] for r in df.where(entry_name_ok("n")).collect()] == ["a", "a.b"]
    names = spark.createDataFrame([(n,) for n in ["x86_64/pkg/foo/1.0", "x86_64/pkg/bar/2.0", "aarch64/pkg/foo/1.0"]], "n string")
    count = lambda g: names.where(F.col("n").rlike(glob_regex(g))).count()
    assert (count("x86_64/*"), count("*/pkg/foo/*"), count("x86?64/pkg/[!f]*")) == (2, 2, 1)
    with pytest.raises(E.InvalidRef):
        glob_regex("[ab")
    with pytest.raises(E.InvalidConflictResolution):
        policy("newest")
    assert policy("LAST") == "last"


def test_diff_kinds(spark):
    a = paths(spark, [("d", "directory", None), ("d/f", "regular", "1", {"size": 3}), ("d/h", "hardlink", None, {"target_path": "d/f"}), ("gone", "regular", "2"), ("t", "directory", None), ("t/x", "regular", "3"), ("u", "regular", "4"), ("v", "regular", "5")])
    b = paths(spark, [("d", "directory", None, {"mode": 0o040700}), ("d/f", "regular", "9", {"size": 3}), ("d/h", "hardlink", None, {"target_path": "v"}), ("new", "directory", None), ("new/a", "regular", "6"), ("t", "regular", "7"), ("u", "symlink", "4"), ("v", "regular", "5", {"size": 8})])
    want = [("d", "m"), ("d/f", "M"), ("d/h", "m"), ("gone", "D"), ("new", "A"), ("new/a", "A"), ("t", "M"), ("u", "M"), ("v", "m")]
    assert changes(a, b) == want
    assert changes(a, a) == []
    swap = {"A": "D", "D": "A"}
    assert changes(b, a) == [(p, swap.get(k, k)) for p, k in want]
    assert changes(*diff.pruned(merkle(a), merkle(b))) == want


def test_merkle_and_flatten_round_trip(spark):
    a = paths(spark, [("a", "directory", None), ("a/b", "directory", None), ("a/b/c", "regular", "1", {"size": 1}), ("a.b", "symlink", "2"), ("e", "directory", None)])
    full = merkle(a)
    hashes = {r.path: r.hash for r in full.collect()}
    assert hashes["e"] == hashlib.sha256(b"").hexdigest() and len(hashes[""]) == 64
    back = flatten(tree_entries(full), spark.createDataFrame([("s", hashes[""])], "snapshot string, tree_hash string"))
    assert {(r.path, r.kind, r.hash) for r in back.collect()} == {(r.path, r.kind, r.hash) for r in full.where("path <> ''").collect()}
    assert [r.path for r in listing.recursive(a).collect()] == ["a", "a/b", "a/b/c", "a.b", "e"]
    other = merkle(paths(spark, [("a", "directory", None), ("a/b", "directory", None), ("a/b/c", "regular", "9", {"size": 1}), ("a.b", "symlink", "2"), ("e", "directory", None)]))
    assert {r.path: r.hash for r in other.collect()}[""] != hashes[""]
    empty = merkle(a.limit(0))
    assert empty.first().hash == hashes["e"]


def test_listing(spark):
    a = paths(spark, [("a", "directory", None), ("a/f", "regular", "1"), ("g", "regular", "2"), ("l", "hardlink", None, {"target_path": "a/f"})])
    names = lambda df: [r.path for r in df.collect()]
    assert names(listing.children(a)) == ["a", "g", "l"]
    assert names(listing.children(a, "a/")) == ["a/f"] and names(listing.children(a, "g")) == ["g"] and names(listing.children(a, "g/x")) == []
    assert [(r.path, r.hash) for r in listing.exportable(a, "l").collect()] == [("l", "1")]
    with pytest.raises(E.InvalidObjectType):
        listing.exportable(a, "a")
    with pytest.raises(E.PathNotFound):
        listing.exportable(a, "nothing")


def test_union_policies(spark):
    one = paths(spark, [("d", "directory", None), ("d/a", "regular", "1"), ("c", "regular", "x")])
    two = paths(spark, [("d", "directory", None, {"mode": 0o040700}), ("d/b", "regular", "2"), ("c", "regular", "x")])
    with pytest.raises(E.UnionConflict, match="c"):
        union.union([one, two])
    got = {r.path: r for r in union.union([one, two], "first").collect()}
    assert set(got) == {"d", "d/a", "d/b", "c"} and got["d"].mode == 0o040700
    with pytest.raises(E.UnionTypeConflict):
        union.union([one, paths(spark, [("d", "regular", "3")])], "last")
    with pytest.raises(E.InvalidRef):
        union.union([])
    last = union.union([one, two], "last")
    assert changes(union.union([last, last], "last"), last) == []


@pytest.fixture(scope="module")
def graph(spark):
    rows = [("c1", []), ("c2", ["c1"]), ("c3", ["c2"]), ("b1", ["c1"]), ("m", ["c3", "b1"]), ("x", ["lost"])]
    full = [(h, f"t{h}", p, "a", i, "msg", {"k": str(i)}) for i, (h, p) in enumerate(rows)]
    return spark.createDataFrame(full, "hash string, tree string, parents array<string>, author string, timestamp long, message string, metadata map<string,string>")


def test_history(spark, graph):
    assert [r.hash for r in history.log(graph, "m").collect()] == ["m", "b1", "c3", "c2", "c1"]
    assert [r.hash for r in history.log(graph, "m", 2).collect()] == ["m", "b1"]
    with pytest.raises(E.ObjectNotFound):
        history.log(graph, "x")
    pairs = spark.createDataFrame([("c1", "m"), ("m", "m"), ("m", "c1"), ("c3", "b1"), ("lost", "x")], "old string, new string")
    assert {(r.old, r.new): r.ok for r in history.is_ancestor(graph, pairs).collect()} == {("c1", "m"): True, ("m", "m"): True, ("m", "c1"): False, ("c3", "b1"): False, ("lost", "x"): False}
    heads = spark.createDataFrame([("main", "m"), ("root", "c1")], "name string, hash string")
    rows = history.truncated(graph, heads).collect()
    assert [(r.name, r.parents, r.timestamp) for r in rows] == [("main", [], 4)]
    assert tuple(history.truncate_stats(graph, heads).first()) == (2, 1)
    assert history.metadata(graph, "m", "k") == "4"
    with pytest.raises(E.MetadataKeyNotFound):
        history.metadata(graph, "m", "none")


def test_doubling_agrees_with_the_walk(spark, graph):
    starts = spark.createDataFrame([("r", "m"), ("s", "c2"), ("s", "gone")], "root string, node string")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(reachable(edges_of(graph), starts)) == rows(reachable(edges_of(graph), starts, sent_edges=0))
    pairs = graph.select(F.col("hash").alias("new")).crossJoin(graph.select(F.col("hash").alias("old")))
    assert rows(history.is_ancestor(graph, pairs)) == rows(history.is_ancestor(graph, pairs, sent_edges=0))


def test_doubling_of_a_long_chain_and_a_circle(spark):
    """A chain's rounds follow the logarithm of its length; a circle, which no sound history has, ends too."""
    chain = spark.range(3000).select(F.col("id").cast("string").alias("child"), (F.col("id") + 1).cast("string").alias("parent"))
    circle = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "child string, parent string")
    starts = spark.createDataFrame([("r", "10"), ("s", "a")], "root string, node string")
    got = reachable(chain.union(circle), starts, sent_edges=0).groupBy("root").count().collect()
    assert {r[0]: r[1] for r in got} == {"r": 2991, "s": 3}


def test_ancestry_of_every_ref_by_brute_force(spark, tmp_path):
    import random
    from datetime import datetime, timedelta

    from treeledger import fixtures
    from treeledger.queries import LAST_SYNC, QUERIES

    rng = random.Random(4)
    events = [(i, rng.randrange(1, 26), datetime(2024, 1, 1) + timedelta(hours=4 * i), rng.choice(["view", "purchase"]), "{}") for i in range(180)]
    spark.createDataFrame(events, "event_id long, user_id long, ts timestamp, event_type string, props string").write.parquet(str(tmp_path / "events.parquet"))
    rows = sorted(fixtures.commits(spark, str(tmp_path)).collect(), key=lambda r: (r.ts, r.event_id))
    parents = {r.hash: r.parents for r in rows}

    def reach(h):
        seen, todo = set(), [h]
        while todo:
            if (x := todo.pop()) not in seen:
                seen.add(x)
                todo += parents[x]
        return seen

    last, first, synced = {}, {}, {}
    for r in rows:
        last[r.user_id] = r.hash
        first.setdefault(r.user_id, r.hash)
        if r.ts < datetime.fromisoformat(LAST_SYNC):
            synced[r.user_id] = r.hash
    pairs = {(first[v], last[u]) for u in last for v in (u, u + 1) if v in first}
    pairs |= {(b, a) for a, b in pairs}
    want = {(old, new, old in reach(new)) for old, new in pairs}
    assert {ok for *_, ok in want} == {True, False}
    got = [tuple(r) for r in QUERIES["is_ancestor"](spark, str(tmp_path)).collect()]
    assert set(got) == want and len(got) == len(want)
    if 11 in synced:
        synced[11] = synced[2]
    want = {f"users/{u}": u not in synced or synced[u] in reach(h) for u, h in last.items()}
    assert set(want.values()) == {True, False} and len(want) > 20
    assert {r.name: r.ok for r in QUERIES["fast_forward"](spark, str(tmp_path)).collect()} == want
    # The queries that SQL checks are parts of these.
    assert {tuple(r) for r in QUERIES["is_ancestor"](spark, str(tmp_path)).collect()} < set(got)
    part = {r.name: r.ok for r in QUERIES["fast_forward"](spark, str(tmp_path)).collect()}
    assert part == {n: ok for n, ok in want.items() if n[-1] in "13"}


def test_fsck_gc_and_usage(spark, graph):
    entries = [("tm", "f", "regular", "B1"), ("tm", "d", "directory", "sub"), ("sub", "g", "regular", "B1"), ("sub", "h", "symlink", "B2"), ("tc1", "f", "regular", "B3")]
    entries = spark.createDataFrame(entries, "tree_hash string, name string, kind string, hash string")
    for c in PATHS.names[3:]:
        entries = entries.withColumn(c, F.lit(None).cast(PATHS[c].dataType))
    trees = spark.createDataFrame([(t, 1) for t in ["tm", "sub", "tc1", "tc2", "tc3", "tb1", "junk"]], "hash string, length long")
    blobs = spark.createDataFrame([("B1", 10), ("B3", 7), ("B9", 100)], "hash string, length long")
    heads = spark.createDataFrame([("m",)], "hash string")
    report = {tuple(r) for r in reach.fsck(graph, entries, trees, blobs, heads).where("status <> 'corrupt'").collect()}
    assert report == {("missing", "blob", "B2", "sub/h"), ("dangling", "tree", "junk", ""), ("dangling", "blob", "B9", ""), ("dangling", "commit", "x", "")}
    marked = reach.mark(graph, entries, heads, trees)
    stats = {r.object_type: (r.removed, r.bytes) for r in reach.gc_stats({"commit": graph.withColumn("length", F.lit(1)), "tree": trees, "blob": blobs}, marked).collect()}
    assert stats == {"blob": (1, 100), "commit": (1, 1), "tree": (1, 1)}
    with pytest.raises(E.ObjectNotFound):
        reach.mark(graph, entries, spark.createDataFrame([("x",)], "hash string"), trees)
    lacking = transfer.needed(marked, {"commit": graph.where("hash <> 'm'"), "tree": trees.where("hash <> 'sub'"), "blob": blobs})
    assert {tuple(r) for r in lacking.collect()} == {("commit", "m"), ("tree", "sub"), ("blob", "B2")}
    snapshot = spark.createDataFrame([("main", "regular", "B1"), ("main", "regular", "B1"), ("main", "regular", "B3"), ("none", "fifo", None)], "snapshot string, kind string, hash string")
    assert [tuple(r) for r in usage.du(snapshot, blobs).collect()] == [("main", 17), ("none", 0)]
    a = paths(spark, [("d", "directory", None), ("d/e", "directory", None), ("d/e/1", "regular", "B1"), ("d/e/2", "regular", "B1"), ("d/f", "regular", "B1"), ("g", "regular", "B3")])
    tree = lambda n: {tuple(r) for r in usage.du_tree(a, blobs, n).collect()}
    assert tree(0) == set() and tree(1) == {("d", 10), ("g", 7)} and tree(2) == {("d", 20), ("d/e", 10), ("d/f", 10)} and tree(3) == {("d", 30), ("d/e", 20), ("d/e/1", 10), ("d/e/2", 10)}


def test_id_maps(spark):
    maps = id_map_rows(spark, "0 1000 1\n1 100000 65536\nnot a\n", "uid")
    ids = spark.createDataFrame([(1000,), (100189,), (999,)], "id long")
    assert [r.i for r in remap.translated(ids, maps, "uid", "id", "i").collect()] == [0, 190, None]
    top = id_map_rows(spark, f"{(1 << 32) - 11} 0 20", "uid")
    ids = spark.createDataFrame([((1 << 32) - 2,), ((1 << 32) - 1,)], "id long")
    assert [r.o for r in remap.translated(ids, top, "uid", "id", "o", outward=True).collect()] == [9, None]
    with pytest.raises(E.NamespaceParseError):
        id_map_rows(spark, "0 x 1", "uid")
    assert remap.maps_equal(maps, maps) and not remap.is_identity(maps)


def test_latest_ref_and_resolve(spark):
    log = spark.createDataFrame([("heads", "a", "1", 1), ("heads", "a", "2", 2), ("heads", "b", "3", 1), ("heads", "b", None, 4), ("heads", "a/b", "5", 5)], "namespace string, name string, hash string, seq long")
    now = refs.current(log)
    assert [tuple(r) for r in refs.listed(now).collect()] == [("a", "2"), ("a/b", "5")]
    assert refs.resolve(now, "a") == "2" and refs.resolve(now, "F" * 64) == "f" * 64
    with pytest.raises(E.RefNotFound):
        refs.resolve(now, "b")
    assert [r.name for r in refs.nesting_conflicts(now).collect()] == ["a"]


def test_hardlinks_and_sparse(spark):
    rows = spark.createDataFrame([("z", "regular", 1, 7, 2), ("a", "regular", 1, 7, 2), ("s", "regular", 1, 9, 2), ("d", "directory", 1, 7, 2)], "path string, file_type string, dev long, ino long, nlink long")
    assert {r.path: r.first_path for r in ingest.hardlinks(rows).collect()} == {"z": "a", "a": None, "s": None, "d": None}
    df = spark.createDataFrame([(bytearray(b"abcdefghij"), [(1, 2), (5, 3)], 12), (bytearray(b"xyz"), None, 3), (bytearray(b""), [], 4)], "c binary, r array<struct<offset:long,length:long>>, n long")
    data = [bytes(r[0]) for r in df.select(ingest.data_bytes(F.col("c"), F.col("r"))).collect()]
    assert data == [b"bcfgh", b"xyz", b""]
    back = df.select(ingest.restored_bytes(ingest.data_bytes(F.col("c"), F.col("r")), F.col("r"), F.col("n"))).collect()
    assert [bytes(r[0]) for r in back] == [b"\0bc\0\0fgh\0\0\0\0", b"xyz", b"\0\0\0\0"]


def test_store_round_trip(spark, tmp_path):
    src = tmp_path / "src"
    (src / "a/b").mkdir(parents=True)
    (src / "a/b/file.txt").write_text("world")
    (src / "top.txt").write_text("hello")
    os.link(src / "top.txt", src / "a/hard")
    (src / "link").symlink_to("a/b/file.txt")
    (src / "empty").mkdir()
    store = Store.create(spark, str(tmp_path / "store"))
    with pytest.raises(E.RepoExists):
        Store.create(spark, str(tmp_path / "store"))
    first = store.commit(read_folder(spark, str(src)), "main", timestamp=1)
    assert store.resolve("main") == first
    assert {r.path: r.kind for r in store.paths("main").collect()} == {"a": "directory", "a/b": "directory", "a/b/file.txt": "regular", "a/hard": "regular", "top.txt": "hardlink", "link": "symlink", "empty": "directory"}
    out = tmp_path / "out"
    checkout.write(checkout.manifest(store.paths("main"), store.table("blobs")), str(out))
    assert (out / "a/b/file.txt").read_text() == "world" and os.readlink(out / "link") == "a/b/file.txt" and os.path.samefile(out / "top.txt", out / "a/hard") and (out / "empty").is_dir()
    with pytest.raises(E.TargetNotEmpty):
        checkout.write(checkout.manifest(store.paths("main"), store.table("blobs")), str(out))
    (src / "a/b/file.txt").write_text("changed")
    second = store.commit(read_folder(spark, str(src)), "main", timestamp=2)
    assert changes(store.paths(first), store.paths(second)) == [("a/b/file.txt", "M")]
    assert [r.hash for r in history.log(store.table("commits"), second).collect()] == [second, first]
    assert reach.is_ok(store.fsck(verify_blobs=True))
    checkout.export(store.paths("main"), store.table("blobs"), "top.txt", str(tmp_path / "one"))
    assert (tmp_path / "one").read_text() == "hello"
    other = Store.create(spark, str(tmp_path / "other"))
    assert transfer.push(store, other, "main", dry_run=True)["objects_to_transfer"] > 0
    assert transfer.push(store, other, "main")["copied"] > 0 and other.resolve("main") == second
    assert store.truncate_history() == 1 and store.table("commits").count() == 3
    with pytest.raises(E.NotFastForward):
        transfer.push(store, other, "main")
    store.delete_ref("main")
    with pytest.raises(E.RefNotFound):
        store.resolve("main")
    report = {r.object_type: r.removed for r in store.gc(dry_run=False).collect()}
    assert report["commit"] == 3 and store.table("blobs").count() == 0
    store.add_remote("r", "x:/y")
    assert store.remote("r") == "x:/y"
    with pytest.raises(E.RemoteNotFound):
        store.remove_remote("none")


def test_streaming_commits(spark, tmp_path):
    from treeledger.streaming.ingest import commit_each_batch

    row = lambda p, text: tuple({"path": p, "file_type": "regular", "uid": 1, "gid": 1, "mode": FILE, "size": len(text), "ino": 1, "dev": 1, "nlink": 1, "content": bytearray(text)}.get(n) for n in SOURCE_FILES.names)
    spark.createDataFrame([row("f", b"1")], SOURCE_FILES).write.parquet(str(tmp_path / "in"))
    store = Store.create(spark, str(tmp_path / "s"))
    stream = spark.readStream.schema(SOURCE_FILES).parquet(str(tmp_path / "in"))
    commit_each_batch(stream, store, "live", str(tmp_path / "cp")).awaitTermination(120)
    assert [r.path for r in store.paths("live").collect()] == ["f"]


def test_checkout_restores_attributes_holes_and_locked_folders(spark, tmp_path):
    """Extended attributes, files of holes, sockets and directories without write permission come back; names that lead out raise."""
    from treeledger.sources.directory import row

    src, out = tmp_path / "src", tmp_path / "out"
    (src / "closed/in").mkdir(parents=True)
    (src / "closed/in/f").write_text("inside")
    with open(src / "holes", "wb") as f:
        f.seek(1 << 20)
        f.write(b"end")
        f.truncate(3 << 20)
    try:
        os.setxattr(src / "closed/in/f", "user.note", b"kept")
        noted = True
    except OSError:
        noted = False
    os.mknod(src / "sock", 0o140600)
    os.chmod(src / "closed/in", 0o500)
    os.chmod(src / "closed", 0o555)
    store = Store.create(spark, str(tmp_path / "r"))
    store.commit(read_folder(spark, str(src)), "main")
    checkout.write(checkout.manifest(store.paths("main"), store.table("blobs")), str(out))
    assert (out / "closed/in/f").read_text() == "inside" and (out / "closed").stat().st_mode & 0o777 == 0o555 and (out / "closed/in").stat().st_mode & 0o777 == 0o500
    assert (out / "holes").read_bytes() == (src / "holes").read_bytes() and row(str(out), "sock")[1] == "socket"
    assert not noted or os.getxattr(out / "closed/in/f", "user.note") == b"kept"
    assert reach.is_ok(store.fsck(verify_blobs=True))
    counts = reach.fsck_counts(store.fsck(), store.table("commits"), store.table("trees"), store.table("blobs")).first().asDict()
    assert counts["objects_checked"] == 1 + store.table("trees").count() + store.table("blobs").count() and counts["missing"] == 0
    for bad in ("../x", "/etc/x", "a//b", "a/./b"):
        with pytest.raises(E.InvalidEntryName):
            checkout.manifest(paths(spark, [(bad, "regular", "h")]), store.table("blobs"))


def test_union_checkout_meets_what_is_there(spark, tmp_path):
    def committed(name, **files):
        src = tmp_path / name
        src.mkdir()
        for k, v in files.items():
            (src / k).write_text(v)
        store.commit(read_folder(spark, str(src)), name)
        return store.paths(name)

    store = Store.create(spark, str(tmp_path / "r"))
    layers = [committed("one", f="1", g="1"), committed("two", h="2")]
    out = tmp_path / "out"
    out.mkdir()
    (out / "f").write_text("mine")
    lay = lambda how: checkout.union_write(layers, store.table("blobs"), str(out), how, force=True)
    with pytest.raises(E.UnionConflict):
        lay("error")
    assert not (out / "h").exists()
    lay("first")
    assert (out / "f").read_text() == "mine" and (out / "h").read_text() == "2"
    lay("last")
    assert (out / "f").read_text() == "1"
    (out / "g").unlink()
    (out / "g").mkdir()
    with pytest.raises(E.UnionTypeConflict):
        lay("last")


def test_collection_keeps_names_and_rewrites_together(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    store = Store.create(spark, str(tmp_path / "r"))
    for i in range(2):
        (src / "f").write_text(f"version {i}")
        store.commit(read_folder(spark, str(src)), f"b{i}")
    store.delete_ref("b0")
    with pytest.raises(E.RefNotFound):
        store.delete_ref("b0")
    assert {r.object_type: r.removed for r in store.gc(dry_run=False).collect()} == {"blob": 1, "commit": 1, "tree": 1}
    assert store.table("commits").count() == 1 and reach.is_ok(store.fsck()) and store.gc().agg(F.sum("removed")).first()[0] == 0
    store.commit(read_folder(spark, str(src)), "b2")
    assert store.refs().count() == 2 and reach.is_ok(store.fsck(verify_blobs=True))
