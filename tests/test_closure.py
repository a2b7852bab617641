"""Reach in graphs that are too large to send: results by brute force, and how many rows are written on the way."""

import random

import pytest

from treeledger.plans import closure, scratch


@pytest.fixture
def written(monkeypatch):
    """Rows of every scratch table, by name."""
    rows, table = [], scratch.Scratch.table

    def counted(self, df, name, *more):
        out = table(self, df, name, *more)
        rows.append((name, out.count()))
        return out

    monkeypatch.setattr(scratch.Scratch, "table", counted)
    return rows


def reach(parents, start):
    seen, todo = set(), [start]
    while todo:
        if (x := todo.pop()) not in seen:
            seen.add(x)
            todo += parents.get(x, [])
    return seen


def test_ancestry_of_many_heads_writes_rows_by_chain_not_by_commit(spark, written):
    """Each commit of a chain as a head: its reach is never written out."""
    edges = spark.createDataFrame([(f"{i + 1:064x}", f"{i:064x}", 0) for i in range(300)], "child string, parent string, ord int")
    pairs = spark.createDataFrame([(f"{i * 7 % 301:064x}", f"{i:064x}") for i in range(301)] + [("none", "none"), ("none", "no")], "old string, new string")
    got = {(r.old, r.new): r.ok for r in closure.tested(edges, pairs, sent_edges=0).collect()}
    assert got == {(f"{i * 7 % 301:064x}", f"{i:064x}"): i * 7 % 301 <= i for i in range(301)} | {("none", "none"): True, ("none", "no"): False}
    assert max(n for _, n in written) < 1000 and sum(n for _, n in written) < 10000


def test_reach_with_merges_and_circles_by_brute_force(spark, written):
    """Random parents, a circle of first parents, names of other forms; nothing grows with the pairs of commits."""
    rng = random.Random(7)
    parents = {f"{i:064x}": [f"{j:064x}" for j in rng.sample(range(max(0, i - 30), i), min(i, 2))] for i in range(1, 400)}
    parents |= {"a": ["b"], "b": ["c"], "c": ["a", f"{50:064x}"], "B" * 64: ["a"]}
    edges = spark.createDataFrame([(c, p, k) for c, ps in parents.items() for k, p in enumerate(ps)], "child string, parent string, ord int")
    starts = [("one", f"{399:064x}"), ("one", "gone"), ("two", "B" * 64), ("two", f"{60:064x}"), ("low", "b" * 64)]
    got = [tuple(r) for r in closure.reachable(edges, spark.createDataFrame(starts, "root string, node string"), sent_edges=0).collect()]
    want = {(root, x) for root, node in starts for x in reach(parents, node)}
    assert set(got) == want and len(got) == len(want)
    assert max(n for _, n in written) < 2000


def test_one_cut_by_tasks_leaves_chains_whole_wherever_rows_lie(spark, monkeypatch):
    """Rows in small blocks, dealt at random, and a commit with rows in two blocks: segments meet again, and each commit has one place."""
    monkeypatch.setattr(closure, "BLOCK_ROWS", 16)
    rng = random.Random(9)
    rows = [(f"{i + 1:064x}", f"{i:064x}", 0) for i in range(200)] + [(f"{i + 100:064x}", f"{i:064x}", 1) for i in range(0, 100, 9)] + [(f"{0:064x}", None, None), ("alone", None, None)]
    rng.shuffle(rows)
    chains = closure.Chains(spark.createDataFrame(rows, "child string, parent string, ord int").repartition(3))
    got = [(r.chain, r.at) for r in chains.points.collect()]
    assert len(got) == len(set(got)) == 202 and len({c for c, _ in got}) == 2
    edges = spark.createDataFrame(rows, "child string, parent string, ord int").repartition(3)
    starts = spark.createDataFrame([("r", f"{150:064x}"), ("s", "alone")], "root string, node string")
    got = [tuple(r) for r in closure.reachable(edges, starts, sent_edges=0).collect()]
    assert sorted(got) == sorted([("r", f"{i:064x}") for i in range(151)] + [("s", "alone")])


def test_large_joins_of_hashes_go_in_slices(spark, written, monkeypatch):
    """Two large sides meet slice by slice, with the rows of a plain join; names of other forms, null and repeated rows too."""
    from treeledger.plans import joins

    monkeypatch.setattr(joins, "SENT_ROWS", 20)
    monkeypatch.setattr(joins, "SLICE_ROWS", 100)
    names = [f"{i:064x}" for i in range(250)] + ["A" * 64, "a" * 64, "", "a", None, "a"]
    left = spark.createDataFrame([(i % 7, h) for i, h in enumerate(names)], "n int, hash string")
    right = spark.createDataFrame([(h,) for h in names[50:251] + ["a", "a"]], "hash string")
    for how in ("left_semi", "left_anti"):
        want = sorted(map(str, left.join(right, "hash", how).select("n", "hash").collect()))
        assert sorted(map(str, joins.matched(left, right, how).select("n", "hash").collect())) == want
    assert len(written) == 6 and max(n for _, n in written) < 150


def _history(spark, n: int = 400):
    """Commits with a tree each, some of them missing; (commits, parents by hash)."""
    rng = random.Random(11)
    parents = {f"{i:064x}": [f"{j:064x}" for j in rng.sample(range(max(0, i - 30), i), min(i, 2))] if i % 50 else [] for i in range(n)}
    rows = [(h, f"tree {h[-1]}", ps) for h, ps in parents.items() if int(h, 16) % 37 != 5]
    return spark.createDataFrame(rows, "hash string, tree string, parents array<string>"), {h: ps for h, _, ps in rows}


@pytest.mark.parametrize("keys", [1_000_000, 3])
def test_marking_a_large_history_writes_no_name_of_a_commit(spark, monkeypatch, keys):
    """What is reached, what isn't and what is missing, by brute force; only ids and the few names of what has no row are written."""
    from treeledger.plans import joins

    monkeypatch.setattr(closure, "KEY_ROWS", keys)
    monkeypatch.setattr(joins, "SLICE_ROWS", 100)
    columns, table = {}, scratch.Scratch.table

    def kept(self, df, name, *more):
        columns[name] = {f.dataType.simpleString() for f in df.schema}
        return table(self, df, name, *more)

    monkeypatch.setattr(scratch.Scratch, "table", kept)
    commits, parents = _history(spark)
    for heads in ([399, 398, 120, 42], [60, 5000], []):
        columns.clear()
        names = [f"{i:064x}" for i in heads]
        want = set().union(*(reach(parents, h) for h in names))
        reached = closure.Reach(closure.edges_of(commits), spark.createDataFrame([(h,) for h in names], "hash string"), sent_edges=0)
        assert all(columns[x] <= {"tinyint", "bigint", "boolean"} for x in ("parts", "more", "side")), columns
        assert sorted(r.hash for r in reached.inside(commits).collect()) == sorted(want & set(parents))
        assert sorted(r.hash for r in reached.outside(commits).collect()) == sorted(set(parents) - want)
        assert sorted(r.hash for r in reached.missing.collect()) == sorted(want - set(parents))
        assert sorted(r.hash for r in reached.hashes(commits).collect()) == sorted(want)
    assert want == set() and len(parents) < 400


def test_shuffle_files_go_when_their_table_is_written(spark):
    import time

    from treeledger.plans.scratch import Scratch

    def shuffles():
        names = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {n for n in names.split("\n") if "/shuffle_" in n}

    scratch = Scratch(spark)
    before = shuffles()
    table = scratch.table(spark.range(1000).repartition("id"), "dealt")
    made = shuffles() - before
    assert made
    scratch.release()
    time.sleep(1)  # the files are removed by a thread of the driver
    assert not made & shuffles()
    assert table.count() == 1000
