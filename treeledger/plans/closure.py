"""What can be reached in a graph of commits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from treeledger.plans.joins import KEY_ROWS, SENT_ROWS, SLICE_ROWS, matched, sent, sliced
from treeledger.plans.scratch import Scratch
from treeledger.plans.workers import prepare

#: A graph of at most so many edges is sent to the executors, which walk it from their own roots: two hashes of 64 letters an edge, 26 MB.
SENT_EDGES = 200_000


def edges_of(commits: DataFrame) -> DataFrame:
    """(child, parent, ord) for each parent of each commit; a commit without parents has one row, without a parent."""
    return commits.select(F.col("hash").alias("child"), F.posexplode_outer("parents").alias("ord", "parent"))


class Graph:
    """A small graph in flat arrays: the parents of node i are parents[first[i]:first[i + 1]]."""

    def __init__(self, child: pa.Array, parent: pa.Array):
        both = pa.concat_arrays([child, parent]).dictionary_encode()
        self.names = both.dictionary
        ids = both.indices.to_numpy()
        child_ids, parent_ids = ids[: len(child)], ids[len(child) :]
        order = np.argsort(child_ids, kind="stable")
        self.parents = parent_ids[order]
        self.first = np.searchsorted(child_ids[order], np.arange(len(self.names) + 1))
        self._at: dict[str, int] | None = None

    def id(self, name: str) -> int:
        """The node of a hash, -1 if it has no edge."""
        if self._at is None:
            self._at = {n: i for i, n in enumerate(self.names.to_pylist())}
        return self._at.get(name, -1)

    def reach(self, starts: list[int]) -> np.ndarray:
        """Whether each node can be reached; a level at a time."""
        seen = np.zeros(len(self.names), bool)
        front = np.unique(np.array(starts, np.int64))
        while len(front):
            seen[front] = True
            count = self.first[front + 1] - self.first[front]
            at = np.repeat(self.first[front] - np.cumsum(count) + count, count) + np.arange(count.sum())
            front = np.unique(self.parents[at])
            front = front[~seen[front]]
        return seen


def _small(edges: DataFrame, limit: int) -> Graph | None:
    """The graph if it has few edges; they are counted before any is fetched."""
    edges = edges.where("child is not null and parent is not null")
    if edges.count() > limit:
        return None
    prepare(edges.sparkSession)
    got = edges.select("child", "parent").distinct().toArrow()
    return Graph(*(pa.concat_arrays([pa.array([], pa.string()), *(x.cast(pa.string()) for x in got[c].chunks)]) for c in ("child", "parent")))


def reachable(edges: DataFrame, starts: DataFrame, sent_edges: int = SENT_EDGES) -> DataFrame:
    """(root, node): every node reachable from the nodes of starts (root, node), themselves included.

    A graph of few edges, counted first, is sent to the executors; each walks it for its roots. A larger one is cut into chains.
    """
    roots = starts.select("root", "node").distinct()
    graph = _small(edges, sent_edges)
    if graph is None:
        return Chains(edges).reachable(roots)
    return _sent_walk(edges.sparkSession, graph, roots)


def _sent_walk(spark: SparkSession, graph: Graph, roots: DataFrame) -> DataFrame:
    shared = spark.sparkContext.broadcast(graph)
    kind = roots.schema["root"].dataType

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, root, ids = shared.value, None, []
        names = ["root", "node"]
        for batch in batches:
            alone: list[int] = []
            for i, (r, node) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if ids and r != root:
                    yield found(g, root, ids, batch.schema)
                    ids = []
                root, at = r, g.id(node)
                if at < 0:
                    alone.append(i)
                else:
                    ids.append(at)
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(alone, pa.int64())) for k in (0, 1)], names=names)
            schema = batch.schema
        if ids:
            yield found(g, root, ids, schema)

    def found(g: Graph, root, ids: list[int], schema: pa.Schema) -> pa.RecordBatch:
        at = np.flatnonzero(g.reach(ids))
        return pa.RecordBatch.from_arrays([pa.array([root] * len(at), schema.field(0).type), g.names.take(pa.array(at)).cast(schema.field(1).type)], names=["root", "node"])

    return roots.repartition("root").sortWithinPartitions("root").mapInArrow(walk, f"root {kind.simpleString()}, node string")


def tested(edges: DataFrame, pairs: DataFrame, sent_edges: int = SENT_EDGES) -> DataFrame:
    """pairs (old, new) with ok: whether old can be reached from new. No more than the pairs is ever made of a graph that can be sent.

    Pairs are dealt by range, so one ``new`` with very many ``old`` is cut over tasks.
    """
    asked = pairs.select("old", "new").distinct()
    small = _small(edges, sent_edges)
    if small is None:
        return Chains(edges).tested(asked)
    shared = edges.sparkSession.sparkContext.broadcast(small)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, last, seen = shared.value, None, None
        for batch in batches:
            ok = []
            for old, new in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if new != last or seen is None:
                    last, at = new, g.id(new)
                    seen = g.reach([at] if at >= 0 else [])
                ok.append(old == new or (at := g.id(old)) >= 0 and bool(seen[at]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], names=["old", "new", "ok"])

    return asked.repartitionByRange("new", "old").sortWithinPartitions("new", "old").mapInArrow(walk, "old string, new string, ok boolean")


#: Columns of the tables of segments: a point (KIND 0), an edge within a block (1), an edge whose parent has no row in the block (2), two names of one id (3).
_CUT = "kind byte, id long, second long, chain long, at long, to long, least long, tail boolean"
#: Rows of edges that a task cuts at once.
BLOCK_ROWS = 1 << 18


def _parts(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """The segments of one block of edges (c, p, first, cs, ps): paths of first parents among the commits that have rows in it, named by the id of their top."""
    c, cs, none = rows["c"].to_numpy(), rows["cs"].to_numpy(), rows["p"].is_null().to_numpy()
    p, ps, first = (rows[x].fill_null(none_).to_numpy() for x, none_ in (("p", 0), ("ps", 0), ("first", False)))
    ids, index, of = np.unique(c, return_index=True, return_inverse=True)
    n, seconds = len(ids), cs[index]
    there = np.minimum(np.searchsorted(ids, p), n - 1)
    local = ~none & (ids[there] == p)
    if (cs != seconds[of]).any() or (ps != seconds[there])[local].any():
        yield from _out(3, 1)
        return
    # Each commit with one first parent, each parent with one commit.
    at = np.flatnonzero(local & first & (p != c))
    at = at[np.lexsort((there[at], of[at]))]
    at = at[np.unique(of[at], return_index=True)[1]]
    at = at[np.lexsort((of[at], there[at]))]
    at = at[np.unique(there[at], return_index=True)[1]]
    below = np.full(n, -1)
    below[of[at]] = there[at]
    while True:
        low, far = np.where(below >= 0, below, np.arange(n)), (below >= 0).astype(np.int64)
        steps = 1
        while steps <= n and (below[low] >= 0).any():
            far, low, steps = far + far[low], low[low], 2 * steps
        circle = below[low] >= 0
        if not circle.any():
            break
        below[circle] = -1
    top = np.ones(n, bool)
    top[below[below >= 0]] = False
    chain = np.empty(n, np.int64)
    chain[low[top]] = ids[top]
    chain = chain[low]
    # In the order of chains: all but the hashes is packed to next to nothing.
    order = np.lexsort((far, chain))
    yield from _out(0, n, id=ids[order], second=seconds[order], chain=chain[order], at=far[order])
    i, j = of, there
    inner = np.flatnonzero(local & ~((below[i] == j) | ((chain[i] == chain[j]) & (far[j] <= far[i]))))
    yield from _out(1, len(inner), chain=chain[i[inner]], at=far[i[inner]], to=chain[j[inner]], least=far[j[inner]])
    outer = np.flatnonzero(~none & ~local)
    yield from _out(2, len(outer), id=p[outer], second=ps[outer], chain=chain[i[outer]], at=far[i[outer]], tail=first[outer] & (far[i[outer]] == 0))


def _out(kind: int, n: int, **columns) -> Iterator[pa.RecordBatch]:
    types = {"kind": pa.int8()} | {k: pa.int64() for k in ("id", "second", "chain", "at", "to", "least")} | {"tail": pa.bool_()}
    columns["kind"] = np.full(n, kind, np.int8)
    arrays = [pa.nulls(n, t) if (x := columns.get(k)) is None else pa.array(x, t) for k, t in types.items()]
    whole = pa.RecordBatch.from_arrays(arrays, names=list(types))
    for k in range(0, n, 1 << 14):
        yield whole.slice(k, 1 << 14)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of edges, each cut by itself; the rows of a commit that follow one another are not parted."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= BLOCK_ROWS:
            rows = pa.Table.from_batches(held)
            c = rows["c"].to_numpy()
            other = np.flatnonzero(c != c[-1])
            if len(other):
                yield from _parts(rows.slice(0, other[-1] + 1))
                held = rows.slice(other[-1] + 1).combine_chunks().to_batches()
    if sum(map(len, held)):
        yield from _parts(pa.Table.from_batches(held))


class Chains:
    """A large graph cut into chains, each commit with its first parent as far as that is no one else's.

    What a root reaches of a chain is one position and all below it, so a root's reach is a row for each chain it meets instead of one for
    each commit. First each task cuts the edges it has into segments, without a shuffle: a history is mostly stored with commits near their
    parents. Then segments whose bottom has the top of another as first parent are joined by doubling, which moves a row for each segment.
    Names are not stored: a commit is told by two 64-bit hashes of its name, and edges are read again for the names of what is asked for.
    Tables: ``points`` (id, second, chain, at), ``lost`` (id, node) of parents without rows, and ``cross`` (chain, since, until, to, least): from positions since to until (exclusive; null:
    the end) of a chain one gets to position ``least`` of the chain ``to`` and no higher.
    """

    def __init__(self, edges: DataFrame):
        self.scratch = Scratch(prepare(edges.sparkSession))
        first = F.col("ord") == 0 if "ord" in edges.columns else F.lit(True)
        self.known = edges.where("child is not null").select("child", "parent", first.alias("first"))
        self.salt = 0
        while not self._cut(self.known):
            self.scratch.clear()
            self.salt += 1
        self._joined()
        self._crossed()

    def _kept(self, df: DataFrame, name: str, compression: str = "none") -> DataFrame:
        out = self.scratch.table(df, name, compression)
        del df
        self.scratch.release()
        return out

    def id(self, c: str) -> Column:
        return F.xxhash64(F.lit(self.salt), F.col(c))

    def _twice(self, points: DataFrame) -> bool:
        """Whether two points have one id; a part of the ids at a time."""
        slices = -(-self.stored // SLICE_ROWS)
        for k in range(slices):
            if not points.where(F.pmod("id", F.lit(slices)) == k).groupBy("id").count().where("count > 1").isEmpty():
                return True
            self.scratch.release()
        return False

    def _cut(self, known: DataFrame) -> bool:
        """Segments. False if a commit has rows in two blocks, or two names have one id: rows of a commit then have to meet, and ids are others."""
        if self.salt:
            known = known.repartition("child").sortWithinPartitions("child")
        second = lambda c: F.xxhash64(F.lit(-1), F.col(c))
        had = F.col("parent").isNotNull()
        rows = known.select(self.id("child").alias("c"), F.when(had, self.id("parent")).alias("p"), "first", second("child").alias("cs"), F.when(had, second("parent")).alias("ps"))
        self.parts = self._kept(rows.mapInArrow(_segments, _CUT), "parts", "zstd")
        points = self.parts.where("kind = 0").select("id", "second", "chain", "at")
        self.stored = points.count()
        if not self.parts.where("kind = 3").isEmpty() or self._twice(points):
            return False
        # Parents without a row in their block: other blocks have them, or no one.
        asked = self._kept(self.parts.where("kind = 2").select("id", "second").distinct(), "asked")
        hits = points.select("id", F.col("second").alias("own"), F.col("chain").alias("to"), F.col("at").alias("least")).join(sent(asked), "id")
        hits = self._kept(hits, "hits")
        if not hits.where("own <> second").isEmpty() or not asked.groupBy("id").count().where("count > 1").isEmpty():
            return False
        more = self._kept(asked.join(hits.select("id"), "id", "left_anti").select("id", "second", F.col("id").alias("chain"), F.lit(0).cast("long").alias("at")), "more")
        self.lost = self.known.where(had).select(self.id("parent").alias("id"), F.col("parent").alias("node"))
        self.lost = self._kept((self.lost.limit(0) if more.isEmpty() else self.lost.join(sent(more.select("id")), "id", "left_semi")).dropDuplicates(["id"]), "lost")
        ends = hits.select("id", "to", "least").unionByName(more.select("id", F.col("id").alias("to"), F.lit(0).cast("long").alias("least")))
        self.opened = self._kept(self.parts.where("kind = 2").select("id", "chain", F.col("at").alias("since"), "tail").join(sent(ends), "id"), "opened")
        self.points = points.unionByName(more)
        self.scratch.drop("asked", "hits")
        return True

    def _joined(self) -> None:
        """Segments put on one another, by doubling: a link for each, whose number doesn't grow. Links in a circle have no end and are let go."""
        one = self.opened.where("tail and id = to and to <> chain").groupBy("chain").agg(F.min(F.struct("to", "least")).alias("e"))
        one = one.groupBy(F.col("e.to").alias("y")).agg(F.min(F.struct("chain", "e.least")).alias("e"))
        links = self._kept(one.select(F.col("e.chain").alias("x"), "y", (F.col("e.least") + 1).alias("n"), F.lit(False).alias("done")), "links-0")
        most, k = links.count(), 0
        while 1 << k <= 2 * most and not links.where("not done").isEmpty():
            far = links.select(F.col("x").alias("y"), F.col("y").alias("z"), F.col("n").alias("more"), F.col("done").alias("ended"))
            moved = links.where("not done").join(far, "y", "left").select("x", F.coalesce("z", "y").alias("y"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), F.coalesce("ended", F.lit(True)).alias("done"))
            k += 1
            links = self._kept(links.where("done").unionByName(moved), f"links-{k}")
            self.scratch.drop(f"links-{k - 1}")
        self.moves = links.where("done").select(F.col("x").alias("chain"), F.col("y").alias("onto"), F.col("n").alias("up"))
        if most:
            few = sent(self.moves)
            self.points = self._moved(self.points, few)
            if few is self.moves:
                self.points = self._kept(self.points, "points", "zstd")
                self.scratch.drop("more")

    def _moved(self, df: DataFrame, moves: DataFrame, chain: str = "chain", at: str = "at") -> DataFrame:
        """df with positions in segments as positions in chains."""
        out = df.join(moves.withColumnRenamed("chain", chain), chain, "left")
        return out.withColumns({chain: F.coalesce("onto", chain), at: F.col(at) + F.coalesce("up", F.lit(0))}).drop("onto", "up")

    def _crossed(self) -> None:
        rows = self.parts.where("kind = 1").select("chain", F.col("at").alias("since"), "to", "least").unionByName(self.opened.select("chain", "since", "to", "least"))
        few = sent(self.moves)
        rows = self._moved(self._moved(rows, few, "chain", "since"), few, "to", "least").where("to <> chain or least > since")
        rows = rows.groupBy("chain", "to", "since").agg(F.max("least").alias("least"))
        order = W.partitionBy("chain", "to").orderBy("since")
        rows = rows.withColumn("before", F.max("least").over(order.rowsBetween(W.unboundedPreceding, -1))).where("before is null or least > before")
        self.cross = self._kept(rows.select("chain", "since", F.lead("since").over(order).alias("until"), "to", "least"), "cross")
        self.scratch.drop("opened")
        if "points" in self.scratch.names:
            self.scratch.drop("parts")

    def _located(self, names: DataFrame) -> DataFrame:
        """names (node) that the graph has, with id, chain and at."""
        asked = self._kept(names.select("node", self.id("node").alias("id"), F.xxhash64(F.lit(-1), F.col("node")).alias("second")), "names")
        return self.points.join(sent(asked), ["id", "second"]).select("node", "id", "chain", "at")

    def _walked(self, starts: DataFrame) -> DataFrame:
        """(root, chain, at): the highest position of each chain that each root of starts (root, chain, at) leads to. A round for each crossing of chains."""
        k, names, total = 0, ["front-0"], 0
        front = self._kept(starts.groupBy("root", "chain").agg(F.max("at").alias("at")), "front-0")
        while n := front.count():
            total += n
            seen = self.scratch.read(front.schema, *names)
            seen = F.broadcast(seen) if total <= SENT_ROWS else seen.groupBy("root", "chain").agg(F.max("at").alias("at"))
            near = self.cross.join(F.broadcast(front) if n <= SENT_ROWS else front, "chain").where("at >= since and (until is null or at < until)")
            near = near.groupBy("root", F.col("to").alias("chain")).agg(F.max("least").alias("at"))
            a, b = near.alias("a"), seen.alias("b")
            new = a.join(b, F.expr("a.root = b.root and a.chain = b.chain and a.at <= b.at"), "left_anti")
            k += 1
            front = self.scratch.table(new, f"front-{k}")
            names.append(f"front-{k}")
            if k % 8 == 0 or total > SENT_ROWS:  # a round of few rows leaves little
                self.scratch.release()
        best = self._kept(self.scratch.read(front.schema, *names).groupBy("root", "chain").agg(F.max("at").alias("at")), "best")
        self.scratch.drop(*names)
        return best

    def reachable(self, roots: DataFrame) -> DataFrame:
        roots = self._kept(roots, "roots")
        here = self._kept(self._heads(roots), "here")
        best = self._walked(here.select("root", "chain", "at")).withColumnRenamed("at", "top")
        found = self.points.join(sent(best), "chain").where("at <= top").select("root", "id")
        names = self.known.select(self.id("child").alias("id"), F.col("child").alias("node"))
        few = (best.agg(F.sum(F.col("top") + 1)).first()[0] or 0) + roots.count() <= SENT_ROWS
        # Few nodes are sent to the edges, of which those that name them are left.
        names = (names.join(F.broadcast(found.select("id").distinct()), "id", "left_semi") if few else names).groupBy("id").agg(F.first("node").alias("node"))
        found = found.join(names.unionByName(self.lost), "id").select("root", "node")
        found = found.unionByName(roots.join(here.select("node").distinct(), "node", "left_anti").select("root", "node"))
        self.scratch.drop("cross", "names")
        if few:
            found = self._kept(found, "reach")
            self.scratch.clear("reach")
        return found  # a large reach isn't written: its points are

    def _heads(self, roots: DataFrame) -> DataFrame:
        return roots.join(self._located(roots.select("node").distinct()), "node")

    def parted(self, heads: DataFrame) -> tuple[DataFrame, bool, DataFrame]:
        """(id) of the nodes that heads (node) lead to, or of the others if these are fewer; whether it is the first; (node) reached that have no row."""
        heads = self._kept(heads.select(F.lit(0).alias("root"), "node").distinct(), "heads")
        here = self._kept(self._heads(heads), "here")
        best = self._walked(here.select("root", "chain", "at")).select("chain", F.col("at").alias("top"))
        n = best.agg(F.sum(F.col("top") + 1)).first()[0] or 0
        inside = 2 * n <= self.points.count()
        side = self.points.join(sent(best), "chain", "inner" if inside else "left").where("at <= top" if inside else "top is null or at > top")
        side = self._kept(side.select("id"), "side")
        gone = self.lost.join(sent(side), "id", "left_semi" if inside else "left_anti").select("node")
        gone = self._kept(gone.unionByName(heads.select("node").join(here.select("node"), "node", "left_anti")), "gone")
        self.scratch.clear("side", "gone")
        return side, inside, gone

    def tested(self, asked: DataFrame) -> DataFrame:
        asked = self._kept(asked, "asked")
        here = self._kept(self._located(asked.select(F.explode(F.array("old", "new")).alias("node")).distinct()), "here")
        self.scratch.drop("parts", "more", "points", "names", "lost")
        new = here.select(F.col("node").alias("new"), F.col("id").alias("root"), F.col("chain").alias("own"), F.col("at").alias("top"))
        old = here.select(F.col("node").alias("old"), "chain", F.col("at").alias("low"))
        pairs = self._kept(asked.join(new, "new").join(old, "old"), "located")
        best = self._walked(pairs.select("root", F.col("own").alias("chain"), F.col("top").alias("at")))
        hit = pairs.join(best, ["root", "chain"]).where("at >= low").select("old", "new", F.lit(True).alias("hit"))
        ok = F.coalesce("hit", F.col("old") == F.col("new"), F.lit(False))
        out = self._kept(asked.join(hit, ["old", "new"], "left").select("old", "new", ok.alias("ok")), "tested")
        self.scratch.clear("tested")
        return out


class Reach:
    """Which of the commits that edges hold as children can be reached from heads (hash), and what else can.

    Of a large graph only one table of ids stays, of what is reached or of what isn't, whichever has fewer: commits are told by it where they lie.
    """

    def __init__(self, edges: DataFrame, heads: DataFrame, sent_edges: int = SENT_EDGES):
        starts = heads.select(F.lit(0).alias("root"), F.col("hash").alias("node")).distinct()
        self.edges, self.found = edges, None
        graph = _small(edges, sent_edges)
        if graph is None:
            chains = Chains(edges)
            side, self.within, self.missing = chains.parted(starts)
            self.id, self.stored = chains.id, chains.stored
            self.few = side.count() <= KEY_ROWS
            self.side = side.select(F.col("id").alias("_id"))
            self.missing = self.missing.select(F.col("node").alias("hash"))
        else:
            self.found = _sent_walk(edges.sparkSession, graph, starts).select(F.col("node").alias("hash"))
            self.missing = matched(self.found, edges.where("child is not null").select(F.col("child").alias("hash")), "left_anti")

    def inside(self, commits: DataFrame, then: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
        """Rows of stored commits that are reached, as ``then`` leaves them; that must work on any part of the rows."""
        return self._side(commits, True, then)

    def outside(self, commits: DataFrame) -> DataFrame:
        """Rows of stored commits that are not reached."""
        return self._side(commits, False)

    def _side(self, commits: DataFrame, reached: bool, then: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
        if self.found is not None:
            return matched(commits, self.found, "left_semi" if reached else "left_anti", lambda df: then(df.select(commits.columns)))
        how = "left_semi" if reached == self.within else "left_anti"
        rows = commits.withColumn("_id", self.id("hash"))
        if self.few:
            return then(rows.join(F.broadcast(self.side), "_id", how).select(commits.columns))
        return sliced(rows, self.side, "_id", self.stored, how, lambda df: then(df.select(commits.columns)))

    def hashes(self, commits: DataFrame) -> DataFrame:
        """(hash) of all that is reached, each once; commits are those that edges were made of."""
        if self.found is not None:
            return self.found
        own = commits.where("hash is not null").select("hash")
        rows = self.inside(own)
        return (rows if own.count() == self.stored else rows.distinct()).unionByName(self.missing)
