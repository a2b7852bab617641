"""Approximate nearest neighbours: a navigable small-world graph for each shard, shard results merged.

Equal vectors are one point of the graph that carries its smallest ids, as many as an answer can need; so a vector that a third of the
rows share is one point. Points are dealt to shards by a hash; a shard's graph is built in one task of bounded size, layer by layer, and
stored as flat arrays: vectors, neighbours of the lowest layer (a fixed number of places for each point), and the upper layers as
(point, neighbour) runs. The distinct query vectors form blocks, and the blocks go to the shards: a task loads a shard once and searches a run of blocks in it. Every
query meets every shard, so the work is queries times shards; the answers of the shards are merged. Scores are computed anew in double precision on the vectors as given.

Cases: null, empty or zero vectors, or those with a null or non-finite component, are neither candidates nor queries; vectors of
different lengths aren't compared; rows with a null id are skipped; an id that comes again with other vectors is asked for with the first of them in the order of their bytes,
and is an answer once, with its best score; ties go to the smaller id; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeledger.llm.common import Scratch, prepare

K = 5
SHARD_POINTS = 4_096
LINKS = 12
BUILD_WIDTH = 48
SEARCH_WIDTH = 100
QUERY_BLOCK = 256
#: Blocks of queries that one copy of a shard serves.
BLOCKS_PER_COPY = 32
#: Distinct vectors that a task holds before it passes them on.
HELD_POINTS = 20_000


class Graph:
    """A hierarchical navigable small world over unit vectors; nearer means a larger product."""

    def __init__(self, points: np.ndarray, links: int = LINKS, width: int = BUILD_WIDTH):
        self.points, self.links = points, links
        n = len(points)
        # A point's level follows from its own bytes, so the same points give the same graph wherever it is built.
        draw = (points.view(np.uint32).astype(np.uint64) * np.arange(1, 2 * points.shape[1], 2, dtype=np.uint64)).sum(1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        self.level = np.minimum(16, -np.log((((draw >> np.uint64(11)).astype(np.float64)) + 1) / (1 << 53)) / np.log(links)).astype(np.int64)
        top = int(self.level.max(initial=0))
        self.layers = [np.full((n, 2 * links), -1, np.int32)]
        self.upper: list[dict[int, np.ndarray]] = [{} for _ in range(top)]
        self.fill = np.zeros(n, np.int32)
        self.entry, self.height = -1, -1
        self.seen, self.mark = np.zeros(n, np.int64), 0
        for i in range(n):
            self._insert(i, width)

    def _near(self, i: int, layer: int) -> np.ndarray:
        return self.layers[0][i, : self.fill[i]] if layer == 0 else self.upper[layer - 1].get(i, self.layers[0][i, :0])

    def _put(self, i: int, layer: int, near: np.ndarray) -> None:
        if layer == 0:
            self.layers[0][i, : len(near)] = near
            self.fill[i] = len(near)
        else:
            self.upper[layer - 1][i] = near.astype(np.int32)

    def _walk(self, q: np.ndarray, start: list[int], layer: int, width: int) -> list[tuple[float, int]]:
        """The best ``width`` points found from start, as (product, point), best first."""
        self.mark += 1
        seen, mark, points = self.seen, self.mark, self.points
        seen[start] = mark
        best = [(float(s), p) for s, p in zip(points[start] @ q, start, strict=True)]
        todo = [(-s, p) for s, p in best]
        heapq.heapify(best)
        heapq.heapify(todo)
        while todo:
            s, p = heapq.heappop(todo)
            if len(best) >= width and -s < best[0][0]:
                break
            near = self._near(p, layer)
            near = near[seen[near] != mark]
            if not len(near):
                continue
            seen[near] = mark
            for t, x in zip((points[near] @ q).tolist(), near.tolist(), strict=True):
                if len(best) < width:
                    heapq.heappush(best, (t, x))
                    heapq.heappush(todo, (-t, x))
                elif t > best[0][0]:
                    heapq.heapreplace(best, (t, x))
                    heapq.heappush(todo, (-t, x))
        return sorted(best, reverse=True)

    def _choose(self, found: list[tuple[float, int]], most: int) -> np.ndarray:
        """Neighbours that are nearer to the point than to each other; the next best fill free places."""
        ids = np.array([p for _, p in found], np.int64)
        if len(ids) <= most:
            return ids
        own = np.array([s for s, _ in found])
        between = self.points[ids] @ self.points[ids].T
        kept: list[int] = []
        rest: list[int] = []
        for k in range(len(ids)):
            if len(kept) < most and (not kept or own[k] >= between[k, kept].max()):
                kept.append(k)
            else:
                rest.append(k)
        return ids[kept + rest[: most - len(kept)]]

    def _insert(self, i: int, width: int) -> None:
        level = int(self.level[i])
        if self.entry < 0:
            self.entry, self.height = i, level
            return
        q, start = self.points[i], [self.entry]
        for layer in range(self.height, level, -1):
            start = [self._walk(q, start, layer, 1)[0][1]]
        for layer in range(min(level, self.height), -1, -1):
            found = self._walk(q, start, layer, width)
            near = self._choose(found, self.links)
            self._put(i, layer, near)
            most = 2 * self.links if layer == 0 else self.links
            for p in near.tolist():
                have = np.append(self._near(p, layer), np.int32(i))
                if len(have) > most:
                    products = self.points[have] @ self.points[p]
                    order = np.argsort(-products, kind="stable")
                    have = self._choose(list(zip(products[order].tolist(), have[order].tolist(), strict=True)), most)
                self._put(p, layer, have)
            start = [p for _, p in found]
        if level > self.height:
            self.entry, self.height = i, level

    def flat(self) -> dict[str, bytes | int]:
        """The graph as flat arrays."""
        runs = [(layer + 1, p, x) for layer, near in enumerate(self.upper) for p, xs in near.items() for x in xs.tolist()]
        return {"low": self.layers[0].tobytes(), "fill": self.fill.tobytes(), "runs": np.array(runs, np.int32).reshape(-1, 3).tobytes(), "entry": self.entry, "height": self.height}

    @classmethod
    def load(cls, points: np.ndarray, row: dict, links: int = LINKS) -> Graph:
        """The graph that flat() wrote."""
        g = cls.__new__(cls)
        g.points, g.links, g.entry, g.height = points, links, row["entry"], row["height"]
        g.layers = [np.frombuffer(row["low"], np.int32).reshape(len(points), -1)]
        g.fill = np.frombuffer(row["fill"], np.int32)
        runs = np.frombuffer(row["runs"], np.int32).reshape(-1, 3)
        g.upper = [{} for _ in range(row["height"])]
        if len(runs):
            cuts = np.flatnonzero(np.any(np.diff(runs[:, :2], axis=0, prepend=-1) != 0, axis=1)).tolist() + [len(runs)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                g.upper[int(runs[a, 0]) - 1][int(runs[a, 1])] = runs[a:b, 2]
        g.seen, g.mark = np.zeros(len(points), np.int64), 0
        return g

    def search(self, q: np.ndarray, width: int) -> list[int]:
        """Points near q, best first."""
        start = [self.entry]
        for layer in range(self.height, 0, -1):
            start = [self._walk(q, start, layer, 1)[0][1]]
        return [p for _, p in self._walk(q, start, 0, width)]


def smallest(ids: list[int], most: int) -> list[int]:
    """The smallest distinct ids."""
    return sorted(set(ids))[:most]


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, for the walk only."""
    v = v.astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return np.ascontiguousarray((v / np.sqrt((v * v).sum(1, keepdims=True))).astype(np.float32))


def cosines(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosine of each row with q in double precision."""
    rows, q = rows.astype(np.float64), q.astype(np.float64)
    return (rows * q).sum(1) / (np.sqrt((rows * rows).sum(1)) * np.sqrt((q * q).sum()))


def nearest(vectors: DataFrame, k: int = K, every: int = 50, shard_points: int = SHARD_POINTS, links: int = LINKS, build: int = BUILD_WIDTH, width: int = SEARCH_WIDTH) -> DataFrame:
    """For each row whose vec_id is divisible by ``every``: query_id, rank, vec_id, score of its k nearest others."""
    spark = prepare(vectors.sparkSession)
    scratch = Scratch(spark)
    keep = k + 1
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(
        "vec_id is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(v, x -> x <> 0)"
    )

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct vectors that the task holds at once with their smallest ids, and whether one is a query's."""
        held: dict[bytes, list] = {}

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"vec": pa.array(list(held), pa.binary()), "ids": pa.array([x[0] for x in held.values()], pa.list_(pa.int64())), "asked": pa.array([x[1] for x in held.values()], pa.bool_())})

        for batch in batches:
            lists = batch.column(1)
            flat, offsets = np.asarray(lists.values), np.asarray(lists.offsets)
            for i, vec_id in enumerate(batch.column(0).to_pylist()):
                got = held.setdefault((flat[offsets[i] : offsets[i + 1]] + 0.0).tobytes(), [[], False])
                got[0], got[1] = smallest([*got[0], vec_id], keep), got[1] or vec_id % every == 0
            if len(held) >= HELD_POINTS:
                yield told()
                held = {}
        yield told()

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by vector to one for each, holding one vector's ids at a time."""
        now, ids, asked = None, [], False
        for batch in batches:
            out: list[tuple] = []
            for vec, more, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if vec != now:
                    if now is not None:
                        out.append((now, ids, asked))
                    now, ids, asked = vec, [], False
                ids, asked = smallest([*ids, *more], keep), asked or wanted
            yield rows_of(out)
        if now is not None:
            yield rows_of([(now, ids, asked)])

    def rows_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in out], t) for i, (n, t) in enumerate((("vec", pa.binary()), ("ids", pa.list_(pa.int64())), ("asked", pa.bool_())))})

    kind = "vec binary, ids array<long>, asked boolean"
    merged = given.mapInArrow(points, kind).repartition("vec").sortWithinPartitions("vec").mapInArrow(together, kind)
    merged = scratch.table(merged, "points")
    total = merged.count()
    n_shards = max(1, -(-total // shard_points))
    dealt = merged.withColumn("shard", F.pmod(F.xxhash64("vec"), F.lit(n_shards)).cast("int")).withColumn("dim", F.length("vec"))

    def graph(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("vec", "ascending")])
        raw = np.stack([np.frombuffer(v, np.float64) for v in table["vec"].to_pylist()])
        row = Graph(unit(raw), links, build).flat()
        row |= {"shard": key[0].as_py(), "dim": key[1].as_py(), "raw": raw.tobytes(), "ids": table["ids"].to_pylist()}
        return pa.Table.from_pylist([row], schema=pa.schema([("shard", pa.int32()), ("dim", pa.int32()), ("entry", pa.int32()), ("height", pa.int32()), ("low", pa.binary()), ("fill", pa.binary()), ("runs", pa.binary()), ("raw", pa.binary()), ("ids", pa.list_(pa.list_(pa.int64())))]))

    index_schema = "shard int, dim int, entry int, height int, low binary, fill binary, runs binary, raw binary, ids array<array<long>>"
    index = scratch.table(dealt.groupBy("shard", "dim").applyInArrow(graph, index_schema), "index")
    asked = merged.where("asked").select("vec", F.length("vec").alias("dim"))
    count = asked.count()
    blocks = asked.withColumn("block", F.pmod(F.xxhash64("vec", F.lit(7)), F.lit(max(1, -(-count // QUERY_BLOCK)))))
    blocks = scratch.table(blocks.groupBy("dim", "block").agg(F.collect_list("vec").alias("queries")).withColumn("copy", F.expr(f"block div {BLOCKS_PER_COPY}")), "blocks")
    # A stated query set against all shards, in blocks: a run of blocks comes to a copy of each shard of its dimension.
    shards = index.select("shard", "dim")
    sent = blocks.join(shards, "dim").select("shard", "dim", "copy", "block", "queries")
    copies = sent.select("shard", "dim", "copy").distinct().join(index, ["shard", "dim"])
    both = copies.unionByName(sent, allowMissingColumns=True).repartition("shard", "dim", "copy").sortWithinPartitions("shard", "dim", "copy", F.col("block").asc_nulls_first())

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j in range(batch.num_rows):
                row = {name: batch.column(c)[j].as_py() for c, name in enumerate(batch.schema.names)}
                if row["queries"] is None:  # the shard itself comes before its blocks
                    raw = np.frombuffer(row["raw"], np.float64).reshape(-1, row["dim"] // 8)
                    g, ids = Graph.load(unit(raw), row, links), row["ids"]
                    continue
                out_q, out_id, out_s = [], [], []
                queries = np.stack([np.frombuffer(q, np.float64) for q in row["queries"]])
                for q, u, key in zip(queries, unit(queries), row["queries"], strict=True):
                    found = np.array(g.search(u, max(width, keep)), np.int64)
                    score = cosines(raw[found], q)
                    best: dict[int, float] = {}
                    for s, p in zip(score.tolist(), found.tolist(), strict=True):
                        for i in ids[p]:
                            best[i] = max(s, best.get(i, -2.0))
                    hits = sorted((-s, i) for i, s in best.items())[:keep]
                    out_q += [key] * len(hits)
                    out_s += [-s for s, _ in hits]
                    out_id += [i for _, i in hits]
                yield pa.RecordBatch.from_pydict({"vec": pa.array(out_q, pa.binary()), "vec_id": pa.array(out_id, pa.int64()), "score": pa.array(out_s, pa.float64())})

    hits = both.select("dim", "entry", "height", "low", "fill", "runs", "raw", "ids", "queries").mapInArrow(search, "vec binary, vec_id long, score double")
    # The best of all shards; ranks are cut before the shuffle too, so a query's rows don't grow with the shards.
    best = hits.groupBy("vec", "vec_id").agg(F.max("score").alias("score"))
    near_first = [F.desc("score"), "vec_id"]
    best = best.withColumn("pos", F.row_number().over(Window.partitionBy("vec").orderBy(*near_first))).where(F.col("pos") <= keep).drop("pos")
    best = scratch.table(best, "hits")
    scratch.clear("hits")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat, offsets = np.asarray(lists.values), np.asarray(lists.offsets)
            yield pa.RecordBatch.from_pydict({"query_id": batch.column(0), "vec": pa.array([(flat[offsets[i] : offsets[i + 1]] + 0.0).tobytes() for i in range(batch.num_rows)], pa.binary())})

    queries = given.where(F.col("vec_id") % every == 0).mapInArrow(own, "query_id long, vec binary").groupBy("query_id").agg(F.min("vec").alias("vec"))
    others = queries.join(best, "vec").where("vec_id <> query_id")
    ranked = others.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*near_first)))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
