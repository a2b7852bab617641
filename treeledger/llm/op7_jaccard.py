"""Exact n-gram Jaccard join in size-banded tiles with hashed bitmaps.

A document is its set of word n-gram hashes. Two sets of Jaccard similarity t or more differ in few elements for
their size. So in a band of sizes the hash space is cut into some more parts than elements can differ; two linked sets of the band
agree in one whole part at least, and the content of a part is hashed to a tile. A set whose upper size bound reaches the next
band also joins that band's tiles. Tiles are dealt to buckets by hash as packed arrays (12 bytes for each set and tile), and a bucket is read
as a stream that remembers one set of each tile; what comes out are the tiles that different sets share. Sets in one tile are candidates:

1. in every tile all sets are held against one centre (the set that shares the largest tiles), which joins up a group of near
   copies with as many comparisons as it has members;
2. tiles whose members are joined already are done. In the rest, blocks of members are compared with each other;
3. in both, sets are compared by bitmaps: the count of bits that differ bounds the overlap from above. Only for pairs whose bound reaches the
   threshold are the sorted arrays made, from the texts again, and intersected. Pairs of one centre are decided in blocks, each of which gets its array once.

Equal sets are one node, named by a hash of the set, and tiles with the same members are one tile, so copies and common passages cost little
beyond the first pass. Nothing of a group comes together in one task unless it has been cut into blocks, and no element, pair or component goes to the driver.

Cases: null or wordless text has an empty set and is a component of its own; a text of fewer than n words is one
shingle of all its words; repeated doc_ids share a component if their texts link; null doc_ids don't count as smallest unless there is
no other; an empty table gives an empty table; other columns are ignored; texts are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.llm.common import Scratch, at_work, byte_rows, byte_table, chunks, flagged, flags_of, mix, prepare, run_hashes, words_of
from treeledger.llm.components import components

WORDS = 3
THRESHOLD = (90, 100)
#: Upper size of a band over its lower size.
BAND = 1.3
#: Parts that may be empty, besides one, as a share of the elements in which linked sets can differ.
SPARE = 0.15
#: Members of a tile that are compared with each other at once.
BLOCK = 1024
#: Pairs of one centre that are decided together.
CENTRE_BLOCK = 256
#: Entries (a set in a tile) of a bucket, and entries that a task holds before it deals them out or merges them.
BUCKET_ENTRIES = 500_000
HELD_ENTRIES = 1_000_000

_TABLE = byte_table(bytes([0x20, *range(0x09, 0x0E)]))


def bands(limit: int = 1 << 40) -> np.ndarray:
    """Lowest size of each band."""
    lows = [1]
    while lows[-1] < limit:
        lows.append(max(lows[-1] + 1, math.ceil(lows[-1] * BAND)))
    return np.array(lows, np.int64)


_LOWS = bands()


def differing(size: int, num: int, den: int) -> int:
    """The most elements in which two linked sets can differ if the larger has ``size`` elements.

    With overlap o and sizes a and b, o >= t (a + b - o); so the difference a + b - 2 o is at most (a + b) (1 - t) / (1 + t).
    """
    return 2 * size * (den - num) // (den + num)


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    none = np.zeros(0, np.uint64)
    odd = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]
    # A NUL is part of a word here; a byte that UTF-8 never uses stands for it, as NUL joins the texts.
    texts = [t.replace(b"\x00", b"\xff") if b"\x00" in t else t for t in texts]
    for a, b in chunks(texts):
        data, starts, ends, firsts = words_of(texts[a:b], _TABLE)
        hashes = run_hashes(data, starts, ends)
        n = max(0, len(hashes) - words + 1)
        rows = np.zeros(n, np.uint64)
        for k in range(words):
            rows = mix(rows + hashes[k : n + k] * odd[k % 5] + np.uint64(k))
        for i in range(b - a):
            lo, hi = int(firsts[i]), int(firsts[i + 1])
            if hi - lo >= words:
                one = np.sort(rows[lo : hi - words + 1])
                new = np.ones(len(one), bool)
                np.not_equal(one[1:], one[:-1], out=new[1:])
                out.append(one[new])
            elif hi > lo:
                value = np.full(1, hi - lo, np.uint64)
                for k in range(lo, hi):
                    value = mix(value + hashes[k : k + 1] * odd[(k - lo) % 5] + np.uint64(0xABCD))
                out.append(value)
            else:
                out.append(none)
    return out


def node_of(s: np.ndarray) -> int:
    """The hash that names a set."""
    return int(mix(np.array([int(mix(s).sum(dtype=np.uint64)) ^ (len(s) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)], np.uint64)).view(np.int64)[0])


def tiles_of(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """The tiles of a set: in its own band, and in the next if a linked set can lie there.

    Linked sets agree in more parts than are spare. Parts where both hold nothing tell nothing and make no tile; so if no more than the spare ones
    are empty in either set, a part with something agrees. A set with more empty parts also has a tile for each of its smallest elements, of which linked
    sets share one: each has all but ceil(t n) - 1 of them.
    """
    size = len(s)
    if not size:
        return np.zeros(0, np.int64)
    own = int(np.searchsorted(_LOWS, size, side="right")) - 1
    out = []
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(s ^ np.uint64(0x5DEECE66D)), dtype=np.uint64)])
    top = (s >> np.uint64(32)).astype(np.int64)
    for band in [own] + [b for b in range(own + 1, len(_LOWS)) if size * den >= num * int(_LOWS[b])]:
        apart = differing(int(_LOWS[band + 1]) - 1, num, den)
        spare = 1 + math.ceil(SPARE * apart)
        parts = apart + 1 + spare
        edges = (np.arange(parts + 1, dtype=np.int64) << 32) // parts
        cuts = np.searchsorted(top, edges)
        seed = np.uint64((band + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        full = np.flatnonzero(cuts[1:] > cuts[:-1])
        out.append(mix(sums[cuts[full + 1]] - sums[cuts[full]] + mix(full.astype(np.uint64) + seed)))
        if parts - len(full) > spare:
            out.append(mix(s[: size - -(-num * size // den) + 1] + mix(np.array([seed], np.uint64))))
    return np.concatenate(out).view(np.int64)


def bitmap(s: np.ndarray) -> np.ndarray:
    """Parity of the elements by hash, in 64-bit words; as wide as the band needs (at least twice as many bits as elements)."""
    band = int(np.searchsorted(_LOWS, len(s), side="right")) - 1
    return bits_in(s, width_of(band))


def width_of(band: int) -> int:
    """Bits of the bitmaps in a tile of this band."""
    return max(256, 1 << math.ceil(math.log2(2 * int(_LOWS[band + 1]))))


def bits_in(s: np.ndarray, width: int) -> np.ndarray:
    counts = np.bincount((mix(s ^ np.uint64(0x1234567)) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(counts.astype(np.uint8)).view(np.uint64)


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """A parity bitmap of fewer words."""
    # Bit index is hash modulo width, so halves fold by exclusive or.
    while len(bits) > words:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Whether den * overlap >= num * union, by intersecting sorted arrays."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if den * len(small) < num * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = len(large) - 1
    overlap = int((large[at] == small).sum())
    return den * overlap >= num * (len(a) + len(b) - overlap)


def packed(tiles: np.ndarray, nodes: np.ndarray, buckets: int) -> pa.RecordBatch:
    """(bucket, tiles, nodes): a row for each bucket, with 32 bits of each tile's hash; that different tiles may agree in them makes candidates, never links."""
    bucket = ((tiles.view(np.uint64) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(bucket)
    sorted_ = bucket[order]
    lead = np.flatnonzero(np.diff(sorted_, prepend=-1))
    edges = np.append(lead, len(order)).astype(np.int32)
    column = lambda x: pa.BinaryArray.from_buffers(pa.binary(), len(lead), [None, pa.py_buffer(edges * np.int32(x.itemsize)), pa.py_buffer(x)])
    return pa.RecordBatch.from_arrays([pa.array(sorted_[lead], pa.int64()), column(tiles[order].view(np.uint64).astype(np.uint32)), column(nodes[order])], ["bucket", "tiles", "nodes"])


def merged(tiles: np.ndarray, nodes: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """((tile, its smallest node) for each tile, (tile, node) of tiles that have different nodes)."""
    order = np.argsort(tiles)
    tiles, nodes = tiles[order], nodes[order]
    new = np.ones(len(tiles), bool)
    np.not_equal(tiles[1:], tiles[:-1], out=new[1:])
    lead = np.flatnonzero(new)
    least = np.minimum.reduceat(nodes, lead)
    many = np.repeat(least != np.maximum.reduceat(nodes, lead), np.diff(lead, append=len(tiles)))
    return (tiles[lead], least), (tiles[many], nodes[many])


def in_reach(x: bytes, y: bytes, n: int, m: int, num: int, den: int) -> bool:
    """Whether bitmaps x and y of sets of n and m elements allow the threshold: bits that differ are elements that differ, at least."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    words = min(len(a), len(b))
    both = n + m - int(np.bitwise_count(fold(a, words) ^ fold(b, words)).sum())  # twice the overlap, at most
    return den * both >= num * (2 * (n + m) - both)


class Join:
    """The steps of the join over one table of documents, each written to the shared folder."""

    def __init__(self, docs: DataFrame, words: int, num: int, den: int, scratch: Scratch | None = None):
        self.spark = prepare(docs.sparkSession)
        self.scratch = scratch or Scratch(self.spark)
        self.words, self.num, self.den = words, num, den
        self.texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def documents(self) -> DataFrame:
        """(doc_id, node, n, bits); node and bits are null for an empty set."""
        words = self.words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at_work("op7")
            for batch in batches:
                sets = shingle_sets(byte_rows(batch.column(1)), words)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "node": pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()), "n": pa.array([len(s) for s in sets], pa.int64()), "bits": pa.array([bitmap(s).tobytes() if len(s) else None for s in sets], pa.binary())})

        return self.scratch.table(self.texts.mapInArrow(run, "doc_id long, node long, n long, bits binary"), "docs")

    def bitmaps(self, docs: DataFrame, members: DataFrame) -> DataFrame:
        """(node, n, bits) of sets that share a tile."""
        known = docs.where("n > 0").join(members.select("node").distinct(), "node", "left_semi")
        return self.scratch.table(known.groupBy("node").agg(F.first("n").alias("n"), F.first("bits").alias("bits")), "bits")

    def members(self, docs: DataFrame) -> DataFrame:
        """(tile, node, size): the tiles that two sets or more share, one of those with the same members."""
        words, num, den = self.words, self.num, self.den
        elements = docs.agg(F.sum("n")).first()[0] or 0
        buckets = max(1, math.ceil(elements * 2 * BAND * (1 + SPARE) * differing(100, num, den) / 100 / BUCKET_ENTRIES))

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at_work("op7")
            tiles: list[np.ndarray] = []
            nodes: list[np.ndarray] = []
            held = 0
            for batch in batches:
                met: set[int] = set()
                for s in shingle_sets(byte_rows(batch.column(0)), words):
                    if len(s) and (node := node_of(s)) not in met:
                        met.add(node)
                        tiles.append(tiles_of(s, num, den))
                        nodes.append(np.full(len(tiles[-1]), node, np.int64))
                        held += len(tiles[-1])
                    if held >= HELD_ENTRIES:
                        yield packed(np.concatenate(tiles), np.concatenate(nodes), buckets)
                        tiles, nodes, held = [], [], 0
            if held:
                yield packed(np.concatenate(tiles), np.concatenate(nodes), buckets)

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bucket, state = -1, (np.zeros(0, np.uint32), np.zeros(0, np.int64))
            parts: list[tuple[np.ndarray, np.ndarray]] = []

            def merge() -> pa.RecordBatch:
                nonlocal state, parts
                state, shared = merged(*(np.concatenate([state[k], *(p[k] for p in parts)]) for k in (0, 1)))
                parts = []
                return pa.RecordBatch.from_pydict({"tile": pa.array(shared[0].astype(np.int64) | bucket << 32, pa.int64()), "node": pa.array(shared[1], pa.int64())})

            for batch in batches:
                for k, b in enumerate(batch.column(0).to_pylist()):
                    if b != bucket or sum(len(p[0]) for p in parts) >= HELD_ENTRIES:
                        if parts:
                            yield merge()
                        if b != bucket:
                            bucket, state = b, (state[0][:0], state[1][:0])
                    parts.append((np.frombuffer(batch.column(1)[k].as_buffer(), np.uint32), np.frombuffer(batch.column(2)[k].as_buffer(), np.int64)))
            if parts:
                yield merge()

        dealt = self.texts.select("text").mapInArrow(deal, "bucket long, tiles binary, nodes binary").repartition("bucket").sortWithinPartitions("bucket")
        shared = self.scratch.table(dealt.mapInArrow(gather, "tile long, node long").distinct(), "shared")
        # Tiles with the same members are one tile.
        kinds = shared.groupBy("tile").agg(F.count(F.lit(1)).alias("size"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("sum")).groupBy("size", "sum").agg(F.min("tile").alias("tile"))
        members = self.scratch.table(shared.join(kinds.select("tile", "size"), "tile"), "members")
        self.scratch.drop("shared")
        return members

    def bounded(self, pairs: DataFrame, bits: DataFrame) -> DataFrame:
        """Those of pairs (a, b) whose sizes and bitmaps leave the threshold in reach."""
        num, den = self.num, self.den
        side = lambda x: bits.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}"))
        sized = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("na", "nb") * den >= F.greatest("na", "nb") * num)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                na, nb, xs, ys = (batch.column(k).to_pylist() for k in (2, 3, 4, 5))
                keep = pa.array([in_reach(x, y, n, m, num, den) for n, m, x, y in zip(na, nb, xs, ys, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

        return sized.select("a", "b", "na", "nb", "bitsa", "bitsb").mapInArrow(run, "a long, b long")

    def sets(self, wanted: DataFrame, name: str) -> DataFrame:
        """(node, items) of wanted nodes, computed from the texts again; a filter of bounded size keeps other sets from being shuffled."""
        flags, words = flags_of(wanted, "node"), self.words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at_work("op7")
            known = flags.value
            for batch in batches:
                keep: dict[int, np.ndarray] = {}
                for s in shingle_sets(byte_rows(batch.column(0)), words):
                    if len(s) and flagged(known, node := node_of(s)):
                        keep[node] = s
                yield pa.RecordBatch.from_pydict({"node": pa.array(list(keep), pa.int64()), "items": pa.array([s.tobytes() for s in keep.values()], pa.binary())})

        found = self.texts.select("text").mapInArrow(run, "node long, items binary")
        table = self.scratch.table(found.groupBy("node").agg(F.first("items").alias("items")), name)
        flags.unpersist()
        return table

    def decided(self, pairs: DataFrame, name: str) -> DataFrame:
        """The linked ones of pairs (a, b), in blocks of one b: its array comes once, each a's once for each pair."""
        num, den = self.num, self.den
        parts = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / CENTRE_BLOCK).cast("int").alias("parts"))
        dealt = self.scratch.table(pairs.join(parts, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part")), f"{name}-pairs")
        sets = self.sets(dealt.select(F.explode(F.array("a", "b")).alias("node")), f"{name}-sets")
        self.scratch.release()
        theirs = dealt.select("b", "part").distinct().join(sets.select(F.col("node").alias("b"), "items"), "b").select("b", "part", F.lit(None).cast("long").alias("a"), "items")
        ours = dealt.join(sets.select(F.col("node").alias("a"), "items"), "a").select("b", "part", "a", "items")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at_work("op7")
            centre = np.zeros(0, np.uint64)
            for batch in batches:
                items, ids, ok = batch.column(3), batch.column(2), np.zeros(batch.num_rows, bool)
                for i, a in enumerate(ids.to_pylist()):
                    if a is None:
                        centre = np.frombuffer(items[i].as_py(), np.uint64)
                    else:
                        ok[i] = linked(np.frombuffer(items[i].as_buffer(), np.uint64), centre, num, den)
                keep = pa.array(ok, pa.bool_())
                yield pa.RecordBatch.from_arrays([ids.filter(keep), batch.column(0).filter(keep)], ["a", "b"])

        blocks = theirs.unionByName(ours).repartition("b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())
        out = self.scratch.table(blocks.mapInArrow(run, "a long, b long"), name)
        self.scratch.drop(f"{name}-pairs", f"{name}-sets")
        self.scratch.release()
        return out

    def centre_pairs(self, members: DataFrame) -> DataFrame:
        """Every member of a tile against the tile's centre."""
        reach = members.groupBy("node").agg(F.sum("size").alias("reach"))
        centres = members.join(reach, "node").groupBy("tile").agg(F.max(F.struct("reach", "node")).alias("c")).select("tile", F.col("c.node").alias("b"))
        return members.join(centres, "tile").where("node <> b").select(F.col("node").alias("a"), "b").distinct()

    def tile_pairs(self, members: DataFrame, labels: DataFrame, bits: DataFrame) -> DataFrame:
        """Pairs that share a tile, are not joined yet, and whose bitmaps leave the threshold in reach."""
        num, den = self.num, self.den
        known = members.join(labels, "node", "left").select("tile", "node", F.coalesce("label", "node").alias("label"))
        open_tiles = known.groupBy("tile").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo <> hi").select("tile", "size")
        parts = F.ceil(F.col("size") / BLOCK).cast("int")
        rows = known.join(open_tiles, "tile").join(bits, "node").withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)"))).select("tile", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "label", "n", "bits")

        def compare(tile: list[tuple]) -> Iterator[tuple[int, int]]:
            """tile: (i, j, own, node, label, n, bits) of one pair of blocks."""
            i, j = tile[0][:2]
            own, node, label, n = (np.array([r[k] for r in tile], np.int64) for k in (2, 3, 4, 5))
            maps = [np.frombuffer(r[6], np.uint64) for r in tile]
            least = min(map(len, maps))
            bits = np.stack([fold(m, least) for m in maps])
            for x in range(len(tile)):
                ys = np.arange(x + 1, len(tile))
                ys = ys[(label[ys] != label[x]) & (np.minimum(n[ys], n[x]) * den >= np.maximum(n[ys], n[x]) * num)]
                if i != j:
                    ys = ys[own[ys] != own[x]]
                if len(ys):
                    every = n[ys] + n[x]
                    both = every - np.bitwise_count(bits[ys] ^ bits[x]).sum(1, dtype=np.int64)
                    ys = ys[den * both >= num * (2 * every - both)]
                    for y in ys.tolist():
                        yield min(node[x], node[y]), max(node[x], node[y])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, key = [], None
            for batch in batches:
                found: list[tuple[int, int]] = []
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if row[:3] != key:
                        found += compare(held) if len(held) > 1 else ()
                        held, key = [], row[:3]
                    held.append(row[1:])
                yield pa.RecordBatch.from_pydict({"a": pa.array([int(f[0]) for f in found], pa.int64()), "b": pa.array([int(f[1]) for f in found], pa.int64())})
            found = list(compare(held)) if len(held) > 1 else []
            yield pa.RecordBatch.from_pydict({"a": pa.array([int(f[0]) for f in found], pa.int64()), "b": pa.array([int(f[1]) for f in found], pa.int64())})

        dealt = rows.repartition("tile", "i", "j").sortWithinPartitions("tile", "i", "j", "node")
        return dealt.mapInArrow(run, "a long, b long").distinct()


def near(docs: DataFrame, words: int = WORDS, threshold: tuple[int, int] = THRESHOLD, scratch: Scratch | None = None) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id; linked if Jaccard similarity is threshold[0] / threshold[1] or more."""
    job = Join(docs, words, *threshold, scratch)
    scratch = job.scratch
    found = job.documents()
    members = job.members(found)
    scratch.release()
    bits = job.bitmaps(found, members)
    pairs = scratch.table(job.bounded(job.centre_pairs(members), bits), "centre-pairs")
    first = job.decided(pairs, "centre-links")
    labels = components(first, scratch, "first", rounds=1)  # enough to tell most tiles that are joined; the rest is compared
    pairs = scratch.table(job.tile_pairs(members, labels, bits), "pairs")
    scratch.release()
    links = first if pairs.isEmpty() else first.union(job.decided(pairs, "tile-links"))
    labels = components(links, scratch, "all")
    rows = found.join(labels, "node", "left").select("doc_id", "n", "node", F.coalesce("label", "node").alias("component"))
    # Written, so that the join below has exchanges of its own, which Spark can split at a hot component.
    least = scratch.table(rows.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("least")), "least")
    out = scratch.table(rows.join(least, "component", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id")), "near")
    scratch.clear("near")
    return out


def one_of_each(docs: DataFrame, words: int = WORDS, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """docs with one document of each component, that of the smallest doc_id; of rows that repeat an id one stays.

    Only ids are joined: those to leave out are a written table, which Spark broadcasts if its size allows. Rows without doc_id can't be named and stay.
    """
    spark = prepare(docs.sparkSession)
    scratch = Scratch(spark)
    groups = near(docs, words, threshold, scratch).where("doc_id is not null")
    kept = docs.join(scratch.table(groups.where("doc_id <> component_id").select("doc_id").distinct(), "left-out"), "doc_id", "left_anti")
    again = scratch.table(groups.groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    scratch.drop("near")
    if not again.isEmpty():
        kept = kept.join(again, "doc_id", "left_anti").unionByName(kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return kept.select(docs.columns)
