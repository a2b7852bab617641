"""Shards cut from a Hilbert curve over metadata, under the law of equal row counts.

Each dimension (size, source, language) is quantised in an order-preserving way, so a shard covers a compact box in all of
them and files can be skipped by the minimum and maximum of any. Rows are sorted by curve index, then by checksum
of the text (equal texts of one cell are neighbours) and doc_id; position in that order decides shard and slot, so shard counts differ
by one at most whatever the skew, and a cell that holds a third of the rows is simply cut.

Only keys and sizes are shuffled, never texts. The order comes from a range partitioning whose rows are written
once; the rows of its partitions are counted there and give each row's position. Values of text dimensions are ranked the same way and joined, however many there are.

Groups: equal texts with equal metadata are one cell and neighbours in it, so they share a shard unless a border falls among them, which the law of equal counts
demands of large groups; equal texts with other metadata may lie elsewhere.

Cases: a null text has no bytes (size 8, checksum 0); null metadata come first in their dimension; repeated rows
each get their own slot; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeledger.llm.common import Scratch, prepare

BITS = 6
SHARDS = 24


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Curve index of each row of unsigned coordinates (rows, dimensions), each below 2**bits.

    The axes are turned into the transposed index by undoing rotations from the top bit down, then Gray-coded; the
    bits are interleaved, first axis highest.
    """
    x = points.astype(np.int64).copy()
    dims = x.shape[1]
    for level in range(bits - 1, 0, -1):
        q = 1 << level
        low = q - 1
        for d in range(dims):
            high = (x[:, d] & q) != 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, d]) & low)
            x[:, 0] ^= np.where(high, low, swap)
            x[:, d] ^= swap
    for d in range(1, dims):
        x[:, d] ^= x[:, d - 1]
    flip = np.zeros(len(x), np.int64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[:, -1] & (1 << level)) != 0, (1 << level) - 1, 0)
    x ^= flip[:, None]
    out = np.zeros(len(x), np.int64)
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            out = out << 1 | (x[:, d] >> level & 1)
    return out


def in_order(df: DataFrame, key: list, scratch: Scratch, name: str, weight: str | None = None) -> tuple[DataFrame, int]:
    """df with ``pos``, the rows (or the weights) before each row in the order of key, and their number in all.

    One row for each partition of the order comes to the driver.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The id holds the partition above its lower 33 bits and the row in the partition below; written, so later reads agree.
    dealt = scratch.table(df.repartitionByRange(parts, *key).sortWithinPartitions(*key).withColumn("at", F.monotonically_increasing_id()), name)
    part = F.shiftright("at", 33)
    sums = sorted(dealt.groupBy(part.alias("part")).agg((F.sum(weight) if weight else F.count(F.lit(1))).cast("long").alias("n")).collect())
    starts = [(r[0], before) for r, before in zip(sums, accumulate([0] + [r[1] for r in sums]), strict=False)]
    first = F.broadcast(df.sparkSession.createDataFrame(starts, "part long, start long"))
    if weight:
        own = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        inside = F.coalesce(F.sum(weight).over(own), F.lit(0))
    else:
        inside = F.col("at").bitwiseAND((1 << 33) - 1)
    return dealt.withColumn("part", part).withColumn("inside", inside).join(first, "part").withColumn("pos", F.col("start") + F.col("inside")).drop("part", "inside", "start", "at"), sum(r[1] for r in sums)


def by_rank(df: DataFrame, name: str, bits: int, scratch: Scratch) -> DataFrame:
    """(name, code): each value of a text column to 1 .. 2**bits - 1 in the order of values, each code with about as many rows."""
    top = (1 << bits) - 1
    counts = df.where(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    ranked, total = in_order(counts, [name], scratch, f"ranks-{name}", "n")
    return ranked.select(name, (1 + F.least(F.lit(top - 1), F.expr(f"pos * {top} div {max(1, total)}"))).cast("int").alias(f"{name}_code"))


def shards(docs: DataFrame, n_shards: int = SHARDS, bits: int = BITS, overhead: int = 8) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, curve."""
    spark = prepare(docs.sparkSession)
    scratch = Scratch(spark)
    given = set(docs.columns)
    meta = [F.col(c).cast("string").alias(c) if c in given else F.lit(None).cast("string").alias(c) for c in ("lang", "source")]
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long") + overhead).alias("size"),
        F.crc32(F.coalesce(F.encode(F.col("text").cast("string"), "utf-8"), F.unhex(F.lit("")))).alias("text_crc32"),
        *meta,
    )
    rows = scratch.table(rows, "keys")
    top = (1 << bits) - 1
    size_code = F.least(F.lit(top), F.floor(F.log2(F.col("size") / overhead) * 4)).cast("int")
    for name in ("source", "lang"):
        rows = rows.join(by_rank(rows, name, bits, scratch), name, "left")
    code = lambda name: F.coalesce(F.col(f"{name}_code"), F.lit(0)).alias(name)
    coded = rows.select("doc_id", "size", "text_crc32", size_code.alias("a"), code("source"), code("lang"))

    def curve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = np.stack([batch.column(i).to_numpy() for i in (3, 4, 5)], 1)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "size": batch.column(1), "text_crc32": batch.column(2), "curve": pa.array(hilbert(points, bits), pa.int64())})

    key = ["curve", "text_crc32", F.col("doc_id").asc_nulls_first()]
    dealt, total = in_order(coded.mapInArrow(curve, "doc_id long, size long, text_crc32 long, curve long"), key, scratch, "sorted")
    scratch.clear("sorted")
    whole, more = divmod(total, n_shards)
    long_rows = more * (whole + 1)
    shard = F.when(F.col("pos") < long_rows, F.expr(f"pos div {whole + 1}")).otherwise(more + F.expr(f"(pos - {long_rows}) div {max(1, whole)}"))
    slot = F.when(F.col("pos") < long_rows, F.expr(f"pos % {whole + 1}")).otherwise(F.expr(f"(pos - {long_rows}) % {max(1, whole)}"))
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve"
    )
