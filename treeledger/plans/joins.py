"""Joins on hashes that leave little on disk."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeledger.plans.scratch import Scratch

#: Tables of at most so many rows, counted first, are sent to all executors.
SENT_ROWS = 200_000
#: Keys of eight bytes are sent if there are at most so many.
KEY_ROWS = 1_000_000
#: Two larger ones are joined in slices of about so many rows, at most MOST_SLICES, one after another.
SLICE_ROWS, MOST_SLICES = 1_000_000, 16


def packed(c: str) -> Column:
    """A hash in half its length; other names as they are. No two names give the same bytes."""
    return F.when(F.col(c).rlike(r"\A[0-9a-f]{64}\z"), F.concat(F.unhex(F.lit("00")), F.unhex(c))).otherwise(F.concat(F.unhex(F.lit("01")), F.col(c).cast("binary")))


def unpacked(c: str) -> Column:
    rest = F.substring(c, 2, (1 << 31) - 1)
    return F.when(F.substring(c, 1, 1) == F.unhex(F.lit("00")), F.lower(F.hex(rest))).otherwise(rest.cast("string"))


def sent(df: DataFrame) -> DataFrame:
    """df, to be sent to all executors in a join if it has few rows, which are counted; else df itself."""
    return F.broadcast(df) if df.count() <= SENT_ROWS else df


def matched(left: DataFrame, right: DataFrame, how: str, then: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Rows of left whose hash right has (left_semi) or lacks (left_anti), as ``then`` leaves them; that must work on any part of the rows.

    A small side goes to the other, so that hashes of the large one are not moved. Two large sides are joined in slices by their hashes,
    so that shuffle files hold one slice at a time; what is left of each is written.
    """
    keys = right.select("hash")
    if (r := right.count()) <= SENT_ROWS:
        return then(left.join(F.broadcast(keys), "hash", how))
    if (n := left.count()) <= SENT_ROWS:
        return then(left.join(keys.join(F.broadcast(left.select("hash")), "hash", "left_semi"), "hash", how))
    halved = lambda df: then(df.withColumn("hash", unpacked("packed")).select(left.columns))
    return sliced(left.withColumn("packed", packed("hash")).drop("hash"), keys.select(packed("hash").alias("packed")), "packed", max(n, r), how, halved)


def sliced(left: DataFrame, right: DataFrame, key: str, n: int, how: str, then: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """A join of left and right, which have n rows at most, one slice of the keys after another. What is left of each slice is written."""
    scratch, names = Scratch(left.sparkSession), []
    slices = min(MOST_SLICES, -(-n // SLICE_ROWS))
    for k in range(slices):
        here = F.pmod(F.xxhash64(key), F.lit(slices)) == k
        part = then(left.where(here).join(right.where(here), key, how))
        names.append(f"slice-{k}")
        scratch.table(part, names[-1], "zstd")
        schema = part.schema
        del part
        scratch.release()
    return scratch.read(schema, *names)
