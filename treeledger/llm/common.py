"""What the operators of this subpackage share: worker settings, scratch tables, hashing of byte runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeledger.plans.scratch import Scratch  # noqa: F401  (for the operators)
from treeledger.plans.workers import prepare  # noqa: F401  (for the operators)

#: Bytes of text that the vectorised kernels take at once; a longer text is a chunk by itself.
CHUNK_BYTES = 1 << 18

_FORGET: dict[str, Callable[[], None]] = {}


def at_work(name: str, forget: Callable[[], None] | None = None) -> None:
    """Called where a task of an operator begins: what other operators remember in this worker process is forgotten."""
    for other, clear in _FORGET.items():
        if other != name:
            clear()
    if forget:
        _FORGET[name] = forget


#: Bits of a filter: so many for each value, and this many at most (16 MB). A full filter lets more through, none less.
FILTER_SHARE = 16
FILTER_BITS = 1 << 27


def flags_of(df: DataFrame, column: str) -> Broadcast:
    """A broadcast filter of a long column's values; no more than its words come to the driver."""
    values = df.select(F.col(column).alias("v")).distinct()
    size = min(FILTER_BITS, 1 << max(12, (FILTER_SHARE * values.count()).bit_length()))
    words = values.groupBy(F.shiftright(F.col("v").bitwiseAND(size - 1), 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(v & 63 as int))")).alias("b"))
    flags = np.zeros(size >> 6, np.int64)
    for r in words.toLocalIterator():
        flags[r.w] = r.b
    return df.sparkSession.sparkContext.broadcast(flags.view(np.uint64))


def flagged(flags: np.ndarray, value: int) -> bool:
    """Whether a filter lets a value through."""
    at = value & (len(flags) << 6) - 1
    return bool(int(flags[at >> 6]) >> (at & 63) & 1)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def byte_rows(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type):
        column = column.cast(pa.binary() if not pa.types.is_large_string(column.type) else pa.large_binary())
    return [x or b"" for x in column.to_pylist()]


def chunks(texts: list[bytes] | list[str], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes in sum."""
    start, total = 0, 0
    for i, text in enumerate(texts):
        if total and total + len(text) > limit:
            yield start, i
            start, total = i, 0
        total += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of 64 over all (multiply and shift, twice)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D
#: Bytes that are hashed with one table of powers.
SPAN = 1 << 17


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        more = np.full(n, base, np.uint64)
        more[:1] = 1
        out.append(np.multiply.accumulate(more))
    return out[0], out[1]


_POWERS = _powers(SPAN)


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each run; equal bytes give equal hashes anywhere.

    Runs must not be empty, nor overlap, and must ascend. Each is a difference of prefix sums, shifted back to its start.
    """
    out = np.zeros(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        base = int(starts[a])
        b = max(a + 1, int(np.searchsorted(ends, base + SPAN, side="right")))
        size = int(ends[b - 1]) - base
        up, down = _POWERS if size <= SPAN else _powers(size)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(_BYTE[data[base : base + size]] * up[:size], out=sums[1:])
        out[a:b] = (sums[ends[a:b] - base] - sums[starts[a:b] - base]) * down[starts[a:b] - base]
        a = b
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def words_of(texts: list[bytes], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word runs of texts joined by a separator: (bytes, start and end of each word, first word of each text and the end).

    ``table`` maps a byte to itself as normalised, or to 0 where it separates words.
    """
    data = table[np.frombuffer(b"\x00".join(texts) + b"\x00", np.uint8)]
    inside = data != 0
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    row_ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    firsts = np.searchsorted(starts, np.concatenate([[0], row_ends]))
    return data, starts, ends, firsts


def byte_table(separators: bytes, lower: bool = True) -> np.ndarray:
    """Byte to normalised byte, 0 for separators."""
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[65:91] += 32
    table[list(separators)] = 0
    table[0] = 0
    return table
