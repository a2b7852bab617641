"""Owner ids between namespaces: ordered ranges, the first that holds an id wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeledger.errors import UnmappedGid, UnmappedUid
from treeledger.schema import U32_MAX


def rows_of(maps: DataFrame, id_type: str) -> list[tuple[int, int, int]]:
    """(inside_start, outside_start, count) in order; a map is a handful of rows of configuration."""
    return [tuple(r) for r in maps.where(F.col("id_type") == id_type).orderBy("ord").select("inside_start", "outside_start", "count").collect()]


def shifted(value: Column, ranges: list[tuple[int, int, int]], outward: bool) -> Column:
    """The id on the other side, or null. The upper end of a range stops at the largest 32-bit number, which it doesn't hold."""
    out = F.lit(None).cast("long")
    for inside, outside, count in reversed(ranges):
        start, to = (inside, outside) if outward else (outside, inside)
        held = (value >= start) & (value < min(start + count, U32_MAX))
        out = F.when(held, value - start + to).otherwise(out)
    return out


def translated(df: DataFrame, maps: DataFrame, id_type: str, source: str, target: str, outward: bool = False) -> DataFrame:
    """df with column ``target``: ``source`` seen from the other side of the map."""
    return df.withColumn(target, shifted(F.col(source).cast("long"), rows_of(maps, id_type), outward))


def inside_ids(df: DataFrame, maps: DataFrame) -> DataFrame:
    """uid and gid as inside ids; an id outside the map raises."""
    out = df
    for name, error in (("uid", UnmappedUid), ("gid", UnmappedGid)):
        out = translated(out, maps, name, name, f"in_{name}")
        bad = out.where(F.col(f"in_{name}").isNull() & F.col(name).isNotNull()).select(name).first()
        if bad:
            raise error(str(bad[0]))
    return out.drop("uid", "gid").withColumnsRenamed({"in_uid": "uid", "in_gid": "gid"})


def remapped(blobs: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """blobs with new_uid, new_gid and outcome: remapped, no_change, skipped_unmapped_source or skipped_unmapped_target."""
    out = blobs
    for name in ("uid", "gid"):
        out = translated(out, old, name, name, f"in_{name}")
        out = translated(out, new, name, f"in_{name}", f"new_{name}", outward=True)
    outcome = (
        F.when(F.col("in_uid").isNull() | F.col("in_gid").isNull(), F.lit("skipped_unmapped_source"))
        .when(F.col("new_uid").isNull() | F.col("new_gid").isNull(), F.lit("skipped_unmapped_target"))
        .when((F.col("new_uid") == F.col("uid")) & (F.col("new_gid") == F.col("gid")), F.lit("no_change"))
        .otherwise(F.lit("remapped"))
    )
    return out.withColumn("outcome", outcome).drop("in_uid", "in_gid")


def remap_stats(rows: DataFrame) -> DataFrame:
    """(outcome, n), with all blobs as total."""
    counts = rows.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
    return counts.unionByName(rows.agg(F.lit("total").alias("outcome"), F.count(F.lit(1)).alias("n"))).orderBy("outcome")


def remap(blobs: DataFrame, old: DataFrame, new: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(blobs with ids moved to the new map, stats). Equal maps change nothing and count nothing; an id that the new map lacks raises unless forced."""
    if maps_equal(old, new):
        return blobs, remap_stats(remapped(blobs.limit(0), old, new))
    rows = remapped(blobs, old, new)
    if not force:
        bad = rows.where("outcome = 'skipped_unmapped_target'").select("uid", "gid", "new_uid").first()
        if bad:
            raise (UnmappedUid if bad[2] is None else UnmappedGid)(f"{bad[0]}:{bad[1]}")
    moved = F.col("outcome") == "remapped"
    out = rows.withColumns({c: F.when(moved, F.col(f"new_{c}")).otherwise(F.col(c)) for c in ("uid", "gid")})
    return out.drop("new_uid", "new_gid", "outcome"), remap_stats(rows)


def maps_equal(a: DataFrame, b: DataFrame) -> bool:
    return all(rows_of(a, k) == rows_of(b, k) for k in ("uid", "gid"))


def is_identity(maps: DataFrame) -> bool:
    return all(rows_of(maps, k) in ([(0, 0, U32_MAX)], [(0, 0, U32_MAX + 1)]) for k in ("uid", "gid"))
