"""Paths as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from treeledger.functions.hashing import col


def parts(path: str | Column) -> Column:
    """Components, empty ones dropped."""
    return F.filter(F.split(col(path), "/"), lambda x: x != "")


def depth(path: str | Column) -> Column:
    """Components of a clean path; the root, '', has none."""
    return F.when(col(path) == "", F.lit(0)).otherwise(F.size(F.split(col(path), "/"))).cast("long")


def parent(path: str | Column) -> Column:
    """What stands before the last slash, '' at the top."""
    return F.regexp_replace(col(path), "/?[^/]*$", "")


def name(path: str | Column) -> Column:
    return F.regexp_extract(col(path), "[^/]*$", 0)


def join(prefix: str | Column, tail: str | Column) -> Column:
    return F.when(col(prefix) == "", col(tail)).otherwise(F.concat(col(prefix), F.lit("/"), col(tail)))


def ancestors(path: str | Column) -> Column:
    """Proper ancestors below the root, shortest first."""
    p = parts(path)
    return F.transform(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), lambda _, i: F.concat_ws("/", F.slice(p, 1, i + 1)))


def clean(path: str) -> str:
    """A path given by a caller without empty components."""
    return "/".join(x for x in path.split("/") if x)


def with_place(paths):
    """Adds parts, depth, parent_path and name."""
    return paths.withColumns({"parts": parts("path"), "depth": depth("path"), "parent_path": parent("path"), "name": name("path")})
