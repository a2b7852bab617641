"""Refs: an append-only log of names and hashes; the latest entry of a name counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeledger.errors import InvalidRef, RefNotFound
from treeledger.functions.hashing import is_hash
from treeledger.functions.text import glob_regex, ref_name_ok

HEADS, ARTIFACTS = "heads", "artifacts"


def current(log: DataFrame) -> DataFrame:
    """(namespace, name, hash): each name's latest entry, without deleted ones. A maximum by group, so no name's history meets in one task."""
    last = log.groupBy("namespace", "name").agg(F.max_by("hash", "seq").alias("hash"))
    return last.where("hash is not null")


def listed(refs: DataFrame, namespace: str = HEADS) -> DataFrame:
    return refs.where(F.col("namespace") == namespace).select("name", "hash").orderBy("name")


def matching(refs: DataFrame, pattern: str, namespace: str = HEADS) -> DataFrame:
    """Refs whose whole name fits a glob; * crosses slashes."""
    return listed(refs.where(F.col("name").rlike(glob_regex(pattern))), namespace)


def lines(refs: DataFrame, namespace: str = HEADS) -> DataFrame:
    """(line): hash and name."""
    return listed(refs, namespace).select(F.concat_ws(" ", "hash", "name").alias("line"))


def resolved(asked: DataFrame, refs: DataFrame, namespace: str = HEADS) -> DataFrame:
    """asked (spec) with hash: 64 hex digits stand for themselves, unchecked; else the ref's hash, or null."""
    known = refs.where(F.col("namespace") == namespace).select(F.col("name").alias("spec"), F.col("hash").alias("h"))
    return asked.join(known, "spec", "left").withColumn("hash", F.when(is_hash("spec"), F.lower("spec")).otherwise(F.col("h"))).drop("h")


def resolve(refs: DataFrame, spec: str, namespace: str = HEADS) -> str:
    """The hash that spec names."""
    if len(spec) == 64 and all(c in "0123456789abcdefABCDEF" for c in spec):
        return spec.lower()
    row = refs.where((F.col("namespace") == namespace) & (F.col("name") == spec)).select("hash").first()
    if row is None:
        raise RefNotFound(spec)
    return row[0]


def valid_names(names: DataFrame, column: str = "name") -> DataFrame:
    """names with ok: whether a ref may be called so."""
    return names.withColumn("ok", ref_name_ok(column))


def check_name(name: str) -> None:
    if not name or "\0" in name or any(x in ("", ".", "..") for x in name.split("/")):
        raise InvalidRef(name)


def nesting_conflicts(refs: DataFrame) -> DataFrame:
    """Names that are both a ref and a prefix of others, which files in folders couldn't be."""
    pieces = F.split("name", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), lambda i: F.concat_ws("/", F.slice(pieces, 1, i)))
    up = refs.where(F.size(pieces) > 1).select("namespace", F.explode(ups).alias("name"))
    return refs.join(up.distinct(), ["namespace", "name"], "left_semi").select("namespace", "name")
