"""Object ids as Spark expressions: SHA-256 over canonical bytes, as 64 lowercase hex digits."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from treeledger.errors import InvalidHashHex
from treeledger.schema import SYMLINK_MODE

#: Digits of the hash of a name that choose the bucket of a directory entry.
BUCKET_DIGITS = 2


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def le32(c: str | Column) -> Column:
    """Four bytes, least first."""
    h = F.lpad(F.hex(col(c).cast("long")), 8, "0")
    return F.unhex(F.concat(*(F.substring(h, i, 2) for i in (7, 5, 3, 1))))


def as_bytes(c: str | Column) -> Column:
    return F.coalesce(F.encode(col(c).cast("string"), "utf-8"), F.unhex(F.lit("")))


def xattr_bytes(xattrs: str | Column) -> Column:
    """Attributes in order of name, each name and value with its length before it."""
    one = lambda x: F.concat(le32(F.octet_length(x["name"])), as_bytes(x["name"]), le32(F.octet_length(x["value"])), x["value"])
    ordered = F.array_sort(F.coalesce(col(xattrs), F.array().cast("array<struct<name:string,value:binary>>")))
    return F.aggregate(F.transform(ordered, one), F.unhex(F.lit("")), lambda a, b: F.concat(a, b))


def blob_hash(uid, gid, mode, content, xattrs=None) -> Column:
    """Owner, mode, attributes and content decide a blob's id."""
    header = [le32(uid), le32(gid), le32(mode)]
    if xattrs is None:
        extra = [le32(F.lit(0))]
    else:
        extra = [le32(F.coalesce(F.size(col(xattrs)), F.lit(0))), xattr_bytes(xattrs)]
    return F.sha2(F.concat(*header, *extra, col(content)), 256)


def symlink_hash(uid, gid, target, xattrs=None) -> Column:
    """A blob of the target, with the one mode that links have."""
    return blob_hash(uid, gid, F.lit(SYMLINK_MODE), as_bytes(target), xattrs)


def escape(c: str | Column) -> Column:
    """Backslash, tab and newline written as two characters."""
    out = F.replace(col(c), F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("\t"), F.lit("\\t"))
    return F.replace(out, F.lit("\n"), F.lit("\\n"))


def xattr_text(xattrs: str | Column) -> Column:
    return F.concat_ws(",", F.transform(F.array_sort(col(xattrs)), lambda x: F.concat(F.hex(as_bytes(x["name"])), F.lit("="), F.hex(x["value"]))))


def region_text(regions: str | Column) -> Column:
    """Null and empty differ: a dense file and one that is all hole."""
    spans = F.concat_ws(",", F.transform(col(regions), lambda r: F.concat(r["offset"].cast("string"), F.lit("+"), r["length"].cast("string"))))
    return F.when(col(regions).isNull(), F.lit("-")).otherwise(spans)


def entry_line(name: str | Column = "name", p: str = "") -> Column:
    """One directory entry as text; absent fields are empty."""
    c = lambda n: F.col(p + n)
    plain = [F.coalesce(c(n).cast("string"), F.lit("")) for n in ("kind", "hash", "size")]
    rest = [F.coalesce(c(n).cast("string"), F.lit("")) for n in ("major", "minor", "uid", "gid", "mode")]
    target = F.coalesce(escape(c("target_path")), F.lit(""))
    return F.concat_ws("\t", escape(name), *plain, target, *rest, region_text(c("sparse_map")), F.coalesce(xattr_text(c("xattrs")), F.lit("")))


def name_bucket(name: str | Column) -> Column:
    """Entries of a directory are hashed in buckets, so that a directory of any size is no single group."""
    return F.substring(F.sha2(as_bytes(name), 256), 1, BUCKET_DIGITS)


def commit_hash(tree="tree", parents="parents", author="author", timestamp="timestamp", message="message", metadata="metadata") -> Column:
    pairs = F.transform(F.array_sort(F.map_entries(col(metadata))), lambda e: F.concat(escape(e["key"]), F.lit("="), escape(e["value"])))
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("tree "), col(tree)),
        F.concat(F.lit("parents "), F.concat_ws(",", col(parents))),
        F.concat(F.lit("author "), escape(author)),
        F.concat(F.lit("time "), col(timestamp).cast("string")),
        F.concat(F.lit("meta "), F.coalesce(F.concat_ws(";", pairs), F.lit(""))),
        escape(message),
    )
    return F.sha2(as_bytes(text), 256)


def artifact_hash(tree="tree", manifest="manifest_hash", output="output") -> Column:
    return F.sha2(as_bytes(F.concat_ws("\n", col(tree), col(manifest), col(output))), 256)


def is_hash(c: str | Column) -> Column:
    return col(c).rlike("^[0-9a-fA-F]{64}$")


def hash_path(c: str | Column) -> Column:
    """Where a store of files keeps an object: the first two digits, then the rest."""
    return F.concat_ws("/", F.substring(col(c), 1, 2), F.substring(col(c), 3, 62))


def checked_hash(text: str) -> str:
    """64 hex digits in lower case; anything else raises."""
    if not re.fullmatch("[0-9a-fA-F]{64}", text):
        raise InvalidHashHex(text)
    return text.lower()


def short(c: str | Column) -> Column:
    return F.substring(col(c), 1, 12)
