"""Snapshots written back to a folder."""

from __future__ import annotations

import errno
import os
import stat

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.errors import HardlinkTargetNotFound, InvalidEntryName, TargetNotEmpty, UnionConflict, UnionTypeConflict
from treeledger.functions import paths as P
from treeledger.functions.text import policy, ref_name_ok
from treeledger.operators.ingest import restored_bytes
from treeledger.operators.union import grouped, resolved


def manifest(paths: DataFrame, blobs: DataFrame) -> DataFrame:
    """What to make, one row for each path: kind, mode, owner, attributes, content (holes restored), the data as stored with its regions, target.

    A path that would lead out of the target (an absolute one, or with an empty, '.' or '..' part) raises.
    """
    check_paths(paths)
    dangling = paths.where("kind = 'hardlink'").join(paths.select(F.col("path").alias("target_path")), "target_path", "left_anti").select("target_path").first()
    if dangling:
        raise HardlinkTargetNotFound(dangling[0])
    known = blobs.select("hash", F.col("uid").alias("b_uid"), F.col("gid").alias("b_gid"), F.col("mode").alias("b_mode"), F.col("content").alias("stored")).dropDuplicates(["hash"])
    rows = paths.join(known, "hash", "left")
    return rows.select(
        "path", "kind", P.depth("path").alias("depth"), "target_path", "major", "minor", "size", "sparse_map", "xattrs", "stored",
        *(F.coalesce(c, f"b_{c}").alias(c) for c in ("uid", "gid", "mode")),
        F.when(F.col("kind") == "regular", restored_bytes(F.col("stored"), F.col("sparse_map"), F.coalesce("size", F.lit(0)))).when(F.col("kind") == "symlink", F.col("stored")).alias("content"),
    )


def union_manifest(layers: list[DataFrame], blobs: DataFrame, on_conflict: str = "error") -> DataFrame:
    """The manifest of several snapshots laid over each other."""
    how = policy(on_conflict)
    groups = grouped(layers)
    wrong = groups.where("any_dir and not all_dirs").orderBy("path").first()
    if wrong:
        raise UnionTypeConflict(wrong["path"])
    if how == "error":
        wrong = groups.where("n > 1 and not any_dir").orderBy("path").first()
        if wrong:
            raise UnionConflict(wrong["path"])
    return manifest(resolved(groups, how), blobs)


def check_paths(paths: DataFrame) -> None:
    """Raise for a path or hardlink target that no snapshot below one folder can have."""
    bad = paths.where(~ref_name_ok("path") | F.col("target_path").isNotNull() & ~ref_name_ok("target_path")).select("path").first()
    if bad:
        raise InvalidEntryName(bad[0])


def write(rows: DataFrame, target: str, force: bool = False, owners: bool = False) -> None:
    """Make a manifest's files below target, which must be empty unless forced; what it holds besides stays.

    Directories are made first, then files and links, then hardlinks, each in parallel; owner, attributes and mode of directories come last, the deepest first, so
    that one that may not be written to can be filled. A file of holes is written at its offsets. The folder must be mounted on all workers.
    """
    if os.path.isdir(target) and os.listdir(target) and not force:
        raise TargetNotEmpty(target)
    os.makedirs(target, exist_ok=True)
    rows = rows.drop("content")
    folders = rows.where("kind = 'directory'")
    folders.foreachPartition(lambda part: [os.makedirs(os.path.join(target, r["path"]), exist_ok=True) for r in part])
    rows.where("kind not in ('directory', 'hardlink')").foreachPartition(_maker(target, owners))
    rows.where("kind = 'hardlink'").foreachPartition(_maker(target, owners))
    for depth in range(folders.agg(F.max("depth")).first()[0] or 0, 0, -1):
        folders.where(F.col("depth") == depth).foreachPartition(lambda part: [describe(os.path.join(target, r["path"]), r, owners) for r in part])


def union_write(layers: list[DataFrame], blobs: DataFrame, target: str, on_conflict: str = "error", force: bool = False, owners: bool = False) -> None:
    """Lay snapshots over each other in target. With force what is there counts as the layer below: a file in the way of a file is a conflict under the policy
    (first keeps it), and a directory in the way of anything else, or the other way round, a type conflict. Nothing is written if one is found."""
    rows = union_manifest(layers, blobs, on_conflict)
    if force and os.path.isdir(target):
        there = rows.select("path", "kind").mapInPandas(_standing(target), "path string, kind string, found string").where("found is not null")
        wrong = there.where("(kind = 'directory') <> (found = 'directory')").orderBy("path").first()
        if wrong:
            raise UnionTypeConflict(wrong["path"])
        files = there.where("kind <> 'directory'")
        if policy(on_conflict) == "error":
            wrong = files.orderBy("path").first()
            if wrong:
                raise UnionConflict(wrong["path"])
        if policy(on_conflict) == "first":
            rows = rows.join(files.select("path"), "path", "left_anti")
    write(rows, target, force, owners)


def _standing(target: str):
    def look(parts):
        for part in parts:
            full = [os.path.join(target, p) for p in part["path"]]
            yield part.assign(found=[None if not os.path.lexists(f) else "directory" if os.path.isdir(f) and not os.path.islink(f) else "file" for f in full])

    return look


def describe(full: str, r, owners: bool) -> None:
    """Attributes, then owner, then mode. Attributes that need privileges or that the file system lacks are left out."""
    for x in r["xattrs"] or ():
        try:
            os.setxattr(full, x["name"], bytes(x["value"]), follow_symlinks=False)
        except OSError as e:
            if e.errno not in (errno.EPERM, errno.EACCES, errno.ENOTSUP):
                raise
    if owners and r["uid"] is not None:
        os.chown(full, r["uid"], r["gid"], follow_symlinks=False)
    if r["mode"] is not None and r["kind"] != "symlink":
        os.chmod(full, r["mode"] & 0o7777)


def fill(full: str, data: bytes, regions, size: int | None) -> None:
    """A file of data, or of data in regions with holes between, up to size."""
    with open(full, "wb") as f:
        if regions is None:
            f.write(data)
            return
        used = 0
        for x in sorted(regions):
            f.seek(x["offset"])
            f.write(data[used : used + x["length"]])
            used += x["length"]
        f.truncate(max(size or 0, f.tell() if regions else 0))


def _maker(target: str, owners: bool):
    nodes = {"fifo": stat.S_IFIFO, "socket": stat.S_IFSOCK, "block_device": stat.S_IFBLK, "char_device": stat.S_IFCHR}

    def make(part) -> None:
        for r in part:
            full = os.path.join(target, r["path"])
            if os.path.lexists(full):
                os.remove(full)
            if r["kind"] == "regular":
                fill(full, bytes(r["stored"] or b""), r["sparse_map"], r["size"])
            elif r["kind"] == "symlink":
                os.symlink(bytes(r["stored"] or b"").decode(), full)
            elif r["kind"] == "hardlink":
                os.link(os.path.join(target, r["target_path"]), full)
                continue
            else:
                os.mknod(full, nodes[r["kind"]] | 0o600, os.makedev(r["major"] or 0, r["minor"] or 0) if r["kind"].endswith("device") else 0)
            describe(full, r, owners)

    return make


def export(paths: DataFrame, blobs: DataFrame, path: str, dest: str, overwrite: bool = True) -> None:
    """One file or link written to dest; a hardlink is taken to its target."""
    from treeledger.operators.listing import exportable

    if os.path.lexists(dest):
        if not overwrite:
            raise TargetNotEmpty(dest)
        os.remove(dest)
    row = manifest(exportable(paths, path).withColumns({c: F.lit(None).cast("long") for c in ("major", "minor", "uid", "gid", "mode")} | {"target_path": F.lit(None).cast("string")}), blobs).first()
    if row["kind"] == "symlink":
        os.symlink(bytes(row["stored"] or b"").decode(), dest)
        return
    fill(dest, bytes(row["stored"] or b""), row["sparse_map"], row["size"])
    describe(dest, row, False)
