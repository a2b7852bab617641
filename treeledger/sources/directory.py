"""Source folders and id maps as DataFrames."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from treeledger.errors import NamespaceParseError
from treeledger.schema import ID_MAPS, SOURCE_FILES, U32_MAX

#: Paths that one task reads.
PATHS_PER_TASK = 2_000
_KINDS = ((stat.S_ISREG, "regular"), (stat.S_ISLNK, "symlink"), (stat.S_ISDIR, "directory"), (stat.S_ISBLK, "block_device"), (stat.S_ISCHR, "char_device"), (stat.S_ISFIFO, "fifo"), (stat.S_ISSOCK, "socket"))


def xattrs(path: str) -> list[tuple[str, bytes]]:
    """Extended attributes by name; none where they aren't supported, without those that can't be read."""
    out = []
    try:
        names = os.listxattr(path, follow_symlinks=False)
    except OSError:
        return out
    for name in sorted(names):
        try:
            out.append((name, os.getxattr(path, name, follow_symlinks=False)))
        except OSError:
            continue
    return out


def regions(path: str, size: int) -> list[tuple[int, int]] | None:
    """Stretches of data in a file; None if there is no hole, empty if there is nothing else."""
    if size == 0:
        return None
    found, at = [], 0
    fd = os.open(path, os.O_RDONLY)
    try:
        while at < size:
            try:
                start = os.lseek(fd, at, os.SEEK_DATA)
            except OSError:
                break
            at = os.lseek(fd, start, os.SEEK_HOLE)
            found.append((start, at - start))
    except OSError:
        return None
    finally:
        os.close(fd)
    return None if found == [(0, size)] else found


def row(root: str, path: str) -> tuple:
    """One SOURCE_FILES row; what can't be read raises."""
    full = os.path.join(root, path)
    s = os.lstat(full)
    kind = next((k for test, k in _KINDS if test(s.st_mode)), "regular")
    holes, content = None, None
    if kind == "regular":
        holes = regions(full, s.st_size)
        with open(full, "rb") as f:
            content = f.read()
    link = os.readlink(full) if kind == "symlink" else None
    return (path, kind, s.st_uid, s.st_gid, s.st_mode, s.st_size, os.major(s.st_rdev), os.minor(s.st_rdev), s.st_ino, s.st_dev, s.st_nlink, xattrs(full), link, holes, content)


class _Part(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[_Part]:
        paths = []
        for top, folders, names in os.walk(self.root):
            folders.sort()
            paths += [os.path.relpath(os.path.join(top, n), self.root) for n in sorted([*folders, *names])]
        paths = sorted(set(paths))
        return [_Part(paths[i : i + PATHS_PER_TASK]) for i in range(0, len(paths), PATHS_PER_TASK)] or [_Part([])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for path in partition.paths:
            yield row(self.root, path)


class FolderSource(DataSource):
    """spark.read.format("folder").load(path): files with owner, mode, attributes, holes and content. The folder must be mounted on all workers."""

    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self):
        return SOURCE_FILES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(FolderSource)
    return spark.read.format("folder").load(path)


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """Files of any Hadoop store: path, size and content, without what only a file system knows."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    base = path.rstrip("/").split(":", 1)[-1].lstrip("/")
    return rows.select(F.regexp_replace("path", f"^.*?{base}/", "").alias("path"), F.lit("regular").alias("file_type"), F.col("length").alias("size"), "content")


def parse_id_map(spark: SparkSession, path: str, id_type: str) -> DataFrame:
    """(id_type, ord, inside_start, outside_start, count) from lines of three numbers; lines with more or fewer fields are skipped, other than 32-bit numbers raise."""
    with open(path) as f:
        return id_map_rows(spark, f.read(), id_type)


def id_map_rows(spark: SparkSession, text: str, id_type: str) -> DataFrame:
    rows = []
    for line in text.splitlines():
        fields = line.split()
        if len(fields) != 3:
            continue
        if not all(x.isascii() and x.isdigit() and int(x) <= U32_MAX for x in fields):
            raise NamespaceParseError(line)
        rows.append((id_type, len(rows), *map(int, fields)))
    return spark.createDataFrame(rows, ID_MAPS)


def current_maps(spark: SparkSession) -> DataFrame:
    """The maps of this process."""
    return parse_id_map(spark, "/proc/self/uid_map", "uid").unionByName(parse_id_map(spark, "/proc/self/gid_map", "gid"))
