"""Schemas of the stored tables and of ``paths``, the flattened snapshot that most operators read."""

from pyspark.sql import types as T

XATTRS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.BinaryType())]))
REGIONS = T.ArrayType(T.StructType([T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())]))


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


S, L = T.StringType(), T.LongType()
PAYLOAD = dict(kind=S, hash=S, size=L, sparse_map=REGIONS, target_path=S, major=L, minor=L, uid=L, gid=L, mode=L, xattrs=XATTRS)

BLOBS = _struct(hash=S, uid=L, gid=L, mode=L, length=L, content=T.BinaryType())
TREE_ENTRIES = _struct(tree_hash=S, name=S, **PAYLOAD)
TREES = _struct(hash=S, n_entries=L, length=L)
COMMITS = _struct(hash=S, tree=S, parents=T.ArrayType(S), author=S, timestamp=L, message=S, metadata=T.MapType(S, S), length=L)
ARTIFACTS = _struct(hash=S, tree=S, manifest_hash=S, output=S)
REFS_LOG = _struct(namespace=S, name=S, hash=S, seq=L)
ID_MAPS = _struct(id_type=S, ord=L, inside_start=L, outside_start=L, count=L)
SOURCE_FILES = _struct(path=S, file_type=S, uid=L, gid=L, mode=L, size=L, major=L, minor=L, ino=L, dev=L, nlink=L, xattrs=XATTRS, link_target=S, sparse_map=REGIONS, content=T.BinaryType())
PATHS = _struct(path=S, **PAYLOAD)

TABLES = {"blobs": BLOBS, "tree_entries": TREE_ENTRIES, "trees": TREES, "commits": COMMITS, "artifacts": ARTIFACTS, "refs_log": REFS_LOG, "id_maps": ID_MAPS}
PAYLOAD_COLUMNS = list(PAYLOAD)

#: Kinds that name an object, and those that never do.
HASHED_KINDS = ("regular", "symlink", "directory")
U32_MAX = (1 << 32) - 1
SYMLINK_MODE = 0o120777
EMPTY_TREE = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
