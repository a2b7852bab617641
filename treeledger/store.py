"""A store on disk: Parquet tables for objects, an append-only log for refs, a lock around its writers."""

from __future__ import annotations

import fcntl
import json
import os
import shutil
import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeledger.errors import CorruptObject, DuplicateEntryName, InvalidEntryName, LockContention, NoRepo, ObjectNotFound, RefNotFound, RemoteExists, RemoteNotFound, RepoExists
from treeledger.functions.hashing import artifact_hash, checked_hash
from treeledger.functions.text import ref_name_ok
from treeledger.operators import ingest, reach, refs
from treeledger.operators.refs import HEADS
from treeledger.operators.remap import inside_ids
from treeledger.operators.history import truncated
from treeledger.plans.merkle import flatten, merkle, tree_entries
from treeledger.schema import PATHS, TABLES

KEYS = {"blobs": ["hash"], "trees": ["hash"], "commits": ["hash"], "artifacts": ["hash"], "tree_entries": ["tree_hash", "name"]}


class Store:
    """Objects are appended first and refs last, so what a ref names is always there."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._held = spark, path.rstrip("/"), False
        if not os.path.exists(f"{self.path}/config.json"):
            raise NoRepo(path)

    @classmethod
    def create(cls, spark: SparkSession, path: str, id_maps: DataFrame | None = None) -> Store:
        """A new store; with id_maps, owners of committed files are translated to inside ids."""
        if os.path.exists(f"{path}/config.json"):
            raise RepoExists(path)
        os.makedirs(path, exist_ok=True)
        for name, schema in TABLES.items():
            spark.createDataFrame([], schema).write.parquet(f"{path}/{name}")
        with open(f"{path}/config.json", "w") as f:
            json.dump({"remotes": {}}, f)
        store = cls(spark, path)
        if id_maps is not None:
            store.append("id_maps", id_maps)
        return store

    @contextmanager
    def locked(self):
        """Hold the store's lock; raises at once if another does. Whoever holds it may take it again."""
        if self._held:
            yield
            return
        with open(f"{self.path}/lock", "w") as f:
            try:
                fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
            except OSError:
                raise LockContention(self.path) from None
            self._held = True
            try:
                yield
            finally:
                self._held = False

    def _place(self, name: str) -> str:
        """The folder that holds a table now; one file names all that were rewritten, so they change together."""
        try:
            with open(f"{self.path}/places.json") as f:
                return f"{self.path}/{json.load(f).get(name, name)}"
        except FileNotFoundError:
            return f"{self.path}/{name}"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(self._place(name))

    def append(self, name: str, rows: DataFrame) -> None:
        """Rows whose key isn't stored yet, each once."""
        fields = TABLES[name].fields
        rows = rows.select([(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
        if name in KEYS:
            keys = KEYS[name]
            rows = rows.dropDuplicates(keys).join(self.table(name).select(keys[0]).distinct(), keys[0], "left_anti").select([f.name for f in fields])
        rows.write.mode("append").option("compression", "zstd").parquet(self._place(name))

    def append_all(self, tables: dict[str, DataFrame]) -> None:
        for name in ("blobs", "tree_entries", "trees", "commits", "artifacts"):
            if name in tables:
                self.append(name, tables[name])

    def exists(self, name: str, hash_: str) -> bool:
        """Whether a table of objects holds a hash."""
        return not self.table(name).where(F.col("hash") == checked_hash(hash_)).isEmpty()

    def ref_exists(self, name: str, namespace: str = HEADS) -> bool:
        return not self.refs(namespace).where(F.col("name") == name).isEmpty()

    def objects(self) -> DataFrame:
        """(object_type, hash) of all that is stored."""
        kinds = (("blob", "blobs"), ("tree", "trees"), ("commit", "commits"))
        return reduce(DataFrame.unionByName, [self.table(t).select(F.lit(k).alias("object_type"), "hash") for k, t in kinds])

    def write_artifact(self, path: str, tree: str, manifest_hash: str, output: str) -> str:
        """Store an artifact and name it; equal artifacts are one object."""
        row = self.spark.createDataFrame([(tree, manifest_hash, output)], "tree string, manifest_hash string, output string").withColumn("hash", artifact_hash())
        self.append("artifacts", row)
        hash_ = row.first()["hash"]
        self.write_ref(path, hash_, refs.ARTIFACTS)
        return hash_

    def read_artifact(self, hash_: str) -> dict:
        """An artifact whose content gives its hash."""
        row = self.table("artifacts").where(F.col("hash") == checked_hash(hash_)).withColumn("made", artifact_hash()).first()
        if row is None:
            raise ObjectNotFound(hash_)
        if row["made"] != hash_:
            raise CorruptObject(hash_)
        return {k: row[k] for k in ("tree", "manifest_hash", "output")}

    # Refs

    def write_ref(self, name: str, hash_: str | None, namespace: str = HEADS) -> None:
        refs.check_name(name)
        with self.locked():
            seq = (self.table("refs_log").agg(F.max("seq")).first()[0] or 0) + 1
            self.append("refs_log", self.spark.createDataFrame([(namespace, name, hash_, seq)], TABLES["refs_log"]))

    def refs(self, namespace: str = HEADS) -> DataFrame:
        return refs.listed(refs.current(self.table("refs_log")), namespace)

    def resolve(self, spec: str) -> str:
        return refs.resolve(refs.current(self.table("refs_log")), spec)

    def delete_ref(self, name: str, namespace: str = HEADS) -> None:
        with self.locked():
            if self.refs(namespace).where(F.col("name") == name).isEmpty():
                raise RefNotFound(name)
            self._drop_refs([name], namespace)

    def delete_refs(self, pattern: str, namespace: str = HEADS) -> list[str]:
        """Delete all refs that fit a glob, in one append; their names."""
        with self.locked():
            names = [r[0] for r in refs.matching(refs.current(self.table("refs_log")), pattern, namespace).collect()]
            if names:
                self._drop_refs(names, namespace)
        return names

    def _drop_refs(self, names: list[str], namespace: str) -> None:
        seq = (self.table("refs_log").agg(F.max("seq")).first()[0] or 0) + 1
        self.append("refs_log", self.spark.createDataFrame([(namespace, name, None, seq + i) for i, name in enumerate(names)], TABLES["refs_log"]))

    # Snapshots

    def commit(self, files: DataFrame, ref: str, message: str = "", author: str = "unknown", timestamp: int = 0, metadata: dict[str, str] | None = None) -> str:
        """Store source files as a commit whose parent is the ref's present value."""
        refs.check_name(ref)
        maps = self.table("id_maps")
        with self.locked():  # so that no collection runs between an object and the ref that leads to it
            paths, blobs = ingest.snapshot(files if maps.isEmpty() else inside_ids(files, maps))
            self.append("blobs", blobs)
            old = self.refs().where(F.col("name") == ref).first()
            return self._commit_paths(paths, ref, [old["hash"]] if old else [], message, author, timestamp, metadata or {})

    def _commit_paths(self, paths: DataFrame, ref: str, parents: list[str], message: str, author: str, timestamp: int, metadata: dict[str, str]) -> str:
        full = merkle(paths)
        bad = full.where((F.col("path") != "") & ~ref_name_ok("path")).select("path").first()
        if bad:
            raise InvalidEntryName(bad[0])
        twice = full.groupBy("path").count().where("count > 1").select("path").first()
        if twice:
            raise DuplicateEntryName(twice[0])
        trees = full.where("kind = 'directory'").select("hash", F.coalesce("n_entries", F.lit(0)).alias("n_entries"), F.lit(None).cast("long").alias("length"))
        root = full.where("path = ''").first()["hash"]
        commit = ingest.commit_row(self.spark, root, parents, author, timestamp, message, metadata)
        self.append_all({"tree_entries": tree_entries(full), "trees": trees, "commits": commit})
        hash_ = commit.first()["hash"]
        self.write_ref(ref, hash_)
        return hash_

    def tree_of(self, spec: str) -> str:
        row = self.table("commits").where(F.col("hash") == self.resolve(spec)).select("tree").first()
        if row is None:
            raise RefNotFound(spec)
        return row[0]

    def paths(self, spec: str) -> DataFrame:
        """The flattened snapshot of a ref or commit hash."""
        return self.paths_of_tree(self.tree_of(spec))

    def paths_of_tree(self, tree: str) -> DataFrame:
        roots = self.spark.createDataFrame([("s", tree)], "snapshot string, tree_hash string")
        return flatten(self.table("tree_entries"), roots).select([f.name for f in PATHS])

    def union(self, specs: list[str], ref: str, on_conflict: str = "error", message: str = "", author: str = "unknown", timestamp: int = 0) -> str:
        """Merge refs into a commit whose parents are all of them."""
        from treeledger.operators.union import union

        merged = union([self.paths(s) for s in specs], on_conflict)
        return self._commit_paths(merged, ref, [self.resolve(s) for s in specs], message, author, timestamp, {})

    def truncate_history(self, dry_run: bool = False) -> int:
        """Replace heads that have parents by copies without; how many."""
        rows = truncated(self.table("commits"), self.refs())
        found = rows.select("name", "hash").collect()
        if found and not dry_run:
            self.append("commits", rows)
            for r in found:
                self.write_ref(r["name"], r["hash"])
        return len(found)

    # Maintenance

    def gc(self, dry_run: bool = True) -> DataFrame:
        """(object_type, removed, bytes); unless dry, tables are rewritten without unreachable objects."""
        with self.locked():  # over marking and sweeping
            stored = {"commit": self.table("commits"), "tree": self.table("trees"), "blob": self.table("blobs")}
            marked = reach.mark(stored["commit"], self.table("tree_entries"), self.refs().select("hash"), stored["tree"])
            report = reach.gc_stats(stored, marked)
            if dry_run:
                return report
            report = self.spark.createDataFrame(report.collect(), report.schema)
            keep = {"commits": marked["commit"], "trees": marked["tree"], "blobs": marked["blob"], "tree_entries": marked["tree"].withColumnRenamed("hash", "tree_hash")}
            self._rewrite({name: self.table(name).join(marks, marks.columns[0], "left_semi") for name, marks in keep.items()})
        return report

    def replace(self, name: str, rows: DataFrame) -> None:
        """Put rows in place of a table."""
        with self.locked():
            self._rewrite({name: rows})

    def _rewrite(self, tables: dict[str, DataFrame]) -> None:
        """Write new folders, then name them all at once; a crash before that leaves the old ones, after it only rubbish."""
        old = {name: self._place(name) for name in tables}
        new = {name: f"{name}.{uuid.uuid4().hex}" for name in tables}
        for name, rows in tables.items():
            rows.select(TABLES[name].names).write.option("compression", "zstd").parquet(f"{self.path}/{new[name]}")
        places = f"{self.path}/places.json"
        known = {}
        if os.path.exists(places):
            with open(places) as f:
                known = json.load(f)
        with open(f"{places}.new", "w") as f:
            json.dump(known | new, f)
        os.replace(f"{places}.new", places)
        for path in old.values():
            shutil.rmtree(path)

    def fsck(self, verify_blobs: bool = False) -> DataFrame:
        return reach.fsck(self.table("commits"), self.table("tree_entries"), self.table("trees"), self.table("blobs"), self.refs().select("hash"), verify_blobs)

    # Remotes

    def _config(self) -> dict:
        with open(f"{self.path}/config.json") as f:
            return json.load(f)

    def _save(self, config: dict) -> None:
        with open(f"{self.path}/config.json.new", "w") as f:
            json.dump(config, f)
        os.replace(f"{self.path}/config.json.new", f"{self.path}/config.json")

    def add_remote(self, name: str, url: str) -> None:
        config = self._config()
        if name in config["remotes"]:
            raise RemoteExists(name)
        config["remotes"][name] = url
        self._save(config)

    def remove_remote(self, name: str) -> None:
        config = self._config()
        if config["remotes"].pop(name, None) is None:
            raise RemoteNotFound(name)
        self._save(config)

    def remote(self, name: str) -> str:
        url = self._config()["remotes"].get(name)
        if url is None:
            raise RemoteNotFound(name)
        return url
