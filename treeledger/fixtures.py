"""The driver's tables as snapshots, histories and maps, so that every operator has data to run on."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from treeledger.functions.hashing import artifact_hash, as_bytes, blob_hash, commit_hash
from treeledger.operators.ingest import with_parents
from treeledger.plans.merkle import merkle, tree_entries
from treeledger.plans.scratch import Scratch, written
from treeledger.schema import PATHS, PAYLOAD_COLUMNS


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def _shaped(df: DataFrame) -> DataFrame:
    have = set(df.columns)
    return df.select([(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in PATHS])


def doc_path() -> F.Column:
    return F.concat_ws("/", "lang", "source", F.concat(F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".txt")))


def files_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, kind, mode, content) of the first snapshot."""
    docs = read(spark, sf_dir, "documents").where("doc_id % 11 <> 0")
    return docs.select(doc_path().alias("path"), F.lit("regular").alias("kind"), F.lit(33188).cast("long").alias("mode"), as_bytes("text").alias("content"))


def files_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second: links, edits, modes, and a directory replaced by a file."""
    docs = read(spark, sf_dir, "documents").where("doc_id % 13 <> 0 and not (lang = 'de' and source = 'src5')")
    link, edited = F.col("doc_id") % 19 == 0, F.col("doc_id") % 7 == 0
    text = F.when(link, F.concat(F.lit("../"), F.col("doc_id").cast("string"))).when(edited, F.concat("text", F.lit(" [edited]"))).otherwise(F.col("text"))
    mode = F.when(link, F.lit(41471)).when(F.col("doc_id") % 17 == 0, F.lit(33261)).otherwise(F.lit(33188)).cast("long")
    rows = docs.select(doc_path().alias("path"), F.when(link, F.lit("symlink")).otherwise(F.lit("regular")).alias("kind"), mode.alias("mode"), as_bytes(text).alias("content"))
    extra = spark.createDataFrame([("de/src5", "regular", 33188, bytearray(b"now a file"))], "path string, kind string, mode long, content binary")
    return rows.unionByName(extra)


def hashed(files: DataFrame) -> DataFrame:
    """files with hash and length."""
    zero = F.lit(1000).cast("long")
    return files.withColumns({"hash": blob_hash(zero, zero, "mode", "content"), "length": F.octet_length("content").cast("long")})


def snapshot_of(files: DataFrame, keep: str, special_mode: bool = False) -> DataFrame:
    """paths: of files with equal kind and blob one stays (the min or max path), the others become hardlinks to it; parents are added."""
    rows = written(hashed(files).drop("content"))  # texts are read and hashed once
    pick = (F.min if keep == "min" else F.max)("path").alias("first")
    rows = rows.join(rows.groupBy("kind", "hash").agg(pick), ["kind", "hash"])
    link = F.col("path") != F.col("first")
    named = rows.select(
        "path",
        F.when(link, F.lit("hardlink")).otherwise(F.col("kind")).alias("kind"),
        F.when(~link, F.col("hash")).alias("hash"),
        F.when(~link & (F.col("kind") == "regular"), F.col("length")).alias("size"),
        F.when(link, F.col("first")).alias("target_path"),
    )
    full = with_parents(_shaped(named), 0, 0, 16877, among=rows)
    if special_mode:
        full = full.withColumn("mode", F.when((F.col("kind") == "directory") & F.col("path").rlike("^[^/]+/src3$"), F.lit(16832).cast("long")).otherwise(F.col("mode")))
    return _shaped(full)


def v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_of(files_v1(spark, sf_dir), "min")


def v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_of(files_v2(spark, sf_dir), "max", special_mode=True)


def blobs_of(files: DataFrame) -> DataFrame:
    """The blob table of a snapshot's files."""
    owner = F.lit(1000).cast("long")
    return hashed(files).select("hash", owner.alias("uid"), owner.alias("gid"), "mode", "length", "content").dropDuplicates(["hash"])


def layers(spark: SparkSession, sf_dir: str, type_conflict: bool = False) -> list[DataFrame]:
    """Three overlapping snapshots for unions; with type_conflict one has the file en/src0."""
    docs = read(spark, sf_dir, "documents")
    out = []
    for i, (mod, suffix) in enumerate(((2, ""), (3, "x"), (5, ""))):
        rows = docs.where(F.col("doc_id") % mod == 0).select(doc_path().alias("path"), F.lit("regular").alias("kind"), F.lit(33188).cast("long").alias("mode"), as_bytes(F.concat("text", F.lit(suffix))).alias("content"))
        if type_conflict and i == 1:
            rows = rows.where(~F.startswith("path", F.lit("en/src0/"))).unionByName(spark.createDataFrame([("en/src0", "regular", 33188, bytearray(b"file"))], rows.schema))
        sized = hashed(rows).select("path", "kind", "hash", F.col("length").alias("size"))
        out.append(_shaped(with_parents(_shaped(sized), 0, 0, 16877 - i, among=rows)))
    return out


def hierarchy(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(paths, blobs): region / nation / customer / order; blobs repeat across orders."""
    region, nation, customer, orders = (read(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders"))
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.concat_ws("|", "o_orderpriority", "o_orderstatus", (F.col("o_orderkey") % 50).cast("string"))
    files = rows.select(
        F.concat_ws("/", "r_name", "n_name", F.replace("c_name", F.lit("/"), F.lit("_")), F.col("o_orderkey").cast("string")).alias("path"),
        F.lit("regular").alias("kind"), F.sha2(as_bytes(key), 256).alias("hash"), (F.octet_length(key) * 10 + F.col("o_orderkey") % 50).cast("long").alias("size"),
    )
    return _shaped(with_parents(_shaped(files), 0, 0, 16877)), files.select("hash", F.col("size").alias("length")).dropDuplicates(["hash"])


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, user_id, ts, event_type, k, first, second): first and second hold the event ids of the parents, null if there is none. No hash is moved."""
    events = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", F.get_json_object("props", "$.k").alias("k"))
    # Sixteen users make a block; an event is in its user's, and in the one before if a user there may ask for it. So all windows share one shuffle.
    block = F.shiftright("user_id", 4)
    places = F.when(F.pmod("user_id", F.lit(16)) == 0, F.array(block, block - 1)).otherwise(F.array(block))
    rows = events.withColumn("block", F.explode(places)).withColumn("home", F.col("block").eqNullSafe(block)).repartition("block")
    own = W.partitionBy("block", "user_id").orderBy("ts", "event_id")
    rows = rows.withColumn("first", F.lag(F.struct("event_id")).over(own))
    # The latest event of user_id + 1 before a purchase: a purchase stands among them too, as an as-of join without a join.
    asking = F.coalesce((F.col("event_type") == "purchase") & F.col("user_id").isNotNull() & F.col("home"), F.lit(False))
    rows = rows.withColumn("ask", F.explode(F.when(asking, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    rows = rows.withColumns({"u": F.col("user_id") + F.col("ask"), "had": F.when(F.col("ask") == 0, F.struct("event_id"))})
    before = W.partitionBy("block", "u").orderBy("ts", F.desc("ask"), "event_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    second = F.when(F.col("ask") == 1, F.last("had", True).over(before))
    return rows.withColumn("second", second).withColumn("asks", asking).where("home and (ask = 1 or not asks)").select("event_id", "user_id", "ts", "event_type", "k", "first", "second")


def commits(spark: SparkSession, sf_dir: str, once: bool = False) -> DataFrame:
    """(event_id, user_id, hash, tree, parents, ...): an event is a commit; its user's event before it is the first parent, and a purchase merges
    the latest earlier event of the next user. With once the events are linked once, for queries that read the history several times."""
    rows = _linked(spark, sf_dir)
    if once:
        scratch = Scratch(spark)
        rows = scratch.table(rows, "linked", "zstd")
        scratch.release()
    id_of = lambda c: F.sha2(as_bytes(F.concat(F.lit("commit "), F.col(c).cast("string"))), 256)
    tree = F.sha2(as_bytes(F.concat(F.lit("tree "), (F.col("event_id") % 500).cast("string"))), 256)
    parents = F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), id_of(f"{c}.event_id")) for c in ("first", "second"))))
    meta = F.when(F.col("k").isNotNull(), F.create_map(F.lit("k"), F.col("k"))).otherwise(F.create_map().cast("map<string,string>"))
    return rows.select(
        "event_id", "user_id", "ts", id_of("event_id").alias("hash"), tree.alias("tree"), parents.alias("parents"), F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("author"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("timestamp"), F.col("event_type").alias("message"), meta.alias("metadata"),
    )


def heads(history: DataFrame) -> DataFrame:
    """(name, hash): one ref for each user, at the latest event."""
    last = history.groupBy("user_id").agg(F.max_by("hash", F.struct("ts", "event_id")).alias("hash"))
    return last.select(F.concat(F.lit("users/"), F.col("user_id").cast("string")).alias("name"), "hash")


def refs_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event writes its user's ref; users divisible by 10 delete it in the end."""
    history = commits(spark, sf_dir)
    name = F.concat(F.lit("users/"), F.col("user_id").cast("string"))
    writes = history.select(F.lit("heads").alias("namespace"), name.alias("name"), "hash", F.unix_micros(F.col("ts").cast("timestamp")).alias("seq"))
    drops = history.where("user_id % 10 = 0").select("user_id").distinct().select(F.lit("heads").alias("namespace"), name.alias("name"), F.lit(None).cast("string").alias("hash"), F.lit(1 << 62).alias("seq"))
    return writes.unionByName(drops)


def store(spark: SparkSession, sf_dir: str, history: DataFrame | None = None) -> dict[str, DataFrame]:
    """A damaged store over the history (made if not given): trees of one to three blobs; some commits and blobs missing, some hashes wrong."""
    history = commits(spark, sf_dir) if history is None else history
    kept = history.where("event_id % 97 <> 0")
    n = history.select((F.col("event_id") % 500).alias("t")).distinct().select("t", F.sha2(as_bytes(F.concat(F.lit("tree "), F.col("t").cast("string"))), 256).alias("tree_hash"))
    slots = n.withColumn("i", F.explode(F.sequence(F.lit(0), (F.col("t") % 3).cast("int"))))
    blob = F.sha2(as_bytes(F.concat(F.lit("blob "), ((F.col("t") * 7 + F.col("i")) % 600).cast("string"))), 256)
    entries = slots.select("tree_hash", F.concat(F.lit("f"), F.col("i").cast("string")).alias("name"), F.lit("regular").alias("kind"), blob.alias("hash"))
    trees = n.where("t % 41 <> 3").select(F.col("tree_hash").alias("hash"), (F.col("t") + 1).cast("long").alias("length"))
    blobs = spark.range(700).where("id % 53 <> 5").select(F.sha2(as_bytes(F.concat(F.lit("blob "), F.col("id").cast("string"))), 256).alias("hash"), (F.col("id") * 3 + 10).alias("length"))
    for c in PAYLOAD_COLUMNS[2:]:
        entries = entries.withColumn(c, F.lit(None).cast(PATHS[c].dataType))
    return {"commits": kept, "tree_entries": entries, "trees": trees, "blobs": blobs, "refs": heads(history).where(~F.col("name").rlike("0$"))}


def nested(spark: SparkSession, sf_dir: str, damaged: bool = False) -> dict[str, DataFrame]:
    """A store of both document snapshots, a commit each, with a ref to the first. Damaged: the first only, without the tree de/src3 and some
    blobs, an entry of en/src1 gone, and a stray tree."""
    parts = [merkle(v1(spark, sf_dir))] if damaged else [merkle(v1(spark, sf_dir)), merkle(v2(spark, sf_dir))]
    entries, trees, commits_, blobs = [], [], [], []
    for i, full in enumerate(parts):
        folders = full.where("kind = 'directory'")
        own = tree_entries(full)
        if damaged:
            hash_of = {r["path"]: r["hash"] for r in folders.where("path in ('de/src3', 'en/src1')").select("path", "hash").collect()}
            first = own.where(F.col("tree_hash") == hash_of.get("en/src1")).agg(F.min("name")).first()[0]
            cut = (F.col("tree_hash") == F.lit(hash_of.get("en/src1"))) & (F.col("name") == F.lit(first))
            own = own.where((F.col("tree_hash") != F.lit(hash_of.get("de/src3", ""))) & ~F.coalesce(cut, F.lit(False)))
            folders = folders.where("path <> 'de/src3'")
        entries.append(own)
        trees.append(folders.select("hash", F.col("n_entries").alias("length")))
        commits_.append(full.where("path = ''").select(F.sha2(F.lit(f"nested {i}").cast("binary"), 256).alias("hash"), F.col("hash").alias("tree"), F.array().cast("array<string>").alias("parents")))
        blobs.append(hashed((files_v1, files_v2)[i](spark, sf_dir)).select("hash", "length"))
    out = {"tree_entries": reduce(DataFrame.unionByName, entries).dropDuplicates(["tree_hash", "name"]), "trees": reduce(DataFrame.unionByName, trees).dropDuplicates(["hash"])}
    out |= {"commits": reduce(DataFrame.unionByName, commits_), "blobs": reduce(DataFrame.unionByName, blobs).dropDuplicates(["hash"])}
    out["refs"] = commits_[0].select(F.lit("main").alias("name"), "hash")
    if damaged:
        out["trees"] = out["trees"].unionByName(spark.createDataFrame([(hashlib.sha256(b"stray").hexdigest(), 1)], "hash string, length long"))
        out["blobs"] = out["blobs"].where("substr(hash, 1, 1) <> '7'")
        # The commit is as it should be.
        row = out["commits"].withColumns({"author": F.lit("a"), "timestamp": F.lit(0).cast("long"), "message": F.lit(""), "metadata": F.create_map().cast("map<string,string>")})
        out["commits"] = row.withColumn("hash", commit_hash())
        out["refs"] = out["commits"].select(F.lit("main").alias("name"), "hash")
    return out


def id_maps(spark: SparkSession, shift: int = 0) -> DataFrame:
    """Two ranges for user ids, the same for group ids; shift moves the outside ids."""
    rows = [(t, i, a, b + shift, c) for t in ("uid", "gid") for i, (a, b, c) in enumerate(((0, 1000, 1), (1, 100000, 65536)))]
    return spark.createDataFrame(rows, "id_type string, ord long, inside_start long, outside_start long, count long")


def owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, uid, gid): ids inside and outside of the ranges."""
    docs = read(spark, sf_dir, "documents")
    uid = F.when(F.col("doc_id") % 5 == 0, F.lit(1000)).when(F.col("doc_id") % 7 == 0, F.col("doc_id")).otherwise(100000 + F.col("doc_id") * 131 % 70000)
    return docs.select("doc_id", uid.cast("long").alias("uid"), (100000 + F.col("doc_id") % 50).cast("long").alias("gid"))


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, tree, manifest_hash, output, hash) from parts."""
    part = read(spark, sf_dir, "part")
    rows = part.select(
        F.concat_ws("/", F.replace("p_brand", F.lit("#"), F.lit("-")), F.replace("p_type", F.lit(" "), F.lit("-")), F.col("p_partkey").cast("string")).alias("path"),
        F.sha2(as_bytes(F.concat(F.lit("tree "), F.col("p_size").cast("string"))), 256).alias("tree"), F.sha2(as_bytes("p_name"), 256).alias("manifest_hash"),
        F.when(F.col("p_partkey") % 2 == 0, F.lit("outputs/bin")).otherwise(F.lit("bundles/dev")).alias("output"),
    )
    return rows.withColumn("hash", artifact_hash())


def inodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files for hardlink detection: parts of one name and size share an inode."""
    docs = read(spark, sf_dir, "documents")
    ino = F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") % 40).otherwise(F.col("doc_id") + 1000)
    return docs.select(doc_path().alias("path"), F.lit("regular").alias("file_type"), F.lit(1).cast("long").alias("dev"), ino.cast("long").alias("ino"), F.when(F.col("doc_id") % 3 == 0, F.lit(2)).otherwise(F.lit(1)).cast("long").alias("nlink"))
