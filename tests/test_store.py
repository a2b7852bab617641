"""What a store keeps besides commits."""

import pytest

from treeledger import errors as E
from treeledger.functions.text import remote_parts
from treeledger.operators import refs
from treeledger.schema import SOURCE_FILES
from treeledger.sources.directory import id_map_rows
from treeledger.store import Store


def test_artifacts_ids_and_lock(spark, tmp_path):
    maps = id_map_rows(spark, "0 1000 1", "uid").unionByName(id_map_rows(spark, "0 1000 1", "gid"))
    store = Store.create(spark, str(tmp_path / "s"), maps)
    one = store.write_artifact("pkg/a", "t" * 64, "m" * 64, "bundles/dev")
    assert one == store.write_artifact("pkg/b", "t" * 64, "m" * 64, "bundles/dev") != store.write_artifact("pkg/c", "t" * 64, "m" * 64, "bundles/full")
    assert store.table("artifacts").count() == 2 and store.exists("artifacts", one) and store.read_artifact(one)["output"] == "bundles/dev"
    with pytest.raises(E.ObjectNotFound):
        store.read_artifact("0" * 64)
    assert store.delete_refs("pkg/*", refs.ARTIFACTS) == ["pkg/a", "pkg/b", "pkg/c"] and store.refs(refs.ARTIFACTS).count() == 0

    def files(uid):
        row = {"path": "f", "file_type": "regular", "uid": uid, "gid": 1000, "mode": 0o100644, "size": 1, "ino": 1, "dev": 1, "nlink": 1, "content": bytearray(b"x")}
        return spark.createDataFrame([tuple(row.get(n) for n in SOURCE_FILES.names)], SOURCE_FILES)

    store.commit(files(1000), "main")
    assert (store.table("blobs").first().uid, store.table("blobs").first().gid) == (0, 0)
    assert {r.object_type for r in store.objects().collect()} == {"blob", "tree", "commit"}
    with pytest.raises(E.UnmappedUid):
        store.commit(files(5), "main")
    with Store(spark, str(tmp_path / "s")).locked(), pytest.raises(E.LockContention):
        store.write_ref("x", "0" * 64)
    with pytest.raises(E.InvalidRef):
        store.write_ref("a//b", "0" * 64)
    assert store.ref_exists("main") and not store.ref_exists("x")
    for bad in ("0" * 63, "g" * 64, ""):
        with pytest.raises(E.InvalidHashHex):
            store.exists("blobs", bad)


def test_remote_addresses():
    assert remote_parts("me@host") == ("me", "host") and remote_parts("host") == (None, "host")
    for bad in ("", "me@", "@host"):
        with pytest.raises(E.RemoteNotFound):
            remote_parts(bad)
