"""Micro-batches of source files as commits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.store import Store


def commit_each_batch(files: DataFrame, store: Store, ref: str, checkpoint: str, **trigger):
    """Start a streaming query that commits each micro-batch of SOURCE_FILES rows to ref.

    A batch that is run again after a failure gives the same objects; its number is in the metadata, and one already at the head is skipped.
    """

    def commit(batch: DataFrame, number: int) -> None:
        head = store.refs().where(F.col("name") == ref).first()
        if head is not None:
            last = store.table("commits").where(F.col("hash") == head["hash"]).first()
            if last is not None and last["metadata"].get("batch") == str(number):
                return
        store.commit(batch, ref, message=f"batch {number}", timestamp=number, metadata={"batch": str(number)})

    return files.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
