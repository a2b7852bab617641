"""Connected components over edges that stay on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "cc", rounds: int | None = None) -> DataFrame:
    """(node, label): the smallest node reachable, for every node of the edges (a, b). After ``rounds``, if given, a label is some node reachable.

    Each round every node takes the smallest label among its neighbours and hands it to the root it pointed to, so whole basins
    are hooked at once; then it takes the label of its label (pointer jumping). Rounds grow with the logarithm of a chain (12 for
    20,000 nodes in random order). Labels are written each round, and rounds end only when none changes: then the ends of every edge
    have one label, the smallest node's. A node with very many neighbours or a root with very many nodes is no single
    group: its minimum is taken before the shuffle, and joins on it can be split.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = scratch.table(both, f"{name}-edges")
    labels = scratch.table(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), f"{name}-0")
    k, changed = 0, 1
    while changed and (rounds is None or k <= rounds):
        k += 1
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("m"))
        step = scratch.table(labels.join(near, labels["node"] == near["a"], "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("m", "label")).alias("label")), f"{name}-{k}-near")
        hooks = step.where("label < old").groupBy(F.col("old").alias("root")).agg(F.min("label").alias("hook"))
        hooked = step.join(hooks, step["node"] == hooks["root"], "left").select("node", "old", F.least("label", F.coalesce("hook", "label")).alias("label"))
        hooked = scratch.table(hooked, f"{name}-{k}-hooked")
        jump = hooked.select(F.col("node").alias("to"), F.col("label").alias("further"))
        out = hooked.join(jump, hooked["label"] == jump["to"], "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label"), "old")
        out = scratch.table(out, f"{name}-{k}")
        changed = out.where("label <> old").agg(F.count(F.lit(1))).first()[0]
        labels = out.select("node", "label")
        scratch.drop(f"{name}-{k - 1}", f"{name}-{k}-near", f"{name}-{k}-hooked")
    scratch.drop(f"{name}-edges")
    return labels
