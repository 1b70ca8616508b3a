"""Connected components of edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import checkpointed, forget


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): (node, root), the root being the least node.

    Each round takes the least label among the neighbours and then the label of
    that label, so long chains halve; each round is written once to the shared
    folder and the one before it removed. Loops and repeated edges change
    nothing; no edges give no rows.
    """
    both = checkpointed(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root"))
    last = None
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        low = labels.join(near, labels.node == near.a).select("node", "root", F.least("root", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("root").alias("further"))
        least = F.least("low", F.coalesce("further", "low"))
        new = checkpointed(low.join(jump, "low", "left").select("node", least.alias("root"), (least < F.col("root")).alias("moved")))
        if last is not None:
            forget(last)
        last, labels = new, new.select("node", "root")
        if not new.where("moved").limit(1).count():
            forget(both)
            return labels
