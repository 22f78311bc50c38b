"""Connected components by distributed label passing; nothing of the graph reaches the driver but one changed-count a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import cut

#: Shares that the nodes of one label are dealt into, as a label may hold a third of all nodes.
SHARES = 16


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). Returns node, component (the least node reachable) for every node with an edge.

    Each round a node takes the least label among its neighbours and itself, then its label's label; the rounds needed
    grow with the logarithm of a component's diameter in practice. Every round is cut into shared storage.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = cut(labels.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")))
        # Only labels whose node has a smaller one by now lead further; there is one row of each, which goes to every share of its label.
        jump = step.select("label").distinct().join(step.select(F.col("node").alias("label"), F.col("label").alias("further")), "label").where("further < label")
        jump = jump.select("label", "further", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long"))).alias("share"))
        dealt = step.withColumn("share", F.pmod(F.xxhash64("node"), F.lit(SHARES).cast("long")))
        after = cut(dealt.join(jump, ["label", "share"], "left").select("node", "old", F.coalesce("further", "label").alias("label")))
        changed = after.where("label <> old").limit(1).count()
        labels = after.select("node", "label")
        if not changed:
            return labels.select("node", F.col("label").alias("component"))
