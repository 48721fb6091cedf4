"""Connected components, over edges too many for the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seaweft.checkpoints import durable

#: Tasks that the nodes of one root are dealt to.
SALTS = 16


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b): the smallest node of its component.

    A node and its root take the smallest label among the node's neighbours, then labels are shortcut, until a round
    changes nothing. Minima are combined before the shuffle, so a node with many neighbours is no hot spot.
    """
    both = durable(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = durable(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("root")))
    while True:
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("low"))
        lower = labels.join(around.withColumnRenamed("a", "node"), "node").withColumn("low", F.least("root", "low"))
        # votes for a root that many nodes share are counted in several tasks before they meet
        of_root = lower.groupBy(F.col("root").alias("node"), F.pmod(F.xxhash64("node"), F.lit(SALTS)).alias("salt")).agg(F.min("low").alias("to"))
        votes = lower.select("node", F.col("low").alias("to")).unionByName(of_root.select("node", "to"))
        hooked = durable(votes.groupBy("node").agg(F.min("to").alias("root")))
        # the nodes of a large component share a root: it is looked up once and the answer dealt out to several tasks
        used = hooked.select(F.col("root").alias("node")).distinct()
        over = hooked.join(used, "node").select(F.col("node").alias("root"), F.col("root").alias("top"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        salted = hooked.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
        after = salted.join(over, ["root", "salt"]).select("node", F.least("root", "top").alias("root"))
        labels_next = durable(after.join(labels.withColumnRenamed("root", "was"), "node"))
        if labels_next.where("root != was").isEmpty():
            return labels_next.select("node", "root")
        labels = labels_next.select("node", "root")
