"""Connected components of an edge list by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripledger.llm.frames import Slots, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each end of the edges (a, b) can reach.

    Every round takes the smallest label among the neighbours and then the label of that label, so labels travel
    twice as far each round. A round is written to the shared folder, over the one before the last; the rounds end when no
    label changes.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(both.where("a <> b").distinct(), "edges")
    slots = Slots(edges.sparkSession)
    labels = slots.put(both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("node"), F.least("a", "m").alias("root"), F.col("a").alias("old")), "labels").select("node", "root")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("root").alias("r")), "b")
        near = near.groupBy("a").agg(F.min("r").alias("r"))
        near = labels.join(near, F.col("node") == F.col("a")).select(
            "node", F.col("root").alias("old"), F.least("root", "r").alias("root"))
        far = labels.select(F.col("node").alias("root"), F.col("root").alias("next"))
        after = slots.put(near.join(far, "root").select(
            "node", F.least("root", "next").alias("root"), "old"), "labels")
        labels = after.select("node", "root")
        if not after.where("old <> root").head(1):
            return labels
