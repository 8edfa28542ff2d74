"""Connected components of a graph in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import keep


def components(edges: DataFrame) -> DataFrame:
    """node and component (the smallest node it reaches) for each node of edges (a, b); neither end may be null.

    Each round takes the smallest label among neighbours, then the label's own label, so long chains shorten by jumps.
    Labels stay in tables; the driver sees one count a round.
    """
    both = keep(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = keep(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels.node == near.a).select("node", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("_at"), F.col("label").alias("_to"))
        after = keep(lower.join(jump, F.col("low") == F.col("_at"), "left").select("node", F.col("label").alias("_was"), F.coalesce("_to", "low").alias("label")), "labels")
        labels = after.select("node", "label")
        if after.where("label <> _was").isEmpty():
            return labels.withColumnRenamed("label", "component")
