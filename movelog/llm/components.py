"""Connected components of an edge table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, component: the smallest node reachable, for every node of the edges (a, b).

    A round passes labels over the edges and then follows each label to its own label, so chains
    shorten by a power each time; each round is written to the shared folder. No edges, no rows.
    """
    both = materialise(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), f"{name}-edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), f"{name}-0")
    step = 0
    while True:
        step += 1
        heard = both.join(labels.withColumnRenamed("node", "a"), "a").select(F.col("b").alias("node"), "component")
        lower = labels.union(heard).groupBy("node").agg(F.min("component").alias("component"))
        own = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
        jumped = lower.join(own, "component", "left").select("node", F.least("component", "next").alias("component"))
        new = materialise(jumped, f"{name}-{step}")
        changed = new.join(labels.withColumnRenamed("component", "old"), "node").where("component != old").limit(1).count()
        labels = new
        if not changed:
            return labels
