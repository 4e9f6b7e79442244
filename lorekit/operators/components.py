"""Connected components by contraction: no link or component reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekit.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of an edge (a, b); component is the smallest node reachable.

    Each round hooks every node to its smallest smaller neighbour, follows that pointer twice, and replaces the
    ends of the remaining edges by their pointers; a hub is pre-aggregated or split by the skew join. The driver
    only asks whether edges are left."""
    hi, lo = F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")
    left = cut_lineage(edges.where("a <> b").select(hi, lo).distinct())
    nodes = left.select(F.explode(F.array("hi", "lo")).alias("node")).distinct()
    labels = nodes.select("node", F.col("node").alias("component"))
    while not left.isEmpty():
        hook = cut_lineage(left.groupBy("hi").agg(F.min("lo").alias("up")))
        for _ in range(2):
            nxt = hook.select(F.col("hi").alias("up"), F.col("up").alias("further"))
            hook = hook.join(nxt, "up", "left").select("hi", F.coalesce("further", "up").alias("up"))
        hook = cut_lineage(hook)
        to = lambda c: hook.select(F.col("hi").alias(c), F.col("up").alias(c + "_up"))
        labels = cut_lineage(labels.join(to("component"), "component", "left")
                             .select("node", F.coalesce("component_up", "component").alias("component")))
        moved = (left.join(to("hi"), "hi", "left").join(to("lo"), "lo", "left")
                 .select(F.coalesce("hi_up", "hi").alias("a"), F.coalesce("lo_up", "lo").alias("b")))
        left = cut_lineage(moved.where("a <> b").select(hi, lo).distinct())
    return labels
