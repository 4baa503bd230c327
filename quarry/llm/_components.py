"""Connected components of an edge table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._spark import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (least node reachable) for every node of an edge.

    Each round takes the least label among neighbours and then the label of that label, so paths of
    length n take about log n rounds. Rounds are written to the shared folder; only a count of changes
    reaches the driver. Aggregation before each shuffle keeps nodes with very many edges harmless.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).filter("node <> other")
    both = materialize(both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "edges")
    labels = materialize(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("component")), "labels")
    while True:
        around = both.join(labels.select(F.col("node").alias("other"), "component"), "other").groupBy("node").agg(F.min("component").alias("_least"))
        lower = labels.join(around, "node").select("node", F.col("component").alias("_was"), F.least("component", "_least").alias("component"))
        target = lower.select(F.col("node").alias("component"), F.col("component").alias("_jump"))
        jumped = lower.join(target, "component").select("node", "_was", F.least("component", "_jump").alias("component"))
        new = materialize(jumped, "labels")
        changed = new.filter("component <> _was").limit(1).count()
        labels = new.select("node", "component")
        if not changed:
            return labels
