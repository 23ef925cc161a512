"""Connected components of an edge table by minimum labels and pointer jumping, as joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reconcilia.llm.common import saved


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of the (a, b) edges; component is the smallest id reachable.

    Each round takes the smallest label among a node and its neighbours and then that label's own
    label, so long chains shrink geometrically. Rounds are written tables, never driver collections;
    only the number of changed labels comes to the driver.
    """
    both = saved(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = saved(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("component")))
    while True:
        near = both.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("component").alias("near"))
        lower = saved(labels.join(near, F.col("id") == F.col("a")).select("id", F.col("component").alias("was"), F.least("component", "near").alias("component")))
        jump = lower.select(F.col("id").alias("component"), F.col("component").alias("root"))
        jumped = saved(lower.join(jump, "component").select("id", "was", F.least("component", "root").alias("component")))
        if jumped.where("component != was").isEmpty():
            return jumped.select("id", "component")
        labels = jumped.select("id", "component")
