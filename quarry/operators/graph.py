"""Reachability over edge lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.plans.cut import cut


def reachable(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """(node, hop): nodes that (src, dst) edges reach from entries (node), with the least number of hops.

    A level-by-level search: each level joins only the new nodes with the edges and drops what earlier levels had; it ends
    when a level has no new nodes.
    """
    seen = cut(entries.select("node").where("node is not null").distinct().withColumn("hop", F.lit(0)))
    front, hop = seen, 0
    while True:
        hop += 1
        step = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        front = cut(step.join(seen.select("node"), "node", "left_anti").withColumn("hop", F.lit(hop)))
        if front.isEmpty():
            return seen
        seen = cut(seen.unionAll(front))
