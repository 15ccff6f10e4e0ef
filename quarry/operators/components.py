"""Distributed connected components with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.plans.cut import forgetful_cut as cut


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Undirected components of an edge list: (node, component), component being the smallest node.

    Each round hooks every node to its smallest neighbour, jumps pointers to the roots and contracts the edges, so that
    the edge list shrinks at every round and a star or a chain needs few of them.  Minima are taken with partial
    aggregation; no neighbourhood is ever gathered.  The joins on a root that very many nodes point to are left to the
    adaptive split of skewed join partitions.  Nodes without an edge to another node don't appear: self loops and
    rows with a null end are ignored, repeated edges count once, an empty edge list gives an empty result.
    """
    a, b = F.col("a"), F.col("b")
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where(a != b)
    e = cut(e.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct())
    labels = None
    while not e.isEmpty():
        both = e.select(a.alias("n"), b.alias("m")).unionAll(e.select(b.alias("n"), a.alias("m")))
        hook = cut(both.groupBy("n").agg(F.min("m").alias("m")).select("n", F.least("n", "m").alias("p")))
        parent = hook
        while True:  # the way to the root halves each time
            onward = parent.select(F.col("n").alias("p"), F.col("p").alias("root"))
            parent = cut(parent.join(onward, "p").select("n", F.col("root").alias("p"), (F.col("p") != F.col("root")).alias("moved")))
            if parent.where("moved").isEmpty():
                break
            parent = parent.select("n", "p")
        if labels is None:
            labels = parent.select(F.col("n").alias("node"), F.col("p").alias("component"))
        else:
            step = parent.select(F.col("n").alias("component"), "p")
            labels = cut(labels.join(step, "component", "left").select("node", F.coalesce("p", "component").alias("component")))
        to_a, to_b = (parent.select(F.col("n").alias(k), F.col("p").alias(f"p{k}")) for k in "ab")
        moved = e.join(to_a, "a").join(to_b, "b").where(F.col("pa") != F.col("pb"))
        e = cut(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    return e.select(a.alias("node"), b.alias("component")) if labels is None else labels
