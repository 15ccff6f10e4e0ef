"""Data flow between calls: owners by pointer doubling, and flows along reaching definitions through arguments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.plans.cut import cut


def owners(parents: DataFrame, methods: DataFrame, max_height: int = 512) -> DataFrame:
    """(node, owner): the nearest method (node) at or above each node of parents (node, parent).

    Pointers double at each round, so a tree of height h takes log2(h) joins; nodes without a method above don't appear.
    """
    m = methods.select("node").distinct()
    up = parents.select("node", "parent").join(m, "node", "left_anti").groupBy("node").agg(F.min("parent").alias("parent"))
    own = m.select("node", F.col("node").alias("at"), F.lit(True).alias("done"))
    state = cut(up.join(m.select(F.col("node").alias("parent"), F.lit(True).alias("done")), "parent", "left").select("node", F.col("parent").alias("at"), F.coalesce("done", F.lit(False)).alias("done")))
    reach = 1
    while reach < max_height and not state.where("not done").isEmpty():
        onward = state.select(F.col("node").alias("at"), F.col("at").alias("next"), F.col("done").alias("then"))
        state = cut(state.join(onward, "at", "left").select("node", F.when(F.col("done") | F.col("next").isNull(), F.col("at")).otherwise(F.col("next")).alias("at"), (F.col("done") | F.coalesce("then", F.lit(False))).alias("done")))
        reach *= 2
    return own.unionAll(state).where("done").select("node", F.col("at").alias("owner"))


def real_arguments(argument_of: DataFrame, real_calls: DataFrame, max_height: int = 512) -> DataFrame:
    """(node, call, idx): the first real call above each node, and the argument index of the node just below that call.

    argument_of: node, parent, idx; real_calls: node.
    """
    real = real_calls.select(F.col("node").alias("parent"), F.lit(True).alias("real")).distinct()
    first = argument_of.groupBy("node").agg(F.min(F.struct("parent", "idx")).alias("p")).select("node", "p.parent", "p.idx")
    state = cut(first.join(real, "parent", "left").select("node", F.col("parent").alias("at"), "idx", F.coalesce("real", F.lit(False)).alias("done")))
    reach = 1
    while reach < max_height and not state.where("not done").isEmpty():
        onward = state.select(F.col("node").alias("at"), F.col("at").alias("next"), F.col("idx").alias("next_idx"), F.col("done").alias("then"))
        go = ~F.col("done") & F.col("next").isNotNull()
        state = cut(state.join(onward, "at", "left").select("node", F.when(go, F.col("next")).otherwise(F.col("at")).alias("at"), F.when(go, F.col("next_idx")).otherwise(F.col("idx")).alias("idx"), (F.col("done") | F.coalesce("then", F.lit(False))).alias("done")))
        reach *= 2
    return state.where("done").select("node", F.col("at").alias("call"), "idx")


def flows_to(seeds: DataFrame, reaching: DataFrame, arguments: DataFrame, params: DataFrame, from_seeds: bool = False) -> DataFrame:
    """(src, call, idx, provenance): which calls' arguments each seed's value gets to.

    seeds: node; reaching: src, dst; arguments: node, call, idx (real_arguments()); params: call, idx, param, the callee's
    parameter for an argument.  A walk from a seed s follows reaching definitions; a node that is an argument of a real
    call other than s is a hit and goes on only at the callee's parameter, crossed.  An argument of s itself is passed
    through.  A flow is proven if some walk without a crossing hits, else inferred.  from_seeds: the seeds themselves are
    walked first, as tainted parameters and request fields are.

    Semi-naive: each round joins only the states (seed, node, crossed) that are new, until there are none.
    """
    rd = cut(reaching.select(F.col("src").alias("node"), F.col("dst").alias("to")).distinct())
    args = arguments.select("node", "call", "idx")
    s = seeds.select(F.col("node").alias("src")).distinct()
    start = s.select("src", F.col("src").alias("node"))
    first = start if from_seeds else start.join(rd, "node").select("src", F.col("to").alias("node")).where("src <> node")
    front = cut(first.distinct().withColumn("crossed", F.lit(False)))
    seen = front if from_seeds else cut(front.unionAll(start.withColumn("crossed", F.lit(False))))
    hits = None
    while not front.isEmpty():
        at = front.join(args, "node", "left")
        stops = F.col("call").isNotNull() & (F.col("call") != F.col("src"))
        hit = cut(at.where(stops).select("src", "call", "idx", "crossed").distinct())
        hits = hit if hits is None else hits.unionAll(hit)
        into = hit.join(params, ["call", "idx"]).select("src", F.col("param").alias("node"), F.lit(True).alias("crossed"))
        along = at.where(~stops).join(rd, "node").select("src", F.col("to").alias("node"), "crossed")
        front = cut(into.unionAll(along).distinct().join(seen, ["src", "node", "crossed"], "left_anti"))
        seen = cut(seen.unionAll(front))
    if hits is None:
        hits = s.limit(0).select("src", F.col("src").alias("call"), F.lit(0).alias("idx"), F.lit(False).alias("crossed"))
    return hits.groupBy("src", "call", "idx").agg(F.when(F.min("crossed"), "inferred").otherwise("proven").alias("provenance"))
