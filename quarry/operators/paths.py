"""Source-to-sink paths over call graphs: sink rules, breadth-first paths in location order, ranking, betweenness."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.plans.cut import cut


@dataclass(frozen=True)
class SinkRule:
    """A category of sinks: its severity and the hints that a call's name or code must hold, whatever their case."""

    category: str
    severity: int
    hints: tuple[str, ...]


def classify_sink(rules: list[SinkRule], name: Column, code: Column) -> Column:
    """Struct (category, severity) of the most severe fitting rule, the earlier one on ties; null if none fits.

    Names of operators (<operator>...) are not compared.  The rules are a parameter and become one expression, no join.
    """
    low_name, low_code = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(code, F.lit("")))
    low_name = F.when(low_name.startswith("<operator>"), "").otherwise(low_name)
    ranked = sorted(enumerate(rules), key=lambda x: (-x[1].severity, x[0]))
    found = F.lit(None).cast("struct<category:string,severity:int>")
    for _, rule in reversed(ranked):
        fits = F.lit(False)
        for hint in rule.hints:
            fits = fits | F.contains(low_name, F.lit(hint.lower())) | F.contains(low_code, F.lit(hint.lower()))
        found = F.when(fits, F.struct(F.lit(rule.category).alias("category"), F.lit(rule.severity).alias("severity"))).otherwise(found)
    return found


def location_key(prefix: str = "") -> list[Column]:
    """The order of calls that doesn't depend on ids: file, line, column, code; the id only decides between equal ones."""
    c = lambda n: F.col(prefix + n)
    return [F.coalesce(c("file"), F.lit("")), F.coalesce(c("line"), F.lit(-1)), F.coalesce(c("column"), F.lit(-1)), F.coalesce(c("code"), F.lit("")), c("uid")]


def flow_sources(flows: DataFrame, entry_calls: DataFrame) -> DataFrame:
    """uid: calls that taint themselves (src = dst) and calls inside entry methods."""
    loops = flows.where("src = dst").select(F.col("src").alias("uid"))
    return loops.unionAll(entry_calls.select("uid")).where("uid is not null").distinct()


def first_paths(calls: DataFrame, flows: DataFrame, sources: DataFrame, max_depth: int = 12) -> DataFrame:
    """(uid, origin, depth, path): the path on which a search from all sources at once first meets each call.

    calls: uid, file, line, column, code; flows: src, dst; sources: uid.  Sources and neighbours are taken in location
    order, first come first served.  Each level keeps the order in which a queue would hold its calls as an increasing
    number (`pos`, not dense), which a range-partitioned sort gives, so no window gathers a level in one task.
    """
    place = calls.select("uid", "file", "line", "column", "code")
    edges = flows.where("src <> dst").select("src", "dst").distinct()

    def numbered(d: DataFrame, *before: str) -> DataFrame:
        order = [*before, *location_key()]
        return cut(d.join(place, "uid").orderBy(*order).withColumn("pos", F.monotonically_increasing_id()).select("uid", "pos", "origin", "depth", "path"))

    start = sources.select("uid").distinct()
    front = numbered(start.select("uid", F.col("uid").alias("origin"), F.lit(0).alias("depth"), F.array("uid").alias("path")))
    seen = front
    for depth in range(1, max_depth + 1):
        if front.isEmpty():
            break
        step = front.join(edges, front["uid"] == edges["src"]).select(F.col("dst").alias("uid"), F.struct("pos", "origin", "path").alias("by"))
        new = step.groupBy("uid").agg(F.min_by("by", "by.pos").alias("by")).join(seen.select("uid"), "uid", "left_anti")
        new = new.select("uid", F.col("by.pos").alias("parent"), "by.origin", F.lit(depth).alias("depth"), F.concat("by.path", F.array("uid")).alias("path"))
        front = numbered(new, "parent")
        seen = cut(seen.unionAll(front))
    return seen.select("uid", "origin", "depth", "path")


def candidate_flows(calls: DataFrame, flows: DataFrame, sources: DataFrame, rules: list[SinkRule], scan_id: str, max_depth: int = 12, most: int = 300) -> DataFrame:
    """(uid, source_uid, sink_uid, sink_category, severity, path_uids, rank): the first `most` sinks that sources reach.

    calls also has name and, if known, centrality.  Rank is by severity, centrality, path length, location of the sink.
    """
    central = F.col("centrality") if "centrality" in calls.columns else F.lit(0.0)
    sinks = calls.withColumn("__sink", classify_sink(rules, F.col("name"), F.col("code"))).where("__sink is not null").withColumn("__central", F.coalesce(central, F.lit(0.0)))
    hit = first_paths(calls, flows, sources, max_depth).join(sinks, "uid")
    order = [F.desc("__sink.severity"), F.desc("__central"), F.size("path"), *location_key()]
    top = hit.orderBy(*order).limit(most)
    # `most` rows are left: numbering them in one task is bounded by the parameter
    packed = top.select(F.struct((-F.col("__sink.severity")).alias("s"), (-F.col("__central")).alias("c"), F.size("path").alias("n"), *(k.alias(f"k{i}") for i, k in enumerate(location_key()))).alias("o"), F.struct("uid", "origin", F.col("__sink.category").alias("category"), F.col("__sink.severity").alias("severity"), "path").alias("v"))
    rows = packed.agg(F.array_sort(F.collect_list(F.struct("o", "v"))).alias("rows")).select(F.posexplode("rows").alias("rank", "row"))
    v = F.col("row.v")
    uid = F.sha1(F.concat_ws("|", F.lit(scan_id), F.lit("CandidateFlow"), v["origin"], v["uid"]))
    return rows.select(uid.alias("uid"), v["origin"].alias("source_uid"), v["uid"].alias("sink_uid"), v["category"].alias("sink_category"), v["severity"].alias("severity"), v["path"].alias("path_uids"), F.col("rank").cast("bigint").alias("rank"))


def betweenness(edges: DataFrame, nodes: DataFrame, pivots: DataFrame | None = None) -> DataFrame:
    """(node, centrality): directed betweenness, divided by (n - 1)(n - 2), of nodes (node) over edges (src, dst).

    Shortest paths are counted level by level forwards and shared out level by level backwards, for all pivots (node;
    all nodes if none are given) side by side, as rows of (pivot, node).  Fewer pivots scale the sums by n / pivots.
    """
    n = nodes.select("node").distinct()
    e = cut(edges.where("src <> dst").select("src", "dst").distinct().join(n.withColumnRenamed("node", "src"), "src").join(n.withColumnRenamed("node", "dst"), "dst"))
    p = (n if pivots is None else pivots.select("node").distinct().join(n, "node")).withColumnRenamed("node", "pivot")
    count, n_pivots = n.count(), p.count()
    levels = [cut(p.select("pivot", F.col("pivot").alias("node"), F.lit(1.0).alias("sigma")))]
    seen = levels[0].select("pivot", "node")
    while True:
        step = levels[-1].join(e, levels[-1]["node"] == e["src"]).groupBy("pivot", F.col("dst").alias("node")).agg(F.sum("sigma").alias("sigma"))
        new = cut(step.join(seen, ["pivot", "node"], "left_anti"))
        if new.isEmpty():
            break
        levels.append(new)
        seen = cut(seen.unionAll(new.select("pivot", "node")))
    share, total = None, None
    for near, far in zip(levels[-2::-1], levels[:0:-1]):
        f = far.select("pivot", F.col("node").alias("dst"), F.col("sigma").alias("far_sigma"))
        f = f.withColumn("owed", F.lit(1.0)) if share is None else f.join(share, ["pivot", "dst"], "left").withColumn("owed", 1 + F.coalesce("share", F.lit(0.0)))
        back = near.join(e.withColumnRenamed("src", "node"), "node").join(f, ["pivot", "dst"])
        share = cut(back.groupBy("pivot", F.col("node").alias("dst")).agg(F.sum(F.col("sigma") / F.col("far_sigma") * F.col("owed")).alias("share")))
        part = share.where("pivot <> dst").groupBy(F.col("dst").alias("node")).agg(F.sum("share").alias("sum"))
        total = part if total is None else total.unionAll(part)
    scale = (count / n_pivots if n_pivots else 0.0) / ((count - 1) * (count - 2)) if count > 2 else 1.0
    if total is None:
        return n.withColumn("centrality", F.lit(0.0))
    total = total.groupBy("node").agg(F.sum("sum").alias("sum"))
    return n.join(total, "node", "left").select("node", (F.coalesce("sum", F.lit(0.0)) * scale).alias("centrality"))
