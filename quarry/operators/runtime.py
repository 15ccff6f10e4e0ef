"""What a run of a program says of its static graph: places resolved to methods and calls, coverage, observed edges.

Static methods are rows (seq, file, line, full_name) and calls (seq, file, line, uid, name); seq is the order in which they
were read, which settles ties.  Traces are rows of files, lines, names and hits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.code import stable_uid
from quarry.operators import joins
from quarry.operators.matching import base_name
from quarry.plans.cut import cut


def plain_path(path: Column) -> Column:
    """A path with / for \\ and without one leading ./."""
    return F.regexp_replace(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")), r"^\./", "")


def short_name(name: Column) -> Column:
    """What stands after the last . or : of a name."""
    return F.element_at(F.split(F.coalesce(name, F.lit("")), "[.:]"), -1)


def made_up(full_name: Column) -> Column:
    """How much a method looks made by the parser: 2 for adapters of classes, 1 more for a name in angle brackets."""
    adapter = F.contains(full_name, F.lit("metaClass")) | F.contains(full_name, F.lit("fakeNew"))
    return adapter.cast("int") * 2 + F.contains(F.element_at(F.split(full_name, r"\."), -1), F.lit("<")).cast("int")


class Index:
    """Lookups of places in one scan's methods and calls."""

    def __init__(self, methods: DataFrame, calls: DataFrame):
        m = methods.select("seq", plain_path(F.col("file")).alias("file"), "line", "full_name").where("file <> '' and line is not null and full_name <> ''")
        best = F.min(F.struct(made_up(F.col("full_name")).alias("score"), "seq", "full_name"))
        #: One method for each line and short name, and one for each line: the least made up, then the first read.
        self.named = m.groupBy("file", "line", short_name(F.col("full_name")).alias("short")).agg(best.alias("best"))
        self.by_line = cut(m.groupBy("file", "line").agg(best.alias("best")).select("file", "line", "best.full_name"))
        c = calls.select("seq", plain_path(F.col("file")).alias("file"), "line", "uid", "name").where("file <> '' and line > 0 and uid <> ''")
        self.calls = c.withColumn("score", F.coalesce(F.col("name").startswith("<operator>"), F.lit(False)).cast("int"))
        self.call_lines = cut(c.select("file", "line").distinct())
        files = self.by_line.select("file").unionAll(self.call_lines.select("file")).distinct()
        #: The one file of a base name; names that several files share aren't here.
        self.by_base = cut(files.groupBy(base_name(F.col("file")).alias("base")).agg(F.count("*").alias("n"), F.min("file").alias("only")).where("n = 1").select("base", "only"))

    def _placed(self, points: DataFrame) -> DataFrame:
        """points with `at`: their file if it has methods, else the only file of its base name, if that has; looked up by file."""
        known = self.by_line.select("file").distinct()
        d = points.select("file").distinct().join(known.select(F.col("file").alias("__f")), F.col("file") == F.col("__f"), "left")
        only = self.by_base.join(known.select(F.col("file").alias("only")), "only").select(F.col("base").alias("__base"), "only")
        d = d.join(only, base_name(F.col("file")) == F.col("__base"), "left")
        return points.join(cut(d.select("file", F.coalesce("__f", "only").alias("at"))), "file", "left")

    def exact(self, points: DataFrame) -> DataFrame:
        """points (file, line, name) with exact: the method declared on that line; of several the one of that short name,
        else the least made up, else the first read."""
        keys = self._placed(points.select("file", "line", "name").distinct())
        first = self.by_line.select(F.col("file").alias("at"), "line", F.col("full_name").alias("first"))
        same = self.named.select(F.col("file").alias("at"), "line", "short", F.col("best.full_name").alias("same"))
        keys = keys.join(first, ["at", "line"]).withColumn("short", F.when(F.col("name") != "", short_name(F.col("name"))))
        # merged: aggregated methods would be taken for as small as the files that they are read from, and sent whole to the driver
        found = keys.join(same.hint("merge"), ["at", "line", "short"], "left").withColumn("exact", F.coalesce("same", "first"))
        f = found.select(F.col("file").alias("__f"), F.col("line").alias("__l"), F.col("name").alias("__n"), "exact")
        return points.join(f, (F.col("file") == F.col("__f")) & (F.col("line") == F.col("__l")) & F.col("name").eqNullSafe(F.col("__n")), "left").drop("__f", "__l", "__n")

    def containing(self, points: DataFrame) -> DataFrame:
        """points (file, line, ...) with inside: the method of the greatest declaration line at or before the line."""
        d = self._placed(points)
        return joins.asof(d, self.by_line.withColumnRenamed("file", "at"), "at", "line", "full_name").withColumnRenamed("asof_full_name", "inside").drop("at")

    def calls_at(self, points: DataFrame) -> DataFrame:
        """(file, line, uid, score, seq): the calls on each distinct place, else those on that line of the only file of its base name."""
        keys = cut(points.select("file", "line").distinct())
        c = self.calls.select("file", "line", "uid", "score", "seq")
        own = cut(keys.join(c, ["file", "line"]))
        rest = keys.join(own.select("file", "line").distinct(), ["file", "line"], "left_anti")
        rest = rest.join(self.by_base, base_name(F.col("file")) == F.col("base")).select("file", "line", "only")
        other = rest.join(c.withColumnRenamed("file", "only"), ["only", "line"]).select(*own.columns)
        return own.unionAll(other)


def line_of_offset(points: DataFrame, starts: DataFrame) -> DataFrame:
    """points (file, offset, ...) with line: the last line (file, line, offset) that starts at or before the offset; 1 before all."""
    found = joins.asof(points, starts, "file", "offset", "line")
    return found.withColumn("line", F.coalesce("asof_line", F.lit(1).cast(starts.schema["line"].dataType))).drop("asof_line")


def line_counts(ranges: DataFrame, starts: DataFrame, bucket: int = 4096) -> DataFrame:
    """(file, line, hits): each line's count, that of the innermost range (file, range_id, start, stop, hits; stop not
    included) around its first character; lines of no hits are left out."""
    spans = ranges.select("file", F.col("range_id").alias("span_id"), "start", (F.col("stop") - 1).alias("stop"))
    at = joins.innermost(starts.select("file", "line", "offset"), spans, "file", "offset", bucket)
    hits = ranges.select("file", F.col("range_id").alias("span_id"), "hits")
    return at.join(hits, ["file", "span_id"]).where("hits > 0").select("file", "line", "hits")


def merge(traces: list[DataFrame], keys: list[str], hits: str | None = "hits") -> DataFrame:
    """Traces as one: hits summed by keys; without hits the distinct keys."""
    every = reduce(DataFrame.unionByName, traces)
    return every.select(*keys).distinct() if hits is None else every.groupBy(*keys).agg(F.sum(hits).alias(hits))


class Correlation:
    """A trace on a static index: hits by call and by method, methods that only the run has, observed edges, what was dropped.

    methods: seq, file, line, name, hits; coverage: file, line, hits; calls: caller_ and callee_ file, line, name, and hits;
    dispatches: site_file, site_line and callee_ file, line, name.
    """

    def __init__(self, index: Index, scan_id: str, methods: DataFrame, coverage: DataFrame, calls: DataFrame, dispatches: DataFrame):
        self.index = index
        seen = cut(index.exact(methods))
        known = seen.where("exact is not null").groupBy(F.col("exact").alias("full_name")).agg(F.sum("hits").alias("hits"))
        named = seen.where("exact is null and coalesce(name, '') <> '' and not startswith(name, '<')")
        new = named.groupBy("file", "line", "name").agg(F.min("seq").alias("seq"), F.min_by("hits", "seq").alias("hits"))
        self.new_methods = cut(new.withColumn("uid", stable_uid(F.lit(scan_id), F.lit("ObservedMethod"), F.col("file"), F.col("line"), F.lit(0), F.col("name"))))
        # lines: the calls on them, and the hottest line of each method
        places = cut(coverage.groupBy("file", "line").agg(F.sum("hits").alias("hits"), F.max("hits").alias("most"), F.count("*").alias("n")))
        at = cut(index.calls_at(places).select("file", "line", "uid"))
        self.call_hits = places.join(at, ["file", "line"]).groupBy("uid").agg(F.sum("hits").alias("hits"))
        inside = cut(index.containing(places))
        hottest = inside.where("inside is not null and most > 0").groupBy(F.col("inside").alias("full_name")).agg(F.max("most").alias("hits"))
        self.method_hits = known.unionAll(hottest.join(known, "full_name", "left_anti"))
        rows = lambda d: d.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        lost_calls = rows(places.join(at.select("file", "line").distinct(), ["file", "line"], "left_anti"))
        # edges between the ends that can be resolved
        side = lambda d, s: self.endpoints(d.withColumns({"file": F.col(f"{s}_file"), "line": F.col(f"{s}_line"), "name": F.col(f"{s}_name")})).withColumnsRenamed({"kind": f"{s}_kind", "key": f"{s}_key"}).drop("file", "line", "name")
        ends = cut(side(side(calls, "caller"), "callee"))
        same = (F.col("caller_kind") == F.col("callee_kind")) & (F.col("caller_key") == F.col("callee_key"))
        fine = F.coalesce(F.col("caller_key").isNotNull() & F.col("callee_key").isNotNull() & ~same, F.lit(False))
        columns = ["type", "src_kind", "src", "dst_kind", "dst"]
        observed = ends.where(fine).select(F.lit("OBSERVED_CALL").alias("type"), F.col("caller_kind").alias("src_kind"), F.col("caller_key").alias("src"), F.col("callee_kind").alias("dst_kind"), F.col("callee_key").alias("dst"), "hits")
        sites = dispatches.select(F.col("site_file").alias("file"), F.col("site_line").alias("line"))
        first = index.calls_at(sites).groupBy(F.col("file").alias("site_file"), F.col("line").alias("site_line")).agg(F.min_by("uid", F.struct("score", "seq")).alias("site"))
        sent = cut(side(dispatches, "callee").join(first, ["site_file", "site_line"], "left"))
        good = F.col("site").isNotNull() & F.col("callee_key").isNotNull() & F.col("callee_line").isNotNull()
        made = sent.where(good).select(F.lit("OBSERVED_DISPATCH").alias("type"), F.lit("Call").alias("src_kind"), F.col("site").alias("src"), F.col("callee_kind").alias("dst_kind"), F.col("callee_key").alias("dst"), F.lit(1).cast("bigint").alias("hits"))
        self.edges = observed.unionAll(made).groupBy(*columns).agg(F.sum("hits").alias("hits"))
        self.dropped = {
            "coverage_no_call": lost_calls,
            "coverage_no_method": rows(inside.where("inside is null")),
            "call_unresolved": ends.where(~fine).count(),
            "dispatch_unresolved": sent.where(~good).count(),
        }

    def endpoints(self, points: DataFrame) -> DataFrame:
        """points (file, line, name, ...) with kind and key: the method declared there, else one that only the run has,
        by name or, for a nameless place, the first there, else the method around it."""
        d = self.index.containing(self.index.exact(points))
        own = self.new_methods.select(F.col("file").alias("__f"), F.col("line").alias("__l"), F.col("name").alias("__n"), F.col("uid").alias("__own"))
        there = self.new_methods.groupBy(F.col("file").alias("__f2"), F.col("line").alias("__l2")).agg(F.min_by("uid", "seq").alias("__there"))
        d = d.join(own, (F.col("file") == F.col("__f")) & (F.col("line") == F.col("__l")) & (F.col("name") == F.col("__n")), "left")
        d = d.join(there, (F.col("file") == F.col("__f2")) & (F.col("line") == F.col("__l2")), "left")
        run = F.when(F.coalesce("name", F.lit("")) != "", F.col("__own")).otherwise(F.col("__there"))
        kind = F.when(F.col("exact").isNotNull(), "Method").when(run.isNotNull(), "ObservedMethod").when(F.col("inside").isNotNull(), "Method")
        d = d.withColumn("kind", kind).withColumn("key", F.coalesce("exact", run, "inside"))
        return d.drop("exact", "inside", "__f", "__l", "__n", "__own", "__f2", "__l2", "__there")


def apply_hits(d: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """Rows of a table with executed and hit_count from hits (key, hits); what they said before is replaced."""
    kept = d.drop("executed", "hit_count")
    h = hits.select(F.col(key).alias("__k"), F.col("hits").alias("hit_count"))
    return kept.join(h, F.col(key) == F.col("__k"), "left").drop("__k").withColumn("executed", F.col("hit_count").isNotNull())


def novel_edges(observed: DataFrame, contains: DataFrame, resolves: DataFrame) -> DataFrame:
    """Observed pairs (src, dst) of methods that no static call links: contains (method, call), resolves (call, method)."""
    static = contains.select(F.col("src").alias("src"), F.col("dst").alias("call")).join(resolves.select(F.col("src").alias("call"), "dst"), "call").select("src", "dst")
    return observed.join(static, ["src", "dst"], "left_anti")


def unreachable_executed(nodes: DataFrame) -> DataFrame:
    """Nodes that ran though no entry reaches them."""
    return nodes.where("executed and not reachable_from_entry")


def runtime_order(flows: DataFrame, executed: DataFrame) -> DataFrame:
    """flows (uid, sink_uid, path_uids, rank) with sink_executed, share and run_rank: sinks that ran first, then by the
    share of the path that ran, then by rank."""
    ran = executed.select(F.col("uid").alias("step")).distinct().withColumn("__ran", F.lit(1.0))
    step = flows.select("uid", F.explode("path_uids").alias("step")).join(ran, "step", "left")
    share = step.groupBy("uid").agg(F.avg(F.coalesce("__ran", F.lit(0.0))).alias("share"))
    d = flows.join(share, "uid", "left").join(ran.select(F.col("step").alias("sink_uid"), F.lit(True).alias("sink_executed")), "sink_uid", "left")
    d = d.withColumns({"sink_executed": F.coalesce("sink_executed", F.lit(False)), "share": F.coalesce("share", F.lit(0.0))})
    by = Window.orderBy(F.desc("sink_executed"), F.desc("share"), "rank", "uid")  # a report's rows: at most as many as a scan keeps
    return d.withColumn("run_rank", F.row_number().over(by) - 1)


def profile_edges(nodes: DataFrame) -> DataFrame:
    """(profile, caller, callee) of a CPU profile's nodes (profile, id, function, url, line, children) whose urls lie inside
    the repository (no scheme but file, no node_modules, not above it); others are left out with their edges."""
    inside = F.col("url").rlike(r"^(?:file://)?[^<:]+$") & (F.col("url") != "") & ~F.contains("url", F.lit("node_modules"))
    name = F.concat_ws(":", F.regexp_replace("url", "^file://", ""), F.col("line").cast("string"), "function")
    n = nodes.withColumn("node", F.when(inside, name))
    up = n.select("profile", F.col("node").alias("caller"), F.explode("children").alias("id"))
    return up.join(n.select("profile", "id", F.col("node").alias("callee")), ["profile", "id"]).where("caller is not null and callee is not null").select("profile", "caller", "callee")


_WIRE = "array<array<string>>"


def to_wire(d: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """(by, wire): each group's rows as JSON lists of their values by position, in the order of the columns."""
    values = F.array(*(F.col(c).cast("string") for c in columns))
    return d.groupBy(*by).agg(F.to_json(F.array_sort(F.collect_list(values))).alias("wire"))


def from_wire(d: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The rows of to_wire() again; columns: name and type by position."""
    rest = [c for c in d.columns if c != "wire"]
    x = d.select(*rest, F.explode(F.from_json("wire", _WIRE)).alias("x"))
    return x.select(*rest, *(F.get("x", i).cast(t).alias(c) for i, (c, t) in enumerate(columns.items())))
