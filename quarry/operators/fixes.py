"""What a fix changes of a code graph: sites of its hunks, flows through them, and the flows that are left afterwards.

Hunks are rows (id, seq, file, old_file, old_start, old_end, new_start, new_end), as texts.hunks gives them: closed ranges,
an empty side being (start, start - 1).  Methods are rows (file, line, full_name), calls (file, line, uid, name), flows
(uid, source_uid, sink_uid, path_uids, rank).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.code import is_test_path
from quarry.operators import joins
from quarry.operators.matching import base_name, same_file
from quarry.plans.cut import cut
from quarry.sources.texts import map_lines

SIDES = {"vulnerable": ("old_file", "old_start", "old_end"), "patched": ("file", "new_start", "new_end")}


_RANGE = ["file", "start", "end"]


def _ranges(hunks: DataFrame, methods: DataFrame, calls: DataFrame, side: str, window: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hunks of the side, names, held): the hunks' distinct ranges (file, start, end) are looked up, each once.

    names: each range's `at` and methods; held: the lines (range, line) whose calls it holds.
    """
    file, start, end = SIDES[side]
    h = hunks.select("id", "seq", F.col(file).alias("file"), F.col(start).alias("start"), F.col(end).alias("end")).where("file is not null")
    h = h.where(~is_test_path(F.col("file"))).withColumn("windowed", F.col("end") < F.col("start"))
    reach = F.when(F.col("windowed"), F.sequence(F.col("start") - window, F.col("start") + window)).otherwise(F.sequence("start", F.greatest("start", "end")))
    lines = cut(h.select(*_RANGE, "windowed").distinct()).select(*_RANGE, "windowed", F.explode(reach).alias("line"))
    places = lines.select("file", "line").unionAll(calls.select("file", "line")).distinct()
    around = cut(joins.asof(places, methods, "file", "line", "full_name").withColumnRenamed("asof_full_name", "around"))
    own = lines.where("line > 0 and (not windowed or line = start)").join(around, ["file", "line"])
    names = own.groupBy(*_RANGE).agg(
        F.max(F.when(F.col("line") == F.col("start"), F.col("around"))).alias("at"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("around").isNotNull(), F.struct("line", "around")))), lambda x: x["around"])).alias("methods"),
    )
    names = cut(names)
    held = lines.join(names.select(*_RANGE, "at"), _RANGE, "left").join(around, ["file", "line"])
    return h, names, cut(held.where(~F.col("windowed") | F.col("around").eqNullSafe(F.col("at"))).select(*_RANGE, "line"))


def _first() -> Column:
    return F.coalesce("at", F.when(~F.col("windowed"), F.try_element_at("methods", F.lit(1))))


def _looked_up(h: DataFrame, found: DataFrame) -> DataFrame:
    """Hunks with what was found for their range."""
    f = found.withColumnsRenamed({k: f"__{k}" for k in _RANGE})
    return h.join(f, [F.col(k) == F.col(f"__{k}") for k in _RANGE], "left")


def sites(hunks: DataFrame, methods: DataFrame, calls: DataFrame, side: str, window: int = 3) -> DataFrame:
    """(id, seq, file, start, end, method, methods, call_uids, windowed) of each hunk outside tests that has a file on the side.

    A range holds the calls on its lines; method is the one around its first line, else the first of those around its
    lines.  An empty side holds the calls within `window` lines of the place that have the same method around them.
    """
    h, names, held = _ranges(hunks, methods, calls, side, window)
    found = held.join(calls.select("file", "line", "uid"), ["file", "line"]).groupBy(*_RANGE).agg(F.array_sort(F.collect_set("uid")).alias("call_uids"))
    d = _looked_up(h, names.join(found, _RANGE, "full_outer"))
    none = F.array().cast("array<string>")
    return d.select("id", "seq", *_RANGE, _first().alias("method"), F.coalesce("methods", none).alias("methods"), F.coalesce("call_uids", none).alias("call_uids"), "windowed")


def site_counts(hunks: DataFrame, methods: DataFrame, calls: DataFrame, side: str, window: int = 3) -> DataFrame:
    """(id, seq, file, start, end, method, n_methods, n_calls, first_call, windowed): sites() with its lists counted, not made.

    Calls of one place are counted by line; only those of several places are met with the ranges one by one.
    """
    h, names, held = _ranges(hunks, methods, calls, side, window)
    c = calls.where("uid is not null").select("file", "line", "uid").join(held.select("file", "line").distinct(), ["file", "line"], "left_semi")
    c = c.repartition("uid").distinct().withColumn("n", F.count("*").over(Window.partitionBy("uid")))
    once = c.where("n = 1").groupBy("file", "line").agg(F.count("*").alias("n"), F.min("uid").alias("first_call"))
    once = held.join(once, ["file", "line"]).groupBy(*_RANGE).agg(F.sum("n").alias("n"), F.min("first_call").alias("first_call"))
    often = held.join(c.where("n > 1").select("file", "line", "uid"), ["file", "line"]).groupBy(*_RANGE).agg(F.count_distinct("uid").alias("n"), F.min("uid").alias("first_call"))
    found = once.unionAll(often).groupBy(*_RANGE).agg(F.sum("n").alias("n_calls"), F.min("first_call").alias("first_call"))
    d = _looked_up(h, names.join(found, _RANGE, "full_outer"))
    counted = F.when(F.col("methods").isNull(), 0).otherwise(F.size("methods")).cast("bigint")
    return d.select("id", "seq", *_RANGE, _first().alias("method"), counted.alias("n_methods"), F.coalesce("n_calls", F.lit(0).cast("bigint")).alias("n_calls"), "first_call", "windowed")


def flows_through(flows: DataFrame, uids: DataFrame) -> DataFrame:
    """flows that pass one of the calls uids (uid), with site_uids, those that they pass."""
    step = flows.select("uid", F.explode(F.array_distinct("path_uids")).alias("step")).join(uids.select(F.col("uid").alias("step")).distinct(), "step")
    hit = step.groupBy("uid").agg(F.array_sort(F.collect_set("step")).alias("site_uids"))
    return flows.join(hit, "uid")


def best_flow(flows: DataFrame, by: list[str]) -> DataFrame:
    """The best-ranked flow of each group: ranked ones before others, then by rank, then by uid."""
    rest = [c for c in flows.columns if c not in by]
    least = F.min_by(F.struct(*rest), F.struct(F.col("rank").isNull().alias("none"), F.coalesce("rank", F.lit(0)).alias("rank"), F.col("uid").cast("string").alias("uid")))
    return flows.groupBy(*by).agg(least.alias("best")).select(*by, "best.*")


def patched_flows(flows: DataFrame, calls: DataFrame, patched: DataFrame, patched_calls: DataFrame, hunks: DataFrame) -> DataFrame:
    """(uid, state, patched_uid) of each flow of the vulnerable scan: found, with the best-ranked flow of the patched scan
    whose ends are on the lines that the fix maps its ends to, in calls of the same names; gone; or unresolved, if an end
    isn't a call.  All scans and hunks are of one id."""
    place = cut(calls.select("uid", "file", "line", "name").dropDuplicates(["uid"]))
    ends = flows.select("uid", "source_uid", "sink_uid")
    known = ends.join(place.select(F.col("uid").alias("source_uid"), F.struct("file", "line", "name").alias("source")), "source_uid", "left")
    known = cut(known.join(place.select(F.col("uid").alias("sink_uid"), F.struct("file", "line", "name").alias("sink")), "sink_uid", "left"))
    asked = known.select("source.file", "source.line").unionAll(known.select("sink.file", "sink.line")).where("file is not null").distinct().withColumn("id", F.lit("fix"))
    to = map_lines(asked.select("id", "file", "line"), hunks.withColumn("id", F.lit("fix")))
    to = cut(to.where("new_file is not null and new_start <= new_end").select("file", "line", "new_file", F.explode(F.sequence("new_start", "new_end")).alias("new_line")))

    def on_patched(d: DataFrame, end: str) -> DataFrame:
        m = to.select(F.col("file").alias("__f"), F.col("line").alias("__l"), F.struct(F.col("new_file").alias("file"), F.col("new_line").alias("line")).alias("__to"))
        d = d.join(m, (F.col(f"{end}.file") == F.col("__f")) & (F.col(f"{end}.line") == F.col("__l"))).drop("__f", "__l")
        return d.withColumn(f"{end}_at", F.struct("__to.file", "__to.line", F.col(f"{end}.name").alias("name"))).drop("__to")

    wanted = on_patched(on_patched(known.where("source is not null and sink is not null"), "source"), "sink").select("uid", "source_at", "sink_at")
    there = cut(patched_calls.select("uid", F.struct("file", "line", "name").alias("at")).dropDuplicates(["uid"]))
    p = patched.select(F.col("uid").alias("patched_uid"), "source_uid", "sink_uid", "rank")
    p = p.join(there.select(F.col("uid").alias("source_uid"), F.col("at").alias("source_at")), "source_uid").join(there.select(F.col("uid").alias("sink_uid"), F.col("at").alias("sink_at")), "sink_uid")
    found = wanted.join(p, ["source_at", "sink_at"]).groupBy("uid").agg(F.min(F.struct(F.col("rank").isNull().alias("none"), F.coalesce("rank", F.lit(0)).alias("rank"), F.col("patched_uid").cast("string").alias("uid"))).alias("best"))
    d = known.join(found, "uid", "left")
    state = F.when(F.col("source").isNull() | F.col("sink").isNull(), "unresolved").when(F.col("best").isNull(), "gone").otherwise("found")
    return d.select("uid", state.alias("state"), F.col("best.uid").alias("patched_uid"))


def pair_yield(site_rows: DataFrame, flows: DataFrame, states: DataFrame) -> DataFrame:
    """(n_sites, n_site_calls, n_site_flows, gold_flow, reason, n_gone, n_unresolved) of one pair's vulnerable scan.

    site_rows: as sites() gives them; states: as patched_flows() gives them.
    """
    uids = site_rows.select(F.explode("call_uids").alias("uid")).distinct()
    through = cut(flows_through(flows, uids))
    n = site_rows.agg(F.count("*").alias("n_sites")).join(uids.agg(F.count("*").alias("n_site_calls")))
    gold = best_flow(through.select("uid", "rank", F.lit(0).alias("all")), ["all"]).select(F.col("uid").alias("gold_flow"))
    said = through.select("uid").join(states, "uid", "left").agg(F.count("*").alias("n_site_flows"), F.count_if(F.col("state") == "gone").alias("n_gone"), F.count_if(F.col("state") == "unresolved").alias("n_unresolved"))
    d = n.join(said).join(gold, F.lit(True), "left")  # a row each
    reason = F.when(F.col("n_site_calls") == 0, "no_site_nodes").when(F.col("n_site_flows") == 0, "no_flow_through_site")
    return d.select("n_sites", "n_site_calls", "n_site_flows", "gold_flow", reason.alias("reason"), "n_gone", "n_unresolved")


def entry_points(flows: DataFrame, calls: DataFrame, methods: DataFrame, entries: DataFrame) -> DataFrame:
    """(uid, entry): flows whose source lies inside an entry method (full_name)."""
    at = calls.select(F.col("uid").alias("source_uid"), "file", "line").dropDuplicates(["source_uid"])
    d = joins.asof(flows.select("uid", "source_uid").join(at, "source_uid"), methods, "file", "line", "full_name")
    return d.select("uid", F.col("asof_full_name").alias("entry")).join(entries.select(F.col("full_name").alias("entry")).distinct(), "entry").select("uid", "entry")


def touched_hunks(hunks: DataFrame, commits: DataFrame) -> DataFrame:
    """hunks (id, file, old_file, ...) of ids that have more than one fix commit only in files that one of these touched
    (commits: id, sha, file); the hunks of other ids stay."""
    several = commits.groupBy("id").agg(F.count_distinct("sha").alias("n")).where("n > 1").select("id", F.lit(True).alias("__several"))
    touched = commits.select("id", "file").where("file is not null").distinct()
    both = F.filter(F.array_distinct(F.array("file", "old_file")), lambda x: x.isNotNull())
    d = hunks.join(several, "id", "left").withColumn("__row", F.struct(*hunks.columns))
    names = d.where("__several").select("__row", "id", F.explode(both).alias("f")).join(touched.withColumnRenamed("file", "f"), ["id", "f"]).select("__row").distinct()
    return d.where("__several is null").select(*hunks.columns).unionAll(names.select("__row.*"))


def hydrate(paths: DataFrame, nodes: DataFrame, keep_absent: bool = False) -> DataFrame:
    """(uid, steps): each path's nodes (uid, and what else nodes has) in the path's order; absent ones are left out, or
    kept as their uid alone."""
    names = [c for c in nodes.columns if c != "uid"]
    step = paths.select("uid", F.posexplode("path_uids").alias("at", "step"))
    n = nodes.select(F.col("uid").alias("step"), F.struct(*names).alias("node")).dropDuplicates(["step"])
    d = step.join(n, "step", "left" if keep_absent else "inner")
    row = F.struct("at", F.col("step").alias("uid"), *(F.col("node")[c].alias(c) for c in names))
    g = d.groupBy("uid").agg(F.array_sort(F.collect_list(row)).alias("steps"))
    none = F.array().cast(g.schema["steps"].dataType)
    return paths.select("uid").join(g, "uid", "left").select("uid", F.coalesce("steps", none).alias("steps"))


def flows_of_files(flows: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """flows a step of which lies in one of files (file), equal paths or one the other's end from a / on."""
    step = flows.select("uid", F.explode("path_uids").alias("step")).join(nodes.select(F.col("uid").alias("step"), F.col("file").alias("at")), "step")
    step = step.withColumn("base", base_name(F.col("at"))).join(files.select("file", base_name(F.col("file")).alias("base")), "base")
    return flows.join(step.where(same_file(F.col("at"), F.col("file"))).select("uid").distinct(), "uid", "left_semi")


def commit_chains(commits: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, linear, earliest, latest) of each id's fix commits (wanted: id, sha) in a history of commits (sha, parent).

    linear: the commits form one chain of ancestors, whose ends are earliest and latest; else these are null.  Ancestors
    are walked level by level from all wanted commits at once.
    """
    w = cut(wanted.select("id", "sha").distinct())
    up = commits.select(F.col("sha").alias("node"), "parent").where("parent is not null").distinct()
    front = seen = cut(w.select(F.col("sha").alias("origin"), F.col("sha").alias("node")).distinct())
    while not front.isEmpty():
        step = front.join(up, "node").select("origin", F.col("parent").alias("node")).distinct()
        front = cut(step.join(seen, ["origin", "node"], "left_anti"))
        seen = cut(seen.unionAll(front))
    others = w.select("id", F.col("sha").alias("node"))
    above = w.withColumnRenamed("sha", "origin").join(seen.where("origin <> node"), "origin").join(others, ["id", "node"])
    n = above.groupBy("id", F.col("origin").alias("sha")).agg(F.count("*").alias("n"))
    d = w.join(n, ["id", "sha"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # in a chain the commits have 0, 1, 2, ... of the others above them
    g = d.groupBy("id").agg(F.count("*").alias("k"), F.count_distinct("n").alias("kinds"), F.min_by("sha", "n").alias("earliest"), F.max_by("sha", "n").alias("latest"))
    linear = F.col("k") == F.col("kinds")
    return g.select("id", linear.alias("linear"), F.when(linear, F.col("earliest")).alias("earliest"), F.when(linear, F.col("latest")).alias("latest"))
