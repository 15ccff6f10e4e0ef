"""Shaping of examples, cases, findings and reports: the small steps between tables of a review and what is made of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.code import clean_cwe, clean_file, clean_lines
from quarry.operators.codeindex import enclosing
from quarry.plans.cut import cut

SPLITS = ("train", "dev", "oldcve")


def normalised_examples(rows: DataFrame) -> DataFrame:
    """(id, pair_id, label, split) of examples and traces, whose fields stand at the top or in meta; raises if a row has none of
    the splits."""
    has = set(rows.columns)
    meta = set(rows.schema["meta"].dataType.names) if "meta" in has else set()
    pick = lambda c: F.coalesce(*([F.col(c)] if c in has else []), *([F.col(f"meta.{c}")] if c in meta else []), F.lit(None).cast("string"))
    d = rows.select("id", *(pick(c).alias(c) for c in ("pair_id", "label", "split")))
    bad = d.where(~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False))).limit(1).collect()
    if bad:
        raise ValueError(f"row {bad[0].id}: split must be one of {SPLITS}, not {bad[0].split!r}")
    return d


def finding(d: DataFrame, arms: dict[str, dict[str, str]]) -> DataFrame:
    """(run_id, arm, file, line, line_end, function, cwe) of raw findings: arms maps an arm to its names of file, line, line_end,
    function, cwe; places and weaknesses are validated, never repaired."""

    def of(field: str) -> Column:
        found = F.lit(None).cast("string")
        for arm, names in arms.items():
            if field in names:
                found = F.when(F.col("arm") == arm, F.col(names[field]).cast("string")).otherwise(found)
        return found

    d = d.withColumns({f"__{k}": of(k) for k in ("file", "line", "line_end", "function", "cwe")})
    start, end = clean_lines(F.col("__line"), F.col("__line_end"))
    return d.select("run_id", "arm", clean_file(F.col("__file")).alias("file"), start.alias("line"), end.alias("line_end"), F.nullif(F.trim("__function"), F.lit("")).alias("function"), clean_cwe(F.col("__cwe")).alias("cwe"))


def targets(annotations: DataFrame, changed: DataFrame, kinds: list[str], most: int) -> DataFrame:
    """(id, span_id, basis): each pair's annotated spans (id, kind, span_id) of its first kind, else its changed functions (id,
    span_id), if they aren't more than `most`; of others one row with basis sprawling and no span."""
    place = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
    a = annotations.withColumn("k", place).where("k > 0")
    first = a.withColumn("least", F.min("k").over(Window.partitionBy("id"))).where("k = least").select("id", "span_id", F.col("kind").alias("basis")).distinct()
    rest = changed.select("id", "span_id").distinct().join(first.select("id").distinct(), "id", "left_anti")
    n = rest.groupBy("id").agg(F.count("*").alias("n"))
    few = rest.join(n.where(F.col("n") <= most).select("id"), "id").select("id", "span_id", F.lit("changed").alias("basis"))
    many = n.where(F.col("n") > most).select("id", F.lit(None).cast(rest.schema["span_id"].dataType).alias("span_id"), F.lit("sprawling").alias("basis"))
    return first.unionByName(few).unionByName(many)


def snippet(lines: DataFrame, anchors: DataFrame, size: int) -> DataFrame:
    """(case_id, start, stop, text): at most `size` lines of an anchor's span (case_id, file, line, start, stop) around its line."""
    low = F.greatest("start", F.least(F.col("line") - F.lit(size // 2), F.col("stop") - (size - 1)))
    a = anchors.withColumn("from", low).withColumn("to", F.least("stop", F.col("from") + (size - 1)))
    d = a.select("case_id", "file", "from", "to", F.explode(F.sequence("from", "to")).alias("lineno")).join(lines.select("file", "lineno", "text"), ["file", "lineno"])
    g = d.groupBy("case_id", "from", "to").agg(F.array_sort(F.collect_list(F.struct("lineno", "text"))).alias("ls"))
    return g.select("case_id", F.col("from").alias("start"), F.col("to").alias("stop"), F.array_join(F.transform("ls", lambda x: x["text"]), "\n").alias("text"))


def units(rows: DataFrame) -> DataFrame:
    """(pair_id, v, p, n): of each pair's rows (pair_id, seq, label, has_twin, has_sink) the vulnerable one that has a surviving
    twin, if any does, that twin (the patched row of its number), and a negative, rather one with a sink; the first on ties."""
    at = F.struct("seq", "twin")
    v = F.min_by(F.when(F.col("label") == "vulnerable", at), F.when(F.col("label") == "vulnerable", F.struct((~F.col("has_twin")).cast("int"), "seq")))
    n = F.min_by(F.when(F.col("label") == "negative", F.col("seq")), F.when(F.col("label") == "negative", F.struct((~F.col("has_sink")).cast("int"), "seq")))
    g = rows.groupBy("pair_id").agg(v.alias("x"), n.alias("n"))
    twins = rows.where("label = 'patched'").select("pair_id", F.col("seq").alias("__t"), F.lit(True).alias("there"))
    d = g.join(twins, (g["pair_id"] == twins["pair_id"]) & (F.col("x.twin") == F.col("__t")), "left").select(g["pair_id"], F.col("x.seq").alias("v"), F.when(F.col("there"), F.col("x.twin")).alias("p"), "n")
    return d


def first_public(d: DataFrame, names: list[str]) -> DataFrame:
    """d with first_public, the earliest of the dates `names`, and its basis, the first of these names that has it."""
    least = F.least(*names)
    basis = F.coalesce(*(F.when(F.col(c) == least, F.lit(c)) for c in names))
    return d.withColumn("first_public", least).withColumn("basis", basis)


def test_candidates(d: DataFrame, cutoff: str, most: int) -> DataFrame:
    """d (id, repo, kind, first_public) with state: kept, early if it isn't after the cutoff, undated, or over_cap if `most` of its
    repository and kind come before it."""
    state = F.when(F.col("first_public").isNull(), "undated").when(F.col("first_public") <= cutoff, "early")
    d = d.withColumn("state", state)
    w = Window.partitionBy("repo", "kind", F.col("state").isNull()).orderBy("first_public", "id")
    return d.withColumn("state", F.coalesce("state", F.when(F.row_number().over(w) > most, "over_cap"), F.lit("kept")))


def case_per_span(findings: DataFrame, spans: DataFrame, files: DataFrame, taken: DataFrame) -> DataFrame:
    """(point_id, span_id): for each function around a finding (point_id, file, line) that isn't taken (span_id), the first finding."""
    first = findings.groupBy("file", "line").agg(F.min("point_id").alias("point_id"))  # a place's later findings lie in the same function
    d = enclosing(first, spans, files).where("span_id is not null").join(taken.select("span_id").distinct(), "span_id", "left_anti")
    return d.groupBy("span_id").agg(F.min("point_id").alias("point_id")).select("point_id", "span_id")


def credited(decisions: DataFrame, findings: DataFrame, caught: DataFrame, calibrated: int, least: int = 100) -> DataFrame:
    """(run_id, idx, key_id): decisions of a judge (run_id, idx, key_id, real) for findings without a file and keys that weren't
    caught, one to one: the lowest finding takes its first key that no lower one takes.  Raises if the judge was calibrated on
    fewer than `least` cases."""
    if calibrated < least:
        raise ValueError(f"the judge was calibrated on {calibrated} cases, fewer than {least}")
    nowhere = findings.where("file is null").select("run_id", "idx")
    open_ = decisions.where("real").join(nowhere, ["run_id", "idx"]).join(caught.select("run_id", "key_id"), ["run_id", "key_id"], "left_anti")
    left, found = cut(open_.select("run_id", "idx", "key_id").distinct()), None
    while not left.isEmpty():
        # findings whose first key nobody lower asks for first are settled in each round
        first = left.groupBy("run_id", "idx").agg(F.min("key_id").alias("key_id"))
        got = cut(first.groupBy("run_id", "key_id").agg(F.min("idx").alias("idx")).select("run_id", "idx", "key_id"))
        # a lower finding may want that key later on: only the lowest finding of a run is sure
        sure = got.join(left.groupBy("run_id").agg(F.min("idx").alias("idx")), ["run_id", "idx"])
        found = sure if found is None else found.unionByName(sure)
        left = cut(left.join(sure.select("run_id", "idx"), ["run_id", "idx"], "left_anti").join(sure.select("run_id", "key_id"), ["run_id", "key_id"], "left_anti"))
    return open_.select("run_id", "idx", "key_id").limit(0) if found is None else found


def log_states(events: DataFrame) -> DataFrame:
    """(run_id, status, started, ended, n_steps) of a run's events (run_id, seq, kind, status, at): the last status counts, a run
    whose last event is its start is running."""
    last = F.max_by(F.when(F.col("status").isNotNull(), F.col("status")), F.when(F.col("status").isNotNull(), F.col("seq")))
    when = lambda k: F.max(F.when(F.col("kind") == k, F.col("at")))
    g = events.groupBy("run_id").agg(last.alias("status"), F.min(F.when(F.col("kind") == "start", F.col("at"))).alias("started"), when("end").alias("ended"), F.count_if(F.col("kind") == "step").alias("n_steps"))
    return g.withColumn("status", F.when(F.col("ended").isNull(), "running").otherwise(F.col("status")))


def neutral(text: Column) -> Column:
    """A text whose marks of a prompt's parts are broken up: runs of < and > get a blank between them."""
    return F.regexp_replace(F.regexp_replace(text, "<(?=<)", "< "), ">(?=>)", "> ")


def rendered_flow(steps: DataFrame) -> DataFrame:
    """(uid, text): a flow's steps (uid, at, file, line, code) as numbered lines."""
    line = F.format_string("%d. %s:%s  %s", F.col("at") + 1, F.coalesce("file", F.lit("?")), F.coalesce(F.col("line").cast("string"), F.lit("?")), neutral(F.coalesce("code", F.lit(""))))
    g = steps.withColumn("__t", line).groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("at", "__t"))).alias("ls"))
    return g.select("uid", F.array_join(F.transform("ls", lambda x: x["__t"]), "\n").alias("text"))


def agreeing_spans(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, state): spans of two sources, once each and without nulls: both, only_a or only_b."""
    one = lambda d, n: reduce(lambda x, c: x.where(F.col(c).isNotNull()), keys, d.select(*keys)).distinct().withColumn(n, F.lit(True))
    d = one(a, "a").join(one(b, "b"), keys, "full_outer")
    return d.select(*keys, F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "only_a").otherwise("only_b").alias("state"))


def structure(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, key, n): distinct nodes (label, uid) and how often each edge (label, src, dst) stands."""
    n = nodes.select(F.lit("node").alias("kind"), F.concat_ws("|", "label", "uid").alias("key")).distinct().withColumn("n", F.lit(1).cast("bigint"))
    e = edges.groupBy("label", "src", "dst").agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), F.concat_ws("|", "label", "src", "dst").alias("key"), "n")
    return n.unionByName(e)


def partition(owners: DataFrame, edges: DataFrame, calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(intra, callgraph): edges (src, dst) both of whose ends have one owner (node, owner), with it, and the distinct (owner,
    callee) of calls (call, callee)."""
    o = owners.select("node", "owner")
    ends = edges.join(o.select(F.col("node").alias("src"), F.col("owner").alias("a")), "src").join(o.select(F.col("node").alias("dst"), F.col("owner").alias("b")), "dst")
    graph = calls.join(o.select(F.col("node").alias("call"), "owner"), "call").select("owner", "callee").distinct()
    return ends.where("a = b").select(F.col("a").alias("owner"), "src", "dst"), graph


def sample_errors(sample: DataFrame, known: DataFrame) -> DataFrame:
    """(case_id, error): cases (case_id, category, real, file) of a sample that stand twice, aren't known (case_id), or have no
    file; and categories whose real and trap cases differ by more than one."""
    twice = sample.groupBy("case_id").count().where("count > 1").select("case_id", F.lit("stands twice").alias("error"))
    strange = sample.select("case_id").distinct().join(known.select("case_id"), "case_id", "left_anti").select("case_id", F.lit("isn't known").alias("error"))
    nowhere = sample.where("file is null").select("case_id", F.lit("has no file").alias("error"))
    g = sample.groupBy("category").agg(F.sum(F.when(F.col("real"), 1).otherwise(-1)).alias("d")).where("abs(d) > 1")
    uneven = g.select(F.lit(None).cast(sample.schema["case_id"].dataType).alias("case_id"), F.concat(F.lit("unbalanced: "), "category").alias("error"))
    return twice.unionByName(strange).unionByName(nowhere).unionByName(uneven)


def markdown(rows: DataFrame, columns: list[str], order: list[Column], most: int = 1000) -> str:
    """A report's rows as a table of text; the driver formats at most `most` of them and says how many were left out."""
    got = rows.orderBy(*order).select(*columns).limit(most + 1).collect()
    lines = ["| " + " | ".join(columns) + " |", "|" + "-|" * len(columns)]
    lines += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in got[:most]]
    return "\n".join(lines + [f"(more than {most} rows)"] * (len(got) > most))


def duplicates(fits: DataFrame, matched: DataFrame, findings: DataFrame) -> DataFrame:
    """(run_id, idx, state) of findings: matched, duplicate if it fits a key that another one took, or unmatched."""
    m = matched.select("run_id", "idx", F.lit(True).alias("m")).distinct()
    f = fits.select("run_id", "idx", F.lit(True).alias("f")).distinct()
    d = findings.select("run_id", "idx").join(m, ["run_id", "idx"], "left").join(f, ["run_id", "idx"], "left")
    return d.select("run_id", "idx", F.when(F.col("m"), "matched").when(F.col("f"), "duplicate").otherwise("unmatched").alias("state"))


def decisions(tests: DataFrame, alpha: float = 0.05, margin: float = 0.05) -> DataFrame:
    """(name, holm, rejects, decision) of a few tests (name, p, gain, far_a, far_b): step by step, a test rejects if its p is at
    most alpha over the tests left and all before it did; better if it rejects, gains and alarms at most `margin` more."""
    by = Window.orderBy("p", "name")  # a test each
    d = tests.withColumn("k", F.row_number().over(by)).withColumn("m", F.count("*").over(Window.partitionBy()))
    left = F.col("m") - F.col("k") + 1
    d = d.withColumn("holm", F.max(F.least(F.lit(1.0), F.col("p") * left)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("rejects", F.bool_and(F.col("p") <= alpha / left).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    better = F.col("rejects") & (F.col("gain") > 0) & (F.col("far_a") - F.col("far_b") <= margin)
    return d.select("name", "holm", "rejects", F.when(better, "better").when(F.col("rejects") & (F.col("gain") < 0), "worse").otherwise("open").alias("decision"))
