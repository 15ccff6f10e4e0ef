"""What large tables need: no exploded table sent to all tasks, no work in the square of a key's rows."""

import random

from pyspark.sql import functions as F

from quarry.operators import codeindex, fixes, matching, rows, runtime
from quarry.operators.components import connected_components
from quarry.plans import adhoc
from quarry.plans.cut import forgetful_cut


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def values(spark, names, rows):
    """A table whose size Spark knows, and so would send if it is small."""
    said = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"{x}L" if isinstance(x, int) else str(x)
    return spark.sql(f"SELECT * FROM VALUES {', '.join('(' + ', '.join(map(said, r)) + ')' for r in rows)} AS t({names})")


def test_chunks_send_no_lines(spark):
    lines = values(spark, "file, lineno, text", [(f, i, f"{f}{i}") for f in "ab" for i in range(1, 71)] + [(None, 1, "x")])
    methods = values(spark, "file, line", [("a", 1), ("a", 30), ("a", 30), ("c", 1), (None, 1)])
    d = codeindex.chunks(lines, methods)
    assert "Broadcast" not in plan(d)
    assert {(r.file, r.start, r.stop, r.n_lines) for r in d.collect()} == {("a", 1, 40, 40), ("a", 30, 69, 40), ("b", 1, 60, 60), ("b", 61, 70, 10), (None, 1, 1, 1)}
    assert d.where("file = 'a' and start = 30").first().text.split("\n") == [f"a{i}" for i in range(30, 70)]


def test_context_sends_no_lines(spark):
    lines = values(spark, "file, lineno, text", [(f, i, f"{f}{i}") for f in "ab" for i in range(1, 61)])
    places = values(spark, "file, line", [("a", 3), ("a", 20), ("a", 20), ("b", 58), ("b", -20), ("c", 1), (None, 1), ("a", None)])
    d = adhoc.context(lines, places)
    assert "Broadcast" not in plan(d)
    want = [("a", 3, i) for i in range(1, 12)] + 2 * [("a", 20, i) for i in range(12, 29)] + [("b", 58, i) for i in range(50, 61)]
    assert sorted((r.file, r.line, r.lineno) for r in d.collect()) == sorted(want)


def many(spark, n, *columns):
    return spark.range(n).selectExpr(*columns)


def made(df):
    """Rows that the joins of a plan have made, after it has run."""
    df.collect()
    opened = lambda p: opened(p.executedPlan()) if "AdaptiveSparkPlan" in p.nodeName() else opened(p.plan()) if "QueryStage" in p.nodeName() else [p, *(x for i in range(p.children().size()) for x in opened(p.children().apply(i)))]
    nodes = opened(df._jdf.queryExecution().executedPlan())
    return max([p.metrics().apply("numOutputRows").value() for p in nodes if "Join" in p.nodeName()], default=0)


def test_exact_looks_up_one_method_a_place(spark):
    methods = many(spark, 400, "id AS seq", "'f.js' AS file", "id % 2 AS line", "CASE WHEN id < 4 THEN 'p.<lambda>' ELSE 'p.m' END || CAST(id AS STRING) AS full_name")
    calls = many(spark, 1, "id AS seq", "'f.js' AS file", "1 AS line", "'c' AS uid", "'x' AS name")
    points = many(spark, 400, "id AS seq", "CASE WHEN id % 3 = 0 THEN 'src/f.js' ELSE './f.js' END AS file", "id % 2 AS line", "CASE WHEN id % 4 > 1 THEN 'q.m' || CAST(id AS STRING) WHEN id % 4 = 1 THEN '' END AS name")
    points = points.selectExpr("seq", "regexp_replace(file, '^[.]/', '') AS file", "line", "name")
    d = runtime.Index(methods, calls).exact(points)
    assert made(d) <= 400
    got = {r.seq: r.exact for r in d.collect()}
    assert got == {i: f"p.m{i}" if i % 4 > 1 and i >= 4 else f"p.m{4 + i % 2}" for i in range(400)}


def test_sites_look_up_each_range_once(spark):
    hunks = many(spark, 300, "'h' AS id", "id AS seq", "'a.js' AS file", "'a.js' AS old_file", "id % 2 * 5 + 10 AS old_start", "id % 2 * 5 + 10 + CASE WHEN id % 4 > 1 THEN -1 ELSE 5 END AS old_end", "1L AS new_start", "0L AS new_end")
    methods = values(spark, "file, line, full_name", [("a.js", 1, "m1"), ("a.js", 12, "m12")])
    calls = many(spark, 200, "'a.js' AS file", "id % 20 AS line", "'c' || CAST(id % 190 AS STRING) AS uid", "'x' AS name")
    counted, listed = (f(hunks, methods, calls, "vulnerable") for f in (fixes.site_counts, fixes.sites))
    assert made(counted) <= 2000
    got = {r.seq: (r.method, r.n_methods, r.n_calls, r.first_call, r.windowed) for r in counted.collect()}
    assert got == {r.seq: (r.method, len(r.methods), len(r.call_uids), min(r.call_uids, default=None), r.windowed) for r in listed.collect()}

    def held(k):
        start, windowed = k % 2 * 5 + 10, k % 4 > 1
        around = lambda line: None if line < 1 else "m1" if line < 12 else "m12"
        lines = [x for x in range(start - 3, start + 4) if around(x) == around(start)] if windowed else range(start, start + 6)
        return {f"c{i % 190}" for i in range(200) if i % 20 in lines}

    assert {k: v[2:4] for k, v in got.items()} == {k: (len(held(k)), min(held(k))) for k in range(300)}


def test_enclosing_keeps_one_span_a_block(spark):
    rng = random.Random(5)
    spans = [(k, rng.choice("ab"), s := rng.randint(-40, 90), s + rng.choice([-1, 0, 1, 3, 8, 60])) for k in range(60)] + [(99, None, 1, 5), (98, "a", None, 5)]
    spans += [(100 + k, "c", 10, 20) for k in range(300)]
    points = [(k, rng.choice(["a", "b", "d", None]), rng.randint(-50, 160)) for k in range(300)] + [(1000, "a", None)] + [(2000 + k, "c", 15) for k in range(300)]
    files = values(spark, "file, n_lines", [("a", 120), ("d", 30)])
    d = codeindex.enclosing(values(spark, "point_id, file, line", points), values(spark, "span_id, file, start, stop", spans), files)
    assert made(d) <= 5000

    def want(file, line):
        around = [(z - a, -a, k, a, z) for k, f, a, z in spans if None not in (f, a, line) and f == file and a <= line <= z]
        n = {"a": 120, "d": 30}.get(file)
        return min(around)[2:] if around else (None, max(1, line - 20), max(line, min(n, line + 20))) if n and line and 1 <= line <= n else (None, None, None)

    assert {r.point_id: (r.span_id, r.start, r.stop) for r in d.collect()} == {k: want(f, x) for k, f, x in points}


def test_cases_keep_one_span_a_block(spark):
    spans = many(spark, 300, "id AS span_id", "'f' AS file", "10L AS start", "20 + id % 3 AS stop")
    points = many(spark, 300, "id AS point_id", "'f' AS file", "20 + id % 3 AS line")
    d = rows.case_per_span(points, spans, values(spark, "file, n_lines", [("f", 90)]), values(spark, "span_id", [(2,)]))
    assert made(d) <= 5000
    assert sorted((r.point_id, r.span_id) for r in d.collect()) == [(0, 0), (1, 1)]


def test_cases_take_one_finding_a_place(spark):
    spans = values(spark, "span_id, file, start, stop", [(1, "f", 1, 9), (2, "f", 4, 6), (3, "f", 20, 30), (4, None, 1, 9)])
    points = many(spark, 3000, "3000 - id AS point_id", "CASE WHEN id % 7 > 0 THEN 'f' END AS file", "CASE WHEN id % 5 > 0 THEN id % 5 + id % 2 * 20 END AS line")
    d = rows.case_per_span(points, spans, values(spark, "file, n_lines", [("f", 90), ("f", 80)]), values(spark, "span_id", [(3,)]))
    assert made(d) <= 50
    lines = {p: i % 5 + i % 2 * 20 for i in range(3000) if i % 7 and i % 5 for p in [3000 - i]}
    assert sorted((r.point_id, r.span_id) for r in d.collect()) == [(min(p for p, x in lines.items() if x < 4), 1), (min(p for p, x in lines.items() if x == 4), 2)]


def test_candidates_read_names_once(spark):
    f = values(spark, "run_id, idx, file, line_start, line_end, function, cwe", [(1, 1, "./a/b.js", 10, 12, "x.go()", "C1"), (1, 2, "b.js", 90, 95, "p.far", "C2"), (1, 2, "c.js", 5, 5, None, "C9"), (1, 3, "b.js", 300, 300, "p.far()", "C1"), (2, 1, "", 1, 1, None, None)])
    k = values(spark, "run_id, key_id, cwe, file, line, end_line, function", [(1, "k1", "C1", "a/b.js", 20, 15, "go"), (1, "k2", "C2", "src/a/b.js", 80, None, "far"), (1, "k2", "C3", "z/b.js", 91, 92, "none"), (1, "k2", "C9", "src/c.js", 1, 9, None), (2, "k1", None, "", 1, 1, None)])
    d = matching.candidates(f, k)
    assert not [x for x in plan(d).splitlines() if ("Join" in x or "Filter" in x) and "regexp_replace" in x]
    assert sorted(map(tuple, d.collect())) == [(1, 1, "k1", 2), (1, 2, "k2", 2), (1, 3, "k2", 1)]
    kin = matching.candidates(f, k, values(spark, "cwe, relative", [("C1", "C2"), ("C1", "C2")]))
    assert sorted(map(tuple, kin.collect())) == [(1, 1, "k1", 2), (1, 2, "k2", 2), (1, 3, "k2", 2)]


def test_estimates_do_not_grow_with_rounds(spark):
    d = spark.range(8).selectExpr("id AS n", "id + 1 AS p")
    for _ in range(6):
        d = forgetful_cut(d.join(d.select(F.col("n").alias("p"), F.col("p").alias("root")), "p", "left").selectExpr("n", "coalesce(root, p) AS p"))
        assert len(str(d._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 25
    assert sorted(map(tuple, d.collect())) == [(i, 8) for i in range(8)]


def test_components_of_a_chain_end_soon(spark):
    n = 3000
    d = connected_components(spark.range(n).selectExpr("CAST(id * 7919 % 3001 AS STRING) AS src", "CAST((id + 1) * 7919 % 3001 AS STRING) AS dst"))
    assert len(str(d._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 60
    assert d.count() == n + 1 and d.select("component").distinct().count() == 1


def test_coverage_meets_calls_by_place(spark):
    methods = values(spark, "seq, file, line, full_name", [(1, "f.js", 1, "p.m")])
    calls = many(spark, 300, "id AS seq", "'f.js' AS file", "5L AS line", "'c' || CAST(id AS STRING) AS uid", "'x' AS name")
    seen = many(spark, 300, "CASE WHEN id < 290 THEN 'f.js' ELSE 'g.js' END AS file", "5L AS line", "id % 2 AS hits")
    none = values(spark, "seq, file, line, name, hits", [(1, "f.js", 1, "m", 1)]).where("seq > 1")
    jumps = values(spark, "caller_file, caller_line, caller_name, callee_file, callee_line, callee_name, hits", [("f.js", 1, "m", "f.js", 5, "", 1)]).where("hits > 1")
    sent = values(spark, "site_file, site_line, callee_file, callee_line, callee_name", [("f.js", 5, "f.js", 1, "m")]).where("site_line > 5")
    c = runtime.Correlation(runtime.Index(methods, calls), "s", none, seen, jumps, sent)
    assert made(c.call_hits) <= 300
    assert {(r.uid, r.hits) for r in c.call_hits.collect()} == {(f"c{i}", 145) for i in range(300)}
    assert [tuple(r) for r in c.method_hits.collect()] == [("p.m", 1)]
    assert c.dropped["coverage_no_call"] == c.dropped["coverage_no_method"] == 10
