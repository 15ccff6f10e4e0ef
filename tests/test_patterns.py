"""Pattern queries: what they return, what is refused, and whether they name their scan."""

import pytest

from quarry.plans import patterns


@pytest.fixture(scope="module")
def graph(spark):
    methods = spark.createDataFrame([("s", "m1", "main", "a.js", 1), ("s", "m2", "run", "a.js", 9), ("s", "m3", "eval", None, 4), ("t", "m9", "other", "z.js", 1)], "scan_id string, uid string, name string, file string, line int")
    calls = spark.createDataFrame([("s", "c1", "run()", 2), ("s", "c2", "eval(x)", 10), ("s", "c3", "log", 11), ("t", "c9", "eval", 1)], "scan_id string, uid string, code string, line int")
    contains = spark.createDataFrame([("s", "m1", "c1"), ("s", "m2", "c2"), ("s", "m2", "c3"), ("t", "m9", "c9")], "scan_id string, src string, dst string")
    resolves = spark.createDataFrame([("s", "c1", "m2"), ("s", "c2", "m3"), ("t", "c9", "m9")], "scan_id string, src string, dst string")
    flows = spark.createDataFrame([("s", "c1", "c2", 0), ("s", "c2", "c3", 1), ("s", "c3", "c1", 2)], "scan_id string, src string, dst string, rank int")
    return patterns.Graph(spark, "s", {"Method": methods, "Call": calls}, {"CONTAINS": contains, "RESOLVES": resolves, "FLOWS": flows})


CASES = [
    ("MATCH (m:Method) RETURN m.name AS name ORDER BY name", [("eval",), ("main",), ("run",)]),
    ("MATCH (m:Method {name: $n})-[:CONTAINS]->(c:Call) RETURN c.code ORDER BY c.line DESC", [("log",), ("eval(x)",)]),
    ("MATCH (a:Method)-[:CONTAINS]->(:Call)-[:RESOLVES]->(b:Method) RETURN a.name AS a, b.name AS b ORDER BY a", [("main", "run"), ("run", "eval")]),
    ("MATCH (b:Method)<-[:RESOLVES]-(c:Call) WHERE c.code CONTAINS 'eval' OR b.name STARTS WITH 'zz' RETURN b.uid", [("m3",)]),
    ("MATCH (m:Method) OPTIONAL MATCH (m)-[:CONTAINS]->(c:Call) WHERE c.line > 10 RETURN m.name AS n, c.uid AS c ORDER BY n", [("eval", None), ("main", None), ("run", "c3")]),
    ("MATCH (m:Method)-[:CONTAINS]->(c) RETURN m.name AS n, count(*) AS k, max(c.line) AS l ORDER BY k DESC, n", [("run", 2, 11), ("main", 1, 2)]),
    ("MATCH (m:Method) WHERE m.file IS NOT NULL WITH m.file AS f, count(m) AS k WHERE k > 1 RETURN f, k", [("a.js", 2)]),
    ("MATCH (a:Call {uid: 'c1'})-[:FLOWS*1..2]->(b:Call) RETURN b.uid AS b ORDER BY b", [("c2",), ("c3",)]),
    ("MATCH (a:Call {uid: 'c1'})-[r:FLOWS*3]->(b) RETURN b.uid, size(r) AS n", [("c1", 3)]),
    ("MATCH (a:Call {uid: 'c1'})-[:FLOWS*0..12]->(b) RETURN count(*) AS n", [(4,)]),
    ("MATCH (a:Call)-[r:FLOWS]-(b:Call) WHERE a.uid = 'c1' RETURN b.uid AS b, r.rank AS k ORDER BY k", [("c2", 0), ("c3", 2)]),
    ("UNWIND [3, 1, 2] AS x WITH x ORDER BY x DESC LIMIT 2 RETURN collect(x) AS xs", [([3, 2],)]),
    ("UNWIND $list AS x RETURN x + 1 AS y, CASE WHEN x > 1 THEN 'b' ELSE 'a' END AS z ORDER BY y SKIP 1", [(3, "b")]),
    ("RETURN any(x IN [1, 2] WHERE x > 1) AS a, all(x IN [1, 2] WHERE x > 1) AS b, none(x IN [1] WHERE x = 2) AS c, single(x IN [1, 1] WHERE x = 1) AS d, [x IN [1, 2] WHERE x > 1 | x * 2] AS e", [(True, False, True, False, [4])]),
    ("MATCH (m:Method) RETURN DISTINCT m.file AS f ORDER BY f", [("a.js",), (None,)]),
    ("MATCH (a:Method {name: 'main'}), (b:Method {name: 'run'}) RETURN toUpper(a.name) + '>' + b.name AS x", [("MAIN>run",)]),
    ("MATCH (m:Method) WHERE NOT m.name IN ['main', 'run'] AND m.line >= 4 RETURN m.uid, coalesce(m.file, 'none')", [("m3", "none")]),
    ("MATCH (a:Call {uid: 'c1'}) MATCH (a)-[:FLOWS]->(b) MATCH (b)-[:FLOWS]->(c) RETURN c.uid // the second\n;", [("c3",)]),
]


@pytest.mark.parametrize("query, rows", CASES)
def test_rows(graph, query, rows):
    got = graph.run(query, params={"n": "run", "list": [1, 2]})
    assert got == {"rows": got.get("rows"), "truncated": False}, got
    assert [tuple(r.values()) for r in got["rows"]] == rows


REFUSED = [
    "CREATE (n:Method) RETURN n", "MATCH (n) DELETE n", "MATCH (n:Method) SET n.x = 1 RETURN n", "CALL db.labels()", "LOAD CSV FROM 'x' AS r RETURN r", "MATCH (n:Method) RETURN n; MATCH (m) RETURN m", "MATCH (a)-[:FLOWS*]->(b) RETURN b", "MATCH (a)-[:FLOWS*2..]->(b) RETURN b",
    "MATCH (a)-[:FLOWS*1..13]->(b) RETURN b", "MATCH (a:Nope) RETURN a", "MATCH (a)-[:NOPE]->(b) RETURN a", "MATCH (a:Method) RETURN b", "MATCH (a:Method) WHERE EXISTS { MATCH (b) RETURN b } RETURN a", "MATCH (a:Method) RETURN apoc.x(a)", "MATCH (a:Method) RETURN shell('x')", "RETURN $secret",
    "MATCH (a:Method) RETURN a.name UNION MATCH (b:Method) RETURN b.name", "FOREACH (x IN [1] | CREATE (n))", "", "RETURN 1" + " " * 9000, "MATCH (a:Method RETURN a", "RETURN 'open",
]


@pytest.mark.parametrize("query", REFUSED)
def test_refused(graph, query):
    assert set(graph.run(query)) == {"error"}


def test_union_truncation_and_other_scans(graph):
    got = graph.frame("MATCH (a:Method) RETURN a.name AS n UNION MATCH (b:Method) RETURN b.name AS n", strict=False)
    assert sorted(r.n for r in got.collect()) == ["eval", "main", "run"]
    assert graph.frame("MATCH (a:Method) RETURN a.name AS n UNION ALL MATCH (b:Method) RETURN b.name AS n", strict=False).count() == 6
    assert graph.run("MATCH (m:Method) RETURN m.uid AS u ORDER BY u", limit=2) == {"rows": [{"u": "m1"}, {"u": "m2"}], "truncated": True}
    assert graph.schema()["FLOWS"] == ["rank"] and graph.run("MATCH (c:Call) WHERE c.scan_id = 't' RETURN c") == {"rows": [], "truncated": False}


@pytest.mark.parametrize("query, fine", [
    ("MATCH (a:M {scan_id: $scan_id}) RETURN a", True),
    ("MATCH (a:M) WHERE a.scan_id = $scan_id AND a.x > 1 RETURN a", True),
    ("MATCH (a:M) WHERE a.scan_id = $scan_id OR a.x > 1 RETURN a", False),
    ("MATCH (a:M) RETURN a", False),
    ("MATCH (a:M {scan_id: 's'}) RETURN a", False),
    ("MATCH (a:M {scan_id: $scan_id})-[:X]->(b) MATCH (b)-[:Y]->(c) RETURN c", True),
    ("MATCH (a:M {scan_id: $scan_id}) WITH a.x AS x MATCH (b:M) RETURN b", False),
    ("MATCH (a:M {scan_id: $scan_id}) WITH a MATCH (a)-[:X]->(b) RETURN b", True),
    ("MATCH (b)-[:X]->(c), (a:M {scan_id: $scan_id})-[:X]->(b) RETURN c", True),
    ("MATCH (a:M {scan_id: $scan_id}) RETURN a.x UNION MATCH (b:M) RETURN b.x", False),
    ("CALL x()", False),
])
def test_scope(query, fine):
    assert (patterns.scope_problem(query) is None) == fine
