import json

import pytest
from pyspark.sql import functions as F

from quarry.functions import code
from quarry.operators import detect
from quarry.sources import codegraph, dumps, texts

SQL = """PRAGMA foreign_keys=OFF;
BEGIN TRANSACTION;
CREATE TABLE IF NOT EXISTS "fixes" (
  cve TEXT,
  hash VARCHAR(40),
  note TEXT,
  PRIMARY KEY (cve)
);
INSERT INTO fixes VALUES('CVE-1','a''b',NULL);
INSERT INTO other VALUES(1,'x');
INSERT INTO fixes VALUES('CVE-2',X'00ff',replace('one);\\ntwo; it''s','\\n',char(10)));
INSERT INTO fixes VALUES('CVE-3',-1.5e3,'lines
over
it''s);
end');
COMMIT;
"""


@pytest.mark.parametrize("block", ["128m", "64"])
def test_sqlite_dump(spark, tmp_path, block):
    (tmp_path / "d.sql").write_text(SQL)
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        names = dumps.sqlite_columns(spark, str(tmp_path / "d.sql"), "fixes")
        assert names == ["cve", "hash", "note"]
        got = dumps.sqlite_dump(spark, str(tmp_path / "d.sql"), "fixes", names).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert {tuple(r) for r in got} == {("CVE-1", "a'b", None), ("CVE-2", "00ff", "one);\ntwo; it's"), ("CVE-3", "-1.5e3", "lines\nover\nit's);\nend")}


@pytest.mark.parametrize("block", ["128m", "40"])
def test_copy_dump(spark, tmp_path, block):
    rows = "1\ta\\tb\t\\N\r\n2\t\\303\\251\\x41\tx\\\\y\n"
    (tmp_path / "d.sql").write_text("SELECT 1;\nCOPY public.c (id, msg, extra) FROM stdin;\n" + rows + "\\.\nCOPY public.e (id) FROM stdin;\n9\n\\.\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = {tuple(r) for r in dumps.copy_dump(spark, str(tmp_path / "d.sql"), "c", ["extra", "msg", "id"]).collect()}
        assert dumps.copy_dump(spark, str(tmp_path / "d.sql"), "none", ["id"]).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {(None, "a\tb", "1"), ("x\\y", "éA", "2")}


def test_comments_and_quantifiers():
    assert code.split_comment('var u = "http://x"; // note')[:2] == ('var u = "http://x"; ', " note")
    assert code.split_comment("a(); /* start") == ("a(); ", " start", True)
    assert code.split_comment("  still inside */ b();", True) == (" b();", "  still inside ", False)
    assert code.split_comment("x = '#not' # real", style="hash")[1] == " real"
    for p in ["([0-9]+)+\\#", "(a+)+", "(x*)*", r"(\w+\s?)*$", "((a+))+", "(a{1,})+", "(?:ab+)*"]:
        assert code.nested_quantifier(p), p
    for p in [r"^\d+$", "(ab)+", "(?:a|b)+", "[a+]+", r"\(a+\)+", "(a+)?", "(a+){2}", "", ")+", "(("]:
        assert not code.nested_quantifier(p), p


def test_detectors(spark):
    js = ["app.use(helmet())", "// TODO fix the password check", "// if (!ok) return;", "x()", "", "// hack", "y()", "z()", "w()", "v()", "r = /(a+)+/;", "q = new RegExp(name)"]
    lines = spark.createDataFrame([("a.js", i, t) for i, t in enumerate(js, 1)] + [("b.py", 1, "# insecure cookie")], "file string, lineno long, text string")
    split = detect.split_lines(lines)
    checks = [detect.Control("headers", r"helmet\("), detect.Control("csrf", "csurf"), detect.Control("old", r"return;", r"q = new")]
    got = {(r.control, r.kind, r.lineno) for r in detect.controls(split, checks).collect()}
    assert got == {("headers", "present", 1), ("csrf", "absent", None), ("old", "disabled", 12), ("old", "commented_out", 3)}
    assert detect.controls(split.limit(0), checks).count() == 0
    got = {(r.file, r.lineno, r.kind, r.score) for r in detect.hedges(split).collect()}
    assert got == {("a.js", 2, "commented_out_fix", 6), ("b.py", 1, "hedge_comment", 5)}
    assert {(r.lineno, r.kind, r.pattern) for r in detect.regex_calls(split).collect()} == {(11, "redos_regex", "(a+)+"), (12, "dynamic_regex", "name")}
    top = detect.shortlist(detect.hedges(split), "C", [F.desc("score"), F.col("file"), F.col("lineno")], "s", 1).collect()
    assert [(r["rank"], r.file) for r in top] == [(0, "a.js")]


def test_diffs(spark):
    diff = '--- a/x.js\n+++ b/x.js\n@@ -3,2 +3,2 @@\n-a\n--- b\n+c\n+d\n@@ -5,0 +6,2 @@\n+e\n+f\n\\ No newline\n@@ -9,2 +11,0 @@\n-g\n-h\n--- "a/caf\\303\\251"\n+++ /dev/null\n@@ -1 +0,0 @@\n-z'
    d = spark.createDataFrame([("1", diff), ("2", None)], "id string, diff string")
    h = texts.hunks(d)
    got = {(r.file, r.old_file, r.old_start, r.old_end, r.new_start, r.new_end) for r in h.collect()}
    assert got == {("x.js", "x.js", 3, 4, 3, 4), ("x.js", "x.js", 5, 4, 6, 7), ("x.js", "x.js", 9, 10, 11, 10), (None, "café", 1, 1, 0, -1)}
    ask = spark.createDataFrame([("1", "x.js", n) for n in (1, 3, 4, 5, 6, 9, 11)] + [("3", "y", 2)], "id string, file string, line long")
    got = {(r.id, r.line): (r.new_start, r.new_end) for r in texts.map_lines(ask, h).collect()}
    assert got == {("1", 1): (1, 1), ("1", 3): (3, 4), ("1", 4): (3, 4), ("1", 5): (5, 5), ("1", 6): (8, 8), ("1", 9): (None, None), ("1", 11): (11, 11), ("3", 2): (2, 2)}


def test_files_and_manifests(spark, tmp_path):
    for name, text in {"a/x.js": "one\r\ntwo\n", "node_modules/y.js": "no", "a/z.min.js": "no", "empty.js": ""}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    files = texts.source_files(spark, str(tmp_path), "*.js")
    assert {(r.file, r.reason) for r in files.collect()} == {("a/x.js", None), ("node_modules/y.js", "folder"), ("a/z.min.js", "minified")}
    assert {(r.file, r.lineno, r.text) for r in texts.source_lines(files).collect()} == {("a/x.js", 1, "one"), ("a/x.js", 2, "two")}
    m = [
        ("r", "package.json", json.dumps({"dependencies": {"express": "^4"}, "devDependencies": {"mocha": "1"}})),
        ("r", "requirements.txt", "# c\nDjango==4.2\nexpress>=1\n-r x\nflask\n"),
        ("r", "pom.xml", "<dependency><groupId>g</groupId><artifactId>a</artifactId><version>2</version></dependency>"),
        ("r", "go.mod", "module x\nrequire (\n\tgithub.com/a/b v1.2.3\n)\n"),
        ("r", "sub/package.json", "not json"),
    ]
    got = {(r.name, r.version) for r in texts.dependencies(spark.createDataFrame(m, "root string, file string, content string")).collect()}
    assert got == {("express", "^4"), ("mocha", "1"), ("Django", "4.2"), ("flask", None), ("g:a", "2"), ("github.com/a/b", "v1.2.3")}


def test_ledger_and_csv(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"id":"a","n":1,"v":"x"}\n{"id":"a","n":2,"v":"y"}\n{"id":"b","n":1,"v":"z"}\n{"id":"c","n"')
    got = texts.latest(spark, str(tmp_path / "l.jsonl"), "id string, n long, v string", "id", "n").collect()
    assert {(r.id, r.v) for r in got} == {("a", "y"), ("b", "z")}
    (tmp_path / "e.csv").write_text("# test name, category; Benchmark version: 1.2\nT1,sqli,true,89\n")
    assert texts.commented_csv(spark, str(tmp_path / "e.csv"), "name string, category string, vulnerable boolean, cwe int").first().cwe == 89
    assert texts.header_value(spark, str(tmp_path / "e.csv"), "version") == "1.2"


def test_code_graph(spark, tmp_path):
    tag = lambda v: {"@type": "g:Int64", "@value": v}
    prop = lambda v: {"@type": "g:VertexProperty", "@value": {"@type": "g:List", "@value": [v]}}
    vs = [
        {"id": tag(1), "label": "CALL", "properties": {"NAME": prop("eval"), "LINE_NUMBER": prop(tag(7)), "CODE": prop("<empty>")}},
        {"id": tag(2), "label": "METHOD", "properties": {"NAME": "h", "FILENAME": ["a.js"]}},
        {"id": tag(3), "label": "METHOD_PARAMETER_IN", "properties": {}},
    ]
    es = [{"label": "AST", "outV": tag(2), "inV": tag(3), "outVLabel": "METHOD", "inVLabel": "METHOD_PARAMETER_IN"}, {"label": "AST", "outV": tag(2), "inV": tag(1), "outVLabel": "METHOD", "inVLabel": "CALL"}]
    (tmp_path / "g.json").write_text(json.dumps({"@type": "tinker:graph", "@value": {"vertices": vs, "edges": es}}))
    v, e = codegraph.graphson(spark, str(tmp_path / "g.json"))
    c = codegraph.calls(v, "s").first()
    assert (c.id, c.name, c.code, c.line, c.file) == (1, "eval", "eval", 7, "<unknown>")
    assert [r.id for r in codegraph.entry_methods(v, e).collect()] == [2]
    pv, pe = codegraph.project(v, e, {"CALL": ["NAME"]}, [("AST", "METHOD", "CALL")])
    assert [(r.id, r.props) for r in pv.collect()] == [(1, {"NAME": "eval"})] and pe.count() == 1
    seg = {"method_id": 5, "vertices": [{"id": 6, "label": "CALL", "properties": {"NAME": "f"}}], "edges": [{"label": "AST", "outV": 5, "inV": 6}], "call_edges": [[6, 9]], "cross_rd": [[6, 6]]}
    (tmp_path / "s.jsonl").write_text('{"seg":-1,"files":[{"id":1,"properties":{"NAME":"a"}}]}\n' + (json.dumps(seg) + "\n") * 2 + '{"method_')
    nodes, edges = codegraph.segment_graph(codegraph.segments(spark, str(tmp_path / "s.jsonl")))
    assert [(r.id, r.label) for r in nodes.collect()] == [(6, "CALL")]
    assert sorted((r.label, r.src, r.dst) for r in edges.collect()) == [("AST", 5, 6), ("CALL", 6, 9), ("REACHING_DEF", 6, 6)]


def test_scalars(spark):
    d = spark.createDataFrame([("https://GitHub.com/A/b.git/commit/ABCDEF1", "cwe_079", ".\\src\\tests\\x.js", "eval(req.body.preTax) eval", "12", "11")], "u string, w string, p string, q string, a string, b string")
    start, end = code.clean_lines(F.col("a"), F.col("b"))
    r = d.select(code.commit_of(F.col("u")), code.clean_cwe(F.col("w")), code.clean_file(F.col("p")), code.keyword_query(F.col("q")), start, end, code.is_test_path(code.clean_file(F.col("p"))), code.cwes(F.lit("CWE-89, cwe 20 CWE-89")), code.github_repo(F.lit("git@github.com:O/R.git")), code.pull_of(F.lit("https://github.com/o/r/pull/17"))).first()
    assert list(r) == ["abcdef1", "CWE-79", "src/tests/x.js", "eval req body pretax", 12, None, True, ["CWE-20", "CWE-89"], "o/r", 17]
    names = {"a.js::program:Foo:bar": "bar", "pkg/mod.py:<module>.view": "view", "com.x.Cls.run:void(java.lang.String)": "run", "f": "f", "a.js::program": None, "m.py:<module>": None, "Cls::m": "m", "g()": "g", "__ecma.Date:getDay": "getDay", "": None}
    got = spark.createDataFrame([(k,) for k in names], "n string").select("n", code.function_name(F.col("n")).alias("f")).collect()
    assert {r.n: r.f for r in got} == names
