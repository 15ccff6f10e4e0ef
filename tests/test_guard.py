"""Queries that the guard refuses, and those that it lets through."""

import pytest

from quarry.plans import adhoc


@pytest.fixture(scope="module")
def scan(spark):
    spark.createDataFrame([(9,)], "x int").createOrReplaceTempView("hidden")
    calls = spark.createDataFrame([("s", "a", 1, "f.js"), ("s", "b", 2, "g.js"), ("s", "b", 3, None), ("t", "c", 4, "h.js")], "scan_id string, name string, line int, file string")
    return adhoc.Scan(spark, "s", {"calls": calls})


REFUSED = [
    "select * from hidden where exists (with hidden as (select 1) select 1 from hidden)",
    "with a as (select * from hidden) select * from a",
    "select * from (with a as (select 1 as x) select * from a) join a",
    "select (select max(x) from hidden) from calls",
    "select * from calls where line in (select x from hidden)",
    "with a as (select * from b), b as (select 1) select * from a",
    "select reflect('java.lang.System', 'getProperty', 'user.home')",
    "select java_method('java.lang.System', 'getenv', 'HOME')",
    "select max(java_method('java.lang.System', 'getenv', name)) over () from calls",
    "select * from calls order by reflect('java.lang.System', 'gc')",
    "select * from parquet.`/tmp`",
    "select * from default.calls",
    "select * from range(1000000000)",
    "select current_user(), input_file_name() from calls",
    "drop view calls",
    "create table t as select * from calls",
    "insert into calls select * from calls",
    "set spark.sql.shuffle.partitions = 1",
    "select 1; select 2",
    "explain select 1",
    "describe calls",
    "select transform(name) using 'cat' as (x) from calls",
    "",
    "select 1 as x " + " " * 9000,
]


@pytest.mark.parametrize("sql", REFUSED)
def test_refused(scan, sql):
    assert set(scan.query(sql)) == {"error"}


ALLOWED = [
    ("select count(*) as n from calls", [{"n": 3}]),
    ("with a as (select name, line from calls), b as (select name from a where line > 1) select count(*) as n from b join a using (name)", [{"n": 4}]),
    ("select name, row_number() over (partition by name order by line) as k from calls where line = 3", [{"name": "b", "k": 1}]),
    ("select name from calls c where exists (select 1 from calls d where d.line > c.line and d.name <> c.name)", [{"name": "a"}]),
    ("select name, count(*) as n from calls group by name having count(*) > 1 order by n limit 5", [{"name": "b", "n": 2}]),
    ("select x from (select explode(array(1, 2)) as x) where x > 1", [{"x": 2}]),
    ("select e.x from calls lateral view explode(transform(array(1, 2), y -> y + line)) e as x where line = 1 and e.x > 2", [{"x": 3}]),
    ("select name from calls where line = :n union all select 'z' as name", [{"name": "a"}, {"name": "z"}]),
    ("select exists(array(1, 2), x -> x > 1) as any, forall(array(1), x -> x > 1) as every", [{"any": True, "every": False}]),
    ("select distinct name from calls where name like 'b%' and file is null except select 'c'", [{"name": "b"}]),
]


@pytest.mark.parametrize("sql, rows", ALLOWED)
def test_allowed(scan, sql, rows):
    assert scan.query(sql, args={"n": 1}) == {"rows": rows, "truncated": False}


def test_counts_and_files(scan):
    got = scan.query("select name from calls order by line", limit=2, count=True)
    assert got == {"rows": [{"name": "a"}, {"name": "b"}], "truncated": True, "row_count": 3}
    assert scan.counts() == {"calls": 3} and [r.file for r in scan.files("calls").collect()] == ["f.js", "g.js"]
    assert adhoc.time_allowed(0) == 420 and adhoc.time_allowed(10_000) == 480 and adhoc.time_allowed(10**6) == 1200


def test_code(spark):
    lines = spark.createDataFrame([(f, i, t * i) for f in "ab" for i, t in enumerate("xyzuv", 1)], "file string, lineno long, text string")
    got = adhoc.code_window(lines, None, 2, 4, most_chars=5).orderBy("file", "lineno").collect()
    assert [(r.file, r.lineno, r.truncated) for r in got] == [(f, n, True) for f in "ab" for n in (2, 3)]
    assert [r.lineno for r in adhoc.code_window(lines, "a", 5, 9, most_chars=1).collect()] == [5]
    places = spark.createDataFrame([("a", 1), ("b", 5)], "file string, line long")
    got = {(r.file, r.line, r.lineno) for r in adhoc.context(lines, places, 1).collect()}
    assert got == {("a", 1, 1), ("a", 1, 2), ("b", 5, 4), ("b", 5, 5)}
