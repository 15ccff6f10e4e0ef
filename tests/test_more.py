"""Operators whose queries can't show everything: draws, gates, errors, runs of hedges, archives, tails."""

import random
import zipfile

import pytest
from pyspark.sql import functions as F

from quarry.operators import detect, pairs, rows, runs
from quarry.plans import skew, store
from quarry.sources import advisories
from quarry.streaming import tail

OUTCOME = "row_id long, pair_id long, label string, flagged boolean"


def outcomes(rng, recall, alarm, n=60):
    return [(3 * i + k, i, label, rng.random() < (recall if label == "vulnerable" else alarm)) for i in range(n) for k, label in enumerate(("vulnerable", "patched", "negative"))]


def test_paired_draws(spark):
    rng = random.Random(1)
    a, b = (spark.createDataFrame(outcomes(rng, r, f), OUTCOME) for r, f in ((0.4, 0.4), (0.95, 0.05)))
    got = runs.paired(a, b, draws=400)
    d = {r.metric: r for r in got.collect()}
    assert all(d[m].low <= d[m].diff <= d[m].high and d[m].low > 0 for m in ("vuln_recall", "pair_correct", "patched_silence"))
    assert runs.gate(got) == "KEEP" and runs.gate(runs.paired(b, a, draws=400)) == "RETRAIN"
    assert {(r.metric, r.low) for r in runs.paired(a, b, draws=400).collect()} == {(r.metric, r.low) for r in got.collect()}
    one = a.where("pair_id = 0")
    assert runs.gate(runs.paired(one, one, draws=50)) == "INCONCLUSIVE"
    with pytest.raises(ValueError):
        runs.paired(a, b.where("row_id > 0"))


def test_samples_raise(spark):
    c = spark.createDataFrame([(1, "a", True), (2, "a", True), (3, "b", False)], "case_id long, category string, real boolean")
    with pytest.raises(ValueError):
        runs.balanced_sample(c, 3, 0)
    with pytest.raises(ValueError):
        rows.credited(c, c, c, 99)
    with pytest.raises(ValueError):
        pairs.exported(spark.createDataFrame([("p", "dev"), ("p", "train")], "pair_id string, split string"))
    with pytest.raises(ValueError):
        pairs.steps(spark.createDataFrame([(1, "s", ["a", "b"], [])], "trace_id long, start string, actions array<string>, results array<string>"))


def test_hedges_in_runs(spark):
    """Of the hedges that follow one another, the first with a term is a row; long lines are no lines."""
    rng = random.Random(4)
    lines = []
    for f in range(40):
        n = 0
        for _ in range(25):
            n += rng.choice([1, 1, 2, 3, 4, 5])
            lines.append((f"f{f}.py", n, rng.choice(["# todo", "x = 1", "# hack", "# fixme the token", "y(password)", "z", "# " + "x" * 400 + " insecure cookie"])))
    got = {(r.file, r.lineno) for r in detect.hedges(detect.split_lines(spark.createDataFrame(lines, "file string, lineno long, text string"))).collect()}
    want = set()
    for f in {x[0] for x in lines}:
        at = {n: t for g, n, t in lines if g == f and len(t) <= 400}
        running = None  # the last line of a run that has been reported
        for n in sorted(at):
            if at[n] not in ("# todo", "# hack", "# fixme the token"):
                continue
            near = any(w in at.get(k, "") for k in range(n - 2, n + 3) for w in ("token", "password"))
            if running is not None and n <= running + 3:
                running = n
            elif near:
                want.add((f, n))
                running = n
    assert got == want and len(want) > 20


def test_controls_ignore_case(spark):
    lines = spark.createDataFrame([("a.js", 1, "HELMET(app)"), ("a.js", 2, "x")], "file string, lineno long, text string")
    got = [(r.kind, r.lineno, r.cwe, r.code) for r in detect.controls(detect.split_lines(lines), [detect.Control("headers", "helmet", cwe="CWE-693")]).collect()]
    assert got == [("present", 1, "CWE-693", "HELMET(app)")]


def test_credit_is_greedy(spark):
    rng = random.Random(9)
    d = [(f"r{rng.randrange(5)}", rng.randrange(12), f"k{rng.randrange(6)}", rng.random() < 0.8) for _ in range(150)]
    f = [(r, i, None if i % 3 else "x") for r in {x[0] for x in d} for i in range(12)]
    caught = [("r0", "k0"), ("r1", "k3")]
    got = rows.credited(spark.createDataFrame(d, "run_id string, idx long, key_id string, real boolean"), spark.createDataFrame(f, "run_id string, idx long, file string"), spark.createDataFrame(caught, "run_id string, key_id string"), 100)
    want = set()
    for run in {x[0] for x in d}:
        taken = {k for r, k in caught if r == run}
        for i in range(12):
            free = sorted({k for r, j, k, real in d if r == run and j == i and real and i % 3} - taken)
            if free:
                want.add((run, i, free[0]))
                taken.add(free[0])
    assert {(r.run_id, r.idx, r.key_id) for r in got.collect()} == want


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "all.zip", "w") as z:
        z.writestr("GHSA-1.json", '{"id":"GHSA-1","published":"2024-01-02T00:00:00Z","affected":[{"package":{"ecosystem":"PyPI","name":"A"}}],"references":[{"type":"FIX","url":"https://github.com/o/R/commit/ABCDEF1"}]}')
        z.writestr("MAL-2.json", '{"id":"MAL-2"}')
        z.writestr("note.txt", "no")
    got = advisories.osv_rows(advisories.archive_members(spark, str(tmp_path / "*.zip"))).collect()
    assert [(r.source, r.repo, r.fix_sha, r.language, r.advisory_published) for r in got] == [("osv-pypi", "o/r", "abcdef1", "py", "2024-01-02")]


def test_tail_goes_on(spark):
    files = lambda text: spark.createDataFrame([("a", bytearray(text.encode()))], "path string, content binary")
    none = spark.createDataFrame([], "path string, offset long")
    lines, cursors = tail.tail(files("one\ntwo é\nthr"), none)
    assert [(r.at, r.value) for r in lines.orderBy("at").collect()] == [(0, "one"), (4, "two é")]
    lines, cursors = tail.tail(files("one\ntwo é\nthree\n" + "x" * 50 + "\nlast\n"), cursors, most=20)
    assert [r.value for r in lines.orderBy("at").collect()] == ["three", "last"]
    assert tail.tail(files("new\n"), cursors)[0].count() == 1


def test_persist_strict(spark, tmp_path):
    nodes = spark.createDataFrame([("s", "a"), ("s", "b")], "scan_id string, uid string")
    edges = spark.createDataFrame([("s", "a", "b"), ("s", "a", "z")], "scan_id string, src string, dst string")
    assert store.persist(nodes, edges, str(tmp_path)) == {"nodes": 2, "edges": 1, "lost": 1}
    with pytest.raises(ValueError):
        store.persist(nodes, edges, str(tmp_path), strict=True)


@pytest.mark.parametrize("few", [0, 512])
def test_spread_join(spark, monkeypatch, few):
    monkeypatch.setattr(skew, "FEW", few)
    left = spark.range(3000).select(F.col("id").alias("i"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 > 0, F.concat(F.lit("k"), (F.col("id") % 40).cast("string"))).alias("k"))
    right = left.where("k is not null and k <> 'k5'").groupBy("k").agg(F.count("*").alias("n"), F.max("i").alias("last"))
    got = skew.spread_join(left, right, "k", skew.heavy(F.col("n"), 3000)).collect()
    want = {r.i: (r.n, r["last"]) for r in left.join(right, "k", "left").collect()}
    assert len(got) == 3000 and {r.i: (r.n, r["last"]) for r in got} == want
