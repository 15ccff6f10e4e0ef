import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.operators import balance, evaluation, leads
from quarry.plans import adhoc, store
from quarry.streaming import ingest

LEAD = "run_id string, index long, shape string, text string, confidence string, source_uid string, sink_uid string, file string, line long, function string, cwe string"


def slots(rows):
    """The same rule, lead after lead."""
    kept, flows, prints, texts = [], set(), {}, set()
    for r in rows:
        fp = (r[7], r[10], r[9] or str(r[8])) if r[7] and r[10] and (r[9] or r[8] is not None) else None
        if r[5] and r[6]:
            if (r[5], r[6]) in flows:
                continue
            flows.add((r[5], r[6]))
            if fp:
                prints.setdefault(fp, len(kept))
        elif fp:
            if fp in prints:
                old = kept[prints[fp]]
                if not old[5] and leads.CONFIDENCE.index(r[4]) > leads.CONFIDENCE.index(old[4]):
                    kept[prints[fp]] = r
                continue
            prints[fp] = len(kept)
        else:
            if (r[2], r[3][:80]) in texts:
                continue
            texts.add((r[2], r[3][:80]))
        kept.append(r)
    return [r[1] for r in kept]


def test_dedup_equals_sequence(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for run in range(40):
        mine = []
        for i in range(rng.randrange(1, 9)):
            flow = rng.random() < 0.4
            loc = rng.random() < 0.6
            mine.append((f"r{run}", i, rng.choice("AB"), rng.choice(["x", "y"]), rng.choice(leads.CONFIDENCE), rng.choice("st") if flow else None, rng.choice("uv") if flow else None, rng.choice(["f", "g"]) if loc else None, 3, rng.choice([None, "h"]), "CWE-1"))
        rows += mine
        want[f"r{run}"] = slots(mine)
    got = {}
    for r in leads.dedup(spark.createDataFrame(rows, LEAD), ["run_id"]).orderBy("run_id", "kept_index").collect():
        got.setdefault(r.run_id, []).append(r["index"])
    assert got == want


def test_price_and_caps(spark):
    rates = spark.createDataFrame([("big-5", 5.0, 25.0)], "model string, input double, output double")
    calls = [("big-5", 1_000_000, 0, 0, 0, None, None), ("BIG-5-2026", 0, 1_000_000, 0, 0, None, None), ("local", 9, 9, 0, 0, None, None), ("large", 0, 0, 10, 0, None, None), ("large", 0, 0, 1_000_000, 0, 1_000_000, 0), (None, 1, 1, 0, 0, None, None)]
    d = spark.createDataFrame([(i, *c) for i, c in enumerate(calls)], "id int, model string, input_tokens long, output_tokens long, cache_write long, cache_read long, write_5m long, write_1h long")
    assert [r.usd for r in leads.price(rates, d, {"large": "big-5"}).orderBy("id").collect()] == [5.0, 25.0, 0.0, None, 6.25, 0.0]
    rows = spark.createDataFrame([("g", i, "x" * n) for i, n in enumerate((2000, 20, 900, 20))], "g string, i int, t string")
    got = leads.cap_rows(rows, ["g"], [F.col("i")], 1000, 1200).collect()
    assert [(r.i, r.truncated) for r in got] == [(0, True), (1, True)] and got[0].t.endswith("...[truncated]")


def test_sarif(spark):
    v = spark.createDataFrame([("r", 1, "CONFIRM", "t", "a.js", 3, 5, None, "CWE-79"), ("r", 2, "REJECT", "t", "a.js", 3, 5, None, "CWE-1"), ("r", 3, "CONFIRM", "t", None, None, None, None, "CWE-2"), ("r", 0, "INCONCLUSIVE", None, "b.js", None, None, "f", None)], "run_id string, lead_index long, decision string, text string, file string, line long, line_end long, function string, cwe string")
    r = leads.sarif_results(v).first()
    doc = json.loads(r.sarif)["runs"][0]
    assert r.unlocated == 1 and [x["ruleId"] for x in doc["results"]] == ["unclassified", "CWE-79"] and [x["id"] for x in doc["tool"]["driver"]["rules"]] == ["CWE-79", "unclassified"]


def test_splits(spark):
    pairs = spark.createDataFrame([(f"o/R{i % 10}", "old" if i % 10 < 5 else "new") for i in range(40)], "repo string, source string")
    got = {r.repo: r.split for r in balance.assign(pairs, old_sources=("old",)).collect()}
    assert len(got) == 10 and sorted(got.values()).count("oldcve") == 1 and sorted(got.values()).count("dev") == 1
    assert all(int(k[-1]) < 5 for k, v in got.items() if v == "oldcve")
    frozen = spark.createDataFrame([("o/r0", "dev"), ("o/r1", "train")], "repo string, split string")
    more = {r.repo: r.split for r in balance.extend(frozen, pairs, old_sources=("old",)).collect()}
    assert more["o/r0"] == "dev" and more["o/r1"] == "train" and set(more) == set(got)
    with pytest.raises(ValueError):
        balance.extend(frozen.unionAll(spark.createDataFrame([("o/r0", "train")], frozen.schema)), pairs)


def test_fill_and_layout(spark):
    units = [(0, "a", "py", 2, "r1", "c1", "f", "py"), (1, "b", "py", 2, "r1", "c1", "f", "py"), (2, "c", "js", 1, "r2", None, "f", "js"), (3, "d", "small", 1, "r3", "c2", "g", "go"), (4, "e", "js", 3, "r4", "c4", "g", "js")]
    d = spark.createDataFrame(units, "seq long, unit string, queue string, size long, repo string, cwe string, family string, language string")
    got = [r.unit for r in balance.fill(d, 5, "py", {"repo": 0.2}).orderBy("place").collect()]
    assert got == ["d", "a", "c"]
    rows, dropped = balance.layout([{"v": "v1", "p": None, "n": None}, {"v": "v2", "p": "p2", "n": "n2"}, {"v": "v3", "p": "p3", "n": None}], 2)
    assert rows == ["v1", "n2", "v2", "p2", "v3", "p3"] and dropped == 0
    rows, dropped = balance.layout([{"v": "v1", "p": None, "n": None}, {"v": "v2", "p": "p2", "n": None}], 2)
    assert rows == ["v1", "v2"] and dropped == 1


def test_conflicts_and_round_robin(spark):
    d = spark.createDataFrame([(0, "s", " x", "vulnerable"), (1, "s", "x\n", "safe"), (2, "s", "x", "vulnerable"), (3, "t", "x", "safe"), (4, "s", None, "safe"), (5, "s", None, "safe")], "seq long, split string, code string, label string")
    assert sorted(r.seq for r in balance.drop_conflicts(d).collect()) == [0, 3, 4, 5]
    r = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 1), ("c", 1)], "g string, i int")
    assert [(x.g, x.i) for x in balance.round_robin(r, "g", [F.col("i")], 4).orderBy("i", "g").collect()] == [("a", 1), ("b", 1), ("c", 1), ("a", 2)]


def test_statistics(spark):
    cells = [("x", f"c{i}", 1 + i % 2, 100, 1, 100) for i in range(6)] + [("y", "c", 1, 1, 1, 1), ("x", "gone", 1, None, 1, 1)]
    d = spark.createDataFrame(cells, "k string, cluster string, caught_a long, tokens_a long, caught_b long, tokens_b long")
    got = {r.k: r for r in evaluation.bootstrap(d, ["k"], draws=500).collect()}
    assert got["x"].point == pytest.approx(0.405465, abs=1e-6) and got["x"].n_clusters == 6 and 0 <= got["x"].low <= got["x"].high
    assert got["y"].n_clusters == 1 and got["y"].low is None and got["y"].p_value is None
    n, c = F.col("n"), F.col("c")
    r = spark.createDataFrame([(5, 2), (1, 1)], "n long, c long").select(evaluation.pass_at(n, c, 2).alias("a"), evaluation.pass_all(n, c, 2).alias("b")).collect()
    assert (round(r[0].a, 6), round(r[0].b, 6), r[1].a) == (0.7, 0.1, None)
    runs = spark.createDataFrame([("a", 1, 600_000, True), ("a", 0, 400_000, None), ("a", 1, None, False)], "arm string, caught long, tokens long, alarm boolean")
    e = evaluation.efficiency(runs, ["arm"]).first()
    assert (e.n, e.n_missing, e.per_million) == (2, 1, 1.0)
    f = evaluation.false_alarms(runs, ["arm"]).first()
    assert (f.rate, round(f.low, 4), round(f.high, 4)) == (0.5, 0.3333, 0.6667)
    p = spark.createDataFrame([("a", True, None, None), ("a", False, 1.0, 1.0), ("a", False, 1.0, 0.0), ("a", False, 0.0, None)], "arm string, matched boolean, judged double, human double")
    r = evaluation.ppi(p, ["arm"]).first()
    assert (r.n_labelled, round(r.precision, 6)) == (2, round((1 + 3 * (2 / 3 - 0.5)) / 4, 6)) and r.low < r.precision < r.high
    one = evaluation.ac1(spark.createDataFrame([("R", "R")], "a string, b string"), "a", "b", ["R", "F"]).first()
    assert one.ac1 == 1.0
    y = {r.b: (r.tp, r.j) for r in evaluation.youden(spark.createDataFrame([("z", True, True), ("z", False, False)], "b string, truth boolean, found boolean"), "b").collect()}
    assert y == {"z": (1, 1.0), None: (1, 1.0)}


def test_adhoc(spark):
    t = spark.createDataFrame([("s", "a", 1), ("s", "b", 2), ("other", "c", 3)], "scan_id string, name string, line long")
    scan = adhoc.Scan(spark, "s", {"calls": t})
    assert scan.query("SELECT name FROM calls ORDER BY line", limit=1) == {"rows": [{"name": "a"}], "truncated": True}
    assert scan.query("WITH x AS (SELECT * FROM calls) SELECT count(*) AS n FROM x WHERE line < :k", args={"k": 9})["rows"] == [{"n": 2}]
    for bad in ("DROP TABLE calls", "INSERT INTO calls VALUES (1)", "SELECT * FROM secrets", "SELECT (SELECT max(x) FROM secrets) FROM calls", "SELECT 1; SELECT 2", "SELEC", "", "CREATE TABLE x AS SELECT 1", "SET a=b", "SELECT * FROM parquet.`/tmp/x`", "SELECT * FROM calls WHERE name IN (SELECT n FROM secrets)"):
        assert "error" in scan.query(bad), bad
    assert "error" in scan.query("SELECT nothing FROM calls") and scan.schema() == {"calls": ["name", "line"]}
    lines = spark.createDataFrame([("f", i, "x" * i) for i in range(1, 9)], "file string, lineno long, text string")
    assert [(r.lineno, r.truncated) for r in adhoc.code_window(lines, "f", 3, 9, 2, 3).collect()] == [(3, True), (4, True)]


def test_store(spark, tmp_path):
    rows = spark.createDataFrame([("s", "m", "a.js", None, 1), ("s", "m", None, True, 2)], "scan_id string, uid string, file string, external boolean, seq long")
    one = store.unite(rows, ["scan_id", "uid"], "seq").first()
    assert (one.file, one.external) == ("a.js", True)
    nodes = rows.select("scan_id", "uid")
    good, lost = store.with_ends(spark.createDataFrame([("s", "m", "m"), ("s", "m", "z"), ("s", "z", "z")], "scan_id string, src string, dst string"), nodes, nodes)
    assert good.count() == 1 and lost.count() == 2
    for k in ("s", "t", "s"):
        store.replace_scan(spark.createDataFrame([(k, "m")], "scan_id string, uid string"), str(tmp_path), "nodes")
    assert store.load_scan(spark, str(tmp_path), "nodes", "s").count() == 1 and store.load_scan(spark, str(tmp_path), "nodes", "t").count() == 1
    plan = store.collect_garbage(spark.createDataFrame([("a", 1), ("b", 2)], "scan_id string, built_at long"), 1)
    assert {(r.scan_id, r.kept) for r in plan.collect()} == {("a", False), ("b", True)}


def test_ingest_resumes(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    rec = lambda m: json.dumps({"method_id": m, "vertices": [{"id": m * 10, "label": "CALL", "properties": {}}], "edges": [], "call_edges": [[m * 10, 1]], "cross_rd": []})
    (tmp_path / "in" / "a.jsonl").write_text(rec(1) + "\n" + rec(2) + '\n{"method_id"')
    ingest.ingest(spark, folder, out, state, 1)
    (tmp_path / "in" / "b.jsonl").write_text(rec(2) + "\n" + rec(3))
    ingest.ingest(spark, folder, out, state, 1)
    nodes, edges = ingest.ingested(spark, out)
    assert sorted(r.id for r in nodes.collect()) == [10, 20, 30] and edges.count() == 3


def test_layout_keeps_pairs_together():
    rng = random.Random(6)
    for _ in range(300):
        batch = rng.choice([1, 2, 3, 4])
        units = [{"v": f"v{i}" if rng.random() < 0.9 else None, "p": None, "n": f"n{i}" if rng.random() < 0.4 else None} for i in range(rng.randint(0, 12))]
        for i, u in enumerate(units):
            if u["v"] and rng.random() < 0.6:
                u["p"] = f"p{i}"
        rows, dropped = balance.layout(units, batch)
        at = {r: i for i, r in enumerate(rows)}
        given = [u[k] for u in units for k in "vpn" if u[k]]
        assert len(at) == len(rows) == len(given) - dropped and set(rows) <= set(given)
        assert all(r.startswith("p") for r in set(given) - set(rows))
        for u in units:
            if u["p"] in at:
                assert at[u["p"]] == at[u["v"]] + 1 and (batch == 1 or at[u["p"]] // batch == at[u["v"]] // batch)


def test_fill_keeps_its_caps(spark):
    rng = random.Random(7)
    units = [(i, f"u{i}", rng.choice(["small", "py", "js", "go"]), rng.randint(1, 3), f"r{rng.randrange(9)}", f"c{rng.randrange(6)}", rng.choice(["f", "g", None]), rng.choice(["py", "js", "go"])) for i in range(120)]
    d = spark.createDataFrame(units, "seq long, unit string, queue string, size long, repo string, cwe string, family string, language string")
    got = balance.fill(d, 60, "py", {"repo": 0.2, "cwe": 0.3, "family": 0.4}, ("g",)).orderBy("place").collect()
    by = {u[1]: u for u in units}
    rows = sum(r["rows"] for r in got)
    assert 40 <= rows <= 60
    for at, share in ((4, 0.2), (5, 0.3), (6, 0.4)):
        counts = Counter(by[r.unit][at] for r in got)
        assert all(n <= max(1, int(share * 60)) for v, n in counts.items() if v not in (None, "g"))
    queues = [by[r.unit][2] for r in got]
    assert queues == sorted(queues, key=lambda q: ["small", "py"].index(q) if q in ("small", "py") else 2)
