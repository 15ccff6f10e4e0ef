import random
from collections import defaultdict, deque
from itertools import combinations, permutations

import pytest
from pyspark.sql import functions as F

from quarry.operators import matching, paths, taint

CALLS = "uid string, file string, line int, column int, code string, name string"


def test_candidate_flows(spark):
    calls = [("c_src", "read", "req.body.x"), ("c_mid", "sanitize", ""), ("c_sink", "eval", ""), ("c_log", "log", ""), ("c_loop", "exec", ""), ("c_dead", "noop", "")]
    calls = spark.createDataFrame([(u, "h.js", 1, None, c, n) for u, n, c in calls], CALLS)
    flows = spark.createDataFrame([("c_src", "c_mid"), ("c_mid", "c_sink"), ("c_src", "c_log"), ("c_src", "c_dead"), ("c_loop", "c_loop")], "src string, dst string")
    sources = paths.flow_sources(flows, spark.createDataFrame([("c_src",), ("c_loop",)], "uid string"))
    rules = [paths.SinkRule("code_exec", 5, ("eval", "exec")), paths.SinkRule("log", 1, ("log",))]
    got = [(r.sink_uid, r.source_uid, r.sink_category, r.path_uids) for r in paths.candidate_flows(calls, flows, sources, rules, "s").orderBy("rank").collect()]
    assert got == [("c_loop", "c_loop", "code_exec", ["c_loop"]), ("c_sink", "c_src", "code_exec", ["c_src", "c_mid", "c_sink"]), ("c_log", "c_src", "log", ["c_src", "c_log"])]
    assert paths.candidate_flows(calls, flows, sources, [], "s").count() == 0
    few = paths.candidate_flows(calls, flows, sources, rules, "s", most=1).collect()
    assert [r["rank"] for r in few] == [0] and few[0].sink_uid == "c_loop"


def test_first_paths_equal_a_queue(spark):
    rng = random.Random(5)
    for _ in range(2):
        n = 14
        edges = sorted({(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(30)})
        line = {f"n{i}": rng.randrange(4) for i in range(n)}
        key = lambda u: (line[u], u)
        starts = ["n0", "n3", "n7"]
        after = defaultdict(list)
        for a, b in edges:
            if a != b:
                after[a].append(b)
        want = {s: [s] for s in starts}
        queue = deque(sorted(starts, key=key))
        while queue:
            u = queue.popleft()
            for v in sorted(after[u], key=key):
                if v not in want:
                    want[v] = [*want[u], v]
                    queue.append(v)
        calls = spark.createDataFrame([(u, "f", x, 0, "", "") for u, x in line.items()], CALLS)
        got = paths.first_paths(calls, spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([(s,) for s in starts], "uid string"))
        assert {r.uid: r.path for r in got.collect()} == want


def test_betweenness(spark):
    rng = random.Random(2)
    nodes = list(range(9))
    edges = sorted({(rng.randrange(9), rng.randrange(9)) for _ in range(24)})
    after = defaultdict(set)
    for a, b in edges:
        if a != b:
            after[a].add(b)

    def shortest(s, t):
        level = [[s]]
        for _ in nodes:
            done = [p for p in level if p[-1] == t]
            if done:
                return done
            level = [[*p, v] for p in level for v in after[p[-1]] if v not in p]
        return []

    want = dict.fromkeys(nodes, 0.0)
    for s, t in permutations(nodes, 2):
        found = shortest(s, t)
        for p in found:
            for v in p[1:-1]:
                want[v] += 1 / len(found) / 56
    e = spark.createDataFrame(edges, "src long, dst long")
    got = paths.betweenness(e.unionAll(e), spark.createDataFrame([(i,) for i in nodes], "node long"))
    assert {r.node: pytest.approx(r.centrality) for r in got.collect()} == want
    assert paths.betweenness(e.limit(0), spark.createDataFrame([(1,)], "node long")).first().centrality == 0.0


def test_owners_and_arguments(spark):
    chain = spark.createDataFrame([(i, i - 1) for i in range(1, 40)] + [(99, 98)], "node long, parent long")
    methods = spark.createDataFrame([(0,), (10,)], "node long")
    got = {r.node: r.owner for r in taint.owners(chain, methods).collect()}
    assert got == {i: 0 if i < 10 else 10 for i in range(40)}
    up = spark.createDataFrame([(5, 4, 2), (4, 3, 1), (3, 2, 7)], "node long, parent long, idx int")
    real = spark.createDataFrame([(3,), (2,)], "node long")
    assert {(r.node, r.call, r.idx) for r in taint.real_arguments(up, real).collect()} == {(5, 3, 1), (4, 3, 1), (3, 2, 7)}


def test_flows_to(spark):
    # a is s's own argument, b an argument of t; p is t's parameter, from which u's argument c is reached
    rd = spark.createDataFrame([("s", "a"), ("a", "b"), ("p", "c")], "src string, dst string")
    args = spark.createDataFrame([("a", "s", 1), ("b", "t", 1), ("c", "u", 2)], "node string, call string, idx int")
    params = spark.createDataFrame([("t", 1, "p")], "call string, idx int, param string")
    seeds = spark.createDataFrame([("s",)], "node string")
    got = taint.flows_to(seeds, rd, args, params).collect()
    assert {(r.src, r.call, r.idx, r.provenance) for r in got} == {("s", "t", 1, "proven"), ("s", "u", 2, "inferred")}
    field = taint.flows_to(spark.createDataFrame([("b",)], "node string"), rd, args, params, from_seeds=True).collect()
    assert {(r.call, r.provenance) for r in field} == {("t", "proven"), ("u", "inferred")}
    assert taint.flows_to(seeds.limit(0), rd, args, params).count() == 0


FINDING = "run_id string, idx long, file string, line_start long, line_end long, function string, cwe string"


def test_levels_and_matching(spark):
    found = [(90, None, None, None), (114, 114, None, None), (89, None, None, None), (115, None, None, None), (None, None, "handler", "CWE-89")]
    f = [("r", i, "src/app.js", *x) for i, x in enumerate(found)] + [("r", 9, "other.js", 100, None, None, None), ("r", 10, "myapp.js", 100, None, None, None), ("r", 11, None, 100, None, None, None)]
    k = spark.createDataFrame([("r", "k", "CWE-89", "app.js", 100, 104, "handler")], "run_id string, key_id string, cwe string, file string, line long, end_line long, function string")
    fits = matching.candidates(spark.createDataFrame(f, FINDING), k)
    assert {(r.idx, r.level) for r in fits.collect()} == {(0, 1), (1, 1), (4, 2)}
    assert [(r.idx, r.level) for r in matching.match_greedy(fits).collect()] == [(4, 2)]


def test_maximum_matching_equals_brute_force(spark):
    rng = random.Random(4)
    rows = []
    want = {}
    for run in range(12):
        n, m = rng.randrange(1, 5), rng.randrange(1, 5)
        level = {(i, j): rng.choice([1, 2]) for i in range(n) for j in range(m) if rng.random() < 0.6}
        best = (0, 0, 0)
        for size in range(1, min(n, m) + 1):
            for pairs in combinations(level, size):
                if len({p[0] for p in pairs}) == len({p[1] for p in pairs}) == size:
                    best = max(best, (size, sum(level[p] == 2 for p in pairs), -sum(p[0] for p in pairs)))
        if level:
            rows += [(f"r{run}", i, f"k{j}", lv) for (i, j), lv in level.items()]
            # findings weigh by their number among those that fit anything
            want[f"r{run}"] = best[:2]
    got = defaultdict(list)
    for r in matching.match_maximum(spark.createDataFrame(rows, "run_id string, idx long, key_id string, level int")).collect():
        got[r.run_id].append(r)
    assert {k: (len(v), sum(r.level == 2 for r in v)) for k, v in got.items()} == want
    assert all(len({r.idx for r in v}) == len({r.key_id for r in v}) == len(v) for v in got.values())


def test_leftovers(spark):
    o = spark.createDataFrame([("r", 1, 1, 5, 0), ("r", 1, 2, 9, 3), ("r", 2, 2, 9, 1), ("r", 2, 1, 1, 0)], "run_id string, left_id long, right_id long, shared long, distance long")
    assert {(r.left_id, r.right_id) for r in matching.pair_leftovers(o).collect()} == {(2, 2), (1, 1)}


def test_sink_rules_ties_and_operators(spark):
    rules = [paths.SinkRule("a", 3, ("run",)), paths.SinkRule("b", 3, ("RUN",)), paths.SinkRule("c", 1, ("assign",))]
    d = spark.createDataFrame([("runAll", ""), ("<operator>.assign", "x"), (None, None)], "name string, code string")
    got = [r.x and r.x.category for r in d.select(paths.classify_sink(rules, F.col("name"), F.col("code")).alias("x")).collect()]
    assert got == ["a", None, None]
