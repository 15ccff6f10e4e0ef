import random

from pyspark.sql import functions as F

from quarry.operators import curation, evaluation, joins
from quarry.operators.components import connected_components
from quarry.operators.graph import reachable


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    for n, m in ((1, 0), (30, 25), (60, 40)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + ([(0, 5), (0, 5), (None, 3)] if m else [])
        parent = list(range(n))

        def find(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for a, b in edges:
            if a is not None and find(a) != find(b):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
        linked = {x for a, b in edges if a is not None and a != b for x in (a, b)}
        got = connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()
        assert {(r.node, r.component) for r in got} == {(i, find(i)) for i in linked}


def test_chain_and_star(spark):
    chain = spark.range(200).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    star = spark.range(1000, 1200).select(F.col("id").alias("src"), F.lit(5000).cast("long").alias("dst"))
    got = {r.component: r["count"] for r in connected_components(chain.unionAll(star)).groupBy("component").count().collect()}
    assert got == {0: 201, 1000: 201}


def test_reachability(spark):
    edges = spark.createDataFrame([("entry", "c1"), ("c1", "helper"), ("helper", "c2"), ("c1", "c3"), ("orphan", "c9"), ("c3", "c1")], "src string, dst string")
    entries = spark.createDataFrame([("entry",), (None,)], "node string")
    assert {(r.node, r.hop) for r in reachable(edges, entries).collect()} == {("entry", 0), ("c1", 1), ("helper", 2), ("c3", 2), ("c2", 3)}
    assert reachable(edges, entries.limit(0)).count() == 0


def test_asof_takes_the_latest_not_later(spark):
    left = spark.createDataFrame([(1, 5), (1, 0), (2, 9)], "k long, t long")
    right = spark.createDataFrame([(1, 5, "b"), (1, 3, "a"), (2, 10, "z")], "k long, t long, v string")
    assert {(r.k, r.t, r.asof_v) for r in joins.asof(left, right, "k", "t", "v").collect()} == {(1, 5, "b"), (1, 0, None), (2, 9, None)}


def test_first_reason_counts_null_as_failed(spark):
    d = spark.createDataFrame([(1,), (None,), (9,)], "x long")
    got = {r.reason: r.n for r in curation.funnel(d, [("small", F.col("x") < 5)]).collect()}
    assert got == {"kept": 1, "small": 2}


def test_statistics(spark):
    holm = evaluation.holm(spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "n string, p double"), "n", "p")
    assert {r.n: round(r.holm, 6) for r in holm.collect()} == {"a": 0.03, "b": 0.06, "c": 0.06}
    k = evaluation.kappa(spark.createDataFrame([(1, 1), (1, 0), (0, 0)], "a int, b int"), "a", "b").first()
    assert k.kappa == 0.4
    k = evaluation.kappa(spark.createDataFrame([(1, 1)], "a int, b int"), "a", "b").first()
    assert k.kappa is None and k.observed == 1.0
    s = spark.createDataFrame([("x", 1), ("x", None), ("y", 2)], "g string, v long").groupBy("g").agg(evaluation.poisoned_sum(F.col("v")).alias("s"))
    assert {r.g: r.s for r in s.collect()} == {"x": None, "y": 2}
    low, high = evaluation.wilson(F.col("h"), F.col("n"))
    r = spark.createDataFrame([(0, 10), (0, 0)], "h long, n long").select(low.alias("l"), high.alias("h")).collect()
    assert r[0].l == 0.0 and r[1].l is None
