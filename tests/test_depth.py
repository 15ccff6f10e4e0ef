from pyspark.sql import functions as F

from quarry.operators.graph import reachable


def test_reachability_has_no_depth_limit(spark):
    edges = spark.range(70).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).coalesce(1)
    got = {(r.node, r.hop) for r in reachable(edges, spark.range(1).select(F.col("id").alias("node"))).collect()}
    assert got == {(i, i) for i in range(71)}
