"""Joins beyond equality: as of, by range, innermost, difference."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """left's rows with `value` of right's latest row of the same `by` that isn't later; null if there is none.

    One shuffle: both sides are laid over each other and the last value is carried on inside a window.
    """
    both = left.withColumn("__side", F.lit(1)).withColumn("__value", F.lit(None).cast(right.schema[value].dataType))
    other = right.select(*(F.col(c) if c in (by, at) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns), F.lit(0).alias("__side"), F.col(value).alias("__value"))
    w = Window.partitionBy(by).orderBy(F.col(at).asc_nulls_first(), "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.unionByName(other).withColumn(f"asof_{value}", F.last("__value", ignorenulls=True).over(w))
    return found.where("__side = 1").drop("__side", "__value")


def innermost(points: DataFrame, spans: DataFrame, by: str, at: str, bucket: int) -> DataFrame:
    """points with the shortest span (span_id, start, stop; stop included) of the same `by` around `at`; the smaller id on ties.

    Spans are dealt to buckets of `bucket` units, so the range join is an equality join on (by, bucket) first.
    """
    s = spans.select(F.col(by).alias("__by"), "span_id", "start", "stop", F.explode_outer(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("stop") / bucket))).alias("__bucket"))
    p = points.withColumn("__b", F.floor(F.col(at) / bucket)).withColumn("__row", F.monotonically_increasing_id())
    hit = p.join(s, (F.col(by) == F.col("__by")) & (F.col("__b") == F.col("__bucket")) & F.col(at).between(F.col("start"), F.col("stop")), "left")
    best = hit.groupBy("__row", *points.columns).agg(F.min(F.when(F.col("span_id").isNotNull(), F.struct((F.col("stop") - F.col("start")).alias("size"), "span_id"))).alias("best"))
    return best.select(*points.columns, F.col("best.span_id").alias("span_id"))


def difference(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """keys and state: added, removed or kept, for the distinct keys of two tables; null keys are equal."""
    a, b = (d.select(*keys).distinct().withColumn(n, F.lit(1)) for d, n in ((old, "__a"), (new, "__b")))
    both = a.unionByName(b, allowMissingColumns=True).groupBy(*keys).agg(F.max("__a").alias("a"), F.max("__b").alias("b"))
    return both.select(*keys, F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("kept").alias("state"))
