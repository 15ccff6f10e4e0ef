"""Joins by keys of which a few may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is heavy if it holds more than one part in PARTS of the rows, so that there are fewer heavy keys than PARTS, and
#: more rows than any task has use for to be spared.
PARTS, FEW = 1000, 512


def heavy(rows: Column, total: int) -> Column:
    """Whether a key of so many rows is one of the heavy ones among total rows."""
    return (rows * PARTS > total) & (rows > FEW)


def spread_join(left: DataFrame, right: DataFrame, key: str, is_heavy: Column) -> DataFrame:
    """left with the columns of right that has at most one row for each key; null where no key fits, as for a null key.

    is_heavy marks rows of right, fewer than PARTS of them (see heavy): these are sent to all tasks, and rows of left
    with such a key are dealt by their partition, not by their key.
    """
    names = [c for c in right.columns if c != key]
    flagged = right.select(F.col(key).alias("__key"), F.struct(*names).alias("__found"), F.coalesce(is_heavy, F.lit(False)).alias("__heavy"))
    few = flagged.where("__heavy").select(F.col("__key").alias("__k"), F.col("__found").alias("__few"))
    rest = flagged.where("not __heavy").select(F.col("__key").alias("__k"), F.col("__found").alias("__rest"))
    d = left.join(F.broadcast(few), F.col(key) == F.col("__k"), "left").drop("__k")
    # a place of their own for the rows that look for nothing any more
    aside = F.col("__few").isNotNull() | F.col(key).isNull()
    d = d.withColumn("__at", F.when(aside, F.spark_partition_id()).otherwise(F.lit(-1))).withColumn("__j", F.when(~aside, F.col(key)))
    d = d.join(rest.withColumn("__minus", F.lit(-1)), (F.col("__j").eqNullSafe(F.col("__k"))) & (F.col("__at") == F.col("__minus")), "left")
    found = F.coalesce("__few", "__rest")
    return d.select(*(left[c] for c in left.columns), *(found[c].alias(c) for c in names))
