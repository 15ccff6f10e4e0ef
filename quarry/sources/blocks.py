"""State that runs through a text file's lines, found without gathering the file in one task.

A file's lines are read as rows with the place of their block and their order inside it.  What a line inherits from all
lines before it is found inside each block, and the blocks' summaries, one row each, are carried on from block to block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.plans.cut import cut

FILE, BLOCK, AT = "__file", "__block", "__at"


def read_lines(spark: SparkSession, path: str, line_sep: str = "\n") -> DataFrame:
    """value, and where it stands: file, block of the file, increasing number inside the block."""
    reader = spark.read.option("lineSep", line_sep)
    d = reader.text(path).select("value", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias(BLOCK))
    return cut(d.withColumn(AT, F.monotonically_increasing_id()))


def running_sum(d: DataFrame, name: str, value: Column, before: bool = False) -> DataFrame:
    """Adds the sum of value over a file's lines up to each line, or up to the line before it."""
    d = d.withColumn("__v", value.cast("bigint"))
    blocks = d.groupBy(FILE, BLOCK).agg(F.sum("__v").alias("__s"))
    earlier = Window.partitionBy(FILE).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(FILE, BLOCK, F.coalesce(F.sum("__s").over(earlier), F.lit(0)).alias("__carry"))
    upto = Window.partitionBy(FILE, BLOCK).orderBy(AT).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    inside = F.coalesce(F.sum("__v").over(upto), F.lit(0))
    return d.withColumn("__in", inside).join(blocks, [FILE, BLOCK]).withColumn(name, F.col("__carry") + F.col("__in")).drop("__v", "__in", "__carry")


def last_before(d: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds the last non-null value up to each line of a file."""
    d = d.withColumn("__v", value)
    blocks = d.groupBy(FILE, BLOCK).agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), F.col(AT))).alias("__s"))
    earlier = Window.partitionBy(FILE).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(FILE, BLOCK, F.last("__s", ignorenulls=True).over(earlier).alias("__carry"))
    upto = Window.partitionBy(FILE, BLOCK).orderBy(AT).rowsBetween(Window.unboundedPreceding, 0)
    inside = F.last("__v", ignorenulls=True).over(upto)
    return d.withColumn("__in", inside).join(blocks, [FILE, BLOCK]).withColumn(name, F.coalesce("__in", "__carry")).drop("__v", "__in", "__carry")
