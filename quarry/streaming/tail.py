"""Growing logs by byte offsets, and the second pass over segments that were read as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans.cut import cut
from quarry.sources.codegraph import segment_graph


def tail(files: DataFrame, cursors: DataFrame, most: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """(lines, cursors): the whole lines of files (path, content) past each one's cursor (path, offset), and the new cursors.

    lines: path, at (byte), value.  A last line without its line break is left for the next time; one of more than `most`
    bytes is passed over; a file without a cursor is read from its start, one that shrank as well.
    """
    d = files.join(cursors.select("path", F.col("offset").alias("__o")), "path", "left")
    size = F.octet_length("content")
    start = F.when(F.col("__o") <= size, F.col("__o")).otherwise(0)
    # one character for each byte
    d = d.withColumn("start", F.coalesce(start, F.lit(0)).cast("int")).withColumn("rest", F.decode(F.expr("substring(content, start + 1)"), "ISO-8859-1"))
    d = d.withColumn("whole", F.length("rest") - F.length(F.substring_index("rest", "\n", -1)))
    d = cut(d.withColumn("rest", F.expr("substring(rest, 1, whole)")).select("path", "start", "whole", "rest"))
    parts = d.where("whole > 0").select("path", "start", F.split(F.expr("substring(rest, 1, whole - 1)"), "\n", -1).alias("ls"))
    lens = F.transform("ls", lambda x: F.length(x) + 1)
    at = F.transform("ls", lambda x, i: F.struct(x.alias("x"), F.aggregate(F.slice(lens, F.lit(1), i), F.lit(0), lambda s, n: s + n).alias("o")))
    lines = parts.select("path", "start", F.explode(at).alias("l")).where(F.length("l.x") <= most)
    lines = lines.select("path", (F.col("start") + F.col("l.o")).cast("bigint").alias("at"), F.decode(F.encode("l.x", "ISO-8859-1"), "UTF-8").alias("value"))
    return lines, d.select("path", (F.col("start") + F.col("whole")).cast("bigint").alias("offset"))


def second_pass(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """(edges, lost) of all segments that were ingested into out: those whose ends some segment has, and the others.

    Calls lead to methods of other segments, so this runs when all of them are there.
    """
    nodes, edges = segment_graph(spark.read.parquet(out))
    ids = cut(nodes.select("id").distinct())
    both = edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    return both, edges.exceptAll(both.select(*edges.columns))
