"""Column expressions shared by the operators on texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters that part words and that are stripped from lines.
WS = " \t\n\x0b\x0c\r"


def whole(text: Column) -> Column:
    """A null text is an empty one."""
    return F.coalesce(text, F.lit(""))


def split_words(text: Column, between: str = r"[\x20\x09-\x0D]+", ends: str = WS) -> Column:
    """The words of a text that isn't null: what stands between runs of separators; none for a text of separators."""
    inner = F.btrim(text, F.lit(ends))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, between))


def literal_rows(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    """A small fixed table as a plan of literals, without Python on the executors."""
    structs = [F.struct(*(F.lit(v).alias(n) for n, v in zip(names, row, strict=True))) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))
