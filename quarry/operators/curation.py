"""Dataset curation: funnel, entity resolution, splits, conflicts, caps, decontamination, turn merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_reason(checks: list[tuple[str, Column]]) -> Column:
    """The name of the first check that fails, else null; a check that is null fails."""
    return F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks))


def funnel(d: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """reason, n: rows by first failed check; kept for the rest."""
    return d.groupBy(F.coalesce(first_reason(checks), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def resolve(docs: DataFrame) -> DataFrame:
    """One row for each text: the smallest id survives with its source, all sources are united."""
    return docs.groupBy(F.sha2("text", 256).alias("text_sha")).agg(
        F.min("doc_id").alias("survivor"),
        F.min_by("source", "doc_id").alias("source"),
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"),
        F.count("*").alias("n_copies"),
    )


def split_of(key: Column, seed: int, shares: list[tuple[str, int]]) -> Column:
    """The split of a group: its hash's first seven hex digits modulo the shares' sum, so no group is in two splits."""
    total, upto, found = sum(n for _, n in shares), 0, None
    rank = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key, F.lit(""))), 256), 1, 7), 16, 10).cast("bigint") % total
    for name, n in shares:
        upto += n
        found = F.when(rank < upto, name) if found is None else found.when(rank < upto, name)
    return found


def cap_by_group(d: DataFrame, group: list[str], order: list[Column], most: int) -> DataFrame:
    """The first `most` rows of each group."""
    return d.withColumn("__k", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("__k") <= most).drop("__k")


def conflicts(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """Texts that have more than one value of a label: text_sha, n_rows, lowest, highest."""
    j = docs.select("doc_id", F.sha2("text", 256).alias("text_sha")).join(labels.select("doc_id", label), "doc_id")
    return j.groupBy("text_sha").agg(F.count("*").alias("n_rows"), F.min(label).alias("lowest"), F.max(label).alias("highest")).where("lowest <> highest")


def merge_turns(turns: DataFrame) -> DataFrame:
    """Neighbouring turns of one role become one: conv_id, role, first_turn, n_turns, text."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    t = turns.withColumn("fresh", F.when(F.lag("role").over(by).eqNullSafe(F.col("role")), 0).otherwise(1))
    t = t.withColumn("island", F.sum("fresh").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    g = t.groupBy("conv_id", "island").agg(F.first("role").alias("role"), F.min("turn").alias("first_turn"), F.count("*").alias("n_turns"), F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("ts"))
    return g.select("conv_id", "role", "first_turn", "n_turns", F.array_join(F.transform("ts", lambda x: x["text"]), "\n").alias("text"))
