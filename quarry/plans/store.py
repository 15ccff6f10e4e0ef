"""Writing graphs by scan: nodes with united properties, edges whose ends exist, one partition replaced at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def unite(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """One row for each key: each column's last non-null value by seq."""
    rest = [c for c in rows.columns if c not in (*keys, seq)]
    return rows.groupBy(*keys).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in rest))


def edge_rows(edges: DataFrame, seq: str, repeated: tuple[str, ...] = ("FLOWS_TO",)) -> DataFrame:
    """Edges (label, src, dst, ...) once for each label and ends, with each property's last non-null value; those of the
    repeated labels all stay."""
    many = F.col("label").isin(*repeated)
    return unite(edges.where(~many), ["label", "src", "dst"], seq).unionByName(edges.where(many).drop(seq))


def persist(nodes: DataFrame, edges: DataFrame, folder: str, strict: bool = False) -> dict[str, int]:
    """Writes the nodes and, of the edges, those whose ends exist, scan by scan; how many were given, written and lost.

    strict: raises if an edge has lost an end.
    """
    replace_scan(nodes, folder, "nodes")
    kept, lost = with_ends(edges, nodes, nodes)
    replace_scan(kept, folder, "edges")
    counts = {"nodes": nodes.count(), "edges": kept.count(), "lost": lost.count()}
    if strict and counts["lost"]:
        raise ValueError(f"{counts['lost']} edges have lost an end")
    return counts


def with_ends(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (scan_id, src, dst, ...) whose ends are among the nodes (scan_id, uid), and those whose aren't."""
    s = sources.select("scan_id", F.col("uid").alias("src")).distinct()
    t = targets.select("scan_id", F.col("uid").alias("dst")).distinct()
    good = edges.join(s, ["scan_id", "src"], "left_semi").join(t, ["scan_id", "dst"], "left_semi")
    no_src = edges.join(s, ["scan_id", "src"], "left_anti")
    no_dst = edges.join(s, ["scan_id", "src"], "left_semi").join(t, ["scan_id", "dst"], "left_anti")
    return good, no_src.unionByName(no_dst)


def replace_scan(d: DataFrame, folder: str, table: str) -> None:
    """Write rows to a table of Parquet files by scan_id; only the scans that occur in d are replaced."""
    d.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scan_id").parquet(f"{folder}/{table}")


def load_scan(spark: SparkSession, folder: str, table: str, scan_id: str) -> DataFrame:
    """One scan's rows; the others' files aren't read."""
    return spark.read.parquet(f"{folder}/{table}").where(F.col("scan_id") == scan_id)


def collect_garbage(scans: DataFrame, keep: int) -> DataFrame:
    """scan_id, built_at, kept: the newest `keep` scans are kept; the others are a plan to delete, not a deletion."""
    newest = scans.orderBy(F.desc("built_at"), "scan_id").limit(keep).select("scan_id", F.lit(True).alias("__k"))
    return scans.join(newest, "scan_id", "left").select("scan_id", "built_at", F.coalesce("__k", F.lit(False)).alias("kept"))
