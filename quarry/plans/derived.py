"""Code graphs, traces and reviews derived from the driver's tables, by expressions that Spark and the checking SQL both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.plans.catalog import table


def _file(number: str, folder: str = "src/") -> str:
    return f"'{folder}f' || CAST({number} AS STRING) || '.js'"


#: name -> table, expressions.
VIEWS = {
    "methods": ("part", ["p_partkey AS seq", f"CASE WHEN p_partkey % 23 = 7 AND p_size % 2 = 1 THEN 'alt/f7.js' ELSE {_file('p_partkey % 23')} END AS file", "p_partkey % 13 * 10 + 5 AS line", "CASE WHEN p_size > 40 THEN 'pkg.<lambda>' ELSE 'pkg.m' END || CAST(p_partkey AS STRING) AS full_name"]),
    "calls": ("orders", ["o_orderkey AS seq", f"{_file('o_custkey % 29')} AS file", "o_orderkey * 7 % 150 + 1 AS line", "'c' || CAST(o_orderkey AS STRING) AS uid", "CASE WHEN o_orderstatus = 'F' THEN '<operator>.add' ELSE o_orderpriority END AS name"]),
    "trace": ("events", ["event_id AS seq", f"CASE WHEN user_id % 4 = 0 THEN {_file('event_id % 31', 'build/')} ELSE {_file('event_id % 31')} END AS file", "event_id % 30 * 5 AS line", "event_id % 5 AS hits", "CASE WHEN event_id % 7 = 0 THEN '<anonymous>' ELSE 'm' || CAST(event_id % 997 AS STRING) END AS name", "event_type AS kind"]),
    "jumps": ("orders", [f"{_file('o_custkey % 31')} AS caller_file", "o_orderkey % 30 * 5 AS caller_line", "CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'm' || CAST(o_orderkey % 997 AS STRING) END AS caller_name", f"{_file('o_orderkey % 27')} AS callee_file", "o_custkey % 30 * 5 AS callee_line", "CASE WHEN o_custkey % 3 = 0 THEN '' ELSE 'm' || CAST(o_custkey % 997 AS STRING) END AS callee_name", "o_orderkey % 3 AS hits"]),
    "sent": ("customer", [f"{_file('c_custkey % 31')} AS site_file", "c_custkey * 7 % 150 + 1 AS site_line", f"{_file('c_nationkey % 25')} AS callee_file", "CASE WHEN c_custkey % 11 > 0 THEN c_custkey % 30 * 5 END AS callee_line", "'' AS callee_name"]),
    "edges": ("lineitem", ["'c' || CAST(l_orderkey AS STRING) AS src", "'c' || CAST(l_partkey AS STRING) AS dst"]),
    "pairs": ("documents", ["doc_id AS seq", "'CVE-' || CAST(doc_id AS STRING) AS id", "source AS repo", "lang AS language", "n_chars AS n_chars"]),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the derived tables."""
    of, columns = VIEWS[name]
    return table(spark, sf_dir, of).selectExpr(*columns)


def sql(*names: str) -> str:
    """The derived tables as common table expressions."""
    return ",\n ".join(f"{n} AS (SELECT {', '.join(VIEWS[n][1])} FROM {VIEWS[n][0]})" for n in names)
