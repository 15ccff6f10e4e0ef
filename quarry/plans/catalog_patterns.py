"""Registered pattern queries: customers, orders and parts as a graph of one scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans import adhoc, patterns
from quarry.plans.catalog import query, table


def _graph(spark: SparkSession, sf_dir: str) -> patterns.Graph:
    """Two scans, of even and of odd customers and what belongs to them."""
    scan = lambda key: f"CASE WHEN {key} % 2 = 0 THEN 'even' ELSE 'odd' END AS scan_id"
    t = lambda name: table(spark, sf_dir, name)
    nodes = {
        "Customer": t("customer").selectExpr(scan("c_custkey"), "'c' || CAST(c_custkey AS STRING) AS uid", "c_custkey AS key", "c_mktsegment AS segment", "c_nationkey AS nation", "c_acctbal AS balance"),
        "Order": t("orders").selectExpr(scan("o_custkey"), "'o' || CAST(o_orderkey AS STRING) AS uid", "o_orderkey AS key", "o_orderstatus AS status", "o_totalprice AS price", "split(o_orderpriority, '-') AS words"),
    }
    edges = {
        "ORDERED": t("orders").selectExpr(scan("o_custkey"), "'c' || CAST(o_custkey AS STRING) AS src", "'o' || CAST(o_orderkey AS STRING) AS dst", "o_totalprice AS price"),
        "NEXT": t("orders").selectExpr(scan("o_custkey"), "'o' || CAST(o_orderkey AS STRING) AS src", "'o' || CAST(o_orderkey + 2 AS STRING) AS dst"),
    }
    return patterns.Graph(spark, "even", nodes, edges)


@query("""
SELECT c_mktsegment AS segment, count(*) AS n, round(max(o_totalprice), 2) AS most, count(DISTINCT c_custkey) AS customers FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 2 = 0 AND o_orderstatus = 'F' AND NOT c_nationkey IN (1, 2) GROUP BY 1
""")
def qry02_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step with properties and conditions, grouped by what isn't aggregated."""
    q = "MATCH (c:Customer)-[:ORDERED]->(o:Order {status: 'F'}) WHERE NOT c.nation IN [1, 2] RETURN c.segment AS segment, count(*) AS n, round(max(o.price), 2) AS most, count(DISTINCT c.uid) AS customers"
    return _graph(spark, sf_dir).frame(q)


@query("""
SELECT c_custkey AS key, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000 WHERE c_custkey % 2 = 0 GROUP BY 1 HAVING count(o_orderkey) < 3
""")
def qry02_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An optional step, and a condition on an aggregate."""
    return _graph(spark, sf_dir).frame("MATCH (c:Customer) OPTIONAL MATCH (c)-[:ORDERED]->(o:Order) WHERE o.price > 300000 WITH c.key AS key, count(o.uid) AS n WHERE n < 3 RETURN key, n")


@query("""
WITH o AS (SELECT * FROM orders WHERE o_custkey % 2 = 0) SELECT a.o_orderkey AS start, b.o_orderkey AS stop FROM o a JOIN o b ON b.o_orderkey IN (a.o_orderkey + 2, a.o_orderkey + 4, a.o_orderkey + 6)
WHERE a.o_orderstatus = 'P' AND NOT EXISTS (SELECT 1 FROM range(0, 6, 2) k(i) WHERE a.o_orderkey + i < b.o_orderkey AND NOT EXISTS (SELECT 1 FROM o m WHERE m.o_orderkey = a.o_orderkey + i))
""")
def qry02_varied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One to three steps along the orders of one scan."""
    return _graph(spark, sf_dir).frame("MATCH (a:Order {status: 'P'})-[:NEXT*1..3]->(b:Order) RETURN a.key AS start, b.key AS stop")


@query("""
WITH w AS (SELECT o_orderkey, unnest(string_split(o_orderpriority, '-')) AS w FROM orders WHERE o_custkey % 2 = 0) SELECT upper(w) AS word, count(*) AS n FROM w WHERE w IN ('LOW', 'HIGH', '1') OR starts_with(w, 'MED') GROUP BY 1
""")
def qry02_unwind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists unwound, with conditions on texts and a parameter."""
    q = "MATCH (o:Order) UNWIND o.words AS w WITH w WHERE w IN $words OR w STARTS WITH 'MED' RETURN toUpper(w) AS word, count(*) AS n"
    return _graph(spark, sf_dir).frame(q, {"words": ["LOW", "HIGH", "1"]})


@query("""
SELECT o_orderkey AS key, CASE WHEN o_totalprice > 250000 THEN 'large' ELSE 'small' END AS size, len(list_filter(string_split(o_orderpriority, '-'), lambda x: contains(x, 'E'))) = 1 AS one, list_contains(string_split(o_orderpriority, '-'), 'LOW') AS low
FROM orders WHERE o_custkey % 2 = 0 ORDER BY o_totalprice DESC, o_orderkey LIMIT 40 OFFSET 10
""")
def qry02_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List predicates, cases, and a page of an ordered result."""
    q = "MATCH (o:Order) RETURN o.key AS key, CASE WHEN o.price > 250000 THEN 'large' ELSE 'small' END AS size, single(x IN o.words WHERE x CONTAINS 'E') AS one, any(x IN o.words WHERE x = 'LOW') AS low ORDER BY o.price DESC, key SKIP 10 LIMIT 40"
    return _graph(spark, sf_dir).frame(q)


@query("SELECT c_mktsegment AS name FROM customer WHERE c_custkey % 2 = 0 UNION SELECT o_orderstatus FROM orders WHERE o_custkey % 2 = 0")
def qry02_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two branches, rows once each."""
    return _graph(spark, sf_dir).frame("MATCH (c:Customer) RETURN c.segment AS name UNION MATCH (o:Order) RETURN o.status AS name", strict=False)


@query("""
WITH q AS (SELECT p_partkey AS id, p_partkey % 6 AS k FROM part) SELECT id, k IN (0, 1, 4) AS refused FROM q
""")
def qry03_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of six kinds of query the guard refuses: writes, steps without a bound, and one that another scan's data would need."""
    forms = ["MATCH (n:M) DELETE n", "MATCH (a)-[:X*]->(b) RETURN a", "MATCH (a:M {scan_id: $scan_id}) RETURN a.x", "MATCH (a:M {scan_id: $scan_id})-[:X*1..3]->(b) WITH b RETURN b", "MATCH (a:M) RETURN a", "MATCH (a:M) WHERE a.scan_id = $scan_id AND a.x > 1 RETURN a"]
    refused = F.array(*(F.lit(patterns.scope_problem(q) is not None) for q in forms))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.get(refused, (F.col("p_partkey") % len(forms)).cast("int")).alias("refused"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_custkey % 2 = 0 GROUP BY 1 ORDER BY n DESC LIMIT 2")
def qry01_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read-only SQL over one scan, through the guard."""
    d = table(spark, sf_dir, "orders").selectExpr("CASE WHEN o_custkey % 2 = 0 THEN 'even' ELSE 'odd' END AS scan_id", "o_orderstatus")
    got = adhoc.Scan(spark, "even", {"calls": d}).query("with t as (select o_orderstatus, count(*) as n from calls group by 1) select * from t order by n desc", limit=2)
    return spark.createDataFrame([(r["o_orderstatus"], r["n"]) for r in got["rows"]], "o_orderstatus string, n bigint")


@query("SELECT 'calls' AS name, count(*) AS n FROM orders WHERE o_custkey % 2 = 0 UNION ALL SELECT 'methods', count(*) FROM customer WHERE c_custkey % 2 = 0")
def qry10_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by table of one scan."""
    scan = lambda t, k: table(spark, sf_dir, t).selectExpr(f"CASE WHEN {k} % 2 = 0 THEN 'even' ELSE 'odd' END AS scan_id")
    counts = adhoc.Scan(spark, "even", {"calls": scan("orders", "o_custkey"), "methods": scan("customer", "c_custkey")}).counts()
    return spark.createDataFrame(sorted(counts.items()), "name string, n bigint")
