"""Registered queries of the steps between tables of a review and what is made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import code
from quarry.operators import codeindex, evaluation, rows, search
from quarry.plans.catalog import query, table


@query("SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'a' || doc_id ELSE 'm' || doc_id END AS pair_id, lang AS label, CASE WHEN doc_id % 3 = 0 THEN 'dev' ELSE 'train' END AS split FROM documents")
def hlp13_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields at the top of a row, else in its meta."""
    d = table(spark, sf_dir, "documents").selectExpr("doc_id AS id", "CASE WHEN doc_id % 2 = 0 THEN 'a' || CAST(doc_id AS STRING) END AS pair_id", "named_struct('pair_id', 'm' || CAST(doc_id AS STRING), 'label', lang, 'split', CASE WHEN doc_id % 3 = 0 THEN 'dev' ELSE 'train' END) AS meta")
    return rows.normalised_examples(d)


@query("""
SELECT o_orderkey AS run_id, CASE o_orderkey % 3 WHEN 0 THEN 'src/a.js' WHEN 1 THEN 'b.js' END AS file, CASE WHEN o_orderkey % 3 < 2 AND o_custkey % 5 > 0 THEN o_custkey % 5 END AS line, CASE WHEN o_orderkey % 3 = 0 AND o_custkey % 5 > 0 AND o_orderkey % 7 >= o_custkey % 5 THEN o_orderkey % 7 END AS line_end, CASE WHEN o_orderkey % 3 = 1 AND o_orderkey % 2 = 0 THEN 'CWE-79' END AS cwe FROM orders
""")
def evl01_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of arms that name their fields differently, validated."""
    d = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS run_id", "CASE o_orderkey % 3 WHEN 0 THEN 'x' WHEN 1 THEN 'y' ELSE 'z' END AS arm", "CASE WHEN o_orderkey % 3 = 0 THEN './src\\\\a.js' ELSE ' ' END AS path", "CASE WHEN o_orderkey % 3 = 1 THEN 'b.js' END AS f", "o_custkey % 5 AS at", "o_orderkey % 7 AS to", "CASE WHEN o_orderkey % 2 = 0 THEN 'cwe: 79' ELSE 'CWE 79x' END AS weak")
    got = rows.finding(d, {"x": {"file": "path", "line": "at", "line_end": "to"}, "y": {"file": "f", "line": "at", "cwe": "weak"}})
    return got.select("run_id", "file", "line", "line_end", "cwe")


@query("""
WITH a AS (SELECT DISTINCT c_nationkey % 12 AS id, ['flow', 'method', 'note'][1 + (c_custkey % 3)::INT] AS kind, c_custkey AS span_id FROM customer WHERE c_nationkey % 12 < 5 AND (c_nationkey % 2 = 0 OR c_custkey % 3 > 0)), k AS (SELECT *, CASE kind WHEN 'flow' THEN 1 WHEN 'method' THEN 2 END AS k FROM a WHERE kind <> 'note'),
 f AS (SELECT id, span_id, kind AS basis FROM (SELECT *, min(k) OVER (PARTITION BY id) AS m FROM k) WHERE k = m), c AS (SELECT DISTINCT s_suppkey % 12 AS id, s_suppkey AS span_id FROM supplier WHERE s_suppkey % 12 > 6 OR s_suppkey < 30), r AS (SELECT * FROM c WHERE id NOT IN (SELECT id FROM f)), n AS (SELECT id, count(*) AS n FROM r GROUP BY 1)
SELECT * FROM f UNION ALL SELECT r.id, span_id, 'changed' FROM r JOIN n USING (id) WHERE n <= 3 UNION ALL SELECT id, NULL, 'sprawling' FROM n WHERE n > 3
""")
def cur09_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated spans by priority, else the changed functions unless there are too many."""
    a = table(spark, sf_dir, "customer").where("c_nationkey % 12 < 5 AND (c_nationkey % 2 = 0 OR c_custkey % 3 > 0)").selectExpr("c_nationkey % 12 AS id", "element_at(array('flow', 'method', 'note'), 1 + CAST(c_custkey % 3 AS INT)) AS kind", "c_custkey AS span_id")
    c = table(spark, sf_dir, "supplier").where("s_suppkey % 12 > 6 OR s_suppkey < 30").selectExpr("s_suppkey % 12 AS id", "s_suppkey AS span_id")
    return rows.targets(a, c, ["flow", "method"], 3)


@query("""
WITH l AS (SELECT c_nationkey AS file, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS lineno, c_name AS text FROM customer), a AS (SELECT s_suppkey AS case_id, s_nationkey AS file, 3 + s_suppkey % 6 AS line, 2 AS start, 12 AS stop FROM supplier),
 w AS (SELECT *, greatest(start, least(line - 2, stop - 4)) AS lo FROM a)
SELECT case_id, lo::BIGINT AS start, least(stop, lo + 4)::BIGINT AS stop, string_agg(text, chr(10) ORDER BY lineno) AS text FROM w JOIN l ON l.file = w.file AND lineno BETWEEN lo AND least(stop, lo + 4) GROUP BY 1, 2, 3
""")
def cur11_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five lines around each case's anchor, within its function."""
    n = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")).cast("bigint")
    l = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("file"), n.alias("lineno"), F.col("c_name").alias("text"))  # noqa: E741
    a = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS case_id", "s_nationkey AS file", "3 + s_suppkey % 6 AS line", "CAST(2 AS BIGINT) AS start", "CAST(12 AS BIGINT) AS stop")
    return rows.snippet(l, a, 5)


@query("""
WITH r AS (SELECT o_custkey AS pair_id, o_orderkey AS seq, CASE o_orderkey % 3 WHEN 0 THEN 'vulnerable' WHEN 1 THEN 'patched' ELSE 'negative' END AS label, o_orderkey + 1 AS twin, o_orderkey % 2 = 0 AS has_twin, o_orderkey % 5 = 0 AS has_sink FROM orders),
 v AS (SELECT pair_id, seq AS v, twin FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY CASE WHEN has_twin THEN 0 ELSE 1 END, seq) AS k FROM r WHERE label = 'vulnerable') WHERE k = 1), n AS (SELECT pair_id, seq AS n FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY CASE WHEN has_sink THEN 0 ELSE 1 END, seq) AS k FROM r WHERE label = 'negative') WHERE k = 1)
SELECT p.pair_id, v, t.seq AS p, n FROM (SELECT DISTINCT pair_id FROM r) p LEFT JOIN v USING (pair_id) LEFT JOIN n USING (pair_id) LEFT JOIN r t ON t.pair_id = p.pair_id AND t.seq = v.twin AND t.label = 'patched'
""")
def cur15_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vulnerable row, its twin and a negative of each pair, by preference."""
    r = table(spark, sf_dir, "orders").selectExpr("o_custkey AS pair_id", "o_orderkey AS seq", "CASE o_orderkey % 3 WHEN 0 THEN 'vulnerable' WHEN 1 THEN 'patched' ELSE 'negative' END AS label", "o_orderkey + 1 AS twin", "o_orderkey % 2 = 0 AS has_twin", "o_orderkey % 5 = 0 AS has_sink")
    return rows.units(r)


_CANDIDATES = "o_orderkey AS id, o_custkey % 30 AS repo, o_orderstatus AS kind, CASE WHEN o_orderkey % 4 > 0 THEN '2024-0' || CAST(1 + o_orderkey % 9 AS STRING) END AS a, CASE WHEN o_orderkey % 3 > 0 THEN '2024-0' || CAST(1 + o_custkey % 9 AS STRING) END AS b"


@query(f"""
WITH c AS (SELECT {_CANDIDATES} FROM orders), f AS (SELECT *, least(a, b) AS f FROM c), s AS (SELECT *, CASE WHEN f IS NULL THEN 'undated' WHEN f <= '2024-02' THEN 'early' END AS st FROM f)
SELECT id, f AS first_public, CASE WHEN a = f THEN 'a' WHEN b = f THEN 'b' END AS basis, coalesce(st, CASE WHEN row_number() OVER (PARTITION BY repo, kind, st IS NULL ORDER BY f, id) > 4 THEN 'over_cap' END, 'kept') AS state FROM s
""")
def cur22_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test candidates by their first public date, with a cap for each repository and kind."""
    c = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "o_custkey % 30 AS repo", "o_orderstatus AS kind", *("CASE" + x for x in _CANDIDATES.split(", CASE")[1:]))
    return rows.test_candidates(rows.first_public(c, ["a", "b"]), "2024-02", 4).select("id", "first_public", "basis", "state")


@query("""
WITH s AS (SELECT c_custkey AS span_id, c_nationkey AS file, c_custkey % 60 AS start, c_custkey % 60 + c_custkey % 9 AS stop FROM customer), p AS (SELECT o_orderkey AS point_id, o_custkey % 30 AS file, o_orderkey % 90 AS line FROM orders), h AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY stop - start, start DESC, span_id) AS k FROM p JOIN s ON s.file = p.file AND line BETWEEN start AND stop),
 b AS (SELECT point_id, span_id, start, stop FROM h WHERE k = 1), n AS (SELECT n_nationkey AS file, 40 + n_nationkey AS n FROM nation)
SELECT p.point_id, span_id, CASE WHEN b.point_id IS NOT NULL THEN start WHEN n IS NOT NULL AND line BETWEEN 1 AND n THEN greatest(1, line - 20) END AS start, CASE WHEN b.point_id IS NOT NULL THEN stop WHEN n IS NOT NULL AND line BETWEEN 1 AND n THEN greatest(line, least(n, line + 20)) END AS stop FROM p LEFT JOIN b USING (point_id) LEFT JOIN n ON n.file = p.file
""")
def jo07_enclosing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest function around each place, else the lines around it."""
    s = table(spark, sf_dir, "customer").selectExpr("c_custkey AS span_id", "c_nationkey AS file", "c_custkey % 60 AS start", "c_custkey % 60 + c_custkey % 9 AS stop")
    p = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS point_id", "o_custkey % 30 AS file", "o_orderkey % 90 AS line")
    return codeindex.enclosing(p, s, table(spark, sf_dir, "nation").selectExpr("n_nationkey AS file", "40 + n_nationkey AS n_lines")).select("point_id", "span_id", "start", "stop")


@query("""
WITH s AS (SELECT c_custkey AS span_id, c_nationkey AS file, c_custkey % 60 AS start, c_custkey % 60 + c_custkey % 9 AS stop FROM customer), p AS (SELECT o_orderkey AS point_id, o_custkey % 30 AS file, o_orderkey % 90 AS line FROM orders), h AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY stop - start, start DESC, span_id) AS k FROM p JOIN s ON s.file = p.file AND line BETWEEN start AND stop)
SELECT min(point_id) AS point_id, span_id FROM h WHERE k = 1 AND span_id NOT IN (SELECT s_suppkey FROM supplier) GROUP BY 2
""")
def hlp04_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One case for each function around a finding that isn't a target already."""
    s = table(spark, sf_dir, "customer").selectExpr("c_custkey AS span_id", "c_nationkey AS file", "c_custkey % 60 AS start", "c_custkey % 60 + c_custkey % 9 AS stop")
    p = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS point_id", "o_custkey % 30 AS file", "o_orderkey % 90 AS line")
    return rows.case_per_span(p, s, table(spark, sf_dir, "nation").selectExpr("n_nationkey AS file", "40 + n_nationkey AS n_lines"), table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS span_id"))


@query("SELECT o_custkey AS run_id, min(o_orderkey) AS idx, 'k' AS key_id FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 AND o_custkey % 4 > 0 GROUP BY 1")
def hlp08_credited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge's decisions on findings without a file, for keys that nothing else caught."""
    o = table(spark, sf_dir, "orders")
    d = o.selectExpr("o_custkey AS run_id", "o_orderkey AS idx", "'k' AS key_id", "o_orderkey % 3 = 0 AS real")
    f = o.selectExpr("o_custkey AS run_id", "o_orderkey AS idx", "CASE WHEN o_orderkey % 2 = 1 THEN 'f' END AS file")
    return rows.credited(d, f, o.where("o_custkey % 4 = 0").selectExpr("o_custkey AS run_id", "'k' AS key_id").distinct(), 120)


@query("""
WITH e AS (SELECT user_id AS run_id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'end' ELSE 'step' END AS kind, CASE WHEN event_type = 'purchase' THEN 's' || event_id % 3 END AS status FROM events)
SELECT run_id, CASE WHEN max(seq) FILTER (kind = 'end') IS NULL THEN 'running' ELSE arg_max(status, seq) FILTER (status IS NOT NULL) END AS status, min(seq) FILTER (kind = 'start') AS started, max(seq) FILTER (kind = 'end') AS ended, count(*) FILTER (kind = 'step') AS n_steps FROM e GROUP BY 1
""")
def hlp21_log_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs by their event log."""
    e = table(spark, sf_dir, "events").selectExpr("user_id AS run_id", "event_id AS seq", "CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'end' ELSE 'step' END AS kind", "CASE WHEN event_type = 'purchase' THEN 's' || CAST(event_id % 3 AS STRING) END AS status", "event_id AS at")
    return rows.log_states(e)


@query("""
WITH s AS (SELECT o_custkey AS uid, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k, CASE WHEN o_orderkey % 3 > 0 THEN 'f.js' ELSE '?' END AS file, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey::VARCHAR ELSE '?' END AS line, CASE WHEN o_orderkey % 2 = 0 THEN 'a < < b > > c' ELSE '' END AS code FROM orders)
SELECT uid, string_agg((k + 1) || '. ' || file || ':' || line || '  ' || code, chr(10) ORDER BY k) AS text FROM s GROUP BY 1
""")
def hlp22_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows as numbered lines of text."""
    at = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    s = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("uid"), at.alias("at"), F.when(F.col("o_orderkey") % 3 > 0, "f.js").alias("file"), F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderkey")).alias("line"), F.when(F.col("o_orderkey") % 2 == 0, "a << b >> c").alias("code"))
    return rows.rendered_flow(s)


@query("""
WITH a AS (SELECT DISTINCT c_nationkey AS f, c_custkey % 9 AS l FROM customer WHERE c_custkey % 4 > 0), b AS (SELECT DISTINCT s_nationkey AS f, s_suppkey % 9 AS l FROM supplier) SELECT coalesce(a.f, b.f) AS f, coalesce(a.l, b.l) AS l, CASE WHEN b.f IS NULL THEN 'only_a' WHEN a.f IS NULL THEN 'only_b' ELSE 'both' END AS state FROM a FULL JOIN b ON a.f = b.f AND a.l = b.l
""")
def hlp23_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that two sources agree on, and those that one has alone."""
    a = table(spark, sf_dir, "customer").selectExpr("CASE WHEN c_custkey % 4 > 0 THEN c_nationkey END AS f", "c_custkey % 9 AS l")
    return rows.agreeing_spans(a, table(spark, sf_dir, "supplier").selectExpr("s_nationkey AS f", "s_suppkey % 9 AS l"), ["f", "l"])


@query("SELECT 'node' AS kind, 'N|' || o_custkey % 40 AS key, 1::BIGINT AS n FROM orders GROUP BY 2 UNION ALL SELECT 'edge', 'E|' || o_custkey % 9 || '|' || o_orderkey % 9, count(*) FROM orders GROUP BY 2")
def hlp24_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct nodes, and edges with how often they stand."""
    o = table(spark, sf_dir, "orders")
    return rows.structure(o.selectExpr("'N' AS label", "o_custkey % 40 AS uid"), o.selectExpr("'E' AS label", "o_custkey % 9 AS src", "o_orderkey % 9 AS dst"))


@query("""
WITH o AS (SELECT p_partkey AS node, p_partkey % 7 AS owner FROM part) SELECT 'intra' AS kind, a.owner, l_partkey AS x, l_partkey * 3 % 200 AS y FROM lineitem JOIN o a ON a.node = l_partkey JOIN o b ON b.node = l_partkey * 3 % 200 WHERE l_linenumber = 1 AND a.owner = b.owner
UNION ALL SELECT 'calls', owner, s, NULL FROM (SELECT DISTINCT owner, l_suppkey AS s FROM lineitem JOIN o ON node = l_partkey WHERE l_linenumber = 2)
""")
def g02_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges inside one owner, and the owners' calls."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    o = table(spark, sf_dir, "part").selectExpr("p_partkey AS node", "p_partkey % 7 AS owner")
    intra, calls = rows.partition(o, l.where("l_linenumber = 1").selectExpr("l_partkey AS src", "l_partkey * 3 % 200 AS dst"), l.where("l_linenumber = 2").selectExpr("l_partkey AS call", "l_suppkey AS callee"))
    return intra.selectExpr("'intra' AS kind", "owner", "src AS x", "dst AS y").unionAll(calls.selectExpr("'calls' AS kind", "owner", "callee AS x", "CAST(NULL AS BIGINT) AS y"))


@query("""
WITH s AS (SELECT c_custkey % 1200 AS case_id, 'c' || c_nationkey AS category, c_custkey % 3 > 0 AS real, CASE WHEN c_custkey % 50 > 0 THEN 'f' END AS file FROM customer), g AS (SELECT category, sum(CASE WHEN real THEN 1 ELSE -1 END) AS d FROM s GROUP BY 1)
SELECT case_id, 'stands twice' AS error FROM s GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT DISTINCT case_id, 'isn''t known' FROM s WHERE case_id NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT case_id, 'has no file' FROM s WHERE file IS NULL UNION ALL SELECT NULL, 'unbalanced: ' || category FROM g WHERE abs(d) > 1
""")
def hlp16_sample_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with a sample."""
    s = table(spark, sf_dir, "customer").selectExpr("c_custkey % 1200 AS case_id", "'c' || CAST(c_nationkey AS STRING) AS category", "c_custkey % 3 > 0 AS real", "CASE WHEN c_custkey % 50 > 0 THEN 'f' END AS file")
    return rows.sample_errors(s, table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS case_id"))


@query("""
WITH f AS (SELECT o_custkey::VARCHAR AS run_id, o_orderkey AS idx FROM orders), t AS (SELECT run_id, idx FROM f WHERE idx % 3 = 0), m AS (SELECT run_id, min(idx) AS idx FROM t GROUP BY 1)
SELECT run_id, idx, CASE WHEN (run_id, idx) IN (SELECT run_id, idx FROM m) THEN 'matched' WHEN idx % 3 = 0 THEN 'duplicate' ELSE 'unmatched' END AS state FROM f
""")
def evl03_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that match, repeat a match, or match nothing."""
    f = table(spark, sf_dir, "orders").selectExpr("CAST(o_custkey AS STRING) AS run_id", "o_orderkey AS idx")
    t = f.where("idx % 3 = 0")
    return rows.duplicates(t, t.groupBy("run_id").agg(F.min("idx").alias("idx")), f)


@query("""
WITH t AS (SELECT n_name AS name, (n_nationkey * 7 % 25) / 2000 AS p, n_nationkey % 4 - 1 AS gain, n_nationkey / 100 AS far_a, 0.1 AS far_b FROM nation), k AS (SELECT *, row_number() OVER (ORDER BY p, name) AS k, count(*) OVER () AS m FROM t),
 h AS (SELECT *, max(least(1.0::DOUBLE, p * (m - k + 1))) OVER (ORDER BY p, name) AS holm, bool_and(p <= 0.05::DOUBLE / (m - k + 1)) OVER (ORDER BY p, name) AS rejects FROM k)
SELECT name, round(holm, 8) AS holm, rejects, CASE WHEN rejects AND gain > 0 AND far_a - far_b <= 0.05 THEN 'better' WHEN rejects AND gain < 0 THEN 'worse' ELSE 'open' END AS decision FROM h
""")
def evl09_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions step by step, with a margin of alarms."""
    t = table(spark, sf_dir, "nation").selectExpr("n_name AS name", "(n_nationkey * 7 % 25) / 2000 AS p", "n_nationkey % 4 - 1 AS gain", "n_nationkey / 100 AS far_a", "0.1D AS far_b")
    return rows.decisions(t).select("name", F.round("holm", 8).alias("holm"), "rejects", "decision")


@query("""
WITH s AS (SELECT count(*) AS n, avg((quality = toxic)::INT) AS po, (avg(quality) + avg(toxic)) / 2 AS p FROM labels) SELECT n, round((po - 2 * p * (1 - p)) / (1 - 2 * p * (1 - p)), 6) AS ac1 FROM s
""")
def evl12_ac1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement by AC1."""
    d = evaluation.ac1(table(spark, sf_dir, "labels"), "quality", "toxic", [0, 1])
    return d.select("n", F.round("ac1", 6).alias("ac1"))


@query("SELECT doc_id, array_to_string(list_slice(list_distinct_ordered, 1, 32), ' ') AS q FROM (SELECT doc_id, list_transform(list_sort(list_transform(list_distinct(w), lambda x: {'k': list_position(w, x), 'x': x})), lambda y: y.x) AS list_distinct_ordered FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents))")
def sea03_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 32 distinct letter runs of each text."""
    return table(spark, sf_dir, "documents").select("doc_id", code.keyword_query(F.col("text")).alias("q"))


@query("""
WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id, round(list_cosine_similarity(q::DOUBLE[], embedding::DOUBLE[]), 6) AS similarity FROM q JOIN embeddings ON vec_id <> query_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s)
SELECT query_id, 'm' || vec_id AS name, rank FROM r WHERE rank <= 5
""")
def sea08_exploit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest documents of each query, by name."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    d = search.knn(v, v.where("vec_id % 50 = 0"), 5)
    return d.select("query_id", F.concat(F.lit("m"), F.col("vec_id").cast("string")).alias("name"), "rank")
