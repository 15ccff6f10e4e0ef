"""Registered queries of evaluations: queues, usage, pair metrics, samples, verdicts, matching, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import evaluation, matching, runs
from quarry.plans.catalog import query, table


@query("""
WITH arms AS (SELECT DISTINCT c_mktsegment AS arm FROM customer), items AS (SELECT DISTINCT 'r' || n_regionkey AS repo, 's' || n_nationkey AS commit_sha, CASE WHEN n_nationkey % 2 = 0 THEN 'k' ELSE '' END AS case_id FROM nation), p AS (SELECT *, unnest(range(1, 4))::INT AS run_no FROM arms, items),
 a AS (SELECT c_mktsegment AS arm, 'r' || n_regionkey AS repo, 's' || c_nationkey AS commit_sha, CASE WHEN c_nationkey % 2 = 0 THEN 'k' ELSE '' END AS case_id, 1 + (c_custkey % 4)::INT AS run_no, c_custkey AS attempt_no, CASE c_custkey % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'running' WHEN 2 THEN 'aborted' WHEN 3 THEN 'hung' ELSE 'error' END AS status FROM customer JOIN nation ON n_nationkey = c_nationkey),
 l AS (SELECT arm, repo, commit_sha, case_id, run_no, arg_max(CASE status WHEN 'running' THEN 'crashed' ELSE status END, attempt_no) AS status, max(attempt_no) AS last FROM a GROUP BY ALL)
SELECT p.arm, p.repo, p.commit_sha, p.case_id, p.run_no, coalesce(last, 0) + 1 AS next_attempt FROM p LEFT JOIN l USING (arm, repo, commit_sha, case_id, run_no) WHERE status IS NULL OR status = 'aborted'
""")
def evl05_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots of an evaluation that still have to run, with the number of the next attempt."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    case = "CASE WHEN {0} % 2 = 0 THEN 'k' ELSE '' END AS case_id"
    items = n.selectExpr("'r' || CAST(n_regionkey AS STRING) AS repo", "'s' || CAST(n_nationkey AS STRING) AS commit_sha", case.format("n_nationkey"))
    status = "CASE c_custkey % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'running' WHEN 2 THEN 'aborted' WHEN 3 THEN 'hung' ELSE 'error' END AS status"
    a = c.join(n, F.col("n_nationkey") == F.col("c_nationkey")).selectExpr("c_mktsegment AS arm", "'r' || CAST(n_regionkey AS STRING) AS repo", "'s' || CAST(c_nationkey AS STRING) AS commit_sha", case.format("c_nationkey"), "1 + CAST(c_custkey % 4 AS INT) AS run_no", "c_custkey AS attempt_no", status)
    return runs.pending(runs.plan(sorted(r[0] for r in c.select("c_mktsegment").distinct().collect()), items.distinct(), 3), a)


@query("""
WITH r AS (SELECT event_id AS id, event_id % 100 AS i, (event_id * 7) % 90 AS c, event_id % 3 AS v FROM events)
SELECT id, CASE v WHEN 0 THEN CASE WHEN id % 5 = 0 THEN NULL ELSE i + c END WHEN 1 THEN CASE WHEN id % 4 = 0 THEN NULL ELSE greatest(0, i - c) END ELSE i END AS uncached_in, CASE v WHEN 0 THEN CASE WHEN id % 5 = 0 THEN NULL ELSE c END WHEN 1 THEN CASE WHEN id % 4 = 0 THEN NULL ELSE c END END AS cache_read,
 CASE WHEN v = 2 THEN 4 END AS cache_write, CASE v WHEN 0 THEN CASE WHEN id % 5 > 0 THEN 6 END ELSE 9 END AS out, CASE WHEN v = 1 THEN 3 END AS reasoning,
 CASE v WHEN 0 THEN CASE WHEN id % 5 = 0 THEN 0 ELSE i + c + c + 6 END WHEN 1 THEN CASE WHEN id % 4 = 0 THEN 9 ELSE greatest(0, i - c) + c + 9 END ELSE i + 4 + 9 END AS total FROM r
""")
def evl06_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of two vendors' logs in one form; nulls stay where a count isn't given."""
    i, c = "CAST(event_id % 100 AS STRING)", "CAST((event_id * 7) % 90 AS STRING)"
    many = f"""'{{"modelUsage":{{"a":{{"inputTokens":' || {i} || ',"outputTokens":6}},"b":{{"inputTokens":' || {c} || ',"cacheReadInputTokens":' || {c} || '}}}},"usage":{{"input_tokens":1}}}}'"""
    codex = f"""'{{"usage":{{"input_tokens":' || {i} || CASE WHEN event_id % 4 = 0 THEN '' ELSE ',"cached_input_tokens":' || {c} END || ',"output_tokens":9,"reasoning_output_tokens":3}}}}'"""
    one = f"""'{{"usage":{{"input_tokens":' || {i} || ',"cache_creation_input_tokens":4,"output_tokens":9}}}}'"""
    raw = f"CASE event_id % 3 WHEN 0 THEN CASE WHEN event_id % 5 = 0 THEN 'torn' ELSE {many} END WHEN 1 THEN {codex} ELSE {one} END AS raw"
    d = table(spark, sf_dir, "events").selectExpr("event_id AS id", "CASE event_id % 3 WHEN 1 THEN 'codex' ELSE 'claude' END AS vendor", raw)
    return runs.usage(d)


_OUTCOMES = "o_custkey % 5 AS arm, o_custkey AS pair_id, CASE o_orderkey % 4 WHEN 0 THEN 'vulnerable' WHEN 1 THEN 'vulnerable' WHEN 2 THEN 'patched' ELSE 'negative' END AS label, {flag} AS flagged"
_FLAG = "CASE WHEN o_orderkey % 4 < 2 THEN o_totalprice > 100000 ELSE o_totalprice > 400000 END"
_PAIR = f"""
 o AS (SELECT {_OUTCOMES.format(flag=_FLAG)} FROM orders),
 p AS (SELECT arm, pair_id, count(*) FILTER (label = 'vulnerable') AS v, count(*) FILTER (label = 'vulnerable' AND flagged) AS vf, count(*) FILTER (label = 'patched') AS p, count(*) FILTER (label = 'patched' AND flagged) AS pf,
   count(*) FILTER (label = 'negative') AS n, count(*) FILTER (label = 'negative' AND flagged) AS nf FROM o GROUP BY 1, 2), t AS (SELECT *, (v > 0 AND p > 0)::BIGINT AS two, (v > 0 AND p > 0 AND v = vf AND pf = 0)::BIGINT AS fine FROM p)
"""


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS row_id", *[x.strip() for x in _OUTCOMES.format(flag=_FLAG).split(", ")])


@query(f"WITH {_PAIR} SELECT pair_id, v AS n_vulnerable, vf AS flagged_vulnerable, p AS n_patched, pf AS flagged_patched, n AS n_negative, nf AS flagged_negative, two AS two_sided, fine AS correct FROM t")
def agg16_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight counts of each pair."""
    return runs.pair_counts(_outcomes(spark, sf_dir), ["pair_id"])


@query(f"""
WITH {_PAIR}, s AS (SELECT arm, sum(v) AS v, sum(vf) AS vf, sum(p) AS p, sum(pf) AS pf, sum(n) AS n, sum(nf) AS nf, sum(two) AS two, sum(fine) AS fine FROM t GROUP BY 1)
SELECT arm, (v + p + n)::BIGINT AS n, round(vf / v, 6) AS vuln_recall, round((p - pf) / p, 6) AS patched_silence, round((n - nf) / n, 6) AS negative_silence, round((p + n - pf - nf) / (p + n), 6) AS nonvuln_silence, round(fine / two, 6) AS pair_correct FROM s
""")
def agg15_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall, silences and correct pairs of each arm."""
    d = runs.judged(_outcomes(spark, sf_dir), ["arm"])
    return d.select("arm", "n", *(F.round(c, 6).alias(c) for c in runs.metrics()))


@query(f"""
WITH {_PAIR}, s AS (SELECT sum(v) AS v, sum(vf) AS vf, sum(p) AS p, sum(pf) AS pf, sum(n) AS n, sum(nf) AS nf, sum(two) AS two, sum(fine) AS fine FROM t)
SELECT unnest(['vuln_recall', 'patched_silence', 'negative_silence', 'nonvuln_silence', 'pair_correct']) AS metric, round(unnest([vf / v, (p - pf) / p, (n - nf) / n, (p + n - pf - nf) / (p + n), fine / two]), 6) AS a, 0.0::DOUBLE AS diff, 0.0::DOUBLE AS low, 0.0::DOUBLE AS high FROM s
""")
def evl10_paired_same(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate against itself: no difference in any draw."""
    o = _outcomes(spark, sf_dir)
    d = runs.paired(o, o, draws=200)
    return d.select("metric", F.round("a", 6).alias("a"), "diff", "low", "high")


@query("""
WITH RECURSIVE g AS (SELECT o_custkey AS pair_id, count(*) AS n, row_number() OVER (ORDER BY sha256('3:' || o_custkey), o_custkey) AS k FROM orders GROUP BY 1),
 w AS (SELECT 0::BIGINT AS k, 200::BIGINT AS room, false AS taken, 0::BIGINT AS pair_id UNION ALL SELECT g.k, CASE WHEN n <= room THEN room - n ELSE room END, n <= room, g.pair_id FROM w JOIN g ON g.k = w.k + 1 WHERE room > 0)
SELECT o_custkey AS pair_id, o_orderkey FROM orders WHERE o_custkey IN (SELECT pair_id FROM w WHERE taken)
""")
def evl11_sample_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pairs that fit into two hundred rows, one after the other in the order of a hash."""
    return runs.sample_pairs(table(spark, sf_dir, "orders").selectExpr("o_custkey AS pair_id", "o_orderkey"), 200, 3)


@query("""
WITH c AS (SELECT c_custkey AS case_id, 'c' || c_nationkey % 7 AS category, c_custkey % 2 = 0 AS real FROM customer), k AS (SELECT category, row_number() OVER (ORDER BY sha256('5:bonus:' || category), category) <= 44 % 7 AS bonus FROM c GROUP BY 1),
 q AS (SELECT category, 44 // 7 + bonus::INT AS quota FROM k), o AS (SELECT *, row_number() OVER (PARTITION BY quota % 2 ORDER BY sha256('5:odd:' || category), category) AS t FROM q), w AS (SELECT category, quota // 2 + (quota % 2 = 1 AND t % 2 = 1)::INT AS n_real, quota - quota // 2 - (quota % 2 = 1 AND t % 2 = 1)::INT AS n_trap FROM o),
 r AS (SELECT *, row_number() OVER (PARTITION BY category, real ORDER BY sha256('5:' || case_id), case_id) AS n FROM c)
SELECT case_id, r.category, real FROM r JOIN w USING (category) WHERE n <= CASE WHEN real THEN n_real ELSE n_trap END
""")
def evl11_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """44 cases, spread over categories, real and trap ones balanced."""
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey AS case_id", "'c' || CAST(c_nationkey % 7 AS STRING) AS category", "c_custkey % 2 = 0 AS real")
    return runs.balanced_sample(c, 44, 5)


@query("""
WITH r AS (SELECT o_orderstatus AS arm, o_custkey AS run_id, sum(CASE WHEN o_orderkey % 6 > 0 THEN o_totalprice END) AS wall, max(o_orderkey) AS rss FROM orders GROUP BY 1, 2)
SELECT arm, count(wall) AS n, count(*) - count(wall) AS n_missing, round(avg(wall), 4) AS mean, round(median(wall), 4) AS median, round(max(wall), 4) AS most, max(rss) AS rss FROM r GROUP BY 1
""")
def agg10_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time and memory of runs, summed by run first."""
    o = table(spark, sf_dir, "orders").selectExpr("o_orderstatus AS arm", "o_custkey AS run_id", "CASE WHEN o_orderkey % 6 > 0 THEN o_totalprice END AS wall", "o_orderkey AS rss")
    return runs.resources(o, ["arm"]).select("arm", "n", "n_missing", *(F.round(c, 4).alias(c) for c in ("mean", "median", "most")), "rss")


@query("""
WITH e AS (SELECT o_orderpriority AS label, count(*) AS n FROM orders GROUP BY 1), w AS (SELECT o_orderpriority AS label, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority <> '1-URGENT' GROUP BY 1 UNION ALL SELECT 'extra', 1)
SELECT coalesce(e.label, w.label) AS label, coalesce(e.n, 0) AS expected, coalesce(w.n, 0) AS written, coalesce(e.n, 0) - coalesce(w.n, 0) AS missing FROM e FULL JOIN w ON e.label = w.label
""")
def agg17_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What should have been written, and what was."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("label"), "o_orderstatus")
    w = o.where("o_orderstatus <> 'P' and label <> '1-URGENT'").select("label").unionAll(spark.range(1).select(F.lit("extra").alias("label")))
    return runs.tally(o, w)


_DECISION = "CASE o_orderkey % 5 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'REJECT' WHEN 2 THEN 'INCONCLUSIVE' WHEN 3 THEN 'REJECT' ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'CONFIRM' ELSE 'REJECT' END END AS decision"


@query(f"""
WITH v AS (SELECT o_custkey AS key, o_orderkey AS seq, {_DECISION} FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY CASE decision WHEN 'CONFIRM' THEN 0 WHEN 'INCONCLUSIVE' THEN 1 WHEN 'REJECT' THEN 2 ELSE 3 END, seq) AS k, min(seq) OVER (PARTITION BY key) AS slot FROM v)
SELECT key, seq, decision, slot FROM r WHERE k = 1
""")
def rnk04_gravest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gravest verdict of each key."""
    return runs.gravest(table(spark, sf_dir, "orders").selectExpr("o_custkey AS key", "o_orderkey AS seq", _DECISION), ["key"])


@query("SELECT p_partkey, p_size AS rank, p_type || p_partkey AS shape FROM part ORDER BY p_size, p_type || p_partkey LIMIT 30")
def rnk09_interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first thirty rows, shapes by turns."""
    return runs.interleaved(table(spark, sf_dir, "part").selectExpr("p_partkey", "p_size AS rank", "p_type || CAST(p_partkey AS STRING) AS shape"), 30)


@query("""
WITH l AS (SELECT c_custkey AS id, substr('ABCD', 1 + (c_custkey % 4)::INT, 1) AS shape, CASE c_custkey % 5 WHEN 0 THEN 'CWE-862' WHEN 1 THEN 'CWE-798' WHEN 2 THEN 'CWE-89' WHEN 3 THEN NULL ELSE 'CWE-79' END AS cwe, c_nationkey % 2 = 0 AS anchored, c_custkey % 3 AS files FROM customer)
SELECT id, CASE WHEN cwe = 'CWE-862' OR (anchored AND files <> 1) THEN 'full' WHEN cwe = 'CWE-798' OR (shape IN ('C', 'D') AND NOT anchored) THEN 'light' ELSE 'full' END AS route FROM l
""")
def prj13_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How closely each lead is looked at."""
    files = "CASE c_custkey % 3 WHEN 1 THEN array('a', 'a', NULL) WHEN 2 THEN array('a', 'b') END"
    d = table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "substr('ABCD', 1 + CAST(c_custkey % 4 AS INT), 1) AS shape", "CASE c_custkey % 5 WHEN 0 THEN 'CWE-862' WHEN 1 THEN 'CWE-798' WHEN 2 THEN 'CWE-89' WHEN 3 THEN NULL ELSE 'CWE-79' END AS cwe", "c_nationkey % 2 = 0 AS anchored", f"{files} AS files")
    return d.select("id", runs.route(F.col("shape"), F.col("cwe"), F.col("anchored"), F.col("files")).alias("route"))


@query("""
WITH r AS (SELECT o_custkey AS run_id, CASE WHEN o_custkey % 4 = 0 THEN 'ok' ELSE 'failed' END AS status, CASE o_custkey % 3 WHEN 0 THEN 'claude' WHEN 1 THEN 'codex' ELSE 'local' END AS agent FROM orders GROUP BY 1), h AS (SELECT DISTINCT o_custkey AS run_id FROM orders WHERE o_orderkey % 12 IN (3, 7))
SELECT run_id, agent, CASE WHEN status <> 'ok' AND agent <> 'local' AND run_id IN (SELECT run_id FROM h) THEN 'aborted' ELSE status END AS status FROM r
""")
def hlp06_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that failed at a limit of the service, by their logs."""
    line = """CASE o_orderkey % 12 WHEN 3 THEN 'Claude usage limit reached' WHEN 7 THEN '{"type":"result","subtype":"error_rate_limit"}' WHEN 1 THEN '{"type":"assistant","message":"usage limit"}' WHEN 2 THEN 'context limit reached' WHEN 5 THEN '[1, 2]' ELSE 'fine' END AS line"""
    o = table(spark, sf_dir, "orders")
    r = o.selectExpr("o_custkey AS run_id", "CASE WHEN o_custkey % 4 = 0 THEN 'ok' ELSE 'failed' END AS status", "CASE o_custkey % 3 WHEN 0 THEN 'claude' WHEN 1 THEN 'codex' ELSE 'local' END AS agent").distinct()
    return runs.run_outcomes(r, o.selectExpr("o_custkey AS run_id", line))


@query("""
WITH f AS (SELECT c_custkey AS idx, 'src/f' || c_nationkey || '.js' AS file, c_mktsegment || ' injection' AS text FROM customer), k AS (SELECT n_nationkey AS key_id, 'f' || n_nationkey || '.js' AS file, ['build', 'mach' || n_regionkey] AS words FROM nation)
SELECT DISTINCT idx, key_id FROM f JOIN (SELECT key_id, file AS kf, unnest(words) AS w FROM k) k ON (contains(f.file, kf) OR contains(kf, f.file)) AND contains(lower(text), w)
""")
def evl04_class_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings against keys by part of the file's name and words of the class, many to many."""
    f = table(spark, sf_dir, "customer").selectExpr("c_custkey AS idx", "'src/f' || CAST(c_nationkey AS STRING) || '.js' AS file", "c_mktsegment || ' injection' AS text")
    k = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS key_id", "'f' || CAST(n_nationkey AS STRING) || '.js' AS file", "array('build', 'mach' || CAST(n_regionkey AS STRING)) AS words")
    return runs.class_matches(f, k)


@query("""
WITH r AS (SELECT event_id AS reply_id, event_id % 4 AS k, event_id % 50 AS line FROM events)
SELECT reply_id, 0 AS item, 'SQL' AS title, 'a.js' AS file, line, 'CWE-89' AS cwe, 'HIGH' AS confidence FROM r WHERE k IN (0, 1) UNION ALL SELECT reply_id, 2, 'XSS', NULL, NULL, NULL, 'LOW' FROM r WHERE k = 0
""")
def hlp01_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in replies; malformed ones drop out, an unknown confidence is low."""
    one = """'{"title":"SQL","file":"a.js","line":' || CAST(event_id % 50 AS STRING) || ',"cwe":"CWE-89","confidence":"high"}'"""
    body = f"""CASE event_id % 4 WHEN 0 THEN '{{"findings":[' || {one} || ',{{"file":"b"}},{{"title":"XSS","line":"x","confidence":"sure"}}]}}' WHEN 1 THEN '{{"findings":[' || {one} || ']}}' WHEN 2 THEN '{{"findings":' ELSE '{{"findings":[]}}' END AS body"""
    d = runs.to_leads(table(spark, sf_dir, "events").selectExpr("event_id AS reply_id", body))
    return d.select("reply_id", F.col("item").cast("int").alias("item"), "title", "file", "line", "cwe", "confidence")


@query("""
WITH l AS (SELECT c_custkey AS lead_id FROM customer), v AS (SELECT o_custkey AS lead_id, CASE o_orderkey % 4 WHEN 0 THEN 'CONFIRM' WHEN 1 THEN 'REJECT' ELSE 'maybe' END AS decision FROM orders WHERE o_orderkey % 7 = 0)
SELECT lead_id, coalesce(min(decision) FILTER (decision <> 'maybe'), 'ERROR') AS decision FROM l LEFT JOIN v USING (lead_id) GROUP BY 1
""")
def hlp01_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads with their verdict; without a readable one they are errors."""
    l = table(spark, sf_dir, "customer").selectExpr("c_custkey AS lead_id")  # noqa: E741
    v = table(spark, sf_dir, "orders").where("o_orderkey % 7 = 0").selectExpr("o_custkey AS lead_id", "CASE o_orderkey % 4 WHEN 0 THEN 'CONFIRM' WHEN 1 THEN 'REJECT' ELSE 'maybe' END AS decision", "'r' AS reason")
    return runs.with_verdicts(l, v).drop("reason")


@query("""
WITH f AS (SELECT c_custkey AS flow_id, (row_number() OVER (ORDER BY c_custkey) - 1) // 4 AS batch FROM customer), l AS (SELECT o_orderkey AS seq, o_custkey // 4 AS batch, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END AS flow_id FROM orders)
SELECT seq, CASE WHEN f.flow_id IS NOT NULL THEN f.flow_id ELSE (SELECT min(g.flow_id) FROM f g WHERE g.batch = l.batch) END AS flow_id, f.flow_id IS NULL AS unresolved FROM l LEFT JOIN f ON f.flow_id = l.flow_id
""")
def hlp03_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads of batches of flows; those without a flow go to their batch's first."""
    f = runs.batches(table(spark, sf_dir, "customer").selectExpr("c_custkey AS flow_id", "c_custkey AS rank"), 4, [F.col("rank")])
    l = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS seq", "o_custkey div 4 AS batch", "CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END AS flow_id")  # noqa: E741
    return runs.batch_leads(l, f).select("seq", "flow_id", "unresolved")


@query("""
WITH f AS (SELECT o_orderkey AS uid, o_custkey % 30 AS source_uid, o_custkey % 20 AS sink_uid FROM orders), l AS (SELECT c_custkey AS lead_id, c_custkey % 40 AS source_uid, c_custkey % 25 AS sink_uid FROM customer)
SELECT lead_id, min(uid) AS flow_uid, CASE WHEN min(uid) IS NULL THEN 'own' ELSE 'p' || min(uid) END AS path FROM l LEFT JOIN f USING (source_uid, sink_uid) GROUP BY 1
""")
def hlp05_flow_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each lead's flow, or else its own path."""
    f = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS uid", "o_custkey % 30 AS source_uid", "o_custkey % 20 AS sink_uid", "array('p' || CAST(o_orderkey AS STRING)) AS path_uids", "o_orderkey AS rank")
    l = table(spark, sf_dir, "customer").selectExpr("c_custkey AS lead_id", "c_custkey % 40 AS source_uid", "c_custkey % 25 AS sink_uid", "array('own') AS path")  # noqa: E741
    return runs.flow_of(l, f).select("lead_id", "flow_uid", F.array_join("path", " ").alias("path"))


@query("SELECT DISTINCT o_custkey % 2000 AS row_id FROM orders WHERE o_custkey % 2000 NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 > 0)")
def evl13_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that runs name and the manifest doesn't have."""
    return runs.unknown_rows(table(spark, sf_dir, "orders").selectExpr("o_custkey % 2000 AS row_id"), table(spark, sf_dir, "customer").where("c_custkey % 3 > 0").selectExpr("c_custkey AS row_id"))


@query("""
SELECT r.run_id, r.status, e.message FROM (SELECT c_custkey AS run_id, CASE WHEN c_custkey % 3 = 0 THEN 'ok' ELSE 'failed' END AS status FROM customer) r LEFT JOIN (SELECT user_id AS run_id, event_id::VARCHAR AS message FROM events WHERE event_type = 'error') e ON e.run_id = r.run_id WHERE r.status <> 'ok'
""")
def evl15_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that didn't end well, with their errors."""
    r = table(spark, sf_dir, "customer").selectExpr("c_custkey AS run_id", "CASE WHEN c_custkey % 3 = 0 THEN 'ok' ELSE 'failed' END AS status")
    return runs.failures(r, table(spark, sf_dir, "events").selectExpr("user_id AS run_id", "event_type AS kind", "CAST(event_id AS STRING) AS message"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'malformed' WHEN c_custkey % 2 = 0 THEN 'done' WHEN c_custkey % 3 = 0 THEN 'stopped' WHEN c_custkey % 5 = 0 THEN 'running' ELSE 'incomplete' END AS state FROM customer")
def evl16_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each run by what its folder holds."""
    d = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_custkey % 11 > 0 AS readable", "c_custkey % 2 = 0 AS has_result", "c_custkey % 3 = 0 AS has_stop", "c_custkey % 5 = 0 AS alive")
    return d.select("c_custkey", runs.run_state(d).alias("state"))


_PATHS = "p AS (SELECT o_custkey % 60 AS run_id, o_orderkey AS at, 'src/f' || (o_orderkey % 23) || '.js' AS file, o_orderkey % 80 AS line FROM orders WHERE o_orderkey % 40 = 0), s AS (SELECT c_custkey AS run_id, 'f' || c_nationkey || '.js' AS file, c_custkey % 80 AS line FROM customer WHERE c_custkey < 80), e AS (SELECT s_suppkey AS run_id, 'src/f' || s_nationkey || '.js' AS file FROM supplier WHERE s_suppkey < 90)"


@query(f"""
WITH {_PATHS}, h AS (SELECT DISTINCT run_id, file FROM p), w AS (SELECT run_id, file FROM s UNION SELECT run_id, file FROM e), a AS (SELECT run_id, count(*) AS a FROM h GROUP BY 1), b AS (SELECT run_id, count(*) AS b FROM w GROUP BY 1), c AS (SELECT run_id, count(*) AS tp FROM h JOIN w USING (run_id, file) GROUP BY 1)
SELECT run_id, EXISTS (SELECT 1 FROM p JOIN s ON s.run_id = p.run_id WHERE p.run_id = n.run_id AND (p.file = s.file OR ends_with(p.file, '/' || s.file)) AND abs(p.line - s.line) <= 10) AS fix_traversal, EXISTS (SELECT 1 FROM p JOIN e USING (run_id, file) WHERE p.run_id = n.run_id) AS entry_hit,
 round(CASE WHEN a IS NULL OR b IS NULL THEN NULL ELSE 2 * coalesce(tp, 0) / (a + b) END, 6) AS f1 FROM (SELECT * FROM a FULL JOIN b USING (run_id)) n LEFT JOIN c USING (run_id)
""")
def evl02_path_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether runs' paths pass fix sites and entries, and how well their files agree."""
    p = table(spark, sf_dir, "orders").where("o_orderkey % 40 = 0").selectExpr("o_custkey % 60 AS run_id", "o_orderkey AS at", "'src/f' || CAST(o_orderkey % 23 AS STRING) || '.js' AS file", "o_orderkey % 80 AS line")
    s = table(spark, sf_dir, "customer").where("c_custkey < 80").selectExpr("c_custkey AS run_id", "'f' || CAST(c_nationkey AS STRING) || '.js' AS file", "c_custkey % 80 AS line")
    e = table(spark, sf_dir, "supplier").where("s_suppkey < 90").selectExpr("s_suppkey AS run_id", "'src/f' || CAST(s_nationkey AS STRING) || '.js' AS file")
    return runs.path_scores(p, s, e).withColumn("f1", F.round("f1", 6))


@query("SELECT o_orderstatus AS arm, round(avg(CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 5 END), 6) AS level, round(avg(o_custkey % 2), 6) AS hit FROM orders GROUP BY 1")
def agg11_path_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over the runs that have a value."""
    o = table(spark, sf_dir, "orders").selectExpr("o_orderstatus AS arm", "CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 5 END AS level", "o_custkey % 2 AS hit")
    return runs.mean_levels(o, ["arm"], ["level", "hit"]).select("arm", *(F.round(c, 6).alias(c) for c in ("level", "hit")))


@query("SELECT o_custkey AS id, CASE WHEN NOT bool_or(o_orderkey % 30 = 0) THEN strftime(min(o_orderdate), '%Y-%m-%d') END AS fix_date FROM orders GROUP BY 1")
def hlp09_merged_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first date that a merge brought in, unless its list was cut."""
    return runs.merged_fix(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), (F.col("o_orderkey") % 30 == 0).alias("truncated")))


@query("""
WITH c AS (SELECT c_nationkey AS id, 'lib' || c_custkey % 6 || CASE WHEN c_custkey % 2 = 0 THEN '/a/b.c' ELSE '' END AS path FROM customer), m AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'lib1' ELSE 'lib2/a' END AS module FROM nation) SELECT DISTINCT c.id, path FROM c JOIN m ON m.id = c.id AND (path = module OR starts_with(path, module || '/'))
""")
def hlp09_submodules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed paths that are submodules or lie under one."""
    c = table(spark, sf_dir, "customer").selectExpr("c_nationkey AS id", "'lib' || CAST(c_custkey % 6 AS STRING) || CASE WHEN c_custkey % 2 = 0 THEN '/a/b.c' ELSE '' END AS path")
    return runs.submodule_hits(c, table(spark, sf_dir, "nation").selectExpr("n_nationkey AS id", "CASE WHEN n_nationkey % 2 = 0 THEN 'lib1' ELSE 'lib2/a' END AS module"))


@query("SELECT DISTINCT o_custkey AS scan_id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def hlp20_unrecorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans with nodes and without a record."""
    return runs.unrecorded(table(spark, sf_dir, "orders").selectExpr("o_custkey AS scan_id"), table(spark, sf_dir, "customer").where("c_acctbal > 0").selectExpr("c_custkey AS scan_id"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'incomplete' WHEN c_mktsegment <> 'BUILDING' THEN 'built with ' || c_mktsegment END AS why FROM customer")
def hlp20_usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a scan can't be used again."""
    d = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_acctbal >= 0 AS complete", "c_mktsegment AS profile")
    return d.select("c_custkey", runs.usable(d, "BUILDING").alias("why"))


_MATCH = """
 f AS (SELECT o_custkey % 40 AS run_id, o_orderkey AS idx, CASE WHEN o_orderkey % 2 = 0 THEN './src/f' ELSE 'f' END || (o_custkey % 7) || '.js' AS file, o_orderkey % 200 AS a, o_orderkey % 200 + o_orderkey % 90 AS b, 'pkg.m' || o_orderkey % 30 AS fn, 'CWE-' || o_orderkey % 4 AS cwe FROM orders WHERE o_orderkey % 3 = 0),
 k AS (SELECT c_custkey % 40 AS run_id, c_custkey AS key_id, 'src/f' || (c_custkey % 7) || '.js' AS file, c_custkey * 3 % 200 AS a, c_custkey * 3 % 200 + 4 AS b, 'm' || c_custkey % 30 || '()' AS fn, 'CWE-' || c_custkey % 4 AS cwe FROM customer)
"""


@query(f"""
WITH {_MATCH} SELECT f.run_id, f.idx, k.key_id, CASE WHEN f.cwe = k.cwe THEN 2 ELSE 1 END AS level FROM f JOIN k ON f.run_id = k.run_id AND (ltrim(f.file, './') = k.file OR ends_with(k.file, '/' || ltrim(f.file, './')))
WHERE f.a <= k.b + 10 AND CASE WHEN f.b - f.a > 50 THEN f.a ELSE f.b END >= k.a - 10 OR replace(f.fn, 'pkg.', '') = replace(k.fn, '()', '')
""")
def jo10_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that fit a key by file and place or function, and by weakness."""
    f = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").selectExpr("o_custkey % 40 AS run_id", "o_orderkey AS idx", "CASE WHEN o_orderkey % 2 = 0 THEN './src/f' ELSE 'f' END || CAST(o_custkey % 7 AS STRING) || '.js' AS file", "o_orderkey % 200 AS line_start", "o_orderkey % 200 + o_orderkey % 90 AS line_end", "'pkg.m' || CAST(o_orderkey % 30 AS STRING) AS function", "'CWE-' || CAST(o_orderkey % 4 AS STRING) AS cwe")
    k = table(spark, sf_dir, "customer").selectExpr("c_custkey % 40 AS run_id", "c_custkey AS key_id", "'src/f' || CAST(c_custkey % 7 AS STRING) || '.js' AS file", "c_custkey * 3 % 200 AS line", "c_custkey * 3 % 200 + 4 AS end_line", "'m' || CAST(c_custkey % 30 AS STRING) || '()' AS function", "'CWE-' || CAST(c_custkey % 4 AS STRING) AS cwe")
    return matching.candidates(f, k)


@query("""
WITH r AS (SELECT event_type AS arm, (value > 50)::BIGINT AS caught, (props ->> '$.k')::BIGINT AS tokens FROM events), c AS (SELECT *, tokens % 7 = 0 AS partial FROM r)
SELECT arm, count(*) AS n, count(*) FILTER (partial) AS n_partial, round((sum(caught) FILTER (NOT partial))::DOUBLE * 1000000 / (sum(tokens) FILTER (NOT partial))::DOUBLE, 4) AS strict, round(sum(caught)::DOUBLE * 1000000 / sum(tokens)::DOUBLE, 4) AS loose FROM c GROUP BY 1
""")
def agg06_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catches per million tokens without and with runs whose counts are partial."""
    tokens = F.get_json_object("props", "$.k").cast("bigint")
    r = table(spark, sf_dir, "events").select(F.col("event_type").alias("arm"), (F.col("value") > 50).cast("bigint").alias("caught"), tokens.alias("tokens"), (tokens % 7 == 0).alias("partial"))
    d = evaluation.sensitivity(r, ["arm"])
    return d.select("arm", "n", "n_partial", F.round("strict", 4).alias("strict"), F.round("loose", 4).alias("loose"))
