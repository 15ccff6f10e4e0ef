"""Registered queries of traces on static graphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import runtime
from quarry.plans.catalog import query, table
from quarry.plans.derived import sql, view

#: The index as SQL: methods by place, the best by line, base names of one file, calls.
_INDEX = """
 ms AS (SELECT file, line, full_name, min(seq) AS seq, (contains(full_name, 'metaClass') OR contains(full_name, 'fakeNew'))::INT * 2 + contains(string_split(full_name, '.')[-1], '<')::INT AS score FROM methods GROUP BY 1, 2, 3),
 by_line AS (SELECT file, line, arg_min(full_name, score * 1000000000 + seq) AS full_name FROM ms GROUP BY 1, 2),
 cs AS (SELECT *, starts_with(name, '<operator>')::INT AS score FROM calls WHERE line > 0),
 by_base AS (SELECT regexp_extract(file, '[^/]+$') AS base, min(file) AS sole FROM (SELECT DISTINCT file FROM ms UNION SELECT DISTINCT file FROM cs) GROUP BY 1 HAVING count(*) = 1)
"""


def _exact(points: str, name: str) -> str:
    """Places with the file that their methods are looked up in, and the method declared there."""
    return f"""
 {name}_at AS (SELECT p.*, coalesce(k.file, b.sole) AS at FROM (SELECT DISTINCT file, line, name FROM {points}) p LEFT JOIN (SELECT DISTINCT file FROM ms) k ON k.file = p.file
   LEFT JOIN (SELECT by_base.* FROM by_base WHERE sole IN (SELECT file FROM ms)) b ON b.base = regexp_extract(p.file, '[^/]+$')),
 {name}_exact AS (SELECT a.file, a.line, a.name, arg_min(full_name, (CASE WHEN a.name <> '' AND regexp_extract(full_name, '[^.:]*$') = regexp_extract(a.name, '[^.:]*$') THEN 0 ELSE 1 END) * 10000000000 + score * 1000000000 + seq) AS exact
   FROM {name}_at a JOIN ms ON ms.file = a.at AND ms.line = a.line GROUP BY 1, 2, 3),
 {name}_in AS (SELECT a.file, a.line, a.name, l.full_name AS inside FROM {name}_at a ASOF JOIN by_line l ON a.at = l.file AND a.line >= l.line)
"""


def _calls_at(points: str, name: str) -> str:
    return f"""
 {name}_own AS (SELECT p.file, p.line, uid, score, seq FROM (SELECT DISTINCT file, line FROM {points}) p JOIN cs ON cs.file = p.file AND cs.line = p.line),
 {name}_calls AS (SELECT * FROM {name}_own UNION ALL SELECT p.file, p.line, uid, score, seq FROM (SELECT DISTINCT file, line FROM {points}) p ANTI JOIN {name}_own o ON o.file = p.file AND o.line = p.line
   JOIN by_base b ON b.base = regexp_extract(p.file, '[^/]+$') JOIN cs ON cs.file = b.sole AND cs.line = p.line)
"""


def _index(spark: SparkSession, sf_dir: str) -> runtime.Index:
    return runtime.Index(view(spark, sf_dir, "methods"), view(spark, sf_dir, "calls"))


@query(f"""
WITH {sql("methods", "calls", "trace")}, {_INDEX}, {_exact("trace", "t")} SELECT t.seq, e.exact FROM trace t LEFT JOIN t_exact e USING (file, line, name)
""")
def jo04_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traced definitions with the method declared on their line: the right name, the least made up, the first."""
    return _index(spark, sf_dir).exact(view(spark, sf_dir, "trace").select("seq", "file", "line", "name")).select("seq", "exact")


@query(f"""
WITH {sql("methods", "calls", "trace")}, {_INDEX}, {_calls_at("trace", "t")} SELECT file, line, uid FROM t_calls
""")
def jo05_base_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls on traced lines, by file or else by a base name that only one file has."""
    return _index(spark, sf_dir).calls_at(view(spark, sf_dir, "trace")).select("file", "line", "uid")


_ENDS = """(SELECT DISTINCT caller_file AS file, caller_line AS line, caller_name AS name FROM jumps UNION SELECT DISTINCT callee_file, callee_line, callee_name FROM jumps
 UNION SELECT DISTINCT callee_file, callee_line, callee_name FROM sent)"""


@query(f"""
WITH {sql("methods", "calls", "trace", "jumps", "sent")}, {_INDEX},
 tm AS (SELECT * FROM trace WHERE kind = 'click'), tc AS (SELECT * FROM trace WHERE kind <> 'click'), {_exact("tm", "t")},
 known AS (SELECT exact AS key, sum(hits)::BIGINT AS hits FROM tm JOIN t_exact USING (file, line, name) GROUP BY 1),
 new AS (SELECT file, line, name, min(seq) AS seq, arg_min(hits, seq) AS hits, sha1(concat_ws('|', 's', 'ObservedMethod', file, line::VARCHAR, '0', name)) AS uid FROM tm ANTI JOIN t_exact USING (file, line, name) WHERE name <> '' AND NOT starts_with(name, '<') GROUP BY 1, 2, 3),
 {_calls_at("tc", "v")}, {_exact("tc", "w")},
 call_hits AS (SELECT uid AS key, sum(hits)::BIGINT AS hits FROM tc JOIN v_calls USING (file, line) GROUP BY 1),
 hot AS (SELECT inside AS key, max(hits) AS hits FROM tc JOIN w_in USING (file, line, name) WHERE hits > 0 GROUP BY 1),
 ends AS (SELECT * FROM {_ENDS}), {_exact("ends", "e")},
 point AS (SELECT ends.*, CASE WHEN x.exact IS NOT NULL THEN 'Method' WHEN r.uid IS NOT NULL THEN 'ObservedMethod' WHEN i.inside IS NOT NULL THEN 'Method' END AS kind, coalesce(x.exact, r.uid, i.inside) AS key
   FROM ends LEFT JOIN e_exact x USING (file, line, name) LEFT JOIN e_in i USING (file, line, name)
   LEFT JOIN (SELECT file, line, name, uid FROM new UNION ALL SELECT file, line, '', arg_min(uid, seq) FROM new GROUP BY 1, 2) r USING (file, line, name)),
 j AS (SELECT a.kind AS src_kind, a.key AS src, b.kind AS dst_kind, b.key AS dst, hits, coalesce(a.key IS NOT NULL AND b.key IS NOT NULL AND NOT (a.kind = b.kind AND a.key = b.key), false) AS fine FROM jumps
   LEFT JOIN point a ON a.file = caller_file AND a.line = caller_line AND a.name = caller_name LEFT JOIN point b ON b.file = callee_file AND b.line = callee_line AND b.name = callee_name),
 places AS (SELECT site_file AS file, site_line AS line FROM sent), {_calls_at("places", "s")},
 site AS (SELECT file AS site_file, line AS site_line, arg_min(uid, score * 1000000000 + seq) AS site FROM s_calls GROUP BY 1, 2),
 d AS (SELECT site, b.kind AS dst_kind, b.key AS dst, site IS NOT NULL AND b.key IS NOT NULL AND callee_line IS NOT NULL AS fine FROM sent LEFT JOIN site USING (site_file, site_line)
   LEFT JOIN point b ON b.file = callee_file AND b.line = callee_line AND b.name = callee_name)
SELECT 'call' AS what, key, hits FROM call_hits UNION ALL SELECT 'method', key, hits FROM known UNION ALL SELECT 'method', key, hits FROM hot ANTI JOIN known USING (key)
UNION ALL SELECT 'new', uid, hits FROM new UNION ALL SELECT 'edge', concat_ws(' ', 'OBSERVED_CALL', src_kind, src, dst_kind, dst), sum(hits)::BIGINT FROM j WHERE fine GROUP BY 1, 2
UNION ALL SELECT 'edge', concat_ws(' ', 'OBSERVED_DISPATCH', 'Call', site, dst_kind, dst), count(*) FROM d WHERE fine GROUP BY 1, 2
UNION ALL SELECT 'dropped', 'coverage_no_call', count(*) FROM tc ANTI JOIN v_calls USING (file, line) UNION ALL SELECT 'dropped', 'coverage_no_method', count(*) FROM tc ANTI JOIN w_in USING (file, line, name)
UNION ALL SELECT 'dropped', 'call_unresolved', count(*) FROM j WHERE NOT fine UNION ALL SELECT 'dropped', 'dispatch_unresolved', count(*) FROM d WHERE NOT fine
""")
def g19_correlate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole trace on its graph: hits by call and method, new methods, edges, and what was dropped."""
    trace = view(spark, sf_dir, "trace")
    c = runtime.Correlation(_index(spark, sf_dir), "s", trace.where("kind = 'click'"), trace.where("kind <> 'click'").select("file", "line", "hits"), view(spark, sf_dir, "jumps"), view(spark, sf_dir, "sent"))
    rows = lambda what, d, key: d.select(F.lit(what).alias("what"), key.alias("key"), "hits")
    edge = F.concat_ws(" ", "type", "src_kind", "src", "dst_kind", "dst")
    lost = [spark.range(1).select(F.lit(k).alias("k"), F.lit(n).cast("bigint").alias("hits")) for k, n in c.dropped.items()]
    parts = [rows("call", c.call_hits, F.col("uid")), rows("method", c.method_hits, F.col("full_name")), rows("new", c.new_methods, F.col("uid")), rows("edge", c.edges, edge), *(rows("dropped", d, F.col("k")) for d in lost)]
    return reduce(DataFrame.unionAll, parts)


@query(f"""
WITH {sql("calls", "trace")}, h AS (SELECT 'c' || (seq % 4000) AS uid, sum(hits)::BIGINT AS hits FROM trace GROUP BY 1) SELECT c.uid, h.hits AS hit_count, h.hits IS NOT NULL AS executed FROM calls c LEFT JOIN h USING (uid)
""")
def snk07_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with what a run says of them."""
    h = runtime.merge([view(spark, sf_dir, "trace").selectExpr("'c' || CAST(seq % 4000 AS STRING) AS uid", "hits")], ["uid"])
    return runtime.apply_hits(view(spark, sf_dir, "calls").select("uid"), h, "uid").select("uid", "hit_count", "executed")


@query(f"""
WITH {sql("trace")} SELECT file, line, name, sum(hits)::BIGINT AS hits FROM (SELECT * FROM trace WHERE kind = 'click' UNION ALL SELECT * FROM trace WHERE kind <> 'error') GROUP BY 1, 2, 3
""")
def agg13_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two traces as one."""
    t = view(spark, sf_dir, "trace")
    return runtime.merge([t.where("kind = 'click'"), t.where("kind <> 'error'")], ["file", "line", "name"])


@query("""
WITH o AS (SELECT DISTINCT l_orderkey % 500 AS src, l_partkey % 500 AS dst FROM lineitem WHERE l_returnflag = 'R'), c AS (SELECT DISTINCT l_orderkey % 500 AS src, l_suppkey AS call FROM lineitem WHERE l_returnflag = 'N' AND l_linenumber < 3),
 r AS (SELECT DISTINCT l_suppkey AS call, l_partkey % 500 AS dst FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber < 3 AND l_suppkey % 10 = 0)
SELECT src, dst FROM o WHERE (src, dst) NOT IN (SELECT c.src, r.dst FROM c JOIN r USING (call))
""")
def g17_novel_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed calls that no static call and what it resolves to link."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    o = l.where("l_returnflag = 'R'").selectExpr("l_orderkey % 500 AS src", "l_partkey % 500 AS dst").distinct()
    c = l.where("l_returnflag = 'N' AND l_linenumber < 3").selectExpr("l_orderkey % 500 AS src", "l_suppkey AS dst").distinct()
    r = l.where("l_returnflag = 'A' AND l_linenumber < 3 AND l_suppkey % 10 = 0").selectExpr("l_suppkey AS src", "l_partkey % 500 AS dst").distinct()
    return runtime.novel_edges(o, c, r)


@query("""
WITH r AS (SELECT o_orderkey AS range_id, o_custkey % 40 AS file, o_orderkey * 13 % 2000 AS start, o_orderkey * 13 % 2000 + 1 + o_custkey * 7 % 900 AS stop, o_orderkey % 4 AS hits FROM orders),
 s AS (SELECT file, line, line * 25 AS offset FROM (SELECT DISTINCT file FROM r), (SELECT unnest(range(0, 120)) AS line)),
 m AS (SELECT s.file, s.line, hits, row_number() OVER (PARTITION BY s.file, s.line ORDER BY stop - start, range_id) AS k FROM s JOIN r ON r.file = s.file AND r.start <= s.offset AND s.offset < r.stop)
SELECT file, line, hits FROM m WHERE k = 1 AND hits > 0
""")
def g20_line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line's count, from the innermost of the ranges around its start."""
    r = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS range_id", "o_custkey % 40 AS file", "o_orderkey * 13 % 2000 AS start", "o_orderkey * 13 % 2000 + 1 + o_custkey * 7 % 900 AS stop", "o_orderkey % 4 AS hits")
    s = r.select("file").distinct().select("file", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(119).cast("bigint"))).alias("line")).withColumn("offset", F.col("line") * 25)
    return runtime.line_counts(r, s)


@query("""
WITH s AS (SELECT s_nationkey AS file, s_suppkey AS line, s_suppkey * 17 % 3000 AS o FROM supplier), p AS (SELECT c_custkey AS id, c_nationkey AS file, c_custkey * 7 % 3100 AS o FROM customer)
SELECT id, p.file, coalesce(s.line, 1) AS line FROM p ASOF LEFT JOIN (SELECT file, o, max(line) AS line FROM s GROUP BY 1, 2) s ON p.file = s.file AND p.o >= s.o
""")
def win12_offset_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line of each character offset."""
    s = table(spark, sf_dir, "supplier").selectExpr("s_nationkey AS file", "s_suppkey AS line", "s_suppkey * 17 % 3000 AS offset").groupBy("file", "offset").agg(F.max("line").alias("line"))
    p = table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_nationkey AS file", "c_custkey * 7 % 3100 AS offset")
    return runtime.line_of_offset(p, s).select("id", "file", "line")


@query(f"""
WITH {sql("calls")}, f AS (SELECT o_orderkey AS uid, 'c' || o_orderkey AS sink_uid, ['c' || (o_orderkey + 1), 'c' || (o_custkey), 'c' || o_orderkey] AS path_uids, o_orderkey % 50 AS rank FROM orders WHERE o_custkey < 40),
 e AS (SELECT uid FROM calls WHERE line % 3 = 0), s AS (SELECT f.uid, avg((e.uid IS NOT NULL)::INT) AS share FROM (SELECT uid, unnest(path_uids) AS step FROM f) f LEFT JOIN e ON e.uid = step GROUP BY 1)
SELECT f.uid, sink_uid IN (SELECT uid FROM e) AS sink_executed, round(share, 6) AS share, row_number() OVER (ORDER BY sink_uid IN (SELECT uid FROM e) DESC, share DESC, rank, f.uid) - 1 AS run_rank FROM f JOIN s USING (uid)
""")
def g18_runtime_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows whose sinks and paths ran come first."""
    f = table(spark, sf_dir, "orders").where("o_custkey < 40").selectExpr("o_orderkey AS uid", "'c' || CAST(o_orderkey AS STRING) AS sink_uid", "transform(array(o_orderkey + 1, o_custkey, o_orderkey), x -> 'c' || CAST(x AS STRING)) AS path_uids", "o_orderkey % 50 AS rank")
    return runtime.runtime_order(f, view(spark, sf_dir, "calls").where("line % 3 = 0").select("uid")).select("uid", "sink_executed", F.round("share", 6).alias("share"), F.col("run_rank").cast("bigint").alias("run_rank"))


@query("""
SELECT count(*) AS n, min(c_custkey) AS first FROM customer WHERE c_acctbal > 0 AND c_nationkey % 2 <> 0
""")
def g17_unreachable_executed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ran though no entry reaches it."""
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") > 0).alias("executed"), (F.col("c_nationkey") % 2 == 0).alias("reachable_from_entry"))
    return runtime.unreachable_executed(c).agg(F.count("*").alias("n"), F.min("c_custkey").alias("first"))


@query("""
WITH n AS (SELECT l_partkey % 50 AS profile, l_orderkey AS id, l_suppkey AS line, CASE l_linenumber WHEN 1 THEN 'file:///r/a.js' WHEN 2 THEN 'node:internal' WHEN 3 THEN 'r/node_modules/b.js' ELSE 'r/c.js' END AS url FROM lineitem WHERE l_linenumber < 5 AND l_returnflag = 'R'),
 f AS (SELECT profile, id, CASE WHEN url IN ('file:///r/a.js', 'r/c.js') THEN replace(url, 'file://', '') || ':' || line || ':f' END AS node FROM n)
SELECT a.profile, a.node AS caller, b.node AS callee FROM f a JOIN f b ON a.profile = b.profile AND b.id IN (a.id + 1, a.id + 2) WHERE a.node IS NOT NULL AND b.node IS NOT NULL
""")
def hlp18_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of CPU profiles inside the repository."""
    url = "CASE l_linenumber WHEN 1 THEN 'file:///r/a.js' WHEN 2 THEN 'node:internal' WHEN 3 THEN 'r/node_modules/b.js' ELSE 'r/c.js' END AS url"
    n = table(spark, sf_dir, "lineitem").where("l_linenumber < 5 AND l_returnflag = 'R'").selectExpr("l_partkey % 50 AS profile", "l_orderkey AS id", "'f' AS function", url, "l_suppkey AS line", "array(l_orderkey + 1, l_orderkey + 2) AS children")
    return runtime.profile_edges(n)


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM orders")
def hlp19_wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to positional lists and back."""
    wire = runtime.to_wire(table(spark, sf_dir, "orders"), ["o_orderkey", "o_orderstatus"], ["o_custkey"])
    return runtime.from_wire(wire, {"o_orderkey": "bigint", "o_orderstatus": "string"})
