"""Registered queries of readers and writers: derived files are written to a work folder and read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import code
from quarry.operators import balance, detect, evaluation, leads, matching, paths, taint
from quarry.plans import store
from quarry.plans.catalog import query, table
from quarry.plans.cut import work_folder
from quarry.sources import advisories, codegraph, dumps, texts
from quarry.streaming import ingest
from quarry.streaming import tail as tails


def _text(d: DataFrame, line: str | Column) -> str:
    """The folder of text files that hold one line for each row."""
    folder = f"{work_folder(d.sparkSession)}/text"
    d.select((F.expr(line) if isinstance(line, str) else line).alias("value")).write.text(folder)
    return folder


@query("SELECT c_custkey AS id, replace(c_name, '#', '''') AS name, CASE WHEN c_nationkey % 5 > 0 THEN 'n' || c_nationkey END AS nation FROM customer")
def src10_sqlite_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of a SQLite dump: quotes in literals, nulls, and rows of another table between."""
    row = """CASE WHEN c_custkey % 7 = 0 THEN 'INSERT INTO other VALUES(1,''x;\n);'');\n' ELSE '' END || 'INSERT INTO customer VALUES(' || CAST(c_custkey AS STRING) || ',''' || replace(c_name, '#', '''''') || ''',' || CASE WHEN c_nationkey % 5 > 0 THEN 'replace(''n@' || CAST(c_nationkey AS STRING) || ''',''@'','''')' ELSE 'NULL' END || ');'"""
    d = dumps.sqlite_dump(spark, _text(table(spark, sf_dir, "customer"), row), "customer", ["id", "name", "nation"])
    return d.select(F.col("id").cast("bigint").alias("id"), "name", "nation")


@query("SELECT o_orderkey AS id, CASE WHEN o_custkey % 4 > 0 THEN o_orderpriority || chr(9) || 'é' END AS priority FROM orders")
def src11_copy_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns of a table of a PostgreSQL dump, with escapes and nulls."""
    o = table(spark, sf_dir, "orders").coalesce(1)
    row = r"""CAST(o_custkey AS STRING) || '\t' || CASE WHEN o_custkey % 4 > 0 THEN o_orderpriority || '\\t\\303\\251' ELSE '\\N' END || '\t' || CAST(o_orderkey AS STRING)"""
    one = lambda x: spark.range(1).select(F.lit(x).alias("value"))
    lines = one("COPY public.other (a) FROM stdin;\nx\n\\.\nCOPY public.orders (cust, priority, id) FROM stdin;").unionAll(o.select(F.expr(row))).unionAll(one("\\.")).coalesce(1)
    d = dumps.copy_dump(spark, _text(lines, "value"), "orders", ["priority", "id"])
    return d.select(F.col("id").cast("bigint").alias("id"), "priority")


@query("""
WITH r AS (SELECT 'r' || c_nationkey AS root, 'p' || c_custkey % 9 AS name, c_custkey FROM customer), n AS (SELECT root, name, '1.' || min(c_custkey) AS version FROM r WHERE c_custkey % 3 = 0 GROUP BY 1, 2),
 q AS (SELECT root, name, '2.' || min(c_custkey) AS version FROM r WHERE c_custkey % 3 > 0 GROUP BY 1, 2)
SELECT * FROM n UNION ALL SELECT * FROM q WHERE (root, name) NOT IN (SELECT root, name FROM n)
""")
def src13_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared packages of two manifests for each root; package.json comes first."""
    c = table(spark, sf_dir, "customer").selectExpr("'r' || CAST(c_nationkey AS STRING) AS root", "'p' || CAST(c_custkey % 9 AS STRING) AS name", "c_custkey")
    first = lambda d: d.groupBy("root", "name").agg(F.min("c_custkey").alias("v"))
    pair = F.concat(F.lit('"'), "name", F.lit('":"1.'), F.col("v").cast("string"), F.lit('"'))
    npm = first(c.where("c_custkey % 3 = 0")).groupBy("root").agg(F.concat(F.lit('{"dependencies":{'), F.array_join(F.collect_list(pair), ","), F.lit("}}")).alias("content")).select("root", F.lit("package.json").alias("file"), "content")
    line = F.concat("name", F.lit("==2."), F.col("v").cast("string"))
    pip = first(c.where("c_custkey % 3 > 0")).groupBy("root").agg(F.concat(F.lit("# all\n"), F.array_join(F.collect_list(line), "\n")).alias("content")).select("root", F.lit("requirements.txt").alias("file"), "content")
    return texts.dependencies(npm.unionAll(pip))


@query("""
SELECT o_orderkey AS id, 'src/f' || o_custkey % 9 || '.js' AS file, o_custkey AS old_start, o_custkey + o_orderkey % 3 - 1 AS old_end, o_custkey + 1 AS new_start, o_custkey + 2 AS new_end FROM orders
""")
def src14_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hunks of a diff for each order, body lines that look like headers among them."""
    n = "CAST(o_custkey AS STRING)"
    file = "'src/f' || CAST(o_custkey % 9 AS STRING) || '.js'"
    diff = f"""'--- a/' || {file} || '\n+++ b/' || {file} || '\n@@ -' || {n} || ',' || CAST(o_orderkey % 3 AS STRING) || ' +' || CAST(o_custkey + 1 AS STRING) || ',2 @@\n' || repeat('--- a/x\n', CAST(o_orderkey % 3 AS INT)) || '+++ b/y\n+z\n\\\\ No newline at end of file' AS diff"""
    d = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", diff)
    return texts.hunks(d).select("id", "file", "old_start", "old_end", "new_start", "new_end")


@query("SELECT p_partkey AS id, p_name AS name, p_size AS size FROM part WHERE p_partkey % 5 > 0")
def src16_commented_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV with comment lines."""
    row = "CASE WHEN p_partkey % 5 = 0 THEN '# version: 1.2, ' || p_name ELSE CAST(p_partkey AS STRING) || ',' || p_name || ',' || CAST(p_size AS STRING) END"
    return texts.commented_csv(spark, _text(table(spark, sf_dir, "part"), row), "id bigint, name string, size bigint")


@query("SELECT o_custkey AS id, max(o_orderkey) AS at, arg_max(o_orderstatus, o_orderkey) AS status FROM orders WHERE o_orderkey % 6 > 0 GROUP BY 1")
def src18_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest line of each key in a ledger with torn lines."""
    row = """CASE WHEN o_orderkey % 6 = 0 THEN '{"id":' || CAST(o_custkey AS STRING) || ',"at"' ELSE to_json(named_struct('id', o_custkey, 'at', o_orderkey, 'status', o_orderstatus)) END"""
    return texts.latest(spark, _text(table(spark, sf_dir, "orders"), row), "id bigint, at bigint, status string", "id", "at")


@query("SELECT o_orderpriority AS data_source, count(*) FILTER (o_orderpriority IN ('5-LOW', '1-URGENT')) AS kept, count(*) FILTER (o_orderpriority NOT IN ('5-LOW', '1-URGENT')) AS dropped FROM orders GROUP BY 1")
def src19_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of each source an allow-list keeps."""
    folder = _text(table(spark, sf_dir, "orders"), "to_json(named_struct('data_source', o_orderpriority, 'q', o_orderkey))")
    return advisories.allowed(spark.read.schema("data_source string, q bigint").json(folder), ["5-LOW", "1-URGENT"])[1]


@query("""
WITH a AS (SELECT page_id AS k, 'o' || page_id % 40 || '/r' AS repo, sha1(page_id::VARCHAR) AS sha, sha1('x' || page_id) AS sha2 FROM pages WHERE page_id % 7 > 0 AND page_id % 9 > 0)
SELECT 'GHSA-' || k AS source_id, CASE WHEN k % 4 < 3 THEN repo END AS repo, CASE k % 4 WHEN 0 THEN sha || ',' || sha2 WHEN 1 THEN sha2 ELSE '' END AS shas, CASE WHEN k % 4 = 2 THEN k END AS fix_pr, CASE WHEN k % 4 = 3 THEN 'https://gitlab.com/x' END AS repo_url, 'js' AS language,
 '2024-03-0' || (1 + k % 9) AS advisory_published, CASE WHEN k % 2 = 0 THEN 'CWE-79,CWE-352' ELSE '' END AS cwe, 'npm:p' || k % 11 AS package FROM a
""")
def src07_osv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advisories with their fix by priority; malware and withdrawn ones are skipped."""
    k, repo = "CAST(page_id AS STRING)", "'https://github.com/O' || CAST(page_id % 40 AS STRING) || '/r'"
    sha, sha2 = f"sha1({k})", f"sha1('x' || {k})"
    ref = lambda t, u: f"'{{\"type\":\"{t}\",\"url\":\"' || {u} || '\"}}'"
    refs = f"CASE page_id % 4 WHEN 0 THEN {ref('WEB', f'{repo} || ' + repr('/commit/') + f' || {sha2}')} WHEN 1 THEN {ref('WEB', repo + ' || ' + repr('/pull/9'))} || ',' || {ref('FIX', f'{repo} || ' + repr('/commit/') + f' || upper({sha2})')} WHEN 2 THEN {ref('WEB', f'{repo} || ' + repr('/pull/') + f' || {k}')} ELSE {ref('WEB', repr('https://x.org'))} END"
    ranges = f"CASE page_id % 4 WHEN 0 THEN '{{\"type\":\"GIT\",\"repo\":\"' || {repo} || '.git\",\"events\":[{{\"introduced\":\"0\"}},{{\"fixed\":\"' || {sha} || '\"}}]}}' WHEN 3 THEN '{{\"type\":\"GIT\",\"repo\":\"https://gitlab.com/x\",\"events\":[{{\"fixed\":\"abcdef1\"}}]}}' ELSE '' END"
    value = f"""'{{"id":"GHSA-' || {k} || '",' || CASE WHEN page_id % 9 = 0 THEN '"withdrawn":"2024-01-01T00:00:00Z",' ELSE '' END || '"published":"2024-03-0' || CAST(1 + page_id % 9 AS STRING) || 'T23:30:00Z","affected":[{{"package":{{"ecosystem":"npm","name":"P' || CAST(page_id % 11 AS STRING) || '"}},"ranges":[' || {ranges} || ']}}],"references":[' || {refs} || ']' || CASE WHEN page_id % 2 = 0 THEN ',"database_specific":{{"cwe_ids":["CWE-352","CWE-79"]}}' ELSE '' END || '}}' AS value"""
    d = advisories.osv_rows(table(spark, sf_dir, "pages").selectExpr(f"CASE WHEN page_id % 7 = 0 THEN 'MAL-' ELSE 'GHSA-' END || {k} || '.json' AS name", value))
    package = F.transform("packages", lambda p: F.concat(p["ecosystem"], F.lit(":"), p["name"]))
    return d.select("source_id", "repo", F.array_join("fix_shas", ",").alias("shas"), "fix_pr", "repo_url", "language", "advisory_published", F.array_join("cwe", ",").alias("cwe"), F.array_join(package, ",").alias("package"))


@query("""
WITH f AS (SELECT DISTINCT 'CVE-' || o_custkey AS cve_id, 'h' || o_orderkey % 400 AS hash, 'https://github.com/o/r' || o_custkey % 20 AS repo_url, CASE o_orderkey % 3 WHEN 0 THEN 1337 WHEN 1 THEN 70 ELSE 10 END AS score FROM orders),
 g AS (SELECT *, max(score = 1337) OVER (PARTITION BY cve_id, repo_url) AS direct FROM f), k AS (SELECT * FROM g WHERE CASE WHEN direct THEN score = 1337 ELSE score >= 65 END),
 c AS (SELECT 'h' || o_orderkey % 400 AS hash, 'https://github.com/o/r' || o_custkey % 20 AS repo_url, min('2024-0' || (1 + o_orderkey % 8) || '-05') AS date FROM orders WHERE o_orderkey % 5 > 0 GROUP BY 1, 2),
 s AS (SELECT k.*, c.date, row_number() OVER (PARTITION BY k.cve_id, k.repo_url ORDER BY coalesce(c.date, '9999'), k.hash) AS n, count(*) OVER (PARTITION BY k.cve_id, k.repo_url) AS n_commits FROM k LEFT JOIN c USING (hash, repo_url)),
 l AS (SELECT 'h' || l_partkey % 400 AS hash, count(DISTINCT l_linenumber % 2) AS kinds, min(CASE WHEN l_linenumber % 2 = 0 THEN 'js' ELSE 'py' END) AS lang FROM lineitem WHERE l_linenumber % 3 > 0 GROUP BY 1)
SELECT cve_id AS source_id, substr(repo_url, 20) AS repo, s.hash AS fix_sha, n_commits, date AS fix_commit_date, NOT direct AS heuristic_fix_link, CASE WHEN kinds = 1 THEN lang WHEN kinds > 1 THEN 'mixed' END AS language FROM s LEFT JOIN l ON l.hash = s.hash WHERE n = 1
""")
def src12_six_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs assembled from a dataset's tables: links an advisory names, commits by date, languages of the fix's files."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")  # noqa: E741
    url = "'https://github.com/o/r' || CAST(o_custkey % 20 AS STRING) AS repo_url"
    f = o.selectExpr("'CVE-' || CAST(o_custkey AS STRING) AS cve_id", "'h' || CAST(o_orderkey % 400 AS STRING) AS hash", url, "CASE o_orderkey % 3 WHEN 0 THEN 1337 WHEN 1 THEN 70 ELSE 10 END AS score").distinct()
    c = o.where("o_orderkey % 5 > 0").selectExpr("'h' || CAST(o_orderkey % 400 AS STRING) AS hash", url, "'2024-0' || CAST(1 + o_orderkey % 8 AS STRING) || '-05 10:00:00' AS d").groupBy("hash", "repo_url").agg(F.min("d").alias("author_date")).withColumn("committer_date", F.lit(None).cast("string"))
    files = l.selectExpr("'h' || CAST(l_partkey % 400 AS STRING) AS hash", "CASE WHEN l_linenumber % 3 = 0 THEN 'test/' ELSE 'src/' END || CASE WHEN l_linenumber % 2 = 0 THEN 'a.ts' ELSE 'b.py' END AS path")
    cves = o.selectExpr("'CVE-' || CAST(o_custkey AS STRING) AS cve_id", "'2024-01-01' AS published_date")
    d = advisories.assembled(f, c, files, cves, cves.select("cve_id", F.lit("CWE-1").alias("cwe_id")), "six", scored=True)
    return d.select("source_id", "repo", "fix_sha", F.size("fix_shas").cast("bigint").alias("n_commits"), "fix_commit_date", "heuristic_fix_link", "language")


@query("""
WITH p AS (SELECT c_custkey AS k, 's' || c_custkey % 700 AS slug, 'CVE-' || c_custkey % 300 AS cve_id FROM customer), d AS (SELECT CASE WHEN s_suppkey % 3 > 0 THEN 's' || s_suppkey ELSE '' END AS slug, 'CVE-' || s_suppkey * 2 AS cve_id, 'm' || s_suppkey AS method FROM supplier)
SELECT k, coalesce((SELECT string_agg(method, ',' ORDER BY method) FROM d WHERE d.slug = p.slug AND d.slug <> ''), (SELECT string_agg(method, ',' ORDER BY method) FROM d WHERE d.cve_id = p.cve_id)) AS methods FROM p
""")
def src08_slug_or_cve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Details by a project's slug, else by its CVE."""
    p = table(spark, sf_dir, "customer").selectExpr("c_custkey AS k", "'s' || CAST(c_custkey % 700 AS STRING) AS slug", "'CVE-' || CAST(c_custkey % 300 AS STRING) AS cve_id")
    d = table(spark, sf_dir, "supplier").selectExpr("CASE WHEN s_suppkey % 3 > 0 THEN 's' || CAST(s_suppkey AS STRING) ELSE '' END AS slug", "'CVE-' || CAST(s_suppkey * 2 AS STRING) AS cve_id", "'m' || CAST(s_suppkey AS STRING) AS method")
    r = advisories.by_slug_or_cve(p, d, "methods")
    return r.select("k", F.array_join(F.transform("methods", lambda x: x["method"]), ",").alias("methods"))


@query("""
WITH g AS (SELECT 'CVE-' || c_nationkey AS source_id, 'o/r' || c_custkey % 3 AS repo, string_agg(DISTINCT sha1(c_custkey::VARCHAR), ',' ORDER BY sha1(c_custkey::VARCHAR)) AS shas, string_agg(DISTINCT 'CWE-' || (c_custkey % 2 + 20), ',' ORDER BY 'CWE-' || (c_custkey % 2 + 20)) AS cwe FROM customer GROUP BY 1, 2)
SELECT 'crossvul' AS source, source_id, repo, shas, cwe FROM g
""")
def src09_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset of single commits, normalised from its links and grouped by advisory and repository."""
    c = table(spark, sf_dir, "customer")
    link = F.concat(F.lit("https://github.com/O/R"), (F.col("c_custkey") % 3).cast("string"), F.lit("/commit/"), F.sha1(F.col("c_custkey").cast("string")))
    cve = F.concat(F.lit("CVE-"), F.col("c_nationkey").cast("string"))
    d = advisories.normalised(c, "crossvul", cve, F.array(F.lit("see"), link), F.array(cve), F.array(F.concat(F.lit("cwe "), (F.col("c_custkey") % 2 + 20).cast("string"))))
    return advisories.grouped(d).select("source", "source_id", "repo", F.array_join("fix_shas", ",").alias("shas"), F.array_join("cwe", ",").alias("cwe"))


@query("""
SELECT o_custkey AS run_id, count(*) FILTER (o_orderkey % 4 > 0) AS n_events, CASE WHEN count(*) FILTER (o_orderkey % 4 = 2) > 0 THEN 'm' END AS model, max(o_orderkey) FILTER (o_orderkey % 4 = 2) AS input_tokens FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderkey % 4 > 0) > 0
""")
def src15_agent_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last result of each run's log says; torn lines are skipped."""
    line = """CASE o_orderkey % 4 WHEN 0 THEN '{"type":"resu' WHEN 2 THEN '{"type":"result","model":"m","usage":{"input_tokens":' || CAST(o_orderkey AS STRING) || '}}' ELSE '{"type":"assistant","message":{"content":[]}}' END AS line"""
    d = advisories.agent_usage(table(spark, sf_dir, "orders").selectExpr("o_custkey AS run_id", "o_orderkey AS seq", line))
    return d.select("run_id", "n_events", "model", "input_tokens")


@query("""
SELECT 'm' || p_partkey AS name, CASE WHEN p_size % 2 = 0 THEN 'CVE-2020-' || (1000 + p_size) ELSE '' END AS cves, CASE WHEN p_size % 3 = 0 THEN 'exploit' ELSE 'auxiliary' END AS kind FROM part WHERE p_size % 3 < 2
""")
def src17_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of two kinds from metadata documents, with the advisories that they name."""
    one = F.struct(F.when(F.col("p_size") % 3 == 0, "exploit").when(F.col("p_size") % 3 == 1, "auxiliary").otherwise("post").alias("type"), F.col("p_name").alias("name"), F.lit("a  b").alias("description"), F.when(F.col("p_size") % 2 == 0, F.array(F.concat(F.lit("cve-2020-"), (1000 + F.col("p_size")).cast("string")))).alias("references"))
    d = table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 10).alias("file")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("m"), F.col("p_partkey").cast("string")), one)))).alias("value"))
    return advisories.module_documents(d, ["exploit", "auxiliary"]).select("name", F.array_join("cves", ",").alias("cves"), "kind")


@query("""
WITH c AS (SELECT o_custkey AS path, string_agg(o_orderkey || ':é', chr(10) ORDER BY o_orderkey) || CASE WHEN o_custkey % 2 = 0 THEN chr(10) ELSE '' END AS content FROM orders GROUP BY 1), l AS (SELECT path, unnest(string_split(content, chr(10))) AS value, generate_subscripts(string_split(content, chr(10)), 1) AS k, len(string_split(content, chr(10))) AS n FROM c)
SELECT path, value FROM l WHERE k < n AND k > 1
""")
def str04_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole lines past a cursor after each file's first line; a last line without its break waits."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("ks"))
    line = F.transform("ks", lambda k: F.concat(k.cast("string"), F.lit(":é")))
    c = o.select(F.col("o_custkey").alias("path"), F.encode(F.concat(F.array_join(line, "\n"), F.when(F.col("o_custkey") % 2 == 0, "\n").otherwise("")), "UTF-8").alias("content"), F.length(F.get("ks", F.lit(0)).cast("string")).alias("n"))
    cursors = c.select("path", (F.col("n") + 4).alias("offset"))
    lines, _ = tails.tail(c.select("path", "content"), cursors)
    return lines.select("path", "value")


@query("""
WITH e AS (SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem WHERE l_linenumber = 1), n AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 3 > 0)
SELECT src, dst FROM e WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)
""")
def str02_second_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls between methods that some segment has, found when all segments are there."""
    nodes = table(spark, sf_dir, "orders").where("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("method_id"), F.array(F.struct(F.col("o_orderkey").alias("id"), F.lit("METHOD").alias("label"))).alias("vertices"))
    calls = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").groupBy(F.col("l_orderkey").alias("method_id")).agg(F.collect_set(F.array("l_orderkey", "l_partkey")).alias("call_edges"))
    records = nodes.join(calls, "method_id", "full_outer").where("vertices is not null or call_edges is not null")
    folder = work_folder(spark)
    records.select(F.to_json(F.struct("method_id", F.coalesce("vertices", F.array().cast(nodes.schema["vertices"].dataType)).alias("vertices"), F.array().cast("array<struct<label:string,outV:bigint,inV:bigint>>").alias("edges"), F.coalesce("call_edges", F.array().cast("array<array<bigint>>")).alias("call_edges"))).alias("value")).write.text(f"{folder}/in")
    ingest.ingest(spark, f"{folder}/in", f"{folder}/out", f"{folder}/state")
    return tails.second_pass(spark, f"{folder}/out")[0].select("src", "dst").distinct()


@query("SELECT o_custkey % 50 AS scan_id, count(*) AS n FROM orders WHERE o_custkey % 50 <> 7 GROUP BY 1 UNION ALL SELECT 7, count(*) FROM orders WHERE o_custkey % 50 = 7 AND o_orderkey % 2 = 0")
def snk06_replace_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of which one scan is replaced."""
    folder = work_folder(spark)
    d = table(spark, sf_dir, "orders").selectExpr("o_custkey % 50 AS scan_id", "o_orderkey AS uid")
    store.replace_scan(d, folder, "calls")
    store.replace_scan(d.where("scan_id = 7 AND uid % 2 = 0"), folder, "calls")
    return spark.read.parquet(f"{folder}/calls").groupBy(F.col("scan_id").cast("bigint").alias("scan_id")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey::VARCHAR AS scan_id, c_custkey * 7 % 1000 AS built_at, row_number() OVER (ORDER BY c_custkey * 7 % 1000 DESC, c_custkey::VARCHAR) <= 20 AS kept FROM customer")
def evl17_gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans that aren't among the newest twenty."""
    return store.collect_garbage(table(spark, sf_dir, "customer").selectExpr("CAST(c_custkey AS STRING) AS scan_id", "c_custkey * 7 % 1000 AS built_at"), 20)


@query("SELECT o_custkey % 400 AS src, o_orderkey % 400 AS dst, CASE o_orderkey % 3 WHEN 0 THEN 'FLOWS_TO' ELSE 'CALLS' END AS label, max(o_orderkey) AS last FROM orders WHERE o_orderkey % 3 > 0 GROUP BY 1, 2, 3 UNION ALL SELECT o_custkey % 400, o_orderkey % 400, 'FLOWS_TO', o_orderkey FROM orders WHERE o_orderkey % 3 = 0")
def snk03_edge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges once for each pair of ends, the last one's properties; flows all stay."""
    e = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS seq", "CASE o_orderkey % 3 WHEN 0 THEN 'FLOWS_TO' ELSE 'CALLS' END AS label", "o_custkey % 400 AS src", "o_orderkey % 400 AS dst", "o_orderkey AS last")
    return store.edge_rows(e, "seq").select("src", "dst", "label", "last")


@query("""
WITH RECURSIVE a AS (SELECT p_partkey AS n, p_partkey - 1 - p_partkey % 3 AS up FROM part WHERE p_partkey % 20 > 0 AND p_partkey - 1 - p_partkey % 3 >= p_partkey // 20 * 20), m AS (SELECT p_partkey AS n FROM part WHERE p_partkey % 20 IN (0, 5)),
 w(n, here) AS (SELECT p_partkey, p_partkey FROM part UNION ALL SELECT w.n, a.up FROM w JOIN a ON a.n = w.here WHERE w.here NOT IN (SELECT n FROM m))
SELECT n AS node, here AS owner FROM w WHERE here IN (SELECT n FROM m)
""")
def g01_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest method above each node."""
    p = table(spark, sf_dir, "part")
    up = p.where("p_partkey % 20 > 0 AND p_partkey - 1 - p_partkey % 3 >= p_partkey div 20 * 20").selectExpr("p_partkey AS child", "p_partkey - 1 - p_partkey % 3 AS parent")
    return taint.owners(up.selectExpr("child AS node", "parent"), p.where("p_partkey % 20 IN (0, 5)").selectExpr("p_partkey AS node"))


_G03 = """
 rd AS (SELECT DISTINCT l_orderkey % 300 AS n, l_partkey % 300 AS m FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 3 = 0), arg AS (SELECT i AS n, (i * 7 + 10) % 300 // 10 * 10 AS c, i % 3 AS idx FROM range(300) t(i) WHERE i % 4 = 1),
 prm AS (SELECT DISTINCT c, idx, (c + 37 + idx) % 300 AS p FROM arg WHERE c % 20 = 0), seed AS (SELECT i AS s FROM range(0, 300, 30) t(i))
"""


@query(f"""
WITH RECURSIVE {_G03},
 w(s, n, x) AS (SELECT s, m, 0 FROM seed JOIN rd ON n = s WHERE m <> s UNION (SELECT s, nxt, y FROM (
   SELECT j.s, CASE WHEN stop THEN p ELSE m END AS nxt, CASE WHEN stop THEN 1 ELSE j.x END AS y FROM (SELECT w.s, w.x, w.n, a.c, a.idx, a.c IS NOT NULL AND a.c <> w.s AS stop FROM w LEFT JOIN arg a ON a.n = w.n) j
   LEFT JOIN prm ON prm.c = j.c AND prm.idx = j.idx AND stop LEFT JOIN rd ON rd.n = j.n AND NOT stop) WHERE nxt IS NOT NULL AND NOT (nxt = s AND y = 0)))
SELECT w.s AS src, arg.c AS call, idx, CASE min(x) WHEN 1 THEN 'inferred' ELSE 'proven' END AS provenance FROM w JOIN arg ON arg.n = w.n AND arg.c <> w.s GROUP BY 1, 2, 3
""")
def g03_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows from seeds along reaching definitions to calls' arguments, proven or inferred over a callee."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    rd = l.where("l_linenumber = 1 AND l_orderkey % 3 = 0").selectExpr("l_orderkey % 300 AS src", "l_partkey % 300 AS dst").distinct()
    arg = spark.range(300).where("id % 4 = 1").selectExpr("id AS node", "(id * 7 + 10) % 300 div 10 * 10 AS call", "CAST(id % 3 AS INT) AS idx")
    prm = arg.where("call % 20 = 0").selectExpr("call", "idx", "(call + 37 + idx) % 300 AS param").distinct()
    return taint.flows_to(spark.range(0, 300, 30).selectExpr("id AS node"), rd, arg, prm)


@query("""
WITH a AS (SELECT DISTINCT s_suppkey % 12 AS s, p_partkey % 15 AS p FROM supplier JOIN lineitem ON l_suppkey = s_suppkey JOIN part ON p_partkey = l_partkey WHERE l_orderkey % 11 = 0), b AS (SELECT DISTINCT c_custkey % 15 AS p, c_nationkey % 9 AS q FROM customer WHERE c_custkey % 4 = 0),
 n AS (SELECT count(*) AS n FROM (SELECT 's' || s FROM a UNION SELECT 'p' || p FROM a UNION SELECT 'p' || p FROM b UNION SELECT 'q' || q FROM b)), t AS (SELECT s, q, p, count(*) OVER (PARTITION BY s, q) AS k FROM a JOIN b USING (p)),
 v AS (SELECT 'p' || p AS node, sum(1 / k) AS b FROM t GROUP BY 1), x AS (SELECT 's' || s AS node FROM a UNION SELECT 'p' || p FROM a UNION SELECT 'p' || p FROM b UNION SELECT 'q' || q FROM b)
SELECT x.node, round(coalesce(v.b, 0) / ((n - 1) * (n - 2)), 8) AS centrality FROM x LEFT JOIN v USING (node), n
""")
def g06_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Betweenness on a graph of three layers."""
    j = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "lineitem").where("l_orderkey % 11 = 0"), F.col("l_suppkey") == F.col("s_suppkey"))
    a = j.selectExpr("'s' || CAST(s_suppkey % 12 AS STRING) AS src", "'p' || CAST(l_partkey % 15 AS STRING) AS dst").distinct()
    b = table(spark, sf_dir, "customer").where("c_custkey % 4 = 0").selectExpr("'p' || CAST(c_custkey % 15 AS STRING) AS src", "'q' || CAST(c_nationkey % 9 AS STRING) AS dst").distinct()
    e = a.unionAll(b)
    nodes = e.select(F.col("src").alias("node")).unionAll(e.select("dst")).distinct()
    return paths.betweenness(e, nodes).select("node", F.round("centrality", 8).alias("centrality"))


@query("""
WITH f AS (SELECT 'c' || o_orderkey AS src, 'c' || CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey ELSE o_custkey END AS dst FROM orders), e AS (SELECT 'c' || c_custkey AS uid FROM customer WHERE c_nationkey = 3) SELECT src AS uid FROM f WHERE src = dst UNION SELECT uid FROM e
""")
def g07_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that taint themselves, and calls inside entry methods."""
    f = table(spark, sf_dir, "orders").selectExpr("'c' || CAST(o_orderkey AS STRING) AS src", "'c' || CAST(CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey ELSE o_custkey END AS STRING) AS dst")
    return paths.flow_sources(f, table(spark, sf_dir, "customer").where("c_nationkey = 3").selectExpr("'c' || CAST(c_custkey AS STRING) AS uid"))


_VERTICES = "o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'METHOD' ELSE 'CALL' END AS label"


def _vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = """map('NAME', CASE WHEN o_orderkey % 5 = 0 THEN '<empty>' WHEN o_orderkey % 28 = 0 THEN '<init>' ELSE 'n' || CAST(o_custkey AS STRING) END, 'CODE', CASE WHEN o_orderkey % 3 = 0 THEN 'x()' END, 'FILENAME', CASE WHEN o_orderkey % 7 = 0 THEN '<unknown>' ELSE 'f.js' END,
     'LINE_NUMBER', CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS STRING) END, 'IS_EXTERNAL', CASE WHEN o_orderkey % 16 = 0 THEN 'true' ELSE 'false' END) AS props"""
    return table(spark, sf_dir, "orders").selectExpr(*[x.strip() for x in _VERTICES.split(", ", 1)], props)


@query("""
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 > 0 THEN CASE WHEN o_orderkey % 28 = 0 THEN '<init>' ELSE 'n' || o_custkey END END AS name, CASE WHEN o_orderkey % 3 = 0 THEN 'x()' WHEN o_orderkey % 5 = 0 THEN '' ELSE 'n' || o_custkey END AS code,
 CASE WHEN o_orderkey % 7 = 0 THEN '<unknown>' ELSE 'f.js' END AS file, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE 0 END AS line FROM orders WHERE o_orderkey % 4 > 0
""")
def prj02_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls in the canonical form: placeholders are nulls, defaults filled in."""
    return codegraph.calls(_vertices(spark, sf_dir), "s").select("id", "name", "code", "file", "line")


@query("""
WITH m AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 4 = 0 AND o_orderkey % 5 > 0 AND o_orderkey % 7 > 0 AND o_orderkey % 16 > 0), p AS (SELECT l_orderkey AS id FROM lineitem WHERE l_linenumber = 1), c AS (SELECT l_partkey AS id FROM lineitem WHERE l_linenumber = 2), r AS (SELECT l_partkey AS id FROM lineitem WHERE l_linenumber = 3 AND l_suppkey % 5 = 0)
SELECT id FROM m WHERE id IN (SELECT id FROM p) AND (id NOT IN (SELECT id FROM c) OR id IN (SELECT id FROM r))
""")
def prj06_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry methods: internal, placed, with a parameter, and not called, or callbacks."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    e = lambda where, src, dst, label, kind: l.where(where).selectExpr(f"'{label}' AS label", f"{src} AS src", f"{dst} AS dst", "'X' AS src_label", f"'{kind}' AS dst_label")
    edges = e("l_linenumber = 1", "l_orderkey", "l_partkey", "AST", "METHOD_PARAMETER_IN").unionAll(e("l_linenumber = 2", "l_orderkey", "l_partkey", "CALL", "METHOD")).unionAll(e("l_linenumber = 3 AND l_suppkey % 5 = 0", "l_orderkey", "l_partkey", "REF", "METHOD"))
    return codegraph.entry_methods(_vertices(spark, sf_dir), edges)


@query("""
WITH v AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'METHOD' ELSE 'CALL' END AS label FROM orders) SELECT id, label, CASE label WHEN 'CALL' THEN (CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END + 1) ELSE 1 END AS n_props FROM v
""")
def prj01_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices of wanted labels with the properties that these list."""
    v = _vertices(spark, sf_dir)
    none = v.selectExpr("id AS src", "id AS dst", "'AST' AS label", "label AS src_label", "label AS dst_label")
    kept, _ = codegraph.project(v, none, {"CALL": ["NAME", "CODE"], "METHOD": ["NAME"]}, [("AST", "CALL", "CALL")])
    return kept.select("id", "label", F.size("props").alias("n_props"))


_FITS = "SELECT o_custkey::VARCHAR AS run_id, o_orderkey AS idx, 'k' AS key_id, 1 + (o_orderkey % 3 = 0)::INT AS level FROM orders"
_ONE = f"WITH f AS ({_FITS}) SELECT run_id, idx, key_id, level FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY level DESC, idx) AS k FROM f) WHERE k = 1"


def _fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("CAST(o_custkey AS STRING) AS run_id", "o_orderkey AS idx", "'k' AS key_id", "1 + CAST(o_orderkey % 3 = 0 AS INT) AS level")


@query(_ONE)
def jo11_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One finding for each run's one key: the best level, then the lowest."""
    return matching.match_greedy(_fits(spark, sf_dir))


@query(_ONE)
def jo12_maximum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a maximum matching."""
    return matching.match_maximum(_fits(spark, sf_dir))


@query("""
WITH o AS (SELECT o_custkey::VARCHAR AS run_id, 1::BIGINT AS left_id, o_orderkey AS right_id, o_orderkey % 5 AS shared, o_orderkey % 7 AS distance FROM orders) SELECT run_id, left_id, right_id FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY shared DESC, distance, right_id) AS k FROM o) WHERE k = 1
""")
def jo13_leftovers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run's one left finding with the right one that shares most."""
    o = table(spark, sf_dir, "orders").selectExpr("CAST(o_custkey AS STRING) AS run_id", "CAST(1 AS BIGINT) AS left_id", "o_orderkey AS right_id", "o_orderkey % 5 AS shared", "o_orderkey % 7 AS distance")
    return matching.pair_leftovers(o)


@query("""
SELECT c_custkey, CASE WHEN path LIKE '../%' THEN 'outside' WHEN k = 1 THEN 'folder' WHEN k = 2 THEN 'minified' WHEN k = 3 THEN 'pseudo' WHEN size > 1000000 THEN 'size' END AS reason FROM (
 SELECT c_custkey, c_custkey % 7 AS k, CASE c_custkey % 7 WHEN 0 THEN '../a.js' WHEN 1 THEN 'a/Node_Modules/b.js' WHEN 2 THEN 'a/x.bundle.JS' WHEN 3 THEN '<unknown>' ELSE 'src/tests.js' END AS path, c_custkey * 5000 % 3000000 AS size FROM customer)
""")
def src05_skip_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a detector doesn't read a file."""
    d = table(spark, sf_dir, "customer").selectExpr("c_custkey", "CASE c_custkey % 7 WHEN 0 THEN '../a.js' WHEN 1 THEN 'a/Node_Modules/b.js' WHEN 2 THEN 'a/x.bundle.JS' WHEN 3 THEN '<unknown>' ELSE 'src/tests.js' END AS path", "c_custkey * 5000 % 3000000 AS size")
    return d.select("c_custkey", texts.skip_reason(F.col("path"), F.col("size")).alias("reason"))


@query("""
SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'folder' WHEN 1 THEN 'symlink' WHEN 2 THEN 'minified' WHEN 3 THEN 'test file' WHEN 4 THEN 'minified (a line over 2000 chars)' END AS reason FROM customer
""")
def src06_index_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a code index leaves a file out."""
    path = "CASE c_custkey % 6 WHEN 0 THEN 'dist/a.js' WHEN 2 THEN 'x.min.js' WHEN 3 THEN 'test/a.js' ELSE 'src/a.js' END AS path"
    d = table(spark, sf_dir, "customer").selectExpr("c_custkey", path, "CASE WHEN c_custkey % 6 = 4 THEN 'a\n' || repeat('x', 2001) ELSE repeat('y', 2000) END AS content", "c_custkey % 6 = 1 AS link")
    return d.select("c_custkey", texts.index_skip_reason(F.col("path"), F.length("content"), F.col("content"), F.col("link")).alias("reason"))


@query("""
WITH l AS (SELECT 'u' || user_id || '.c' AS file, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS lineno, CASE event_id % 9 WHEN 0 THEN 'a(); /* open' WHEN 4 THEN 'shut */ b();' ELSE 'x = 1;' END AS text, event_id % 9 AS k FROM events),
 s AS (SELECT *, last_value(CASE WHEN k IN (0, 4) THEN k END IGNORE NULLS) OVER (PARTITION BY file ORDER BY lineno ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM l)
SELECT file, lineno, CASE WHEN before = 0 THEN CASE k WHEN 4 THEN ' b();' ELSE '' END WHEN k = 0 THEN 'a(); ' ELSE text END AS code, CASE WHEN before = 0 THEN CASE k WHEN 4 THEN 'shut ' ELSE text END WHEN k = 0 THEN ' open' ELSE '' END AS comment FROM s
""")
def win11_block_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines parted into code and comment, block comments followed across lines."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("bigint")
    text = "CASE event_id % 9 WHEN 0 THEN 'a(); /* open' WHEN 4 THEN 'shut */ b();' ELSE 'x = 1;' END"
    l = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".c")).alias("file"), n.alias("lineno"), F.expr(text).alias("text"))  # noqa: E741
    return detect.split_lines(l).select("file", "lineno", "code", "comment")


@query("""
SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, CASE event_id % 4 WHEN 0 THEN 'run' WHEN 1 THEN 'm' WHEN 2 THEN 'go' END AS name, CASE event_id % 3 WHEN 0 THEN 'a b c' ELSE 'z' END AS words FROM events
""")
def fn_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of time stamps with a zone, bare function names, keyword queries."""
    e = table(spark, sf_dir, "events")
    full = "CASE event_id % 4 WHEN 0 THEN 'a.js::program:Impl:run' WHEN 1 THEN 'a.py:<module>.Cls.m' WHEN 2 THEN 'p.C.go:void(int)' ELSE 'a.js::program' END"
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    words = F.when(F.col("event_id") % 3 == 0, "A, b; 7 a_c").otherwise("Z9z")
    return e.select("event_id", advisories.day(stamp).alias("day"), code.function_name(F.expr(full)).alias("name"), code.keyword_query(words).alias("words"))


@query("""
SELECT o_orderkey AS lead_index, decision FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'CONFIRM' WHEN 1 THEN 'REJECT' WHEN 2 THEN 'ERROR' ELSE 'INCONCLUSIVE' END AS decision, CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice END AS c FROM orders)
ORDER BY CASE decision WHEN 'CONFIRM' THEN 0 WHEN 'INCONCLUSIVE' THEN 1 WHEN 'REJECT' THEN 2 ELSE 3 END, coalesce(c, 0) DESC, o_orderkey LIMIT 500
""")
def rnk01_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first verdicts of a report."""
    v = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS lead_index", "CASE o_orderkey % 4 WHEN 0 THEN 'CONFIRM' WHEN 1 THEN 'REJECT' WHEN 2 THEN 'ERROR' ELSE 'INCONCLUSIVE' END AS decision", "CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice END AS sink_centrality")
    return leads.ranked(v).limit(500).select("lead_index", "decision")


@query("""
WITH t AS (SELECT n_name, (n_nationkey * 7 % 25) / 100 AS p, CASE WHEN n_nationkey % 6 > 0 THEN 0.5 ELSE -0.5 END AS low FROM nation) SELECT n_name, bool_and(low > 0) OVER (ORDER BY p, n_name) AS rejecting FROM t
""")
def win09_rejecting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all tests up to each one still reject."""
    t = table(spark, sf_dir, "nation").selectExpr("n_name", "(n_nationkey * 7 % 25) / 100 AS p", "CASE WHEN n_nationkey % 6 > 0 THEN 0.5 ELSE -0.5 END AS low")
    d = evaluation.still_rejecting(t, "p", "low", "n_name")
    return d.select("n_name", F.col([c for c in d.columns if c not in t.columns][0]).alias("rejecting"))


@query("""
WITH f AS (SELECT DISTINCT 'r' || n_nationkey AS repo, CASE WHEN n_nationkey % 3 = 0 THEN 'dev' ELSE 'train' END AS split FROM nation WHERE n_nationkey < 12), p AS (SELECT DISTINCT 'r' || c_nationkey AS repo FROM customer), n AS (SELECT repo, row_number() OVER (ORDER BY sha256('0:' || repo), repo) AS k, count(*) OVER () AS n FROM p WHERE repo NOT IN (SELECT repo FROM f))
SELECT repo, split FROM f UNION ALL SELECT repo, CASE WHEN k <= least(n, greatest(1, round_even(0.15::DOUBLE * n, 0))) THEN 'dev' ELSE 'train' END FROM n
""")
def cur08_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frozen splits stay; new repositories are assigned among themselves."""
    f = table(spark, sf_dir, "nation").where("n_nationkey < 12").selectExpr("'r' || CAST(n_nationkey AS STRING) AS repo", "CASE WHEN n_nationkey % 3 = 0 THEN 'dev' ELSE 'train' END AS split")
    return balance.extend(f, table(spark, sf_dir, "customer").selectExpr("'R' || CAST(c_nationkey AS STRING) AS repo", "'new' AS source"))


@query("SELECT 'u' || p_partkey AS unit, 1::BIGINT AS rows FROM (SELECT p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS k FROM part) WHERE k <= 12")
def cur16_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units up to a cap for each repository; a total that all of these fit into."""
    n = table(spark, sf_dir, "part").select("p_type").distinct().count()
    u = table(spark, sf_dir, "part").selectExpr("p_partkey AS seq", "'u' || CAST(p_partkey AS STRING) AS unit", "'small' AS queue", "CAST(1 AS BIGINT) AS size", "p_type AS repo", "CAST(NULL AS STRING) AS cwe", "CAST(NULL AS STRING) AS family", "'py' AS language")
    return balance.fill(u, 12 * n, "py", {"repo": 1.0 / n + 1e-9}).select("unit", "rows")


@query("""
WITH e AS (SELECT (o_orderkey % 4) AS scan_id, 'n' || o_custkey % 300 AS src, 'n' || o_orderkey % 300 AS dst FROM orders), n AS (SELECT DISTINCT o_orderkey % 4 AS scan_id, 'n' || o_orderkey % 200 AS uid FROM orders)
SELECT e.scan_id, count(*) AS n FROM e WHERE (scan_id, src) IN (SELECT scan_id, uid FROM n) AND (scan_id, dst) IN (SELECT scan_id, uid FROM n) GROUP BY 1
""")
def snk01_persist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph written by scan: edges without an end aren't."""
    o, folder = table(spark, sf_dir, "orders"), work_folder(spark)
    nodes = o.selectExpr("o_orderkey % 4 AS scan_id", "'n' || CAST(o_orderkey % 200 AS STRING) AS uid").distinct()
    store.persist(nodes, o.selectExpr("o_orderkey % 4 AS scan_id", "'n' || CAST(o_custkey % 300 AS STRING) AS src", "'n' || CAST(o_orderkey % 300 AS STRING) AS dst"), folder)
    return spark.read.parquet(f"{folder}/edges").groupBy(F.col("scan_id").cast("bigint").alias("scan_id")).agg(F.count("*").alias("n"))
