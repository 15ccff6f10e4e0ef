"""Further registered queries: joins by range and prefix, windows, grouping sets, hybrid search, prices, code tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import code
from quarry.operators import balance, curation, evaluation, leads, matching, paths, search
from quarry.plans import store
from quarry.plans.catalog import _BM25, _KNN, TERMS, query, table


@query("""
SELECT o_orderkey, count(*) AS n_lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate >= o_orderdate AND l_shipdate <= o_orderdate + INTERVAL 30 DAY GROUP BY 1
""")
def jo06_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines shipped within thirty days of their order: an equality join with a range beside it."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")  # noqa: E741
    near = (F.col("l_shipdate") >= F.col("o_orderdate")) & (F.col("l_shipdate") <= F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS"))
    return o.join(l, (F.col("l_orderkey") == F.col("o_orderkey")) & near).groupBy("o_orderkey").agg(F.count("*").alias("n_lines"))


@query("""
SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity BETWEEN 10 AND 40)
""")
def jo16_anti_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without a line inside a range of quantities."""
    l = table(spark, sf_dir, "lineitem").where(F.col("l_quantity").between(10, 40)).select(F.col("l_orderkey").alias("o_orderkey"))  # noqa: E741
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(l, "o_orderkey", "left_anti")


@query("""
SELECT p_partkey, p_brand, p_type FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_size > 48) AND p_type NOT IN (SELECT p_type FROM part WHERE p_retailprice > 2000)
""")
def jo16_allow_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of allowed brands that are of no leaked type."""
    p = table(spark, sf_dir, "part")
    allowed = p.where("p_size > 48").select("p_brand").distinct()
    leaked = p.where("p_retailprice > 2000").select("p_type").distinct()
    return p.select("p_partkey", "p_brand", "p_type").join(allowed, "p_brand", "left_semi").join(leaked, "p_type", "left_anti")


@query("""
WITH s AS (SELECT o_orderkey, o_orderpriority AS repo, sha1(o_orderkey::VARCHAR) AS sha FROM orders), a AS (SELECT repo, substr(sha, 1, 7 + (o_orderkey % 5)::INT) AS short FROM s)
SELECT s.o_orderkey, a.short FROM a JOIN s ON s.repo = a.repo AND starts_with(s.sha, a.short)
""")
def jo18_sha_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abbreviated hashes found again in their repository: joined by their first seven digits, then compared whole."""
    s = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("repo"), F.sha1(F.col("o_orderkey").cast("string")).alias("sha"))
    a = s.select("repo", F.expr("substr(sha, 1, 7 + cast(o_orderkey % 5 as int))").alias("short"))
    seven = lambda c: F.substring(c, 1, 7)
    a, s = a.withColumn("head", seven("short")), s.withColumn("head", seven("sha"))
    return s.join(a, ["repo", "head"]).where(F.startswith("sha", F.col("short"))).select("o_orderkey", "short")


@query("""
WITH v AS (SELECT user_id, (event_id % 3)::INT AS run_no, max(value) AS v FROM events WHERE event_type = 'click' GROUP BY 1, 2), p AS (SELECT user_id, (event_id % 3)::INT AS run_no, max(value) AS p FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT coalesce(v.user_id, p.user_id) AS user_id, count(*) FILTER (v.v IS NOT NULL AND p.p IS NOT NULL) AS n_pairs, count(*) FILTER (v.v > p.p) AS n_correct, count(*) FILTER (v.v IS NULL OR p.p IS NULL) AS n_unpaired
FROM v FULL JOIN p ON v.user_id = p.user_id AND v.run_no = p.run_no GROUP BY 1
""")
def jo19_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two kinds, paired by user and run; those without a partner are counted."""
    e = table(spark, sf_dir, "events").withColumn("run_no", (F.col("event_id") % 3).cast("int"))
    side = lambda kind, name: e.where(F.col("event_type") == kind).groupBy("user_id", "run_no").agg(F.max("value").alias(name))
    both = side("click", "v").join(side("purchase", "p"), ["user_id", "run_no"], "full_outer")
    paired = F.col("v").isNotNull() & F.col("p").isNotNull()
    return both.groupBy("user_id").agg(F.count_if(paired).alias("n_pairs"), F.count_if(F.col("v") > F.col("p")).alias("n_correct"), F.count_if(~paired).alias("n_unpaired"))


@query("""
SELECT doc_id, source, CASE WHEN lang <> 'en' THEN 'language' WHEN n_chars < 500 THEN 'short' WHEN n_chars > 5000 THEN 'long' END AS reason FROM documents
""")
def prj10_first_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = [("language", F.col("lang") == "en"), ("short", F.col("n_chars") >= 500), ("long", F.col("n_chars") <= 5000)]
    return table(spark, sf_dir, "documents").select("doc_id", "source", curation.first_reason(checks).alias("reason"))


@query("""
WITH s AS (SELECT *, lower(p_name) AS n FROM part)
SELECT p_partkey, CASE WHEN contains(lower(p_type), 'steel') OR contains(n, 'steel') THEN 'metal' WHEN contains(lower(p_type), 'brass') OR contains(n, 'brass') THEN 'alloy' WHEN contains(lower(p_type), 's') OR contains(n, 's') THEN 'other' END AS category FROM s
""")
def prj08_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's category by hints in its name or type, the most severe first."""
    rules = [paths.SinkRule("other", 1, ("s",)), paths.SinkRule("metal", 5, ("steel",)), paths.SinkRule("alloy", 3, ("brass",))]
    found = paths.classify_sink(rules, F.col("p_name"), F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", found["category"].alias("category"))


@query(r"""
WITH c AS (SELECT page_id, replace(trim(url), '\', '/') AS f, regexp_extract(url, '([0-9]{1,4})$', 1) AS n FROM pages)
SELECT page_id, nullif(regexp_replace(f, '^\./', ''), '') AS file, CASE WHEN n <> '' THEN 'CWE-' || n::INT END AS cwe FROM c
""")
def prj04_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places with / and without ./, and the weakness that a closing number names."""
    n = F.regexp_extract("url", "([0-9]{1,4})$", 1)
    return table(spark, sf_dir, "pages").select("page_id", code.clean_file(F.col("url")).alias("file"), code.clean_cwe(n).alias("cwe"))


@query("""
WITH t AS (SELECT doc_id, n_chars, source, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents)
SELECT doc_id, len(w)::BIGINT AS n_runs, sha1(concat_ws('|', source, doc_id::VARCHAR, n_chars::VARCHAR)) AS uid FROM t
""")
def m04_uid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stable ids from business columns, and the letter runs that a keyword search sees."""
    runs = F.size(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).cast("bigint")
    return table(spark, sf_dir, "documents").select("doc_id", runs.alias("n_runs"), code.stable_uid(F.col("source"), F.col("doc_id"), F.col("n_chars")).alias("uid"))


@query("""
SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) FILTER (o_orderstatus <> 'O') AS o_orderstatus, arg_max(o_orderpriority, o_orderkey) AS o_orderpriority, count(*) AS n FROM orders GROUP BY 1
""")
def snk02_unite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a customer: each property's last value that isn't null."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).alias("o_orderstatus"), "o_orderpriority", "o_orderkey")
    n = o.groupBy("o_custkey").agg(F.count("*").alias("n"))
    return store.unite(o, ["o_custkey"], "o_orderkey").join(n, "o_custkey")


@query("""
SELECT l_orderkey, l_partkey, EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size < 40) AS kept FROM lineitem WHERE l_linenumber = 1
""")
def snk05_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges whose ends exist, and those that are lost."""
    at = lambda d, c: d.select(F.lit("s").alias("scan_id"), F.col(c).alias("uid"))
    e = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.lit("s").alias("scan_id"), F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    good, lost = store.with_ends(e, at(table(spark, sf_dir, "orders"), "o_orderkey"), at(table(spark, sf_dir, "part").where("p_size < 40"), "p_partkey"))
    return good.withColumn("kept", F.lit(True)).unionByName(lost.withColumn("kept", F.lit(False))).select(F.col("src").alias("l_orderkey"), F.col("dst").alias("l_partkey"), "kept")


@query("""
SELECT event_id, user_id, sum((event_id % 7) - 3) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)::BIGINT AS shift FROM events
""")
def win10_prefix_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the changes before each one of the same file add up to."""
    by = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.sum(F.col("event_id") % 7 - 3).over(by).alias("shift"))


@query("""
SELECT conv_id, turn, role, string_agg(role, '>') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM conversations
""")
def sft_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn with the roles of all turns before it."""
    by = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    d = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.collect_list("role").over(by).alias("b"))
    return d.select("conv_id", "turn", "role", F.when(F.size("b") > 0, F.array_join("b", ">")).alias("before"))


@query("""
WITH t AS (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations) SELECT conv_id, turn, next FROM t WHERE role = 'user' AND next = 'assistant'
""")
def win07_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that the right partner follows at once."""
    nxt = F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn")).alias("next")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", nxt).where("role = 'user' and next = 'assistant'").select("conv_id", "turn", "next")


@query("""
SELECT e.event_id, CASE WHEN e.event_type = 'click' THEN round(k * 5 / 1e6, 9) WHEN e.event_type = 'purchase' THEN round(k * 1 / 1e6, 9) ELSE 0 END AS usd FROM (SELECT *, (props ->> '$.k')::BIGINT AS k FROM events) e
""")
def agg05_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens priced by model; a model without a price costs nothing."""
    rates = spark.createDataFrame([("click", 5.0, 25.0), ("purchase", 1.0, 5.0)], "model string, input double, output double")
    none = F.lit(None).cast("bigint")
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("model"), F.get_json_object("props", "$.k").cast("bigint").alias("input_tokens"), *(none.alias(c) for c in ("output_tokens", "cache_write", "cache_read", "write_5m", "write_1h")))
    return leads.price(rates, e, {}).select("event_id", F.round("usd", 9).alias("usd"))


@query("""
SELECT CASE WHEN n_chars <= 1000 THEN 'small' WHEN n_chars <= 5000 THEN 'middle' WHEN n_chars IS NULL THEN 'unknown' ELSE 'large' END AS size, lang, count(*) AS n FROM documents GROUP BY 1, 2
""")
def agg03_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    size = F.when(n <= 1000, "small").when(n <= 5000, "middle").when(n.isNull(), "unknown").otherwise("large")
    return table(spark, sf_dir, "documents").groupBy(size.alias("size"), "lang").agg(F.count("*").alias("n"))


@query("""
WITH r AS (SELECT event_type AS arm, (value > 50)::BIGINT AS caught, CASE WHEN event_id % 10 > 0 THEN (props ->> '$.k')::BIGINT END AS tokens FROM events)
SELECT arm, count(tokens) AS n, count(*) - count(tokens) AS n_missing, round(CASE WHEN sum(tokens) > 0 THEN (sum(caught) FILTER (tokens IS NOT NULL))::DOUBLE * 1000000 / sum(tokens)::DOUBLE END, 4) AS per_million FROM r GROUP BY 1
""")
def evl07_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catches per million tokens; runs without a token count are left out and counted."""
    tokens = F.when(F.col("event_id") % 10 > 0, F.get_json_object("props", "$.k").cast("bigint"))
    r = table(spark, sf_dir, "events").select(F.col("event_type").alias("arm"), (F.col("value") > 50).cast("bigint").alias("caught"), tokens.alias("tokens"))
    return evaluation.efficiency(r, ["arm"]).withColumn("per_million", F.round("per_million", 4))


@query("""
WITH r AS (SELECT event_type AS arm, CASE WHEN event_id % 10 > 0 THEN value > 50 END AS alarm FROM events), s AS (SELECT arm, count(alarm) AS n, count(*) - count(alarm) AS n_missing, count(*) FILTER (alarm) AS h FROM r GROUP BY 1)
SELECT arm, n, n_missing, round(h / n, 6) AS rate, round(h / (n + n_missing), 6) AS low, round((h + n_missing) / (n + n_missing), 6) AS high FROM s
""")
def agg07_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of alarms with their bounds for runs that are missing."""
    r = table(spark, sf_dir, "events").select(F.col("event_type").alias("arm"), F.when(F.col("event_id") % 10 > 0, F.col("value") > 50).alias("alarm"))
    return evaluation.false_alarms(r, ["arm"]).select("arm", "n", "n_missing", *(F.round(c, 6).alias(c) for c in ("rate", "low", "high")))


@query("""
WITH r AS (SELECT lang, quality = 1 AS truth, n_chars > 1500 AS found FROM documents JOIN labels USING (doc_id)), s AS (
SELECT lang, count(*) FILTER (truth AND found) AS tp, count(*) FILTER (NOT truth AND found) AS fp, count(*) FILTER (truth AND NOT found) AS fn, count(*) FILTER (NOT truth AND NOT found) AS tn FROM r GROUP BY ROLLUP (lang))
SELECT lang, tp, fp, fn, tn, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END - CASE WHEN fp + tn > 0 THEN fp / (fp + tn) END, 6) AS j FROM s
""")
def agg12_youden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion counts by language and of all."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    r = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(labels, "doc_id").select("lang", (F.col("quality") == 1).alias("truth"), (F.col("n_chars") > 1500).alias("found"))
    return evaluation.youden(r, "lang").select("lang", "tp", "fp", "fn", "tn", F.round("j", 6).alias("j"))


@query("""
WITH r AS (SELECT l_suppkey % 50 AS file, unnest(range(l_linenumber, l_linenumber + 1 + (l_orderkey % 4)::INT)) AS line FROM lineitem) SELECT file, line, count(*) AS hits FROM r GROUP BY 1, 2
""")
def agg14_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits by line from ranges of lines."""
    end = F.col("l_linenumber") + (F.col("l_orderkey") % 4)
    r = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 50).alias("file"), F.explode(F.sequence(F.col("l_linenumber").cast("bigint"), end)).alias("line"))
    return r.groupBy("file", "line").agg(F.count("*").alias("hits"))


@query("""
WITH m AS (SELECT c_nationkey, c_custkey, avg(o_totalprice) AS m FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2) SELECT c_nationkey, count(*) AS n, round(avg(m), 4) AS mean, round(median(m), 4) AS median, round(max(m), 4) AS most FROM m GROUP BY 1
""")
def agg09_mean_of_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.avg("o_totalprice").alias("m"))
    r = lambda x, n: F.round(x, 4).alias(n)
    return c.join(o, "c_custkey").groupBy("c_nationkey").agg(F.count("*").alias("n"), r(F.avg("m"), "mean"), r(F.median("m"), "median"), r(F.max("m"), "most"))


@query("""
SELECT o_custkey, bool_and(o_orderstatus <> 'P') AND NOT bool_or(o_totalprice < 1000) AS correct, count(*) AS n FROM orders GROUP BY 1
""")
def agg15_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups all of whose rows pass and none of whose rows fails."""
    fine = F.bool_and(F.col("o_orderstatus") != "P") & ~F.bool_or(F.col("o_totalprice") < 1000)
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(fine.alias("correct"), F.count("*").alias("n"))


@query("""
SELECT lang, doc_id, turn FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('0:' || doc_id), doc_id) AS turn FROM documents) ORDER BY turn, lang LIMIT 50
""")
def cur12_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty documents, one language after the other."""
    order = [F.sha2(F.concat(F.lit("0:"), F.col("doc_id").cast("string")), 256), F.col("doc_id")]
    d = balance.round_robin(table(spark, sf_dir, "documents").select("lang", "doc_id"), "lang", order, 50)
    return d.withColumn("turn", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint"))


@query("""
WITH r AS (SELECT lower(source) AS repo, bool_and(lang IN ('en', 'de')) AS ready FROM documents GROUP BY 1), n AS (SELECT *, row_number() OVER (PARTITION BY ready ORDER BY sha256('0:' || repo), repo) AS k, count(*) OVER (PARTITION BY ready) AS n FROM r),
 o AS (SELECT repo FROM n WHERE ready AND k <= least(n, greatest(1, round_even(0.2::DOUBLE * n, 0)))), e AS (SELECT repo, row_number() OVER (ORDER BY sha256('0:' || repo), repo) AS k, count(*) OVER () AS n FROM r WHERE repo NOT IN (SELECT repo FROM o))
SELECT repo, CASE WHEN k <= least(n, greatest(1, round_even(0.15::DOUBLE * n, 0))) THEN 'dev' ELSE 'train' END AS split FROM e UNION ALL SELECT repo, 'oldcve' FROM o
""")
def cur07_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources to splits by the rank of a hash, with a share for those that are ready-made."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("repo"), F.col("lang").alias("source"))
    return balance.assign(d, old_sources=("en", "de"))


@query("""
WITH d AS (SELECT doc_id AS seq, lang AS split, text AS code, CASE WHEN doc_id % 3 = 0 THEN 'vulnerable' ELSE 'safe' END AS label FROM documents), m AS (SELECT *, max(label = 'vulnerable') OVER (PARTITION BY split, trim(code, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS bad, row_number() OVER (PARTITION BY split, trim(code, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), label ORDER BY seq) AS k FROM d)
SELECT seq, split, label FROM m WHERE code IS NULL OR ((NOT bad OR label = 'vulnerable') AND k = 1)
""")
def cur14_drop_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("doc_id") % 3 == 0, "vulnerable").otherwise("safe")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.col("lang").alias("split"), F.col("text").alias("code"), label.alias("label"))
    return balance.drop_conflicts(d).select("seq", "split", "label")


@query("""
WITH d AS (SELECT o_orderpriority AS p, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 UNION ALL SELECT 'none', 0), s AS (SELECT o_orderpriority AS p FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_orderpriority FROM orders WHERE o_orderstatus = 'P') SELECT p, n, p IN (SELECT p FROM s) AS shared FROM d
""")
def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union and intersection of repository sets."""
    o = table(spark, sf_dir, "orders")
    of = lambda s: o.where(F.col("o_orderstatus") == s).select(F.col("o_orderpriority").alias("p"))
    d = of("F").groupBy("p").agg(F.count("*").alias("n")).unionByName(spark.range(1).select(F.lit("none").alias("p"), F.lit(0).cast("bigint").alias("n")))
    shared = of("O").intersect(of("P")).withColumn("s", F.lit(True))
    return d.join(shared, "p", "left").select("p", "n", F.coalesce("s", F.lit(False)).alias("shared"))


@query(f"""
{_KNN.rstrip()}, b AS ({_BM25}), k AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM b),
 v AS (SELECT query_id, vec_id, rank FROM r WHERE rank <= 20), w AS (SELECT query_id, doc_id AS vec_id, rank FROM q, k WHERE rank <= 20)
SELECT coalesce(v.query_id, w.query_id) AS query_id, coalesce(v.vec_id, w.vec_id) AS vec_id, round(coalesce(1 / (60 + v.rank), 0) + coalesce(1 / (60 + w.rank), 0), 6) AS score,
 CASE WHEN w.rank IS NULL THEN 'vector' WHEN v.rank IS NULL THEN 'keyword' ELSE 'both' END AS matched FROM v FULL JOIN w ON v.query_id = w.query_id AND v.vec_id = w.vec_id
""")
def sea06_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches by a vector and by terms over all vectors and texts, fused, with where each hit comes from.

    A search goes out from each vector whose id 50 divides; a text's vector has its id.  As in the reference, 20 of each
    ranking are fused.
    """
    depth = 20
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = v.where("vec_id % 50 = 0")
    vector = search.knn(v, asked, depth).select("query_id", "vec_id", "rank")
    best = search.bm25(table(spark, sf_dir, "documents"), TERMS).orderBy(F.desc("score"), "doc_id").limit(depth)
    best = best.select(F.col("doc_id").alias("vec_id"), F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")).alias("rank"))
    # the terms' ranking is the same for all searches: 20 rows for each
    keyword = asked.select(F.col("vec_id").alias("query_id")).distinct().crossJoin(F.broadcast(best))
    return search.hybrid(vector, keyword, ["query_id", "vec_id"])


@query("""
WITH l AS (SELECT l_orderkey AS index, l_partkey % 40 AS a, l_suppkey % 10 AS b, l_linenumber FROM lineitem WHERE l_linenumber = 1) SELECT a, b, min(index) AS index FROM l GROUP BY 1, 2
""")
def rnk03_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first lead of each pair of ends, by the whole dedup rule."""
    no = F.lit(None).cast("string")
    l = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("index"), (F.col("l_partkey") % 40).alias("a"), (F.col("l_suppkey") % 10).alias("b"))  # noqa: E741
    d = l.withColumns({"shape": no, "text": no, "confidence": F.lit("LOW"), "source_uid": F.col("a").cast("string"), "sink_uid": F.col("b").cast("string"), "file": no, "line": F.lit(None).cast("bigint"), "function": no, "cwe": no, "run": F.pmod("a", F.lit(4))})
    return leads.dedup(d, ["run"]).select("a", "b", "index")


@query("""
WITH k AS (SELECT n_nationkey AS key, 'nation-' || n_nationkey AS file FROM nation), f AS (SELECT c_custkey AS idx, 'x/nation-' || c_nationkey AS file FROM customer) SELECT idx, key FROM f JOIN k ON f.file = k.file OR ends_with(f.file, '/' || k.file)
""")
def jo09_same_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that are equal from a / on: joined by base name, then compared."""
    k = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.concat(F.lit("nation-"), F.col("n_nationkey").cast("string")).alias("k_file"))
    f = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("idx"), F.concat(F.lit("x/nation-"), F.col("c_nationkey").cast("string")).alias("f_file"))
    j = f.withColumn("base", matching.base_name(F.col("f_file"))).join(k.withColumn("base", matching.base_name(F.col("k_file"))), "base")
    return j.where(matching.same_file(F.col("f_file"), F.col("k_file"))).select("idx", "key")


@query("""
SELECT doc_id, count(*) FILTER (regexp_matches(line, '(?i)licen[cs]e')) AS n_license, count(*) FILTER (contains(line, '@')) AS n_address, count(*) AS n_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1
""")
def str_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that patterns find, by text."""
    l = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))  # noqa: E741
    return l.groupBy("doc_id").agg(F.count_if(F.col("line").rlike("(?i)licen[cs]e")).alias("n_license"), F.count_if(F.col("line").contains("@")).alias("n_address"), F.count("*").alias("n_lines"))


@query()
def evl08_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two arms' catches by user, drawn 2,000 times."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    arm = lambda t, a: [F.sum(F.when(F.col("event_type") == t, (F.col("value") > 50).cast("bigint"))).alias(f"caught_{a}"), F.sum(F.when(F.col("event_type") == t, F.col("k"))).alias(f"tokens_{a}")]
    # a cluster is a repository; users stand for them, in a hundred groups
    cells = e.groupBy((F.col("user_id") % 100).alias("cluster")).agg(*arm("click", "a"), *arm("purchase", "b")).withColumn("pair", F.lit("click-purchase"))
    return evaluation.bootstrap(cells, ["pair"], draws=2000)
