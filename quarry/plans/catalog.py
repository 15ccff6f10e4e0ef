"""The library's registered queries over the driver's tables, and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators import components, curation, evaluation, graph, joins, search
from quarry.streaming import events as event_stream

FLAGSHIP = "g05_reachability"
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""
WITH e0 AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'),
 e1 AS (SELECT o_orderkey FROM orders JOIN e0 ON o_custkey = c_custkey),
 e2 AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem JOIN e1 ON l_orderkey = o_orderkey)
SELECT 'c' || c_custkey AS node, 0 AS hop FROM e0 UNION ALL SELECT DISTINCT 'o' || o_orderkey, 1 FROM e1
UNION ALL SELECT DISTINCT 'p' || l_partkey, 2 FROM e2 UNION ALL SELECT DISTINCT 's' || l_suppkey, 2 FROM e2
""")
def g05_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From one segment's customers over their orders to parts and suppliers."""
    n = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    line = table(spark, sf_dir, "lineitem")
    edges = table(spark, sf_dir, "orders").select(n("c", "o_custkey").alias("src"), n("o", "o_orderkey").alias("dst"))
    edges = edges.unionAll(line.select(n("o", "l_orderkey"), n("p", "l_partkey"))).unionAll(line.select(n("o", "l_orderkey"), n("s", "l_suppkey")))
    entries = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(n("c", "c_custkey").alias("node"))
    return graph.reachable(edges, entries)


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey AS a, l_orderkey + 1 AS b FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1),
 w(n, root) AS (SELECT a, a FROM e WHERE a NOT IN (SELECT b FROM e) UNION ALL SELECT e.b, w.root FROM w JOIN e ON e.a = w.n)
SELECT n AS node, root AS component FROM w
""")
def g16_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alias groups: an order is linked to the next one if its first line came back."""
    first = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_linenumber = 1")
    return components.connected_components(first.select(F.col("l_orderkey").alias("src"), (F.col("l_orderkey") + 1).alias("dst")))


@query("""
SELECT e.event_id, e.user_id, e.ts, (SELECT arg_max(p.value, p.ts) FROM events p WHERE p.event_type = 'purchase' AND p.user_id = e.user_id AND p.ts <= e.ts) AS asof_value
FROM events e WHERE e.event_type = 'click'
""")
def jo03_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each click with the value of its user's latest purchase before it."""
    e = table(spark, sf_dir, "events")
    return joins.asof(e.where("event_type = 'click'").select("event_id", "user_id", "ts"), e.where("event_type = 'purchase'"), "user_id", "ts", "value")


@query("""
WITH s AS (SELECT user_id, event_id AS span_id, floor(epoch(ts))::BIGINT AS start, floor(epoch(ts))::BIGINT + 86400 * (1 + event_id % 5) AS stop FROM events WHERE event_type = 'signup'),
 p AS (SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS sec FROM events WHERE event_type = 'error')
SELECT event_id, p.user_id, sec, arg_min(span_id, (stop - start) * 1000000000 + span_id) AS span_id
FROM p LEFT JOIN s ON s.user_id = p.user_id AND sec BETWEEN start AND stop GROUP BY ALL
""")
def jo07_innermost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors with the shortest period after a signup of the same user that holds them."""
    e = table(spark, sf_dir, "events").withColumn("sec", F.unix_seconds(F.col("ts").cast("timestamp")))
    spans = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("span_id"), F.col("sec").alias("start"), (F.col("sec") + 86400 * (1 + F.col("event_id") % 5)).alias("stop"))
    return joins.innermost(e.where("event_type = 'error'").select("event_id", "user_id", "sec"), spans, "user_id", "sec", 86400)


@query("""
WITH a AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE year(o_orderdate) = 1996), b AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE year(o_orderdate) = 1997)
SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, coalesce(a.o_orderpriority, b.o_orderpriority) AS o_orderpriority,
 CASE WHEN a.o_custkey IS NULL THEN 'added' WHEN b.o_custkey IS NULL THEN 'removed' ELSE 'kept' END AS state
FROM a FULL JOIN b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority
""")
def jo14_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two years' orders have of customers and priorities."""
    o = table(spark, sf_dir, "orders")
    return joins.difference(o.where(F.year("o_orderdate") == 1996), o.where(F.year("o_orderdate") == 1997), ["o_custkey", "o_orderpriority"])


@query("""
SELECT l_orderkey, l_partkey FROM (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linestatus = 'F' EXCEPT ALL SELECT l_orderkey, l_partkey FROM lineitem WHERE l_discount > 0.02)
""")
def jo15_multiset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.where("l_linestatus = 'F'").select("l_orderkey", "l_partkey").exceptAll(l.where("l_discount > 0.02").select("l_orderkey", "l_partkey"))


@query("""
SELECT CASE WHEN lang <> 'en' THEN 'language' WHEN n_chars < 500 THEN 'short' WHEN n_chars > 5000 THEN 'long' ELSE 'kept' END AS reason, count(*) AS n FROM documents GROUP BY 1
""")
def agg02_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.funnel(table(spark, sf_dir, "documents"), [("language", F.col("lang") == "en"), ("short", F.col("n_chars") >= 500), ("long", F.col("n_chars") <= 5000)])


@query("""
SELECT sha256(text) AS text_sha, min(doc_id) AS survivor, arg_min(source, doc_id) AS source, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, count(*) AS n_copies FROM documents GROUP BY text
""")
def cur04_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.resolve(table(spark, sf_dir, "documents"))


@query("""
WITH r AS (SELECT doc_id, source, ('0x' || substr(sha256('0:' || source), 1, 7))::BIGINT % 100 AS r FROM documents)
SELECT doc_id, source, CASE WHEN r < 80 THEN 'train' WHEN r < 90 THEN 'valid' ELSE 'test' END AS split FROM r
""")
def cur07_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole sources go to one split each."""
    return table(spark, sf_dir, "documents").select("doc_id", "source", curation.split_of(F.col("source"), 0, [("train", 80), ("valid", 10), ("test", 10)]).alias("split"))


@query("""
SELECT sha256(text) AS text_sha, count(*) AS n_rows, min(quality) AS lowest, max(quality) AS highest FROM documents JOIN labels USING (doc_id) GROUP BY text HAVING min(quality) <> max(quality)
""")
def cur14_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.conflicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality")


@query("""
SELECT doc_id, source, lang FROM (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY sha256(doc_id::VARCHAR), doc_id) AS k FROM documents) WHERE k <= 3
""")
def win03_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return curation.cap_by_group(d, ["source", "lang"], [F.sha2(F.col("doc_id").cast("string"), 256), F.col("doc_id")], 3)


@query("""
WITH f AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) IS NOT DISTINCT FROM role THEN 0 ELSE 1 END AS fresh FROM conversations),
 i AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM f)
SELECT conv_id, first(role) AS role, min(turn) AS first_turn, count(*) AS n_turns, string_agg(text, chr(10) ORDER BY turn, text) AS text FROM i GROUP BY conv_id, island
""")
def sft_merge_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.merge_turns(table(spark, sf_dir, "conversations"))


@query("""
SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1
""")
def win02_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("user_id", "event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf_dir, "events").withColumn("k", F.row_number().over(by)).where("k = 1").select("user_id", "event_type", "event_id", "value")


@query("""
SELECT user_id, event_type, grouping(user_id, event_type)::BIGINT AS level, count(*) AS n, CASE WHEN count(*) FILTER (props IS NULL) > 0 THEN NULL ELSE sum((props ->> '$.k')::BIGINT)::BIGINT END AS tokens
FROM events GROUP BY GROUPING SETS ((user_id, event_type), (event_type), ())
""")
def agg04_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token sums by user and type, by type, and of all; a sum is null as soon as one entry lacks its number."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    sets = [[F.col("user_id"), F.col("event_type")], [F.col("event_type")], []]
    g = e.groupingSets(sets, "user_id", "event_type")
    return g.agg(F.grouping_id().cast("bigint").alias("level"), F.count("*").alias("n"), evaluation.poisoned_sum(F.col("k")).alias("tokens"))


_WILSON = """
WITH c AS (SELECT c_mktsegment AS segment, count(*) AS n, count(*) FILTER (c_acctbal < 0) AS hits FROM customer GROUP BY 1), p AS (SELECT *, hits / n AS p FROM c),
 i AS (SELECT *, (p + 1.96::DOUBLE * 1.96 / (2 * n)) / (1 + 1.96::DOUBLE * 1.96 / n) AS mid, 1.96::DOUBLE * sqrt(p * (1 - p) / n + 1.96::DOUBLE * 1.96 / (4 * n * n)) / (1 + 1.96::DOUBLE * 1.96 / n) AS half FROM p)
SELECT segment, n, hits, round(greatest(0, mid - half), 6) AS low, round(least(1, mid + half), 6) AS high FROM i
"""


@query(_WILSON)
def evl_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") < 0).alias("hits"))
    low, high = evaluation.wilson(F.col("hits"), F.col("n"))
    return c.select("segment", "n", "hits", low.alias("low"), high.alias("high"))


@query("""
WITH t AS (SELECT n_name, (n_nationkey + 1) * 0.003::DOUBLE AS p FROM nation), f AS (SELECT *, least(1.0::DOUBLE, p * (count(*) OVER () - row_number() OVER (ORDER BY p, n_name) + 1)) AS f FROM t)
SELECT n_name, round(max(f) OVER (ORDER BY p, n_name), 6) AS holm FROM f
""")
def evl09_holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "nation").select("n_name", ((F.col("n_nationkey") + 1) * F.lit(0.003)).alias("p"))
    return evaluation.holm(t, "n_name", "p").select("n_name", F.round("holm", 6).alias("holm"))


@query("""
WITH s AS (SELECT count(*) AS n, avg((quality = toxic)::INT) AS po, avg(quality) AS pa, avg(toxic) AS pb FROM labels), e AS (SELECT *, pa * pb + (1 - pa) * (1 - pb) AS pe FROM s)
SELECT n, round(po, 6) AS observed, round(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END, 6) AS kappa FROM e
""")
def evl12_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.kappa(table(spark, sf_dir, "labels"), "quality", "toxic")


@query("""
SELECT p.p_partkey, p.p_size, p.p_retailprice FROM part p WHERE NOT EXISTS (SELECT 1 FROM part q WHERE (q.p_size < p.p_size AND q.p_retailprice >= p.p_retailprice) OR (q.p_size = p.p_size AND q.p_retailprice > p.p_retailprice))
""")
def rnk07_pareto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of small size and high price: the best of each size are found first, then compared, one row a size."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    best = p.groupBy("p_size").agg(F.max("p_retailprice").alias("p_retailprice"))
    return p.join(evaluation.pareto(best, "p_size", "p_retailprice"), ["p_size", "p_retailprice"])


@query("""
WITH d AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents), c AS (SELECT doc_id, n, unnest(range(0, (n - 1) // 60 + 1)) AS chunk FROM d)
SELECT doc_id, chunk, least(60, n - chunk * 60) AS n_lines, chunk * 60 + 1 AS first_line FROM c
""")
def sea01_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.chunks(table(spark, sf_dir, "documents"))


TERMS = ["the", "with", "license"]
_BM25 = """
WITH w AS (SELECT doc_id, string_split_regex(lower(text), '[^a-z]+') AS w FROM documents),
 d AS (SELECT doc_id, len(w) AS n, {counts} FROM w), s AS (SELECT count(*) AS c, avg(n) AS mean, {dfs} FROM d)
SELECT doc_id, round({score}, 6) AS score FROM d, s WHERE {score} > 0
""".format(
    counts=", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS t{i}" for i, t in enumerate(TERMS)),
    dfs=", ".join(f"count(*) FILTER (t{i} > 0) AS df{i}" for i in range(len(TERMS))),
    score=" + ".join(f"ln(1 + (c - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) * t{i} * 2.2::DOUBLE / (t{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean))" for i in range(len(TERMS))),
)


@query(_BM25)
def sea04_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25(table(spark, sf_dir, "documents"), TERMS)


_KNN = """
WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0),
 s AS (SELECT query_id, vec_id, round(list_cosine_similarity(q::DOUBLE[], embedding::DOUBLE[]), 6) AS similarity FROM q JOIN embeddings ON vec_id <> query_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s)
"""


@query(_KNN + "SELECT query_id, vec_id, similarity, rank FROM r WHERE rank <= 10")
def sea02_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search.knn(v, v.where("vec_id % 50 = 0"), 10)


@query(_KNN + "SELECT vec_id, round(sum(1 / (rank + 60)), 6) AS score FROM r WHERE rank <= 10 GROUP BY 1")
def sea05_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search.fuse([search.knn(v, v.where("vec_id % 50 = 0"), 10)], "vec_id")


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def strm_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_stream.streamed_counts(spark, sf_dir, "events.parquet")


@query("""
SELECT l_partkey AS caller, count(DISTINCT l_suppkey) AS n_callees, min(l_suppkey) AS first_callee, count(*) AS n_calls FROM lineitem GROUP BY 1
""")
def agg01_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each node calls: distinct targets, the smallest, and all calls."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.groupBy(F.col("l_partkey").alias("caller")).agg(F.countDistinct("l_suppkey").alias("n_callees"), F.min("l_suppkey").alias("first_callee"), F.count("*").alias("n_calls"))


@query("""
WITH o AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R'), s AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'N')
SELECT o.l_partkey, o.l_suppkey FROM o ANTI JOIN s ON o.l_partkey = s.l_partkey AND o.l_suppkey = s.l_suppkey
""")
def g17_novel_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed edges that the static ones lack."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    edges = lambda flag: l.where(F.col("l_returnflag") == flag).select("l_partkey", "l_suppkey").distinct()
    return edges("R").join(edges("N"), ["l_partkey", "l_suppkey"], "left_anti")


@query("""
WITH l AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS i, l_partkey, CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END AS confidence, l_orderkey, l_linenumber FROM lineitem),
 r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY confidence DESC, l_orderkey, l_linenumber) AS k, count(*) OVER (PARTITION BY l_partkey) AS n FROM l)
SELECT l_partkey, l_orderkey, l_linenumber, confidence, n AS n_merged FROM r WHERE k = 1
""")
def rnk03_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One finding for each key: the surest, then the earliest; with how many it stands for."""
    sure = F.when(F.col("l_returnflag") == "R", 2).when(F.col("l_returnflag") == "A", 1).otherwise(0).alias("confidence")
    l = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", sure)  # noqa: E741
    least = F.min(F.struct((-F.col("confidence")).alias("c"), "l_orderkey", "l_linenumber")).alias("x")
    g = l.groupBy("l_partkey").agg(least, F.count("*").alias("n_merged"))
    return g.select("l_partkey", "x.l_orderkey", "x.l_linenumber", (-F.col("x.c")).alias("confidence"), "n_merged")


@query("""
SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'error') AS error FROM events GROUP BY 1
""")
def agg08_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(*(F.count_if(F.col("event_type") == t).alias(t) for t in ("click", "purchase", "error")))


_TAIL = "regexp_replace(regexp_replace(url, '#.*$', ''), '[?&](utm_[a-z]+|ref)=[^&]*', '', 'g')"


@query(f"SELECT page_id, regexp_replace({_TAIL}, '/$', '') AS clean FROM pages")
def prj_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urls without fragment, tracking parameters and closing slash."""
    u = F.regexp_replace(F.regexp_replace("url", "#.*$", ""), "[?&](utm_[a-z]+|ref)=[^&]*", "")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(u, "/$", "").alias("clean"))


_SCANS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]+", "ipv4": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "phone": r"\+[0-9][0-9 -]{6,}[0-9]"}


@query("SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, '{p}'))::BIGINT AS {n}" for n, p in _SCANS.items()) + " FROM documents")
def str_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many addresses, hosts and numbers a text has."""
    found = [F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0))).cast("bigint").alias(n) for n, p in _SCANS.items()]
    return table(spark, sf_dir, "documents").select("doc_id", *found)


@query("""
WITH b AS (SELECT item_id, lower(trim(text)) AS t FROM benchmark)
SELECT doc_id, count(*) AS n_items, min(item_id) AS first_item FROM documents JOIN b ON contains(lower(text), t) GROUP BY doc_id
""")
def txt_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage: joined by the passage's first words' hashes, then verified.

    Passages of three to six words are joined by as many inner words as they have; those of one or two words, which have
    no inner one, are looked up in each text.
    """
    n = 5
    b = table(spark, sf_dir, "benchmark").select("item_id", F.lower(F.trim("text")).alias("t")).where("t is not null").withColumn("bw", F.split("t", " "))
    # the first and last word may stand inside longer ones, so whole words are hashed from the second to the last but one
    b = b.select("item_id", "t", "bw", F.least(F.lit(n), F.greatest(F.lit(0), F.size("bw") - 2)).alias("size"))
    sizes = sorted(r["size"] for r in b.select("size").distinct().collect())
    d = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("low")).withColumn("w", F.split("low", " "))
    grams = lambda k: F.transform("w", lambda _, i: F.xxhash64(F.concat_ws(" ", *(F.get("w", i + j) for j in range(k)))))
    hits = d.select("doc_id", "low").join(b.where("size = 0").select("item_id", "t"), F.contains("low", F.col("t"))).select("doc_id", "item_id").distinct() if 0 in sizes else None
    if any(sizes):
        long = b.where("size > 0").select("item_id", "t", F.xxhash64(F.array_join(F.slice("bw", F.lit(2), F.col("size")), " ")).alias("gram"))
        # ids alone meet the passages; only the texts of candidates are read again to be verified
        ids = d.withColumn("g", F.array_distinct(F.concat(*(grams(k) for k in sizes if k)))).select("doc_id", F.explode_outer("g").alias("gram"))
        candidates = ids.join(long, "gram").select("doc_id", "item_id", "t").distinct()
        found = d.select("doc_id", "low").join(candidates, "doc_id").where(F.contains("low", F.col("t"))).select("doc_id", "item_id").distinct()
        hits = found if hits is None else hits.unionAll(found).distinct()
    if hits is None:
        hits = d.join(b, F.lit(False)).select("doc_id", "item_id")
    return hits.groupBy("doc_id").agg(F.count("*").alias("n_items"), F.min("item_id").alias("first_item"))
