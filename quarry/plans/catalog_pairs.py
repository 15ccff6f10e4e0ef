"""Registered queries of curation: reasons, entity resolution, leak sets, mixes, checks, training rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import pairs
from quarry.plans.catalog import query, table

PRIORITY = ["src1", "src3", "src2"]
LANGUAGES = ["en", "de", "fr"]
EXCLUDED = {"src7": "license_no_rights"}
CUTOFF = "2024-06-01"

#: Pairs from documents; ids are shared by some, so that aliases chain.
_COLUMNS = [
    "'CVE-' || CAST(doc_id AS STRING) AS id", "source AS source", "CASE WHEN doc_id % 4 = 0 THEN 'GHSA-' ELSE 'x' END || CAST(doc_id AS STRING) AS source_id",
    "CASE WHEN doc_id % 31 > 0 THEN 'o/r' || CAST(doc_id % 97 AS STRING) END AS repo", "CASE WHEN doc_id % 62 > 0 THEN 'u' END AS repo_url", "CASE WHEN doc_id % 5 = 0 THEN 'o/c' || CAST(doc_id % 89 AS STRING) END AS repo_canonical",
    "CASE WHEN doc_id % 17 > 0 THEN 'sha' || CAST(doc_id % 211 AS STRING) END AS fix_sha", "CAST(NULL AS STRING) AS fix_sha_full", "CASE WHEN doc_id % 34 = 0 THEN doc_id END AS fix_pr", "CASE WHEN doc_id % 19 > 0 THEN lang END AS language",
    "CASE WHEN doc_id % 23 > 0 THEN '2024-0' || CAST(1 + doc_id % 7 AS STRING) || '-01' END AS advisory_published", "doc_id % 29 = 0 AS llm_assisted_labels", "doc_id % 37 = 0 AS heuristic_fix_link",
    "CASE WHEN doc_id % 41 = 0 THEN 'missing' ELSE 'ok' END AS repo_status", "CASE WHEN doc_id % 43 = 0 THEN 'error' WHEN doc_id % 47 = 0 THEN 'commit_missing' WHEN doc_id % 53 = 0 THEN NULL ELSE 'ok' END AS enrich_status",
    "CASE WHEN doc_id % 59 > 0 THEN '2024-0' || CAST(1 + doc_id % 6 AS STRING) || '-09' END AS fix_commit_date", "doc_id % 13 AS n_files_lang", "CASE WHEN doc_id % 11 > 0 THEN doc_id % 15 END AS n_files", "CASE WHEN doc_id % 6 = 0 THEN 'note' || CAST(doc_id AS STRING) END AS note",
]
_ALIASES = ["'CVE-' || CAST(doc_id AS STRING)", "'A' || CAST(doc_id - doc_id % 3 AS STRING)", "'B' || CAST(doc_id % 400 AS STRING)"]
_NAMES = [c.rsplit(" AS ", 1)[1] for c in _COLUMNS]


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrays = [f"CASE WHEN doc_id % 9 > 0 THEN array({', '.join(_ALIASES)}) END AS aliases", "array('CWE-' || CAST(doc_id % 90 + 20 AS STRING)) AS cwe", "array(named_struct('ecosystem', 'npm', 'name', 'p' || CAST(doc_id % 71 AS STRING))) AS packages"]
    return table(spark, sf_dir, "documents").selectExpr(*_COLUMNS, *arrays)


def _leaks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n = table(spark, sf_dir, "nation")
    return n.where("n_nationkey % 5 = 0").selectExpr("'o/r' || CAST(n_nationkey AS STRING) AS repo").unionAll(n.where("n_nationkey = 3").selectExpr("'o/c' || CAST(n_nationkey AS STRING)")), n.where("n_nationkey % 6 = 0").selectExpr("'npm' AS ecosystem", "'p' || CAST(n_nationkey AS STRING) AS name")


_P = f"p AS (SELECT doc_id, {', '.join(_COLUMNS)}, CASE WHEN doc_id % 9 > 0 THEN [{', '.join(_ALIASES)}] ELSE ['CVE-' || doc_id] END AS aliases, 'CWE-' || (doc_id % 90 + 20) AS cwe FROM documents)"
_LEAKS = "repos AS (SELECT 'o/r' || n_nationkey AS r FROM nation WHERE n_nationkey % 5 = 0 UNION ALL SELECT 'o/c3'), pk AS (SELECT n_nationkey AS k FROM nation WHERE n_nationkey % 6 = 0)"
_REASON = f"""CASE WHEN source = 'src7' THEN 'source_excluded:license_no_rights' WHEN llm_assisted_labels THEN 'llm_assisted_labels' WHEN heuristic_fix_link THEN 'heuristic_fix_link'
 WHEN repo IS NULL THEN CASE WHEN repo_url IS NULL THEN 'no_fix_commit' ELSE 'non_github_repo' END WHEN fix_sha IS NULL AND fix_pr IS NULL THEN 'no_fix_commit' WHEN language IS NULL THEN 'language_unknown'
 WHEN language NOT IN ('en', 'de', 'fr') THEN 'language_unsupported:' || language WHEN advisory_published IS NULL THEN 'advisory_date_missing' WHEN advisory_published >= '{CUTOFF}' THEN 'advisory_after_cutoff'
 WHEN repo IN (SELECT r FROM repos) OR repo_canonical IN (SELECT r FROM repos) THEN 'post_cutoff_repo' WHEN doc_id % 71 IN (SELECT k FROM pk) THEN 'post_cutoff_package' WHEN repo_status = 'missing' THEN 'repo_missing'
 WHEN fix_sha IS NULL THEN 'fix_pr_unresolved' WHEN enrich_status = 'commit_missing' THEN 'commit_missing' WHEN enrich_status = 'error' THEN 'enrich_error' WHEN coalesce(enrich_status, '') <> 'ok' THEN 'enrich_pending'
 WHEN fix_commit_date IS NULL THEN 'fix_date_missing' WHEN fix_commit_date >= '{CUTOFF}' THEN 'fix_after_cutoff' WHEN n_files_lang = 0 THEN 'no_source_files_in_language' END"""


@query(f"WITH {_P}, {_LEAKS} SELECT id, {_REASON} AS reason FROM p")
def prj10_row_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pair's first failing check."""
    d = pairs.with_leaks(_pairs(spark, sf_dir), *_leaks(spark, sf_dir))
    return d.select("id", pairs.row_reason(CUTOFF, LANGUAGES, EXCLUDED).alias("reason"))


_RESOLVED = f"""
 {_P}, {_LEAKS}, q AS (SELECT *, row_number() OVER (ORDER BY CASE source WHEN 'src1' THEN 0 WHEN 'src3' THEN 1 WHEN 'src2' THEN 2 ELSE 3 END, CASE WHEN starts_with(source_id, 'GHSA-') THEN 0 ELSE 1 END, id, source_id) AS rk, {_REASON} AS reason FROM p),
 ok AS (SELECT * FROM q WHERE reason IS NULL), al AS (SELECT rk, unnest(aliases) AS alias FROM ok),
 reach(a, b) AS (SELECT rk, rk FROM ok UNION SELECT r.a, y.rk FROM reach r JOIN al x ON x.rk = r.b JOIN al y ON y.alias = x.alias),
 comp AS (SELECT a AS rk, min(b) AS first FROM reach GROUP BY 1),
 s AS (SELECT c.first, list_sort(list_distinct(flatten(list(aliases)))) AS aliases, array_to_string(list_transform(list_sort(list(DISTINCT cwe[5:]::INT)), lambda x: 'CWE-' || x), ',') AS cwe, min(advisory_published) AS advisory_published, string_agg(source || ':' || source_id, ',' ORDER BY ok.rk) AS sources,
   arg_min(note, ok.rk) FILTER (note IS NOT NULL) AS note, arg_min(source || ':' || source_id, ok.rk) FILTER (note IS NOT NULL) AS note_by FROM comp c JOIN ok USING (rk) GROUP BY 1),
 t AS (SELECT s.first, f.id, s.aliases, s.cwe, s.advisory_published, s.sources, s.note, CASE WHEN f.note IS NULL THEN s.note_by END AS note_from, f.n_files, f.source, f.source_id,
   row_number() OVER (PARTITION BY coalesce(f.repo_canonical, f.repo), f.fix_sha ORDER BY f.rk) AS n, first(f.id) OVER (PARTITION BY coalesce(f.repo_canonical, f.repo), f.fix_sha ORDER BY f.rk) AS same FROM s JOIN ok f ON f.rk = s.first)
"""


@query(f"WITH RECURSIVE {_RESOLVED} SELECT id, array_to_string(aliases, ',') AS aliases, cwe, advisory_published, sources, note, note_from FROM t WHERE n = 1 AND n_files <= 10")
def cur03_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that pass all checks, resolved over aliases and commits, with what they take over from duplicates."""
    kept, _ = pairs.keep(_pairs(spark, sf_dir), *_leaks(spark, sf_dir), PRIORITY, CUTOFF, LANGUAGES, EXCLUDED, annotations=["note"])
    joined = lambda c: F.array_join(c, ",").alias(c)
    return kept.select("id", joined("aliases"), joined("cwe"), "advisory_published", joined("sources"), "note", "note_from")


@query(f"""
WITH RECURSIVE {_RESOLVED} SELECT id, reason FROM q WHERE reason IS NOT NULL UNION ALL SELECT ok.id, 'duplicate_alias:' || f.id FROM ok JOIN comp USING (rk) JOIN ok f ON f.rk = comp.first WHERE ok.rk <> comp.first
UNION ALL SELECT id, 'duplicate_commit:' || same FROM t WHERE n > 1 UNION ALL SELECT id, CASE WHEN n_files IS NULL THEN 'files_unknown' ELSE 'too_many_files' END FROM t WHERE n = 1 AND (n_files IS NULL OR n_files > 10)
""")
def cur04_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dropped pairs with the reason, the duplicate's survivor among them."""
    _, dropped = pairs.keep(_pairs(spark, sf_dir), *_leaks(spark, sf_dir), PRIORITY, CUTOFF, LANGUAGES, EXCLUDED, annotations=["note"])
    return dropped.select("id", "reason")


@query("""
WITH a AS (SELECT CASE WHEN page_id % 5 = 0 THEN 'MAL-' ELSE 'GHSA-' END || page_id AS id, '2024-0' || (1 + page_id % 9) AS published, 'o' || page_id % 30 || '/r' AS repo, page_id % 3 = 0 AS fix, 'p' || page_id % 40 AS p FROM pages), l AS (SELECT * FROM a WHERE published >= '2024-06')
SELECT 'repo' AS kind, repo AS name FROM l GROUP BY 2 UNION ALL SELECT 'fix', repo FROM l WHERE fix GROUP BY 2 UNION ALL SELECT 'package', p FROM l GROUP BY 2 UNION ALL SELECT 'malware', repo FROM l GROUP BY 2 HAVING bool_and(starts_with(id, 'MAL-'))
""")
def cur02_leak_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories, fix repositories, packages and malware repositories of late advisories."""
    url = "'https://github.com/O' || CAST(page_id % 30 AS STRING) || '/r.git'"
    a = table(spark, sf_dir, "pages").selectExpr("CASE WHEN page_id % 5 = 0 THEN 'MAL-' ELSE 'GHSA-' END || CAST(page_id AS STRING) AS id", "'2024-0' || CAST(1 + page_id % 9 AS STRING) AS published", f"array({url}, 'https://x.org/y') AS refs", f"CASE WHEN page_id % 3 = 0 THEN array({url}) ELSE array() END AS fix_refs", "array(named_struct('ecosystem', 'npm', 'name', 'p' || CAST(page_id % 40 AS STRING))) AS packages")
    repos, fix, packages, malware = pairs.leak_sets(a, "2024-06")
    parts = [repos.select(F.lit("repo").alias("kind"), F.col("repo").alias("name")), fix.select(F.lit("fix"), "repo"), packages.select(F.lit("package"), "name"), malware.select(F.lit("malware"), "repo")]
    return reduce(DataFrame.unionAll, parts)


@query("""
WITH p AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 > 0 THEN '2020' END AS published, ['a' || (o_orderkey % 500), 'b' || (o_custkey % 300)] AS aliases FROM orders), d AS (SELECT 'a' || c_custkey AS alias, '1' || c_custkey % 70 AS published FROM customer WHERE c_custkey % 4 = 0 UNION ALL SELECT 'b' || s_suppkey, '0' || s_suppkey FROM supplier),
 f AS (SELECT id, min(d.published) AS f FROM (SELECT id, unnest(aliases) AS alias FROM p WHERE published IS NULL) x JOIN d USING (alias) GROUP BY 1)
SELECT p.id, coalesce(published, f) AS advisory_published FROM p LEFT JOIN f ON f.id = p.id
""")
def jo17_alias_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing dates from the earliest of all aliases."""
    p = table(spark, sf_dir, "orders").selectExpr("CAST(o_orderkey AS STRING) AS id", "CASE WHEN o_orderkey % 3 > 0 THEN '2020' END AS advisory_published", "array('a' || CAST(o_orderkey % 500 AS STRING), 'b' || CAST(o_custkey % 300 AS STRING)) AS aliases")
    d = table(spark, sf_dir, "customer").where("c_custkey % 4 = 0").selectExpr("'a' || CAST(c_custkey AS STRING) AS alias", "'1' || CAST(c_custkey % 70 AS STRING) AS published").unionAll(table(spark, sf_dir, "supplier").selectExpr("'b' || CAST(s_suppkey AS STRING)", "'0' || CAST(s_suppkey AS STRING)"))
    return pairs.fill_dates(p, d).select(F.col("id").cast("bigint").alias("id"), "advisory_published")


@query("""
WITH p AS (SELECT DISTINCT o_custkey % 100 AS repo, o_orderkey % 50 AS sha FROM orders), c AS (SELECT c_custkey % 100 AS repo, c_nationkey AS sha, CASE c_custkey % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'error' ELSE 'missing' END AS status FROM customer)
SELECT repo, sha FROM p WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.repo = p.repo AND c.sha = p.sha AND status <> 'error')
""")
def cur05_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits that still have to be fetched."""
    p = table(spark, sf_dir, "orders").selectExpr("o_custkey % 100 AS repo", "o_orderkey % 50 AS sha")
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey % 100 AS repo", "c_nationkey AS sha", "CASE c_custkey % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'error' ELSE 'missing' END AS status")
    return pairs.todo(p, c)


@query("SELECT 'r' || c_nationkey AS repo, arg_min('R' || c_custkey % 7, c_custkey) AS canonical FROM customer WHERE c_custkey % 5 > 0 GROUP BY 1")
def cur05_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first canonical name that a repository was found under."""
    d = table(spark, sf_dir, "customer").selectExpr("c_custkey AS seq", "'R' || CAST(c_nationkey AS STRING) AS repo", "CASE WHEN c_custkey % 5 > 0 THEN 'R' || CAST(c_custkey % 7 AS STRING) END AS canonical")
    return pairs.canonical_repos(d)


@query("""
WITH h AS (SELECT lang, count(*) AS n FROM documents WHERE lang IN ('en', 'de', 'fr') GROUP BY 1), s AS (SELECT lang, n, CASE lang WHEN 'en' THEN 0.5::DOUBLE WHEN 'de' THEN 0.3::DOUBLE ELSE 0.4::DOUBLE END AS share FROM h),
 w AS (SELECT lang, round_even(share / 1.2::DOUBLE * 150, 0) AS want FROM s), r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('mix:' || doc_id), doc_id) AS k FROM documents)
SELECT lang, doc_id FROM r JOIN w USING (lang) WHERE k <= want
""")
def cur18_mix_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """150 documents by shares that are renormalised; a short language is taken whole."""
    d = table(spark, sf_dir, "documents").select("lang", "doc_id")
    return pairs.mix(d, "lang", {"en": 0.5, "de": 0.3, "fr": 0.4, "xx": 2.0}, 150, [F.sha2(F.concat(F.lit("mix:"), F.col("doc_id").cast("string")), 256), F.col("doc_id")])


@query("SELECT o_custkey AS pair_id, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS splits FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def cur20_split_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that stand in several splits."""
    d = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").selectExpr("o_custkey AS pair_id", "o_orderstatus AS split")
    return pairs.split_conflicts(d).select("pair_id", F.array_join("splits", ",").alias("splits"))


@query("""
WITH r AS (SELECT c_custkey % 1000 AS id, c_acctbal AS a, c_mktsegment AS s FROM customer) SELECT id, 'no balance' AS error FROM r WHERE a < 0 UNION ALL SELECT id, 'bad segment: ' || s FROM r WHERE s IN ('BUILDING', 'MACHINERY') UNION ALL SELECT id, 'stands ' || count(*) || ' times' FROM r GROUP BY id HAVING count(*) > 1
""")
def cur23_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rows of a manifest fail, in words."""
    r = table(spark, sf_dir, "customer").selectExpr("c_custkey % 1000 AS id", "c_acctbal AS a", "c_mktsegment AS s")
    return pairs.row_errors(r, "id", [(F.col("a") < 0, F.lit("no balance")), (F.col("s").isin("BUILDING", "MACHINERY"), F.concat(F.lit("bad segment: "), "s"))])


@query("""
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'excluded' WHEN c_nationkey < 5 THEN 'control' WHEN c_mktsegment = 'BUILDING' THEN 'scale' ELSE 'headline' END AS tier,
 array_to_string(list_filter([CASE WHEN c_acctbal < 0 THEN 'debt' END, CASE WHEN c_nationkey < 5 THEN 'near' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'large' END], lambda x: x IS NOT NULL), ',') AS reasons FROM customer
""")
def prj11_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's tier and all reasons for it."""
    tier, why = pairs.tiers([("debt", F.col("c_acctbal") < 0, "excluded"), ("near", F.col("c_nationkey") < 5, "control"), ("large", F.col("c_mktsegment") == "BUILDING", "scale")])
    return table(spark, sf_dir, "customer").select("c_custkey", tier.alias("tier"), F.array_join(why, ",").alias("reasons"))


@query("""
SELECT id, seq, n FROM (SELECT o_custkey AS id, o_orderkey AS seq, 1 + o_orderkey % 4 AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 4, o_orderkey) AS k FROM orders WHERE o_orderstatus = 'F') WHERE k = 1
""")
def cur24_rollout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest passing trace of each case, the first on ties."""
    r = table(spark, sf_dir, "orders").selectExpr("o_custkey AS id", "o_orderkey AS seq", "sequence(0, CAST(o_orderkey % 4 AS INT)) AS trace", "o_orderstatus = 'F' AS passes")
    return pairs.shortest_passing(r, ["id"]).select("id", "seq", F.size("trace").cast("bigint").alias("n"))


@query("""
WITH t AS (SELECT * FROM (SELECT o_orderkey AS seq, o_custkey AS pair_id, CASE o_orderstatus WHEN 'F' THEN 'vulnerable' WHEN 'O' THEN 'patched' ELSE 'negative' END AS label, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey END AS fix_site FROM orders WHERE o_orderkey % 5 > 0) WHERE label <> 'negative'),
 g AS (SELECT pair_id, max(seq) FILTER (label = 'vulnerable') AS v, max(seq) FILTER (label = 'patched') AS p, arg_max(CASE WHEN fix_site IS NULL THEN -1 ELSE fix_site END, seq) FILTER (label = 'vulnerable') AS f FROM t GROUP BY 1)
SELECT pair_id, CASE WHEN v IS NULL OR p IS NULL THEN 'unpaired' WHEN f = -1 THEN 'no_fix_site' ELSE 'pair' END AS state FROM g
""")
def hlp14_rollout_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with both sides and a fix site; the others with why they are skipped."""
    t = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS seq", "o_custkey AS pair_id", "CASE WHEN o_orderkey % 5 > 0 THEN 'train' ELSE 'dev' END AS split", "CASE o_orderstatus WHEN 'F' THEN 'vulnerable' WHEN 'O' THEN 'patched' ELSE 'negative' END AS label", "CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey END AS fix_site")
    good, skipped = pairs.rollout_pairs(t)
    return good.select("pair_id", F.lit("pair").alias("state")).unionAll(skipped.select("pair_id", "reason"))


@query("""
SELECT id, language, turn FROM (SELECT 'CVE-' || doc_id AS id, lang AS language, row_number() OVER (PARTITION BY lang ORDER BY CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 1 END, sha256('7:CVE-' || doc_id), 'CVE-' || doc_id) AS turn FROM documents WHERE n_chars > 300) WHERE turn <= 20
""")
def hlp11_select_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty eligible pairs of each language, dataflow ones first."""
    d = table(spark, sf_dir, "documents").selectExpr("'CVE-' || CAST(doc_id AS STRING) AS id", "lang AS language", "n_chars", "doc_id % 4 = 0 AS flow")
    return pairs.eligible(d, [F.col("n_chars") > 300], 20, 7, F.col("flow")).select("id", "language", F.col("turn").cast("bigint").alias("turn"))


@query("""
WITH t AS (SELECT DISTINCT o_custkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'vulnerable' ELSE 'patched' END AS kind, o_orderkey AS span_id FROM orders WHERE o_orderkey % 7 = 0), o AS (SELECT DISTINCT o_custkey AS id, o_orderkey AS span_id FROM orders WHERE o_orderkey % 5 < 3)
SELECT id, kind, span_id FROM t UNION ALL SELECT id, 'negative', span_id FROM (SELECT id, span_id, row_number() OVER (PARTITION BY id ORDER BY sha256('1:' || id || ':' || span_id), span_id) AS k FROM o WHERE (id, span_id) NOT IN (SELECT id, span_id FROM t)) WHERE k <= 2
""")
def cur10_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets as cases, and two other spans of each pair as negatives."""
    o = table(spark, sf_dir, "orders")
    t = o.where("o_orderkey % 7 = 0").selectExpr("o_custkey AS id", "CASE WHEN o_orderkey % 2 = 0 THEN 'old' ELSE 'new' END AS side", "o_orderkey AS span_id")
    return pairs.cases(t, o.where("o_orderkey % 5 < 3").selectExpr("o_custkey AS id", "o_orderkey AS span_id"), 2, 1)


@query("""
WITH a AS (SELECT conv_id, list(text ORDER BY turn) AS ts FROM conversations GROUP BY 1), r AS (SELECT conv_id, unnest(range(0, (len(ts) + 1) // 2)) AS step, ts FROM a)
SELECT conv_id, step, array_to_string(['start'] || ts[1:2 * step], chr(10)) AS history, ts[2 * step + 1] AS target FROM r
""")
def cur19_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each action of a trace with the conversation before it."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("ts"))
    every = lambda k: F.filter("ts", lambda x, i: i % 2 == k)
    odd = F.size("ts") % 2 == 1
    t = c.select(F.col("conv_id").alias("trace_id"), F.lit("start").alias("start"), every(0).alias("actions"), F.when(odd, every(1)).otherwise(F.slice(every(1), F.lit(1), F.greatest(F.size(every(1)) - 1, F.lit(0)))).alias("results"))
    return pairs.steps(t).select(F.col("trace_id").alias("conv_id"), F.col("step").cast("bigint").alias("step"), F.array_join("history", "\n").alias("history"), "target")


@query("SELECT doc_id, n, array_to_string(list_transform(range(0, least(n, 6)), lambda i: CASE WHEN i < 2 THEN -100 ELSE i END), ',') AS labels FROM (SELECT doc_id, len(string_split(text, ' '))::BIGINT AS n FROM documents) WHERE n <= 300")
def cur21_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that fit a length, with the prompt's tokens masked."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.size(F.split("text", " ")).cast("bigint").alias("n"))
    short, _ = pairs.fitting(d, F.col("n"), 300)
    ids = F.sequence(F.lit(0), F.least(F.col("n"), F.lit(6)).cast("int") - 1)
    return short.select("doc_id", "n", F.array_join(pairs.label_mask(ids, F.lit(2)), ",").alias("labels"))
