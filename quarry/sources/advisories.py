"""Advisories and datasets of fixes as rows of one form: OSV archives, dumps of six tables, CSV and JSON datasets, logs.

A row: source, source_id, aliases, repo, repo_url, fix_shas, fix_sha (the first), fix_pr, cwe, language, advisory_published,
packages.  Archives of JSON members are read member by member, each a row.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.code import commit_of, cwes, github_repo, is_test_path, pull_of
from quarry.operators.codeindex import exploit_documents

# Languages by ecosystem and by ending of a file.
ECOSYSTEMS = {"npm": "js", "pypi": "py", "maven": "java", "go": "go"}
ENDINGS = {"js": "js", "jsx": "js", "ts": "js", "tsx": "js", "mjs": "js", "cjs": "js", "py": "py", "java": "java", "go": "go"}
# The score of links that an advisory names itself, and the least of others.
DIRECT, LEAST_SCORE = 1337, 65

ROW = "source string, source_id string, aliases array<string>, repo string, repo_url string, fix_shas array<string>, fix_sha string, fix_pr bigint, cwe array<string>, language string, advisory_published string, packages array<struct<ecosystem:string,name:string>>"


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[key]


def day(text: Column) -> Column:
    """The UTC date of a time stamp in any zone, as text; null if it is none."""
    return F.date_format(F.to_utc_timestamp(F.try_to_timestamp(text), F.current_timezone()), "yyyy-MM-dd")


def file_language(path: Column) -> Column:
    return _lookup(ENDINGS, F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1)))


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, name, value): the JSON members of zip archives; an archive is read in one task, its members one by one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            for archive, content in zip(d["path"], d["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        if name.endswith(".json"):
                            yield pd.DataFrame({"archive": [archive], "name": [name], "value": [z.read(name).decode("utf-8", "replace")]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, name string, value string")


_OSV = """struct<id:string,withdrawn:string,published:string,aliases:array<string>,affected:array<struct<package:struct<ecosystem:string,name:string>,
 ranges:array<struct<type:string,repo:string,events:array<struct<introduced:string,fixed:string>>>>>>,references:array<struct<type:string,url:string>>,database_specific:struct<cwe_ids:array<string>>>"""
_SHA = "^[0-9a-f]{7,40}$"


def osv_rows(members: DataFrame, ecosystem: str | None = None) -> DataFrame:
    """Rows of OSV advisories (name, value): no malware, none withdrawn.

    The fix is, of the commits of git ranges, then of references typed FIX, then of the others, all those in the first
    one's repository; without any the first pull request, typed ones first.
    """
    d = members.where(~F.element_at(F.split("name", "/"), -1).startswith("MAL-")).select(F.from_json("value", _OSV).alias("d")).select("d.*").where("id is not null and withdrawn is null")
    none = lambda c, t: F.coalesce(c, F.array().cast(t))
    d = d.withColumns({"affected": none("affected", d.schema["affected"].dataType), "references": none("references", d.schema["references"].dataType)})
    ranges = F.flatten(F.transform("affected", lambda a: F.coalesce(F.filter(a["ranges"], lambda r: r["type"] == "GIT"), F.array())))
    found = lambda repo, sha: F.struct(repo.alias("repo"), F.lower(sha).alias("sha"))
    ranged = F.flatten(F.transform(ranges, lambda r: F.transform(F.filter(F.coalesce(r["events"], F.array()), lambda e: e["fixed"].isNotNull()), lambda e: found(github_repo(r["repo"]), e["fixed"]))))
    refs = F.concat(F.filter("references", lambda r: r["type"] == "FIX"), F.filter("references", lambda r: ~r["type"].eqNullSafe("FIX")))
    linked = F.transform(refs, lambda r: found(github_repo(r["url"]), commit_of(r["url"])))
    every = F.filter(F.concat(ranged, linked), lambda x: x["repo"].isNotNull() & x["sha"].rlike(_SHA))
    pulls = F.filter(F.transform(refs, lambda r: F.struct(github_repo(r["url"]).alias("repo"), pull_of(r["url"]).alias("pr"))), lambda x: x["repo"].isNotNull() & x["pr"].isNotNull())
    elsewhere = F.filter(F.transform(ranges, lambda r: F.when(github_repo(r["repo"]).isNull(), r["repo"])), lambda x: x.isNotNull())
    package = F.transform(F.filter("affected", lambda a: a["package"].isNotNull()), lambda a: F.struct(F.lower(F.coalesce(a["package"]["ecosystem"], F.lit(""))).alias("ecosystem"), F.lower(F.coalesce(a["package"]["name"], F.lit(""))).alias("name")))
    d = d.select("id", "published", "aliases", package.alias("ps"), every.alias("fixes"), pulls.alias("pulls"), elsewhere.alias("other"), F.col("database_specific.cwe_ids").alias("cwe"))
    names = F.transform("ps", lambda p: p["ecosystem"])
    known = F.filter(names, lambda e: e.isin(*ECOSYSTEMS))
    first = lambda xs: F.try_element_at(xs, F.lit(1))
    own = F.coalesce(F.when(F.array_contains(names, (ecosystem or "").lower()), F.lit((ecosystem or "").lower())), first(known), first(names), F.lit(""))
    d = d.withColumn("eco", own).withColumn("fix", first(F.col("fixes"))).withColumn("pull", F.when(F.size("fixes") == 0, first(F.col("pulls"))))
    shas = F.array_distinct(F.transform(F.filter("fixes", lambda x: x["repo"] == F.col("fix.repo")), lambda x: x["sha"]))
    number = F.expr("array_sort(array_distinct(coalesce(cwe, array())), (l, r) -> int(substr(l, 5)) - int(substr(r, 5)))")
    repo = F.coalesce("fix.repo", "pull.repo")
    return d.select(
        F.concat(F.lit("osv-"), "eco").alias("source"), F.col("id").alias("source_id"), none("aliases", "array<string>").alias("aliases"), repo.alias("repo"), F.when(repo.isNull(), first(F.col("other"))).alias("repo_url"), shas.alias("fix_shas"),
        first(shas).alias("fix_sha"), F.col("pull.pr").alias("fix_pr"), number.alias("cwe"), F.coalesce(_lookup(ECOSYSTEMS, F.col("eco")), F.nullif("eco", F.lit(""))).alias("language"), day(F.col("published")).alias("advisory_published"), F.array_sort(F.array_distinct("ps")).alias("packages"),
    )


def assembled(fixes: DataFrame, commits: DataFrame, files: DataFrame, cves: DataFrame, weaknesses: DataFrame, source: str, scored: bool = False, least: int = LEAST_SCORE) -> DataFrame:
    """Rows of six-table datasets, one for each (cve_id, repo_url) of fixes (cve_id, hash, repo_url and, if scored, score).

    Commits (hash, repo_url, author_date, committer_date) stand by their later date, those without one last; the first is
    the fix.  Scored links count if an advisory names them or, where none does, from the least score on.  Adds
    fix_commit_date, enrich_status, n_files (without tests; files: hash, path), heuristic_fix_link; language is that of the
    fix's files if they have one, mixed if more.
    """
    date = F.greatest(day(F.col("author_date")), day(F.col("committer_date")))
    c = commits.select("hash", "repo_url", date.alias("date"), F.lit(True).alias("known")).dropDuplicates(["hash", "repo_url"])
    key = ["cve_id", "repo_url"]
    f = fixes
    if scored:
        direct = F.max(F.coalesce(F.col("score") == DIRECT, F.lit(False))).over(Window.partitionBy(*key))
        f = f.withColumn("direct", direct).where(F.when(F.col("direct"), F.col("score") == DIRECT).otherwise(F.col("score") >= least))
    else:
        f = f.withColumn("direct", F.lit(True))
    f = f.select(*key, "hash", "direct").distinct().join(c, ["hash", "repo_url"], "left")
    g = f.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("date", F.lit("9999")).alias("at"), "hash", "date", "known"))).alias("cs"), F.bool_and("direct").alias("direct"))
    g = g.withColumn("fix", F.get("cs", F.lit(0)))
    changed = files.select("hash", "path").withColumn("test", is_test_path(F.col("path"))).where("not test")
    sizes = changed.groupBy("hash").agg(F.count("*").alias("n_files"), F.collect_set(file_language(F.col("path"))).alias("langs"))
    all_files = files.groupBy("hash").agg(F.count("*").alias("n_files_total"))
    n = all_files.join(sizes, "hash", "left").select(F.col("hash").alias("fix_sha"), F.coalesce("n_files", F.lit(0)).alias("n_files"), "langs")
    dates = cves.groupBy("cve_id").agg(F.min(day(F.col("published_date"))).alias("advisory_published"))
    weak = weaknesses.groupBy("cve_id").agg(F.array_sort(F.collect_set("cwe_id")).alias("cwe"))
    d = g.withColumn("fix_sha", F.col("fix.hash")).join(n, "fix_sha", "left").join(dates, "cve_id", "left").join(weak, "cve_id", "left")
    repo = github_repo(F.col("repo_url"))
    known = F.coalesce("fix.known", F.lit(False))
    language = F.when(F.size("langs") == 1, F.get("langs", F.lit(0))).when(F.size("langs") > 1, "mixed")
    return d.select(
        F.lit(source).alias("source"), F.col("cve_id").alias("source_id"), F.array("cve_id").alias("aliases"), repo.alias("repo"), F.when(repo.isNull(), F.col("repo_url")).alias("repo_url"), F.transform("cs", lambda x: x["hash"]).alias("fix_shas"), "fix_sha",
        F.lit(None).cast("bigint").alias("fix_pr"), F.coalesce("cwe", F.array().cast("array<string>")).alias("cwe"), language.alias("language"), "advisory_published", F.array().cast("array<struct<ecosystem:string,name:string>>").alias("packages"),
        F.when(known, F.col("fix.date")).alias("fix_commit_date"), F.when(known, "ok").alias("enrich_status"), F.when(known, F.col("n_files")).alias("n_files"), (~F.col("direct")).alias("heuristic_fix_link"),
    )


def by_slug_or_cve(projects: DataFrame, details: DataFrame, name: str) -> DataFrame:
    """projects (slug, cve_id) with `name`, the details (slug, cve_id, ...) of their slug or, without any, of their CVE."""
    item = F.struct(*(c for c in details.columns if c not in ("slug", "cve_id")))
    by = lambda k: details.where(F.coalesce(k, F.lit("")) != "").groupBy(F.col(k).alias(f"__{k}")).agg(F.array_sort(F.collect_list(item)).alias(f"__by_{k}"))
    d = projects.join(by("slug"), F.col("slug") == F.col("__slug"), "left").join(by("cve_id"), F.col("cve_id") == F.col("__cve_id"), "left")
    return d.withColumn(name, F.coalesce("__by_slug", "__by_cve_id")).drop("__slug", "__cve_id", "__by_slug", "__by_cve_id")


def fix_of_links(urls: Column) -> Column:
    """Struct (repo, shas, pr) of a list of links: commits of the first commit's repository, else the first pull request, else
    the first repository."""
    commits = F.filter(F.transform(urls, lambda u: F.struct(github_repo(u).alias("repo"), commit_of(u).alias("sha"))), lambda x: x["repo"].isNotNull() & x["sha"].isNotNull())
    pulls = F.filter(F.transform(urls, lambda u: F.struct(github_repo(u).alias("repo"), pull_of(u).alias("pr"))), lambda x: x["repo"].isNotNull() & x["pr"].isNotNull())
    repos = F.filter(F.transform(urls, github_repo), lambda x: x.isNotNull())
    first = lambda xs: F.try_element_at(xs, F.lit(1))
    repo = F.coalesce(first(commits)["repo"], first(pulls)["repo"], first(repos))
    shas = F.transform(F.filter(commits, lambda x: x["repo"] == first(commits)["repo"]), lambda x: x["sha"])
    return F.struct(repo.alias("repo"), shas.alias("shas"), F.when(F.size(commits) == 0, first(pulls)["pr"]).alias("pr"))


def normalised(d: DataFrame, source: str, source_id: Column, links: Column, aliases: Column, weakness: Column, language: Column | None = None, published: Column | None = None, packages: Column | None = None) -> DataFrame:
    """Rows of one dataset from expressions over its own columns: links, aliases and weakness texts are arrays."""
    fix = fix_of_links(links)
    first = lambda xs: F.try_element_at(xs, F.lit(1))
    none = F.array().cast("array<struct<ecosystem:string,name:string>>")
    return d.select(
        F.lit(source).alias("source"), source_id.cast("string").alias("source_id"), F.array_distinct(F.array_compact(aliases)).alias("aliases"), fix["repo"].alias("repo"), F.when(fix["repo"].isNull(), first(links)).alias("repo_url"), fix["shas"].alias("fix_shas"),
        first(fix["shas"]).alias("fix_sha"), fix["pr"].alias("fix_pr"), cwes(F.array_join(weakness, " ")).alias("cwe"), (F.lit(None).cast("string") if language is None else language).alias("language"), (F.lit(None).cast("string") if published is None else day(published)).alias("advisory_published"),
        (none if packages is None else packages).alias("packages"),
    )


def grouped(rows: DataFrame) -> DataFrame:
    """Rows of one commit each as rows of one source_id and repository: commits in their order, weaknesses and aliases united."""
    united = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    key = ["source", "source_id", "repo"]
    g = rows.groupBy(*key).agg(F.min("repo_url").alias("repo_url"), united("aliases").alias("aliases"), united("fix_shas").alias("fix_shas"), F.min("fix_pr").alias("fix_pr"), united("cwe").alias("cwe"), F.max("language").alias("language"), F.min("advisory_published").alias("advisory_published"), united("packages").alias("packages"))
    return g.withColumn("fix_sha", F.try_element_at("fix_shas", F.lit(1))).select(*rows.columns)


def collected(sources: list[DataFrame]) -> DataFrame:
    """All sources' rows in one table, with nulls for columns that a source lacks."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


_EVENT = "struct<type:string,model:string,total_cost_usd:double,num_turns:bigint,usage:struct<input_tokens:bigint,output_tokens:bigint,cache_creation_input_tokens:bigint,cache_read_input_tokens:bigint,cache_creation:struct<ephemeral_5m_input_tokens:bigint,ephemeral_1h_input_tokens:bigint>>>"


def agent_usage(log: DataFrame) -> DataFrame:
    """(run_id, n_events, model, tokens ..., total_cost_usd, num_turns): a log's (run_id, seq, line) readable events and what its
    last result says; what isn't said is null, never 0."""
    d = log.select("run_id", "seq", F.try_parse_json(F.trim("line")).alias("v"), F.from_json("line", _EVENT).alias("e")).where("v is not null")
    final = F.when(F.col("e.type") == "result", F.col("seq"))
    g = d.groupBy("run_id").agg(F.count("*").alias("n_events"), F.max_by(F.when(F.col("e.type") == "result", F.col("e")), final).alias("r"))
    u = "r.usage."
    return g.select(
        "run_id", "n_events", F.when(F.col("r").isNotNull(), F.coalesce("r.model", F.lit(""))).alias("model"), *(F.col(u + c).alias(c) for c in ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")),
        F.col(u + "cache_creation.ephemeral_5m_input_tokens").alias("write_5m"), F.col(u + "cache_creation.ephemeral_1h_input_tokens").alias("write_1h"), "r.total_cost_usd", "r.num_turns",
    )


def allowed(rows: DataFrame, sources: list[str], column: str = "data_source") -> tuple[DataFrame, DataFrame]:
    """(rows of the sources, counts by source: kept, dropped); rows without a source are dropped."""
    ok = F.coalesce(F.col(column).isin(*sources), F.lit(False))
    return rows.where(ok), rows.groupBy(column).agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("dropped"))


def module_documents(metadata: DataFrame, kinds: list[str], with_cve: bool = False) -> DataFrame:
    """(name, cves, text, kind) of metadata files (value: one JSON object of records by name): records of the kinds, those that
    name an advisory only if asked for."""
    record = "map<string,struct<type:string,name:string,description:string,references:array<string>>>"
    d = metadata.select(F.explode(F.from_json("value", record)).alias("name", "r")).where(F.col("r.type").isin(*kinds))
    d = d.select("name", F.col("r.type").alias("kind"), F.col("r.name").alias("title"), F.col("r.description").alias("description"), F.array_join("r.references", " ").alias("refs"))
    e = exploit_documents(d, ["title", "description", "refs"]).join(d.select("name", "kind"), "name")
    return e.where(F.size("cves") > 0) if with_cve else e
