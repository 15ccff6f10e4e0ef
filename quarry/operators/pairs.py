"""Curation of vulnerability-fix pairs: reasons to drop a row, entity resolution over aliases, leak sets, dates, mixes, checks.

A pair is a row with id, source, source_id, repo, fix_sha and what else the checks below name; aliases, cwe, packages are
arrays.  Leak sets are tables, joined, not sent.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.code import github_repo
from quarry.operators.components import connected_components
from quarry.plans.cut import cut


def row_reason(cutoff: str, languages: list[str], excluded: dict[str, str], allow: frozenset[str] = frozenset(), before_enrichment: bool = False) -> Column:
    """The first check that a pair fails, else null.  Flags leaked_repo and leaked_package come from with_leaks().

    excluded: source -> why; allow: names among unknown_language, llm_assisted, heuristic_fix whose checks are left out;
    before_enrichment: only the checks that need nothing fetched.
    """
    c, said = F.col, F.coalesce
    given = lambda x: said(c(x).cast("string"), F.lit("")) != ""
    flag = lambda x: said(c(x), F.lit(False))
    checks = [(c("source") == s, F.lit(f"source_excluded:{why}")) for s, why in excluded.items()]
    if "llm_assisted" not in allow:
        checks.append((flag("llm_assisted_labels"), F.lit("llm_assisted_labels")))
    if "heuristic_fix" not in allow:
        checks.append((flag("heuristic_fix_link"), F.lit("heuristic_fix_link")))
    checks += [(~given("repo"), F.when(given("repo_url"), "non_github_repo").otherwise("no_fix_commit")), (~given("fix_sha") & ~given("fix_pr"), F.lit("no_fix_commit"))]
    if "unknown_language" not in allow:
        checks.append((c("language").isNull(), F.lit("language_unknown")))
    checks += [
        (c("language").isNotNull() & ~c("language").isin(*languages), F.concat(F.lit("language_unsupported:"), "language")),
        (~given("advisory_published"), F.lit("advisory_date_missing")),
        (c("advisory_published") >= cutoff, F.lit("advisory_after_cutoff")),
        (flag("leaked_repo"), F.lit("post_cutoff_repo")),
        (flag("leaked_package"), F.lit("post_cutoff_package")),
    ]
    if not before_enrichment:
        status = said(c("enrich_status"), F.lit(""))
        checks += [
            (said(c("repo_status"), F.lit("")) == "missing", F.lit("repo_missing")),
            (~given("fix_sha"), F.lit("fix_pr_unresolved")),
            (status == "commit_missing", F.lit("commit_missing")),
            (status == "error", F.lit("enrich_error")),
            (status != "ok", F.lit("enrich_pending")),
            (~given("fix_commit_date"), F.lit("fix_date_missing")),
            (c("fix_commit_date") >= cutoff, F.lit("fix_after_cutoff")),
            (said(c("n_files_lang") == 0, F.lit(False)), F.lit("no_source_files_in_language")),
        ]
    return F.coalesce(*(F.when(said(fails, F.lit(False)), why) for fails, why in checks))


def with_leaks(pairs: DataFrame, repos: DataFrame, packages: DataFrame) -> DataFrame:
    """pairs with leaked_repo, if repos (repo) has their repository or its canonical name, and leaked_package, if packages
    (ecosystem, name) has one of theirs."""
    d = pairs.withColumn("__row", F.struct("id", "source", "source_id"))
    names = d.select("__row", F.explode(F.array_distinct(F.filter(F.array("repo", "repo_canonical"), lambda x: x.isNotNull()))).alias("repo"))
    bad = names.join(repos.select("repo").distinct(), "repo").select("__row").distinct().withColumn("leaked_repo", F.lit(True))
    used = d.select("__row", F.explode("packages").alias("p")).select("__row", "p.ecosystem", "p.name")
    leaked = used.join(packages.select("ecosystem", "name").distinct(), ["ecosystem", "name"]).select("__row").distinct().withColumn("leaked_package", F.lit(True))
    d = d.join(bad, "__row", "left").join(leaked, "__row", "left").drop("__row")
    return d.withColumns({"leaked_repo": F.coalesce("leaked_repo", F.lit(False)), "leaked_package": F.coalesce("leaked_package", F.lit(False))})


def rank(priority: list[str]) -> Column:
    """The order in which pairs survive: their source's place, GHSA ids first, id, source_id."""
    place = F.array_position(F.array(*map(F.lit, priority)), F.coalesce("source", F.lit("")))
    ghsa = F.upper(F.coalesce(F.col("source_id").cast("string"), F.lit(""))).startswith("GHSA-")
    return F.struct(F.when(place > 0, place - 1).otherwise(F.lit(len(priority)).cast("bigint")).alias("place"), F.when(ghsa, 0).otherwise(1).alias("other"), F.col("id").alias("id"), F.coalesce(F.col("source_id").cast("string"), F.lit("None")).alias("source_id"))


def _tag() -> Column:
    return F.concat_ws(":", "source", F.col("source_id").cast("string"))


def resolve(pairs: DataFrame, priority: list[str], annotations: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): pairs that share an alias, over any chain of these, become one; of those with one commit the first stays.

    The best-ranked pair of a group survives with the united aliases, weaknesses (by number) and packages, the earliest
    date, all sources in rank order, and annotations that it lacks from the best-ranked one that has them, with where
    they come from.  dropped: id, source, source_id, reason.
    """
    d = cut(pairs.withColumn("rank", rank(priority)).withColumn("aliases", F.when(F.size(F.coalesce("aliases", F.array().cast("array<string>"))) > 0, F.col("aliases")).otherwise(F.array("id"))).withColumn("key", _tag()))
    names = d.select("key", F.explode("aliases").alias("alias"))
    edges = names.select(F.concat(F.lit("r"), "key").alias("src"), F.concat(F.lit("a"), "alias").alias("dst"))
    members = connected_components(edges).where(F.col("node").startswith("r")).select(F.expr("substr(node, 2)").alias("key"), "component")
    d = cut(d.join(members, "key"))

    def united(c: str) -> DataFrame:
        """A group's distinct entries; made distinct as rows, since array_distinct compares structs each with each."""
        each = d.select("component", F.explode(c).alias("x")).distinct()
        return each.groupBy("component").agg(F.array_sort(F.transform(F.collect_list(F.struct("x")), lambda s: s["x"])).alias(c))

    donors = [F.min_by(F.when(F.coalesce(F.col(k).cast("string"), F.lit("")) != "", F.struct(F.col(k).alias("v"), F.col("key").alias("by"))), F.when(F.coalesce(F.col(k).cast("string"), F.lit("")) != "", F.col("rank"))).alias(f"__{k}") for k in annotations]
    rest = [c for c in pairs.columns if c not in ("aliases", "cwe", "packages", "advisory_published", *annotations)]
    g = d.groupBy("component").agg(
        F.min_by(F.struct(*rest, "rank", *annotations), "rank").alias("best"),
        F.min("advisory_published").alias("advisory_published"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "key"))), lambda x: x["key"]).alias("sources"), *donors,
    )
    for c in ("aliases", "cwe", "packages"):
        g = g.join(united(c), "component", "left").withColumn(c, F.coalesce(c, F.array().cast(pairs.schema[c].dataType)))
    cwe = F.expr("array_sort(cwe, (l, r) -> int(substr(l, 5)) - int(substr(r, 5)))")
    own = lambda k: F.coalesce(F.col(f"best.{k}").cast("string"), F.lit("")) != ""
    noted = [x for k in annotations for x in (F.when(own(k), F.col(f"best.{k}")).otherwise(F.col(f"__{k}.v")).alias(k), F.when(~own(k), F.col(f"__{k}.by")).alias(f"{k}_from"))]
    s = cut(g.select("component", "best.rank", *(F.col(f"best.{c}").alias(c) for c in rest), "aliases", cwe.alias("cwe"), "packages", "advisory_published", "sources", *noted))
    gone = d.join(s.select("component", F.col("id").alias("to"), F.col("rank").alias("first")), "component").where(F.col("rank") != F.col("first"))
    dropped = gone.select("id", "source", "source_id", F.concat(F.lit("duplicate_alias:"), "to").alias("reason"))
    w = Window.partitionBy(F.coalesce("repo_canonical", "repo"), F.coalesce("fix_sha_full", "fix_sha")).orderBy("rank")
    s = cut(s.withColumn("n", F.row_number().over(w)).withColumn("first", F.first("id").over(w)))
    again = s.where("n > 1").select("id", "source", "source_id", F.concat(F.lit("duplicate_commit:"), "first").alias("reason"))
    return s.where("n = 1").drop("component", "rank", "n", "first"), dropped.unionAll(again)


def keep(pairs: DataFrame, repos: DataFrame, packages: DataFrame, priority: list[str], cutoff: str, languages: list[str], excluded: dict[str, str], most_files: int | None = 10, annotations: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped with reason): the checks by row, then resolution, then the size of the fix (none given: any)."""
    d = cut(with_leaks(pairs, repos, packages).withColumn("reason", row_reason(cutoff, languages, excluded)))
    failed = d.where("reason is not null").select("id", "source", "source_id", "reason")
    kept, again = resolve(d.where("reason is null").select(*pairs.columns), priority, annotations)
    if most_files is None:
        return kept, failed.unionAll(again)
    size = F.when(F.col("n_files").isNull(), "files_unknown").when(F.col("n_files") > most_files, "too_many_files")
    kept = kept.withColumn("reason", size)
    large = kept.where("reason is not null").select("id", "source", "source_id", "reason")
    return kept.where("reason is null").drop("reason"), failed.unionAll(again).unionAll(large)


def leak_sets(advisories: DataFrame, cutoff: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(repos, fix_repos, packages, malware_repos) of advisories (id, published, refs, fix_refs, packages) from the cutoff on.

    repos: every repository that a reference names; fix_repos: those that fix links name; packages: ecosystem, name;
    malware_repos: repositories that only advisories of malware (MAL-) name.
    """
    late = advisories.where(F.col("published") >= cutoff)
    named = lambda c: late.select("id", F.explode(c).alias("url")).select("id", github_repo(F.col("url")).alias("repo")).where("repo is not null")
    every = named("refs")
    malware = every.groupBy("repo").agg(F.bool_and(F.col("id").startswith("MAL-")).alias("only")).where("only").select("repo")
    return every.select("repo").distinct(), named("fix_refs").select("repo").distinct(), late.select(F.explode("packages").alias("p")).select("p.ecosystem", "p.name").distinct(), malware


def fill_dates(pairs: DataFrame, dates: DataFrame) -> DataFrame:
    """pairs (id, aliases, advisory_published) whose missing date is the earliest of their aliases' (dates: alias, published)."""
    lacking = pairs.where("advisory_published is null").select("id", F.explode(F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), F.array("id"))).alias("alias"))
    found = lacking.join(dates, "alias").groupBy("id").agg(F.min("published").alias("__date"))
    return pairs.join(found, "id", "left").withColumn("advisory_published", F.coalesce("advisory_published", "__date")).drop("__date")


def todo(pairs: DataFrame, cache: DataFrame) -> DataFrame:
    """The distinct (repo, sha) of pairs that the cache (repo, sha, status) has no settled answer for."""
    return pairs.where("repo is not null and sha is not null").select("repo", "sha").distinct().join(cache.where("status in ('ok', 'missing')").select("repo", "sha"), ["repo", "sha"], "left_anti")


def canonical_repos(seen: DataFrame) -> DataFrame:
    """(repo, canonical): the first name that a repository was found under (seq, repo, canonical)."""
    return seen.where("canonical is not null").groupBy(F.lower("repo").alias("repo")).agg(F.min_by("canonical", "seq").alias("canonical"))


def mix(d: DataFrame, group: str, shares: dict[str, float], total: int | None, order: list[Column]) -> DataFrame:
    """Rows of each group in proportion to its share of `total`, the first in `order`; a short group is taken whole.

    Shares count over the groups that there are; without a total the largest is taken that every group can fill.  (The
    driver sees a count for each group named in shares.)
    """
    have = {r[0]: r[1] for r in d.where(F.col(group).isin(*shares)).groupBy(group).count().collect()}
    active = {k: s for k, s in shares.items() if s > 0 and k in have}
    if not active:
        return d.limit(0)
    norm = sum(active.values())
    whole = int(min(have[k] * norm / s for k, s in active.items())) if total is None else total
    # a sort and a limit for each group: no group stands in one task
    parts = [d.where(F.col(group) == k).orderBy(*order).limit(round(s / norm * whole)) for k, s in sorted(active.items())]
    return reduce(DataFrame.unionAll, parts)


def split_conflicts(rows: DataFrame) -> DataFrame:
    """(pair_id, splits): pairs that stand in more than one split over all inputs; null pairs are a conflict of their own."""
    g = rows.groupBy("pair_id").agg(F.array_sort(F.collect_set("split")).alias("splits"))
    return g.where((F.size("splits") > 1) | F.col("pair_id").isNull())


def exported(rows: DataFrame, never: tuple[str, ...] = ("oldcve",)) -> DataFrame:
    """The rows that may be written, without those of splits that never are; raises if a pair is in two splits or has no id."""
    bad = split_conflicts(rows).limit(5).collect()
    if bad:
        raise ValueError(f"pairs without an id or in two splits: {[(r.pair_id, r.splits) for r in bad]}")
    return rows.where(~F.col("split").isin(*never))


def row_errors(rows: DataFrame, key: str, checks: list[tuple[Column, Column]]) -> DataFrame:
    """(key, error): what each row fails (condition, message), and keys that stand more than once."""
    found = F.array_compact(F.array(*(F.when(F.coalesce(fails, F.lit(False)), said) for fails, said in checks)))
    each = rows.select(key, F.explode(found).alias("error"))
    twice = rows.groupBy(key).count().where("count > 1").select(key, F.concat(F.lit("stands "), F.col("count").cast("string"), F.lit(" times")).alias("error"))
    return each.unionAll(twice)


def tiers(reasons: list[tuple[str, Column, str]], best: str = "headline") -> tuple[Column, Column]:
    """(tier, reasons): the tier of the first check that holds, best if none does, and the names of all that hold.

    reasons: name, condition, tier, the gravest tier first."""
    holds = [(n, F.coalesce(ok, F.lit(False)), t) for n, ok, t in reasons]
    tier = F.coalesce(*(F.when(ok, F.lit(t)) for _, ok, t in holds), F.lit(best))
    return tier, F.array_compact(F.array(*(F.when(ok, F.lit(n)) for n, ok, _ in holds)))


def shortest_passing(rollouts: DataFrame, by: list[str]) -> DataFrame:
    """(by, seq, trace): each group's shortest trace that passes, the first on ties."""
    return rollouts.where("passes").groupBy(*by).agg(F.min_by(F.struct("seq", "trace"), F.struct(F.size("trace"), "seq")).alias("best")).select(*by, "best.*")


def rollout_pairs(traces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, skipped): train pairs with a vulnerable and a patched trace (seq, pair_id, split, label, fix_site), the last of
    each; skipped: pair_id, reason unpaired or no_fix_site."""
    d = traces.where("split = 'train' and label in ('vulnerable', 'patched')")
    side = lambda label, c: F.max_by(F.when(F.col("label") == label, F.col(c)), F.when(F.col("label") == label, F.col("seq")))
    g = d.groupBy("pair_id").agg(side("vulnerable", "seq").alias("vulnerable"), side("patched", "seq").alias("patched"), side("vulnerable", "fix_site").alias("fix_site"))
    why = F.when(F.col("vulnerable").isNull() | F.col("patched").isNull(), "unpaired").when(F.col("fix_site").isNull(), "no_fix_site")
    g = g.withColumn("reason", why)
    return g.where("reason is null").drop("reason"), g.where("reason is not null").select("pair_id", "reason")


def eligible(pairs: DataFrame, checks: list[Column], per_language: int, seed: int, dataflow: Column) -> DataFrame:
    """The first pairs (id, language) of each language in the order of a hash, those of dataflow classes before others."""
    ok = F.lit(True)
    for c in checks:
        ok = ok & F.coalesce(c, F.lit(False))
    w = Window.partitionBy("language").orderBy((~dataflow).cast("int"), F.sha2(F.concat(F.lit(f"{seed}:"), "id"), 256), "id")
    return pairs.where(ok).withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= per_language)


def cases(targets: DataFrame, others: DataFrame, negatives: int, seed: int) -> DataFrame:
    """(id, kind, span_id): each pair's target spans (id, side, span_id) as vulnerable or patched, and `negatives` of its other
    spans (id, span_id) by the rank of a hash of seed, pair and span."""
    kind = F.when(F.col("side") == "old", "vulnerable").otherwise("patched")
    w = Window.partitionBy("id").orderBy(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"), F.col("span_id").cast("string")), 256), "span_id")
    none = others.join(targets.select("id", "span_id"), ["id", "span_id"], "left_anti").withColumn("k", F.row_number().over(w)).where(F.col("k") <= negatives)
    return targets.select("id", kind.alias("kind"), "span_id").unionAll(none.select("id", F.lit("negative"), "span_id"))


def steps(traces: DataFrame) -> DataFrame:
    """(trace_id, step, history, target): a row for each action of a trace (trace_id, start, actions, results), with the
    messages before it; raises if a trace hasn't one result fewer than actions."""
    d = traces.withColumn("__ok", F.size("results") == F.size("actions") - 1)
    if not d.where("not __ok").isEmpty():
        raise ValueError("a trace has to have one result fewer than actions")
    d = d.select("trace_id", "start", "actions", "results", F.posexplode("actions").alias("step", "target"))
    # the start, then action and result by turns, up to the step
    before = F.flatten(F.transform(F.slice("results", F.lit(1), F.col("step")), lambda r, i: F.array(F.get("actions", i), r)))
    return d.select("trace_id", "step", F.concat(F.array("start"), before).alias("history"), "target")


def fitting(rows: DataFrame, length: Column, most: int) -> tuple[DataFrame, int]:
    """(rows of at most `most` units, how many were longer)."""
    d = rows.withColumn("__fits", length <= most)
    return d.where("__fits").drop("__fits"), d.where("not __fits").count()


def label_mask(tokens: Column, prompt: Column) -> Column:
    """The tokens' ids as labels: -100 for those of the prompt."""
    return F.transform(tokens, lambda x, i: F.when(i < prompt, F.lit(-100)).otherwise(x))
