"""URL filters: longest matching rule, and block decisions carried over redirects and canonical links (DataFrame only).

The pages of one component of the redirect and canonical-link graph are aliases: a page without a rule of its own is
blocked if an alias is blocked by a rule and none is explicitly allowed.  Decisions start from urls as they are written,
those of pages and those that links lead to.  Null urls and urls without :// have an empty host and path, fit no rule and
have no aliases; they are allowed.  Repeated rows are judged one by one; an empty table gives an empty result; null or
empty html has no links; html is searched whole, however long; an edge with a null end, a self loop and a repeated edge
lead nowhere new.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.components import connected_components
from quarry.plans.cut import cut
from quarry.plans.skew import heavy, spread_join

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ATTRIBUTE = r"""(?<![\w-])%s\s*=\s*["']?"""
_HREF = r"""[^>]*?""" + _ATTRIBUTE % "href" + r"""([^"'\s>]+)"""
_REL = r"""(?is)<link\b(?=[^>]*""" + _ATTRIBUTE % "rel" + r"""(?:[^"'>]*\s)?canonical(?![\w-]))""" + _HREF
_META = r"""(?is)<meta\b(?=[^>]*""" + _ATTRIBUTE % "http-equiv" + r"""refresh\b)[^>]*?""" + _ATTRIBUTE % "content" + r"""[^"'>]*?url\s*=\s*["']?([^"'\s>]+)"""
_BASE = r"""(?is)<base\b""" + _HREF
#: What isn't markup: comments and scripts.
_ASIDE = r"""(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script|\z)"""
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ://."""
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url)))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, else null.  A rule is a host, then a path from its first /;
    of rules of one length an allowing one wins.  The rules are a parameter and become one expression, no join."""
    found = None
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[1] != "allow", r[0])):
        name, slash, tail = rule.partition("/")
        fits = (host == name) | F.endswith(host, F.lit("." + name))
        fits = fits & F.startswith(path, F.lit(slash + tail))
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if found is None else found


def without_dots(path: Column) -> Column:
    """A path that starts with /, with its . and .. segments resolved."""
    parts = F.split(path, "/", -1)
    none = F.array().cast("array<string>")
    step = lambda kept, x: F.when(x == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).when(x == ".", kept).otherwise(F.concat(kept, F.array(x)))
    kept = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), none, step)
    # a last segment that is resolved leaves its slash
    kept = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(path.contains("/."), F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(path)


def node(url: Column) -> Column:
    """A url's name in the alias graph: host, path (/ if empty) and query, without scheme and fragment; null if it has no host."""
    host, path = host_and_path(url)
    query = F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1)
    return F.when(host != "", F.concat(host, F.when(path == "", "/").otherwise(without_dots(path)), query))


def resolved(to: Column, base: Column) -> Column:
    """The url that a link `to` on a page of url `base` leads to."""
    root = F.regexp_extract(base, r"(?s)^([^:/?#]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"(?s)^([^:/?#]*:)//", 1)
    page = F.regexp_extract(base, r"(?s)^([^?#]*)", 1)
    _, path = host_and_path(base)
    folder = F.regexp_extract(path, r"(?s)^(.*/)", 1)
    split = lambda k: F.regexp_extract(to, r"(?s)^([^?#]*)(.*)$", k)
    at_root = lambda p: F.concat(root, without_dots(p), split(2))
    return (
        F.when(to.rlike(_SCHEME), to)
        .when(to.startswith("//"), F.concat(scheme, to))
        .when(to.startswith("/"), at_root(split(1)))
        .when(to.startswith("?") | to.startswith("#"), F.concat(page, to))
        .otherwise(at_root(F.concat(F.when(folder == "", "/").otherwise(folder), split(1))))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """(src, dst): the urls of all canonical links and refresh redirects in the pages' html, relative ones resolved."""
    low = F.lower("html")
    has = F.contains(low, F.lit("canonical")) | F.contains(low, F.lit("refresh"))
    d = pages.where(has).select("url", F.regexp_replace("html", _ASIDE, " ").alias("html"))
    to = F.concat(*(F.regexp_extract_all("html", F.lit(p), F.lit(1)) for p in (_REL, _META)))
    base = resolved(F.replace(F.regexp_extract("html", _BASE, 1), F.lit("&amp;"), F.lit("&")), F.col("url"))
    base = F.when(F.regexp_extract("html", _BASE, 1) == "", F.col("url")).otherwise(base)
    d = d.select("url", base.alias("base"), F.explode(F.array_distinct(F.filter(to, lambda x: x != ""))).alias("to"))
    return d.select(F.col("url").alias("src"), resolved(F.replace(F.col("to"), F.lit("&amp;"), F.lit("&")), F.col("base")).alias("dst"))


def alias_edges(pages: DataFrame) -> DataFrame:
    """(src, dst): page_links() by the names of their ends."""
    return page_links(pages).select(node(F.col("src")).alias("src"), node(F.col("dst")).alias("dst"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], edges: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages (page_id, url, html).

    edges: further (src, dst) urls known to be one page, such as a crawler's redirect log.
    """
    p = pages.select("page_id", "url", "html")
    links = page_links(p)
    if edges is not None:
        links = links.unionAll(edges.select("src", "dst"))
    links = cut(links)
    members = connected_components(links.select(node(F.col("src")).alias("src"), node(F.col("dst")).alias("dst")))
    # what the rules say of each url of a component, counted so that the most frequent nodes and components are known
    urls = links.select("src").unionAll(links.select("dst")).unionAll(p.select("url")).toDF("url")
    urls = urls.select(node(F.col("url")).alias("node"), rule_of(*host_and_path(F.col("url")), rules)["verdict"].alias("verdict")).where("node is not null")
    said = urls.groupBy("node").agg(F.max(F.col("verdict") == "allow").alias("allowed"), F.max(F.col("verdict") == "block").alias("blocked"), F.count("*").alias("n"))
    members = cut(members.join(said, "node"))
    by_component = members.groupBy("component").agg(F.max("allowed").alias("any_allowed"), F.max("blocked").alias("any_blocked"), F.count("*").alias("nodes"))
    blocked = by_component.where("any_blocked and not coalesce(any_allowed, false)").select("component", "nodes")
    totals = members.agg(F.count("*").alias("nodes"), F.sum("n").alias("n")).first()
    aliases = spread_join(members.select("node", "n", "component"), blocked, "component", heavy(F.col("nodes"), totals.nodes))
    aliases = cut(aliases.where("nodes is not null").select(F.col("node").alias("__node"), "n", F.lit(True).alias("__blocked")))
    host, path = host_and_path(F.col("url"))
    q = p.select("page_id", host.alias("host"), path.alias("path"), node(F.col("url")).alias("__node"))
    q = q.withColumn("__rule", rule_of(F.col("host"), F.col("path"), rules))
    q = spread_join(q, aliases, "__node", heavy(F.col("n"), totals.n or 0))
    verdict = F.coalesce(F.col("__rule.verdict"), F.when(F.col("__blocked"), "block"), F.lit("allow"))
    return q.select("page_id", "host", "path", F.col("__rule.rule").alias("rule"), verdict.alias("verdict"))
