"""Link resolution against urllib, and generated link graphs against union-find, with allow precedence."""

import random
from urllib.parse import urljoin, urlsplit

import pytest

from quarry.llm import queries, url_filter


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_all_links_of_a_page_carry_a_block(spark):
    links = '<link rel="canonical" href="http://a.org/1"><p><LINK href=/2 rel=canonical>'
    moves = '<meta http-equiv="refresh" content="0; url=http://c.org/3"> <meta http-equiv=refresh content="5;URL=http://b.net/es/4">'
    rows = [(0, "http://a.org/0", links + "\n" + moves), (1, "http://a.org/1", ""), (2, "http://a.org/2", None), (3, "http://c.org/3", ""), (4, "http://b.net/es/4", ""), (5, "http://c.org/5", "canonical")]
    d = pages(spark, rows)
    edges = {(r.src, r.dst) for r in url_filter.alias_edges(d).collect()}
    assert edges == {("a.org/0", x) for x in ("a.org/1", "a.org/2", "c.org/3", "b.net/es/4")}
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(d, queries.RULES).collect()}
    assert got == {0: "block", 1: "block", 2: "block", 3: "block", 4: "block", 5: "allow"}


@pytest.mark.parametrize("base", ["http://a.org/x/y/z?p=1#f", "https://a.org", "http://a.org/x", "http://a.org/x/?b/c"])
def test_links_are_resolved(spark, base):
    targets = ["/go?u=http://b.net/es/1", "?q=1", "../z", "../../z", "../../../z", "./z", "z", "z/./w/..", "z/..", ".", "..", "//c.org/p", "http://c.org/p", "HTTPS://c.org", "z?u=a/../b", "/a/./b/../c", "z#g", "/..", "mailto:x@y.org"]
    html = [(i, base, f"<link rel=canonical href='{t}'>") for i, t in enumerate(targets)]
    got = [r.dst for r in url_filter.page_links(pages(spark, html).coalesce(1)).collect()]
    name = lambda u: (urlsplit(u).netloc.lower(), urlsplit(u).path or "/", urlsplit(u).query)
    assert [name(x) for x in got] == [name(urljoin(base, t)) for t in targets]


def test_what_is_no_link(spark):
    html = [
        "<!-- <link rel=canonical href=http://b.net/es/1> -->",
        "<!-- open <link rel=canonical href=http://b.net/es/1>",
        "<script>'<link rel=canonical href=http://b.net/es/1>'</script>",
        "<link rel=stylesheet href=http://b.net/es/1 title=canonical>",
        "<link rel=canonical data-href=http://b.net/es/1>",
        "<link data-rel=canonical href=http://b.net/es/1>",
        "<meta name=refresh content='0;url=http://b.net/es/1'>",
        "canonical refresh", "", None, "<link rel=canonical href=''>", "<link rel=canonical href='mailto:a@b.net'>",
    ]
    d = pages(spark, [(i, f"http://a.org/{i}", h) for i, h in enumerate(html)])
    assert {r.verdict for r in url_filter.judge_urls(d, queries.RULES).collect()} == {"allow"}
    based = "<base href='http://b.net/es/'><link rel='x canonical' href='1'>"
    assert [r.verdict for r in url_filter.judge_urls(pages(spark, [(1, "http://a.org/", based)]), queries.RULES).collect()] == ["block"]


def test_urls_that_fit_no_rule_start_nothing(spark):
    """http://evil.org has an empty path: the rule evil.org/ doesn't fit it, nor does it block those it is linked with."""
    d = pages(spark, [(1, "http://evil.org", "<link rel=canonical href=http://a.org/x>"), (2, "http://a.org/x", "")])
    rules = [("evil.org/", "block")]
    assert {r.verdict for r in url_filter.judge_urls(d, rules).collect()} == {"allow"}
    more = d.unionAll(pages(spark, [(3, "http://evil.org/", "")]))
    assert {r.page_id: r.verdict for r in url_filter.judge_urls(more, rules).collect()} == {1: "block", 2: "block", 3: "block"}


def test_generated_graphs(spark):
    """Random links, with cycles, repeats, null ends and further edges, on urls of which some fit rules."""
    rng = random.Random(8)
    hosts = ["a.org", "b.net", "c.example.com", "www.example.com", "q.info"]
    urls = [f"http://{rng.choice(hosts)}/{rng.choice(['en', 'es', 'fr', 'x'])}/{i}" for i in range(300)]
    # the rules fit about a fifth, most of them blocking
    rules = [("b.net/es/", "block"), ("b.net/fr/", "block"), ("example.com/en/", "block"), ("www.example.com/en/", "allow")]
    rows, edges = [], []
    for i, u in enumerate(urls):
        html = ""
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
            v = rng.choice(urls)
            edges.append((u, v))
            html += rng.choice([f"<link rel=canonical href='{v}'>", f"<meta http-equiv=refresh content='0;url={v}'>", f"<link rel='canonical' href='//{v[7:]}'>"])
        rows.append((i, u, html))
        if i % 20 == 0:
            rows.append((1000 + i, u, None))
    log = [(rng.choice(urls), rng.choice(urls)) for _ in range(10)] + [(urls[0], None), (None, None), (urls[3], urls[3]), (urls[1], urls[2]), (urls[2], urls[1])]
    parent = {u: u for u in urls}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges + [e for e in log if None not in e]:
        parent[find(a)] = find(b)

    def fits(u):
        host, path = u[7:].split("/", 1)
        found = [(len(r), v) for r, v in rules for h, t in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and ("/" + path).startswith("/" + t)]
        return max(found)[1] if found else None

    said = {u: {fits(v) for v in urls if find(v) == find(u)} for u in urls}
    want = {i: fits(u) or ("block" if "block" in said[u] and "allow" not in said[u] else "allow") for i, u, _ in rows}
    got = url_filter.judge_urls(pages(spark, rows), rules, spark.createDataFrame(log, "src string, dst string")).collect()
    assert len(got) == len(rows) and {r.page_id: r.verdict for r in got} == want
    assert 10 < sum(v == "block" and fits(urls[i % 1000]) is None for i, v in want.items())
