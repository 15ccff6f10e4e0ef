"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns for all operators and stages."""

import hashlib
import os
import re
from collections import defaultdict

import public_tokenizers
import pytest
import xxhash

import corpus_pipeline
from quarry.llm import licenses, line_crf, line_dedup, mixing, quality_rules, queries, simhash, topk, toxicity, url_filter

LONG = "\n".join(f"Line {i} has a{i} b{i} and c{i} d{i} for itself." for i in range(3000))
SAME = "This line stands in very many documents, all the same."
ROWS = [
    (1, f"{SAME}\nown words of the first one", "en", "a"),
    (2, f"  {SAME.upper()} \nown words of the second one", "en", None),
    (3, f"{SAME}\n\nown words of the third one, an idiot", None, "a"),
    (3, f"{SAME}\n\nown words of the third one, an idiot", None, "a"),
    (4, None, "de", "b"),
    (5, "", "de", "b"),
    (6, LONG, "en", "a"),
    (7, LONG + " more", "en", "b"),
    (None, "No id at all. Licensed under CC BY 4.0", "en", "b"),
    (None, None, None, None),
    (8, "ÄÖ 日本語 👍 \x1c \x00 end", "xx", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    clash = "doc_id long, text string, lang string, source string, n_chars long, size int, words string, kept string, fp string, key string, score string"
    return spark.createDataFrame([(*r, len(r[1] or ""), 1, "w", "k", "f", "y", "s") for r in ROWS], clash)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 0, 1), (4, None, None), (None, 1, 1), (99, 0, 1)], "doc_id long, quality int, toxic int")


def operators(labels):
    return {
        "quality": lambda d: quality_rules.quality(d),
        "mix": lambda d: mixing.mix(d),
        "crf": lambda d: line_crf.score(d, line_crf.train(d, labels)),
        "license": lambda d: licenses.scan(d),
        "toxicity": lambda d: toxicity.score(d, toxicity.train(d, labels)),
        "lines": lambda d: line_dedup.dedup_lines(d),
        "simhash": lambda d: simhash.near_duplicates(d),
    }


@pytest.mark.parametrize("name", ["quality", "mix", "crf", "license", "toxicity", "lines", "simhash"])
def test_one_row_each_and_empty(docs, labels, name):
    f = operators(labels)[name]
    assert f(docs).count() == len(ROWS)
    assert f(docs.limit(0)).count() == 0


def test_stages(spark, docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0
        assert stage(spark, docs, "").count() > 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns


def test_lines(docs):
    got = sorted((r.doc_id or 0, r.text, r["__n_lines"], r["__n_dropped"]) for r in line_dedup.dedup_lines(docs).collect())
    by = defaultdict(list)
    for r in got:
        by[r[0]].append(r[1:])
    assert by[1] == [("own words of the first one", 2, 1)] and by[2] == [("own words of the second one", 2, 1)]
    assert by[3] == [(f"{SAME}\n\nown words of the third one, an idiot", 3, 0)] * 2
    assert by[4] == by[5] == [("", 1, 0)]


def test_simhash(docs):
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    zero = {(i, c) for i, f, c in got if f == "0" * 16}
    assert zero == {(4, 4), (5, 4), (None, 4)}
    words = re.findall(r"[^\x20\x09-\x0D]+", ROWS[0][1])
    words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words]
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert (1, format(want, "016x"), 1) in got


def test_simhash_large_lists(spark):
    import random

    rng = random.Random(2)
    base = rng.getrandbits(64)
    fps = {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(300)} | {rng.getrandbits(64) for _ in range(50)}
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    d = spark.createDataFrame([(x,) for x in fps], "fp long")
    from quarry.operators.components import connected_components

    got = {r.node: r.component for r in connected_components(simhash.links(d, block=16)).collect()}
    parent = {x: x for x in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 3 and find(a) != find(b):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    assert all(got.get(x, x) == find(x) for x in fps)


def test_mix_takes_whole_copies(docs):
    got = mixing.mix(docs).collect()
    assert all(r.taken == r.copies * r.size <= 2 * r.size for r in got)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs).collect()), key=str)


def test_licenses(docs):
    got = {r.doc_id: r for r in licenses.scan(docs).collect() if r.n_words}
    assert got[None].base_labels == "cc-by" and got[None].first_word == 6 and got[1].labels == ""


def test_toxicity_disguises(docs, labels):
    model = toxicity.fit(["an idiot", "fine words"], [1, 0])
    a = model.automaton()
    for t in ("IDIOT", "1d1ot", "іdіоt", "ｉｄｉｏｔ", "st​upid", "$tupid"):
        assert toxicity.hits(t, a), t
    for t in ("idiotic", "455", "a trash can here", ""):
        assert not toxicity.hits(t, a), t


def test_urls(spark):
    rows = [(1, "http://a.org/x", '<LINK href="http://b.net/es/1" rel=canonical>'), (2, "http://b.net/es/1#f", None), (3, None, None), (4, "no scheme", ""), (5, "HTTP://EXAMPLE.com/en/9?x", '<link rel="canonical" href="http://q.org/">'), (6, "http://q.org", ""), (7, "http://q.org/", '<link rel="canonical" href="http://www.example.com/en/">')]
    d = spark.createDataFrame([(*r, "v") for r in rows], "page_id long, url string, html string, verdict string")
    got = {r.page_id: r for r in url_filter.judge_urls(d, queries.RULES).collect()}
    assert [got[i].verdict for i in range(1, 8)] == ["block", "block", "allow", "allow", "block", "allow", "allow"]
    assert got[5].host == "example.com" and got[5].rule == "example.com/en/" and got[3].host == ""
    assert url_filter.judge_urls(d.limit(0), queries.RULES).count() == 0


def test_topk(spark):
    rows = [(0, [1.0, None]), (20, [1.0, 2.0]), (1, [float("nan")]), (2, [0.5]), (3, None), (4, []), (5, [0.5]), (None, [1.0])]
    d = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<float>, rank int")
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.search(d).orderBy("rank").collect()] == [(20, 1, 2, 2048), (20, 2, 5, 2048), (20, 3, 4, 0)]
    assert topk.search(d.limit(0)).count() == 0


def test_quality_counts(docs):
    got = {r.doc_id: r for r in quality_rules.quality(docs).collect() if r.doc_id in (1, 6)}
    words = re.findall(r"[^\x20\x09-\x0D]+", LONG)
    assert got[6].n_words == len(words) and got[6].word_chars == sum(map(len, words)) and not got[6].base_failed


def test_pipeline_on_whole_table(spark, sf_dir):
    """The last stages follow from the ones before: encoded rows are the mixed ones."""
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, sf_dir)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation(), t.no_padding()

    def sha(text):
        ids = t.encode(text, add_special_tokens=False).ids
        return hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()

    assert sorted((r.doc_id, r.ids_sha256) for r in out.collect()) == sorted((r.doc_id, sha(r.text)) for r in d.collect())


def test_held_out_accuracy(spark, sf_dir):
    folder = f"{os.path.dirname(sf_dir)}/sf0.1"  # the smallest table has 19 such rows
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    for name, f, least in (("quality", line_crf, 0.9), ("toxic", toxicity, 0.85)):
        s = f.score(docs, f.train(docs, labels)).where("held_out").join(labels, "doc_id")
        right, n = s.selectExpr(f"count_if(predicted = {name})", "count(*)").first()
        assert right >= least * n
