"""The quality rules, the license scan and the pipeline's first four stages against plain Python (mixing: op3's SQL) on whole tables."""

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import pandas as pd
import pytest
import xxhash

import corpus_pipeline
from quarry.llm import licenses, quality_rules, queries
from quarry.plans.cut import ensure_checkpoint_dir

WS = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def distance(p, q):
    sp, sq = sum(p), sum(q)
    if not sp or not sq:
        return None
    half = lambda x, m: x * math.log2(x / m) if x > 0 else 0.0
    pairs = [(a / sp, b / sq) for a, b in zip(p, q, strict=True)]
    return math.sqrt(max(0.0, sum(half(x, (x + y) / 2) + half(y, (x + y) / 2) for x, y in pairs) / 2))


def quality(docs):
    """docs: (doc_id, lang, text, ...) dicts; the rows of op1."""
    out, refs = [], defaultdict(lambda: (Counter(), Counter()))
    for d in docs:
        text = d["text"] or ""
        words, raw = WORD.findall(text), text.encode()
        count = lambda s: sum(map(text.count, s))  # noqa: E731,B023
        classes = [count(WS), sum("A" <= c <= "Z" for c in text), sum("0" <= c <= "9" for c in text), count(".,;:!?'\"()-"), count("#*$%&|<>")]
        classes += [sum(low <= c <= high for c in text) for low, high in (("\u0370", "\u052f"), ("\u0530", "\u1fff"), ("\u2e80", "\U0010ffff"))] + [len(raw) - len(text)]
        classes.append(len(raw) - sum(classes))
        commons = [words.count(w) for w in quality_rules.WORDS]
        commons.append(len(words) - sum(commons))
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)] if len(words) > 8 else []
        times = Counter(windows)
        covered = {i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(8)}
        lines = [x for x in text.split("\n") if x.strip(WS)]
        failed = len(words) < 20 or len(covered) * 100 > len(words) * 30
        row = {"doc_id": d["doc_id"], "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": classes[4], "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "base_failed": failed}
        out.append((row, d["lang"], classes, commons, len(raw)))
        for ref, h in zip(refs[d["lang"]], (classes, commons), strict=True):
            ref.update(dict(enumerate(h)))
    for row, lang, classes, commons, size in out:
        c, w = ([ref[i] for i in range(len(h))] for ref, h in zip(refs[lang], (classes, commons), strict=True))
        far = size >= 200 and distance(classes, c) > 0.32
        if row["n_words"] >= 50:
            limit, share = 0.45, 1 - w[-1] / sum(w)
            if row["n_words"] * share >= 8:
                limit = min(limit, 0.97 * distance([0, 1], [sum(w[:-1]), w[-1]]))
            far = far or distance(commons, w) > limit
        row["kept"] = not row["base_failed"] and not far
    return [x[0] for x in out]


def lines(docs):
    key = lambda x: lower(x.strip(WS))
    holders = defaultdict(set)
    for d in docs:
        for x in (d["text"] or "").split("\n"):
            holders[key(x)].add(d["doc_id"])
    gone = lambda x, i: len(key(x)) >= 20 and len(holders[key(x)]) >= 3 and i != max(holders[key(x)])
    return [d | {"text": "\n".join(x for x in (d["text"] or "").split("\n") if not gone(x, d["doc_id"]))} for d in docs]


def near_duplicates(docs):
    def fingerprint(text):
        w = [lower(x) for x in WORD.findall(text)]
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fp, group = {d["doc_id"]: fingerprint(d["text"]) for d in docs}, {d["doc_id"]: d["doc_id"] for d in docs}
    ids = sorted(fp)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (fp[a] ^ fp[b]).bit_count() <= 3 and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {i: low if g == high else g for i, g in group.items()}
    return [d for d in docs if group[d["doc_id"]] == d["doc_id"]]


def mix(docs):
    documents = pd.DataFrame([{k: d[k] for k in ("doc_id", "source", "text")} for d in docs])  # noqa: F841 (read by the SQL)
    taken = {r[0]: (r[1], r[2]) for r in duckdb.sql("SELECT doc_id, size, taken FROM (" + queries.oracle_sql()["op3_entropy_mixing"] + ")").fetchall()}
    return [d for d in docs for size, n in [taken[d["doc_id"]]] if size for _ in range(n // size)]


@pytest.fixture(scope="module")
def docs(sf_dir):
    d = duckdb.sql(f"SELECT doc_id, lang, source, text FROM '{sf_dir}/documents.parquet'").fetchall()
    assert len({r[0] for r in d}) == len(d)
    return [dict(zip(("doc_id", "lang", "source", "text"), r, strict=True)) for r in d]


def test_quality_of_generated_texts(spark):
    """Languages null and empty apart, other scripts, repeated windows and lines, guards, repeated rows."""
    rng = random.Random(21)
    alphabets = {"en": "abcdefgh", "ru": "абвгдежз", "ja": "日本語文字列", "": "xyz", None: "klmn"}
    docs = []
    for i in range(400):
        lang = rng.choice(list(alphabets))
        letters = alphabets[lang if rng.random() < 0.9 else "ja"]
        words = [rng.choice(["the", "of", "and"]) if lang == "en" and rng.random() < 0.2 else "".join(rng.choices(letters, k=rng.randint(1, 6))) for _ in range(rng.choice([0, 1, 8, 9, 19, 20, 49, 50, 150]))]
        if rng.random() < 0.3 and words:
            at = rng.randrange(len(words))
            words += words[at : at + rng.choice([7, 8, 9, 20])] * rng.randint(1, 4)
        text = "".join(w + rng.choice([" "] * 40 + ["\n", "\t\x0b", " #$| ", ", "]) for w in words)
        docs.append({"doc_id": rng.choice([i, i // 3, None]), "lang": lang, "text": text if rng.random() < 0.95 else None})
    docs += docs[:20]
    d = spark.createDataFrame([(x["doc_id"], x["lang"], x["text"], 5) for x in docs], "doc_id long, lang string, text string, n_words int")
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = Counter(tuple(r[c] for c in names) for r in quality_rules.quality(d).collect())
    want = quality(docs)
    assert got == Counter(tuple(r[c] for c in names) for r in want)
    assert sum(r["n_repeat_words"] > 0 for r in want) > 40 and 5 < sum(not r["kept"] and not r["base_failed"] for r in want) < 300


def test_quality_rules(spark, sf_dir, docs):
    got = {r.doc_id: r.asDict() for r in queries.op1_quality_rules(spark, sf_dir).collect()}
    assert got == {r["doc_id"]: r for r in quality(docs)}
    assert len({r["kept"] for r in got.values()}) == 2


def test_pipeline_stages(spark, sf_dir, docs):
    kept = {r["doc_id"] for r in quality(docs) if r["kept"]}
    want = [[d for d in docs if d["doc_id"] in kept]]
    for f in (lines, near_duplicates, mix):
        want.append(f(want[-1]))
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ensure_checkpoint_dir(spark)
    for (name, stage), rows in zip(corpus_pipeline.STAGES, want, strict=False):
        d = stage(spark, d, sf_dir).checkpoint()
        got = sorted((r.doc_id, r.text) for r in d.select("doc_id", "text").collect())
        if name == "mixing":
            got = [r for r in got if WORD.search(r[1])]
        assert got == sorted((r["doc_id"], r["text"]) for r in rows), name


def licensed(text):
    """n_words, n_base, first_word, last_word, base_labels, labels, score."""
    split = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(s))
    w = split(text or "")
    at = [(i, label) for p, label in licenses.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    base, more, best = {x for _, x in at}, set(), 0.0
    for label, template in licenses.TEMPLATES:
        t, by = split(template), defaultdict(list)
        for i in range(len(w) - 2):
            for j in range(len(t) - 2):
                if w[i : i + 3] == t[j : j + 3]:
                    by[i - j].append((i, j))
        bands, last = [], None
        for diagonal in sorted(by):
            if last is None or diagonal - last > 3:
                bands.append([])
            bands[-1] += by[diagonal]
            last = diagonal
        for band in bands:
            for first, _ in band:
                near = {j for i, j in band if first <= i and i + 3 - first <= int(len(t) * 1.5) + 3}
                coverage = len({j + k for j in near for k in range(3)}) / len(t)
                if coverage >= 0.8:
                    more.add(label)
                    best = max(best, coverage)
    places = [i for i, _ in at]
    return len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 if at else best


def test_license_scan(spark, docs):
    bsd = next(t for label, t in licenses.TEMPLATES if label == "bsd").split()
    planted = ["x " + " ".join([*bsd[:9], "surely", "so", *bsd[9:]]) + " y", " ".join([*bsd[:9], *["far"] * 30, *bsd[9:]]), " ".join(bsd[:-6]), " ".join(bsd[:-3]).upper()]
    rows = [(d["doc_id"], d["text"]) for d in docs] + [(-1 - i, t) for i, t in enumerate(planted)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r[0]: tuple(r)[1:-1] + (round(r.score, 9),) for r in licenses.scan(d).collect()}
    want = {i: licensed(t) for i, t in rows}
    assert got == {i: (*x[:-1], round(x[-1], 9)) for i, x in want.items()}
    assert [got[-1 - i][5] for i in range(4)] == ["bsd", "", "", "bsd"]


def test_spans_of_generated_texts(spark):
    """Notices among repeats of their own words, with words put in and left out; rows share ids, null included."""
    rng = random.Random(11)
    notices = [t for _, t in licenses.TEMPLATES]
    rows = [(None, "released under the " * 4 + "released under the mit license"), (None, "no license here"), (None, None), (7, ""), (7, notices[0]), (7, notices[0])]
    for i in range(400):
        parts = []
        for _ in range(rng.randint(1, 4)):
            w = rng.choice(notices).split()
            at = rng.randrange(len(w))
            kind = rng.randrange(5)
            if kind == 0:
                w = w[at : at + 3] * rng.randint(1, 30) + w
            elif kind == 1:
                w = w[:at] + ["else"] * rng.randint(1, 12) + w[at:]
            elif kind == 2:
                w = w[:at] + w[at + rng.randint(1, 8) :]
            elif kind == 3:
                w = w[at:] + w[:at]
            parts += w + ["so"] * rng.randint(0, 5)
        text = " ".join(parts)
        rows.append((rng.choice([None, i % 50, i]), text.upper() if i % 7 == 0 else text))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r)[:-1] + (round(r.score, 9),) for r in licenses.scan(d).collect())
    assert got == Counter((i, *x[:-1], round(x[-1], 9)) for i, t in rows for x in [licensed(t)])
    assert sum(n for r, n in got.items() if "mit" in r[6]) > 20
    table = spark.createDataFrame(licenses.TEMPLATES, "label string, text string")
    assert got == Counter(tuple(r)[:-1] + (round(r.score, 9),) for r in licenses.scan(d, templates=table).collect())
