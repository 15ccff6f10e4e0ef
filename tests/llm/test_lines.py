"""Line dedup against plain Python on generated texts: many passes, full filters, null and repeated ids, hot lines."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from quarry.llm import line_dedup

WS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WS))


def expected(rows):
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= 20:
                holders[key(line)].add(i)
    out = Counter()
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= 3 and i != max(holders[key(x)]))]
        out[i, "\n".join(kept), len(lines), len(lines) - len(kept)] += 1
    return out


def corpus(ids):
    rng = random.Random(9)
    common = [f"{w} line that many of the texts share" for w in ("A", "b", "É", "日本語の行です")] + ["short one", "x" * 20, "x" * 19, "  " + "Y" * 25 + "\t", "ÄÖ" * 10]
    rows = [(None, "a line that many of the texts share\nown"), (None, None), (ids(1), None), (ids(1), ""), (None, "b LINE that many of the texts share")]
    for i in range(400):
        lines = [rng.choice(common) if rng.random() < 0.4 else f"line {rng.randrange(900)} of the ones that few share" for _ in range(rng.randint(0, 8))]
        lines = ["  " + x.upper() if rng.random() < 0.2 else x for x in lines] + ["the hottest line, in every text"]
        rows.append((ids(rng.randrange(350)), "\n".join(lines)))
    return rows


@pytest.mark.parametrize("limits", [None, (1 << 10, 1 << 10, 3), (1 << 12, 1 << 12, 16)])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_equals_plain_python(spark, monkeypatch, limits, kind):
    if limits:  # filters that are far too small, in several passes
        monkeypatch.setattr(line_dedup, "MIN_BITS", limits[0])
        monkeypatch.setattr(line_dedup, "MAX_BITS", limits[1])
        monkeypatch.setattr(line_dedup, "MAX_RANGES", limits[2])
        assert line_dedup.filter_sizes(5000)[1] > 1
    rows = corpus((lambda i: f"d{i:04}") if kind == "string" else (lambda i: i))
    d = spark.createDataFrame([(*r, "k", "o", "l") for r in rows], f"doc_id {kind}, text string, key string, own string, lost string")
    got = line_dedup.dedup_lines(d)
    assert got.columns == [*d.columns, "__n_lines", "__n_dropped"]
    assert Counter((r.doc_id, r.text, r["__n_lines"], r["__n_dropped"]) for r in got.collect()) == expected(rows)
    assert line_dedup.dedup_lines(d.limit(0)).count() == 0


def test_filters():
    bits = 1 << 14
    packed = np.zeros(bits // 8, np.uint8)
    h = line_dedup.hashes([f"line {i}".encode() for i in range(300)])
    line_dedup.put(packed, line_dedup.places(h[:200], bits))
    assert line_dedup.has(packed, line_dedup.places(h[:200], bits)).all()
    assert line_dedup.has(packed, line_dedup.places(h[200:], bits)).mean() < 0.05
    assert sum(line_dedup.in_range(h, k, 7) for k in range(7)).tolist() == [1] * 300
    for n in (0, 1, 10**6, 10**8, 10**10, 10**13):
        size, ranges = line_dedup.filter_sizes(n)
        assert size <= line_dedup.MAX_BITS and 1 <= ranges <= line_dedup.MAX_RANGES and size & (size - 1) == 0
        assert size * ranges >= n * line_dedup.BITS_PER_LINE or ranges == line_dedup.MAX_RANGES
