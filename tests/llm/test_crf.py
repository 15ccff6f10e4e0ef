"""The chain against enumeration, its gradient against finite differences, pieces and blocks against the whole."""

import itertools
import os
import random

import numpy as np
import pytest

from quarry.llm import line_crf


def enumerated(u, trans):
    """Marginals of good, pair marginals and log partition of one chain, over all labellings."""
    total, good, pairs = 0.0, np.zeros(len(u)), np.zeros((max(0, len(u) - 1), 2, 2))
    for ys in itertools.product((0, 1), repeat=len(u)):
        p = np.exp(sum(x for x, y in zip(u, ys, strict=True) if y) + sum(trans[a, b] for a, b in itertools.pairwise(ys)))
        total += p
        good += p * np.array(ys)
        for t, (a, b) in enumerate(itertools.pairwise(ys)):
            pairs[t, a, b] += p
    return good / total, pairs / total, np.log(total)


@pytest.mark.parametrize("block", [1, 2, 3, 256])
def test_marginals_equal_enumeration(monkeypatch, block):
    monkeypatch.setattr(line_crf, "BLOCK", block)
    rng = np.random.default_rng(block)
    n_lines = np.array([1, 4, 9, 2, 1, 7])
    u, trans = rng.normal(size=n_lines.sum()) * 3, rng.normal(size=(2, 2)) * 2
    good, pairs, log_z, last = line_crf.forward_backward(u, trans, n_lines)
    at = 0
    for k, n in enumerate(n_lines):
        g, p, z = enumerated(u[at : at + n], trans)
        np.testing.assert_allclose(good[at : at + n], g, atol=1e-12)
        np.testing.assert_allclose(pairs[at : at + n - 1], p, atol=1e-12)
        assert abs(log_z[k] - z) < 1e-9 and last[k] == at + n - 1 and not pairs[last[k]].any()
        at += n


def test_large_potentials_and_long_chains():
    u = np.tile([800.0, -800.0, 0.0], 50_000)
    good, _, log_z, _ = line_crf.forward_backward(u, np.zeros((2, 2)), np.array([len(u)]))
    np.testing.assert_allclose(good.reshape(-1, 3), np.tile([1.0, 0.0, 0.5], (50_000, 1)), atol=1e-12)
    assert abs(log_z[0] / (50_000 * (800 + np.log(2))) - 1) < 1e-9


def random_texts(rng, n):
    line = lambda: b" ".join(rng.choice([b"aa", b"The", b"x9", b"!!", b"long-word.", "é".encode()]) for _ in range(rng.randint(0, 9)))
    return [b"\n".join(line() for _ in range(rng.randint(1, 12))) for _ in range(n)]


def test_gradient_equals_finite_differences():
    rng = random.Random(4)
    texts = random_texts(rng, 9)
    x, n_lines, _ = line_crf.line_features(texts, [set() for _ in texts])
    labels = np.array([rng.randint(0, 1) for _ in texts])
    f = line_crf.objective(lambda theta: line_crf.likelihood(x, n_lines, labels, theta))
    theta = np.random.default_rng(2).normal(size=line_crf.WIDTH + 4) * 0.4
    _, g = f(theta)
    for k in range(len(theta)):
        e = np.zeros_like(theta)
        e[k] = 1e-5
        assert abs((f(theta + e)[0] - f(theta - e)[0]) / 2e-5 - g[k]) < 1e-7, k


def test_likelihood_equals_enumeration():
    rng = random.Random(6)
    texts = [t for t in random_texts(rng, 20) if t.count(b"\n") < 9]
    labels = np.array([rng.randint(0, 1) for _ in texts])
    theta = np.random.default_rng(3).normal(size=line_crf.WIDTH + 4) * 0.4
    trans, want = theta[line_crf.WIDTH :].reshape(2, 2), 0.0
    for t, y in zip(texts, labels, strict=True):
        x, _, _ = line_crf.line_features([t], [set()])
        own, w = len(x), theta
        u = [x[i] @ w[:17] + (x[i - 1, :16] @ w[17:33] if i else 0) + (x[i + 1, :16] @ w[33:49] if i + 1 < own else 0) for i in range(own)]
        want += (y * sum(u) + (own - 1) * trans[y, y] - enumerated(np.array(u), trans)[2]) / own
    x, n_lines, _ = line_crf.line_features(texts, [set() for _ in texts])
    assert abs(line_crf.likelihood(x, n_lines, labels, theta)[0] - want) < 1e-9


def test_pieces_equal_the_whole(monkeypatch):
    rng = random.Random(5)
    crf = line_crf.Crf(np.random.default_rng(1).normal(size=line_crf.WIDTH + 4))
    texts = [*random_texts(rng, 30), b"", b"\n\n\n", b"one line " * 200, b"\n".join(random_texts(rng, 40))]
    want = [crf.scores([t])[0] for t in texts]
    monkeypatch.setattr(line_crf, "CHUNK", 50)
    np.testing.assert_allclose(crf.scores(texts), want, atol=1e-9)


def test_minimum_of_a_known_function():
    a = np.diag([1.0, 10.0, 100.0])
    got = line_crf.minimum(lambda x: (float((x - 1) @ a @ (x - 1) / 2), a @ (x - 1)), np.zeros(3))
    np.testing.assert_allclose(got, 1, atol=1e-3)


def test_ids_ties_and_repeats(spark):
    docs = spark.createDataFrame([("a", "A fine line.\nAnother one here."), ("a", "A fine line.\nAnother one here."), ("b", "## || 99\n## ||"), ("c", None), (None, "")], "doc_id string, text string")
    labels = spark.createDataFrame([("a", 1), ("a", 1), ("b", 0), ("b", 1), ("c", 0), (None, 0), ("z", 0), ("b", 5)], "doc_id string, quality int")
    got = line_crf.score(docs, line_crf.train(docs, labels)).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if r.doc_id == "a"}) == 1
    assert {r.score for r in line_crf.score(docs, line_crf.train(docs, labels.limit(0))).collect()} == {0.5}


def test_held_out_rows(spark, sf_dir):
    folder = f"{os.path.dirname(sf_dir)}/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    s = line_crf.score(docs, line_crf.train(docs, labels)).where("held_out").join(labels, "doc_id").where("quality is not null")
    good, bad, n_good, n_bad = s.selectExpr("count_if(quality = 1 and predicted = 1)", "count_if(quality = 0 and predicted = 0)", "count_if(quality = 1)", "count_if(quality = 0)").first()
    assert good >= 0.98 * n_good and bad >= 0.9 * n_bad, (good, n_good, bad, n_bad)
