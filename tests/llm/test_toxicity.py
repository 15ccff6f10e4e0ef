"""Toxicity: folding, numbers, exceptions, learned fragments, copies, and recall and clean texts apart."""

import os
import random

import pytest

from quarry.llm import toxicity


@pytest.fixture(scope="module")
def automaton():
    return toxicity.first_model().automaton()


def test_every_lookalike_is_folded(automaton):
    for letter, others in toxicity.LOOKALIKES.items():
        for x in others:
            assert toxicity.fold(x) == toxicity.fold(letter), (letter, x)
    for t in ("ID10T", "s+t".replace("+", "") + "upid", "ŝtüpid", "ＭＯＲＯＮ", "mo​ron", "$tup!d", "ｓｃｕｍ", "l0ser", "тrаsh", "scum.", "(moron)", "you_idiot"):
        assert toxicity.hits(t, automaton), t


def test_numbers_and_exceptions(automaton):
    for t in ("call 5117 now", "ﬁne, call 5117 now", "455", "4 55 ﬂat", "the trash can", "a Class  clown", "idiotic", "", " ", "a 7r45h can"):
        assert not toxicity.hits(t, automaton), t
    for t in ("5h17", "ﬁ 1d10t 5117", "trash, can", "trash"):
        assert toxicity.hits(t, automaton), t


def test_repeats_count_each(automaton):
    assert len(toxicity.hits("idiot idiot idiots", automaton)) == 3
    assert toxicity.hits("idiot " * 5000, automaton)[-1][0] == 6 * 4999


def corpus(n, seed):
    """Texts of two invented tongues whose insults are stems with many endings, near copies among them."""
    rng = random.Random(seed)
    tongues = [("ka me tu lo ri sa ne vo".split(), "grubak"), ("sha dre pli ost uun ger".split(), "mulqe")]
    texts, labels = [], []
    for i in range(n):
        parts, stem = tongues[i % 2]
        words = ["".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(rng.randint(20, 300))]
        toxic = int(rng.random() < 0.15)
        for _ in range(toxic * rng.randint(2, 5)):
            words[rng.randrange(len(words))] = stem + rng.choice(parts)
        for _ in range(1 + toxic):  # copies of a toxic text share words that aren't toxic
            texts.append(" ".join(words))
            labels.append(toxic)
    return texts, labels


def recall(predicted, labels):
    toxic = [p for p, y in zip(predicted, labels, strict=True) if y]
    clean = [p for p, y in zip(predicted, labels, strict=True) if not y]
    return sum(toxic) / len(toxic), sum(clean) / len(clean)


def test_stems_are_learned(spark):
    texts, labels = corpus(500, 1)
    model = toxicity.fit(texts, labels)
    assert model.fragments and all(f.startswith(("grub", "muiq")) for f in model.fragments)
    docs = spark.createDataFrame([(f"d{i}", t, 1) for i, t in enumerate(texts)], "doc_id string, text string, label int")
    rows = spark.createDataFrame([(f"d{i}", y) for i, y in enumerate(labels)], "doc_id string, toxic int")
    spread = toxicity.train(docs, rows)
    assert spread.fragments and all(f.startswith(("grub", "muiq")) for f in spread.fragments)
    other, want = corpus(300, 2)
    for m in (model, spread):
        a = m.automaton()
        caught, false = recall([toxicity._sigmoid(toxicity.np.dot(toxicity.features(t, a), m.beta)) >= 0.5 for t in other], want)
        assert caught >= 0.95 and false <= 0.01
    got = toxicity.score(docs, spread)
    assert got.schema["doc_id"].dataType.simpleString() == "string" and got.count() == len(texts)
    assert toxicity.train(docs, rows.where("toxic = 0")).fragments == {}
    assert toxicity.train(docs, rows.limit(0)).fragments == {}


def test_ties_and_repeated_labels(spark):
    docs = spark.createDataFrame([(1, "an idiot"), (1, "an idiot"), (2, "fine"), (2, None), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (2, 0), (None, 1), (3, None), (4, 7)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(got) == 5 and len({r.score for r in got if r.doc_id == 1}) == 1


def test_copies():
    rng = random.Random(3)
    w = [f"w{rng.randrange(500)}" for _ in range(400)]
    near = w[:200] + ["else"] + w[201:]
    s = [toxicity.signature(" ".join(x)) for x in (w, near, w[::-1], [], ["one"])]
    assert toxicity.copies([*s, s[0]], [0, 0, 0, 0, 0, 1]) == [False, True, False, False, False, False]


def test_held_out_recall(spark, sf_dir):
    folder = f"{os.path.dirname(sf_dir)}/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    s = toxicity.score(docs, toxicity.train(docs, labels)).where("held_out").join(labels, "doc_id").where("toxic is not null")
    rows = s.select("predicted", "toxic").collect()
    caught, false = recall([r.predicted for r in rows], [r.toxic for r in rows])
    assert caught >= 0.9 and false <= 0.005
