"""Mixing: the dual's residual and optimality, targets, repeated rows, ids of any type, sizes shared by very many documents."""

import math
import random
from collections import Counter, defaultdict

import pytest

from quarry.llm import mixing


def table(spark, rows, kind="long"):
    return spark.createDataFrame(rows, f"doc_id {kind}, source string, text string, m string, size string, copies string")


def row(i, source, n):
    return (i, source, " ".join(f"w{i}" for _ in range(n)) if n is not None else None, "m", "s", "c")


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    return [row(i, rng.choice(["a", "a", "a", "b", "c", None]), int(rng.lognormvariate(4, 1))) for i in range(3000)]


def test_rates_meet_targets_and_are_optimal(spark, corpus):
    got = mixing.mix(table(spark, corpus)).collect()
    assert len(got) == len(corpus)
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    for rows in by.values():
        size, target = rows[0].source_size, rows[0].target
        assert size == sum(r.size for r in rows)
        assert abs(sum(r.rate * r.size for r in rows) - target) <= 1e-6 * target
        assert abs(sum(r.taken for r in rows) - target) <= 0.01 * target
        # a common multiplier explains all rates under the bound: log(rate) = multiplier * tilt
        mean = size / len(rows)
        free = [(math.log(r.rate), r.size / (r.size + mean)) for r in rows if r.size and 0 < r.rate < 2 - 1e-6]
        if free:
            k = free[0][0] / free[0][1]
            assert all(abs(a - k * x) < 1e-6 for a, x in free)
            assert all(k * r.size / (r.size + mean) >= math.log(2) - 1e-6 for r in rows if r.rate >= 2 - 1e-6)
            assert len({r.rate for r in rows}) > 10  # tilted by size, not one rate for all
        assert all(0 <= r.copies <= 2 and r.taken == r.copies * r.size for r in rows)
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix(table(spark, corpus[::-1])).collect()))


def test_targets(spark):
    """Weights 5, 2, 1 repeating share 150% of all words; what exceeds twice a source's size is shared again."""
    sizes = {"a": 10, "b": 100, "c": 400, "d": 50, None: 300}
    hist = spark.createDataFrame([(s, 1, n) for s, n in sizes.items()], "source string, size long, n long")
    weights = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2], strict=True))
    want, left, open_ = {}, 1.5 * sum(sizes.values()), set(sizes)
    while True:
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not full:
            want |= share
            break
        want |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2.0 * sizes[s] for s in full)
        open_ -= full
    got = {r.source: r.target for r in mixing.targets(hist).collect()}
    assert got == pytest.approx(want)


def test_copies_equal_mix(spark, corpus):
    """Rows alike in id, or in all, are written as often as mix() takes them."""
    equal = [row(7, "b", 30)] * 40 + [row(None, "b", 30)] * 3 + [row(None, "b", 12), row(None, "b", None), row(None, None, 0)] + [row(7, "b", 31)] * 2
    d = table(spark, corpus[:500] + equal)
    m, written = mixing.mix(d), mixing.copies(d)
    assert written.columns == d.columns
    want = Counter()
    for r in m.collect():
        want[r.doc_id, r.source, r.size] += r.copies
    got = Counter((r.doc_id, r.source, len((r.text or "").split())) for r in written.collect())
    assert got == +want


def test_string_ids_many_of_a_size_and_empty(spark):
    rows = [row(f"id{i}", "a", 5) for i in range(6000)] + [row(f"x{i}", "b", 700) for i in range(40)] + [row(f"e{i}", "c", 0) for i in range(20)]
    d = table(spark, rows, "string")
    got = mixing.mix(d).collect()
    assert len(got) == len(rows)
    for s in "ab":
        part = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in part) - part[0].target) <= 700 * 0.51
    assert all(r.copies == 1 and r.target == 0 for r in got if r.source == "c")
    assert mixing.mix(d.limit(0)).count() == mixing.copies(d.limit(0)).count() == 0
    assert mixing.copies(d).count() == sum(r.copies for r in got)
