"""Top-k search against all pairs, in several blocks and lanes, with ties, repeats and large components."""

import math
from collections import defaultdict

import numpy as np
import pytest

from quarry.llm import topk


def expected(rows, k=20, every=20):
    """(query_id, rank, vec_id, score) by brute force; repeated query rows are ranked together."""
    v = [(i, [math.floor(64 * float(np.float32(x))) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) and abs(x) * 64 < 1 << 28 for x in e)]
    found = defaultdict(list)
    for i, a in v:
        if i % every == 0:
            found[i] += sorted((-sum(x * y for x, y in zip(a, b, strict=False)), j) for j, b in v if j != i)[:k]
    return sorted((i, r, j, -s) for i, x in found.items() for r, (s, j) in enumerate(sorted(x)[:k], 1))


def vectors(rng, n, dim, spread):
    centres = rng.normal(size=(9, dim)) * spread
    return [(i, (centres[rng.integers(9)] + rng.normal(size=dim)).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("sizes", [(2048, 1024, 4096, 8, 512), (64, 20, 7, 3, 11), (16, 400, 30, 1, 5)])
@pytest.mark.parametrize("spread", [0.0, 8.0])
def test_equals_all_pairs(spark, monkeypatch, sizes, spread):
    for name, x in zip(("SAMPLE", "PER_LEAF", "QUERY_BLOCK", "LANES", "PART"), sizes, strict=True):
        monkeypatch.setattr(topk, name, x)
    monkeypatch.setattr(topk.packed_blocks, "__defaults__", (sizes[2],))
    rng = np.random.default_rng(7)
    rows = vectors(rng, 900, 6, spread) + [(i, [1.0] * 6) for i in range(900, 1000)] + [(20, [1.0] * 6), (20, [0.5] * 6), (None, [9.0] * 6)]
    rows += [(2000, None), (2001, [1.0, None] * 3), (2020, [float("inf")] * 6), (2003, [1e30] * 6), (2040, [0.25, 0.25])]
    d = spark.createDataFrame([(*r, 0, 0) for r in rows], "vec_id long, embedding array<float>, block int, rank int")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(d).collect())
    assert got == expected(rows)


def test_blocks():
    first, blocks = topk.packed_blocks(np.array([3, 4, 0, 25, 2, 9]), 10)
    assert first.tolist() == [0, 0, 0, 1, 4, 5] and blocks.tolist() == [1, 1, 1, 3, 1, 1]
    assert topk.block_spans(np.array([True, False, False, True, False, True]), first, blocks) == [(0, 3), (5, 5)]
