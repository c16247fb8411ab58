from __future__ import annotations

import numpy as np
import pytest

from tests.llm.test_duplicates import ODD, vectors
from treeline.llm import topk


def brute(rows, k=10, every=100):
    use = [(i, v) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    use = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in use]
    out = []
    for a, (q, x) in enumerate(use):
        if q % every == 0:
            scored = sorted((-sum(s * t for s, t in zip(x, y)), c) for b, (c, y) in enumerate(use) if b != a and len(x) == len(y))
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard", [40, 8192])
def test_top_k_against_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(topk, "SHARD", shard)
    monkeypatch.setattr(topk, "LEAF", 8)
    monkeypatch.setattr(topk, "BLOCK", 3)
    rows = vectors() + ODD + [(7, [0.0] * 16), (200_000, [0.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(df).collect())) == brute(rows)


def test_large_numbers_stay_exact():
    v = np.array([[2.0**40, 1.0], [2.0**40, 2.0], [2.0**40, 3.0]])
    tree = topk.BallTree(v)
    ids = tree.order
    assert tree.top(np.array([2.0**40, 1.0]), 2, -np.inf, ids, -1, ids) == [(2**80 + 3, -2), (2**80 + 2, -1)]


def test_fewer_than_k_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(df).collect()] == [(0, 1, 1, 1024 * 2048)]
    assert topk.top_k(df.limit(0)).count() == 0


def test_components_that_overflow_take_no_part_and_large_ones_do(spark):
    df = spark.createDataFrame([(0, [1e306]), (100, [1e300]), (1, [1.0]), (2, [-1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(df).collect()] == [(100, 1, 1, 2**63 - 1), (100, 2, 2, -(2**63))]
