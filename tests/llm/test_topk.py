"""Exact top-k against all inner products."""

import random

import pytest

from rollcall.llm import queries, topk

F = topk.F


def brute(rows, k=5):
    import math

    sound = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in sorted(sound):
        asked.setdefault(i, v)
    most = (1 << 63) - 1
    out = []
    for q, a in asked.items():
        if q % 50 == 0:
            scores = sorted((-max(-most - 1, min(most, sum(x * y for x, y in zip(a, v)))), i) for i, v in sound if i != q)
            exact = sorted((-sum(x * y for x, y in zip(a, v)), i) for i, v in sound if i != q)[:k]
            out += [(q, r + 1, i, max(-most - 1, min(most, -s))) for r, (s, i) in enumerate(exact)]
            assert len(scores) >= len(exact)
    return sorted(out)


def found(spark, rows, **sizes):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    return sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0, **sizes).collect()))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    draw = random.Random(seed)
    rows = [(i, [draw.choice([draw.gauss(0, 1), 0.5]) for _ in range(40)]) for i in range(400)]
    rows += [(1000 + i, [0.25] * 40) for i in range(30)]  # ties
    assert found(spark, rows, queries=3, candidates=50) == brute(rows)
    assert found(spark, rows) == brute(rows)


def test_edges(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (50, []), (100, [float("nan")]), (150, None), (200, [None]), (None, [9.0, 9.0]), (3, [1.0]), (4, [2.0, 2.0, 7.0]),
            (5, [float("inf")]), (6, [-1.0, -1.0]), (6, [-1.0, -1.0])]
    assert found(spark, rows, queries=1, candidates=2) == brute(rows)
    assert found(spark, [(50, [1.0])]) == []
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).count() == 0


def test_products_beyond_a_double(spark):
    rows = [(0, [3e6, 1.0]), (1, [3e6 + 1 / 256, 1.0]), (2, [3e6, 1.5]), (3, [1e30, 0.0]), (4, [-1e30, 0.0])]
    assert found(spark, rows) == brute(rows)


def test_pruning_leaves_candidates_out():
    import numpy as np

    draw = np.random.default_rng(1)
    c = np.floor(256 * draw.normal(size=(3000, 64)) * draw.choice([0.01, 1], (3000, 1)))
    ids = np.arange(3000)
    got = topk.search(c[:5], ids[:5], c, ids, 5)
    scores = c[:5] @ c.T
    for q in range(5):
        want = sorted((-scores[q, i], i) for i in range(3000) if i != q)[:5]
        assert [(i, s) for a, i, s in got if a == q] == [(i, -s) for s, i in want]


def test_registered(spark):
    assert queries.op4_topk(spark, "/root/testdata/sf0.001").columns == ["query_id", "rank", "vec_id", "score"]
