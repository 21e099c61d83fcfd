from __future__ import annotations

import numpy as np
import pytest

from reviewloom.llm import topk


@pytest.mark.parametrize("count, dims, spread", [(3, 4, 1), (60, 3, 1), (700, 16, 30), (900, 5, 2)])
def test_lists_keep_the_best(count, dims, spread):
    rng = np.random.default_rng(count)
    points, queries = (np.floor(rng.normal(0, spread, (n, dims))).astype(np.int64) for n in (count, 40))
    own = np.zeros((40, count), bool)
    own[np.arange(min(40, count)), np.arange(min(40, count))] = True
    kept = topk.SortedLists(points).top(queries, 5, own)
    scores = (queries @ points.T).astype(float)
    scores[own] = -np.inf
    for i in range(40):
        order = np.lexsort((np.arange(count), -scores[i]))[:5]
        assert set(order[scores[i][order] > -np.inf]) <= set(kept[i]) and not set(np.flatnonzero(own[i])) & set(kept[i])


def test_search_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "VECTORS", 100)
    monkeypatch.setattr(topk, "QUERIES", 7)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.round(rng.normal(0, 0.1, 6), 2)], 0) for i in range(900)]
    rows += [(i + 1, v, 1) for i, v, _ in rows[::50]]  # repeated ids with copies of the queries' vectors
    rows += [(2000, None, 0), (2001, [], 0), (2050, [1.0, None], 0), (2100, [float("nan")] * 6, 0), (2150, [float("inf")] + [0.0] * 5, 0),
             (None, [1.0] * 6, 0), (2200, [0.5] * 3, 0), (2201, [0.25] * 3, 0), (2300, [0.5] * 2, 0), (2400, [9e5] * 6, 0), (2450, [2e6] * 6, 0), (2451, [2.0 ** 20, 0.0, 0.0, 0.0, 0.0, -1.0], 0), (2452, [-1e7, 3e7, 0.5, 0.0, 0.0, 1.0], 0),
             (2500, [2e6, -7.0, 0.25, 0.0, 0.0, 0.0], 0), (50, [0.75, 0.5, 0.25, -0.5, 0.5, -1.0], 0)]  # one id, two different vectors
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int").repartition(5)
    good = [(i, [int(np.floor(x * 256)) for x in v]) for i, v, _ in rows
            if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, a in sorted({(i, tuple(x)) for i, x in good}):
        if q % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q and len(a) == len(b))[:5]
            want += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    got = [tuple(r) for r in topk.top_k(df).collect()]
    assert sorted(got) == sorted(want)
    assert topk.top_k(df.limit(0)).count() == 0


def test_vectors_of_any_length(spark):
    """Components of 2^20 and more take part, and far larger ones too, as long as the scores fit."""
    rows = [(0, [1.0, 0.0]), (1, [2.0 ** 20, 0.0]), (2, [0.5, 0.0]), (3, [2.0 ** 40, 5.0]), (4, [-(2.0 ** 44), 0.0]), (5, [0.0, 1e300])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["rank"], r.vec_id, r.score) for r in topk.top_k(df).orderBy("rank").collect()]
    assert got == [(1, 3, 2 ** 56), (2, 1, 2 ** 36), (3, 2, 2 ** 15), (4, 5, 0), (5, 4, -(2 ** 60))]
    with pytest.raises(Exception, match="too large for a long"):
        topk.top_k(spark.createDataFrame([(0, [1e300]), (1, [1.0])], "vec_id long, embedding array<double>")).collect()
    low = spark.createDataFrame([(0, [1.0]), *((i, [0.5]) for i in range(1, 6)), (6, [-1e300])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in topk.top_k(low).orderBy("rank").collect()] == [1, 2, 3, 4, 5]  # not among the best, so no error
