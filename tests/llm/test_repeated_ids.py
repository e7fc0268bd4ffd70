"""Searches where one id has several vectors, and scores beyond 64 bits."""

import numpy as np
from pyspark.sql import functions as F

from cuewise.llm import covertree, forest

SCHEMA = "vec_id long, embedding array<double>"


def rows():
    rng = np.random.default_rng(5)
    out = [(int(i), rng.normal(size=6).round(3).tolist()) for i in rng.integers(0, 40, 400)]
    # one id crowds the neighbourhood of query 0
    return out + [(0, [1.0] * 6)] + [(7, [1.0 + k / 100] * 5 + [0.9]) for k in range(12)]


def brute(data, measure, k=5):
    want = {}
    for q in {i for i, _ in data if i % 50 == 0}:
        best = {}
        for i, v in data:
            if i != q:
                best[i] = max([best.get(i, -np.inf), *(measure(u, v) for j, u in data if j == q)])
        want[q] = sorted(((i, s) for i, s in best.items()), key=lambda p: (-p[1], p[0]))[:k]
    return want


def found(frame):
    got = {}
    for r in frame.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return got


def test_top_k_counts_an_id_once(spark):
    data = rows()
    want = brute(data, lambda a, b: int(np.floor(256 * np.array(a)) @ np.floor(256 * np.array(b))))
    assert found(covertree.top_k(spark.createDataFrame(data, SCHEMA), lambda x: F.floor(F.lit(256.0) * x), lambda i: i % 50 == 0)) == want


def test_dual_search_with_repeated_ids():
    rng = np.random.default_rng(3)
    data, ids = rng.integers(-50, 50, (700, 4)), rng.integers(0, 60, 700)
    queries, names = rng.integers(-50, 50, (150, 4)), rng.integers(0, 60, 150)
    scores, got = covertree.dual_search(queries, names, data, ids, 5)
    for n in range(len(queries)):
        best = {}
        for i, s in zip(ids.tolist(), (data @ queries[n]).tolist()):
            if i != names[n]:
                best[i] = max(s, best.get(i, s))
        assert list(zip(got[n].tolist(), scores[n].tolist())) == sorted(best.items(), key=lambda p: (-p[1], p[0]))[:5]


def test_scores_beyond_64_bits(spark):
    data = [(0, [1e300, 1.0]), (1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [1.0, 1.0])]
    got = found(covertree.top_k(spark.createDataFrame(data, SCHEMA), lambda x: F.floor(F.lit(256.0) * x), lambda i: i % 50 == 0))
    assert [i for i, _ in got[0]] == [1, 3, 2] and got[0][0][1] == 2 ** 63 - 1 and got[0][2][1] == 1 - 2 ** 63


def test_nearest_counts_an_id_once(spark):
    data = rows()

    def cosine(a, b):
        a, b = np.array(a), np.array(b)
        return float(a @ b / np.sqrt((a @ a) * (b @ b)))

    want = brute(data, cosine)
    got = found(forest.nearest(spark.createDataFrame(data, SCHEMA), lambda i: i % 50 == 0))
    assert {q: [i for i, _ in r] for q, r in got.items()} == {q: [i for i, _ in r] for q, r in want.items()}
    assert forest.nearest(spark.createDataFrame([], SCHEMA), lambda i: i % 50 == 0).count() == 0
