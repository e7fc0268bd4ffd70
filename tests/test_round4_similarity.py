"""Best products of two blocks of vectors: exact, and without all products in memory."""

import tracemalloc

import numpy as np
import pandas as pd

from cuewise.operators import similarity


def test_best_products_keep_nothing_but_the_best():
    rng = np.random.default_rng(3)
    left, right = rng.normal(size=(3000, 4)), rng.normal(size=(4000, 4))
    rows, references = pd.DataFrame({"_vector": range(3000), "embedding": list(left)}), pd.DataFrame({"ref_vector": list(right)})
    tracemalloc.start()
    found = similarity._best_products(3)(rows, references)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = np.sort(left @ right.T, axis=1)[:, -3:]
    assert found["_vector"].tolist() == list(range(3000))
    assert np.allclose(np.sort(np.vstack(found["_top"].to_numpy()), axis=1), want)
    assert peak < 40 << 20  # all the products take 96 MB


def test_mean_of_the_highest_with_fewer_references_than_asked_and_with_none(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], "id int, embedding array<double>")
    sets = [(np.array([[1.0, 1.0], [3.0, 1.0]]), 8), (np.empty((0, 0)), 8), (np.array([[1.0, 1.0], [3.0, 1.0]]), 1)]
    found = {r["id"]: r["m"] for r in rows.select("id", similarity.top_means(rows["embedding"], sets).alias("m")).collect()}
    assert found == {1: [2.0, 0.0, 3.0], 2: [2.0, 0.0, 2.0]}
