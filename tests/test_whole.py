"""Operators do the whole job: nothing is left out by a block, a cap or a stop."""

import numpy as np

from kinfold.operators import candidates


def test_nearest_is_whole(spark, monkeypatch):
    """Against brute force over all rows, on several blocks; ties go by id."""
    monkeypatch.setattr(candidates, "TILE", 40)
    r = np.random.default_rng(5)
    vec = np.concatenate([r.normal(size=(150, 8)), np.zeros((2, 8))])
    vec[20:26] = vec[20]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vec)], "id long, vec array<double>")
    norm = np.linalg.norm(vec, axis=1)
    both = np.outer(norm, norm)
    d = np.round(np.where(both == 0, 1.0, np.clip(1 - vec @ vec.T / np.where(both == 0, 1, both), 0, 2)), 9)
    want = {(i, j, n + 1) for i in range(len(vec)) for n, j in enumerate(sorted((j for j in range(len(vec)) if j != i), key=lambda j: (d[i, j], j))[:5]) if d[i, j] <= 0.9}
    assert {(x["id"], x["other"], x["rank"]) for x in candidates.nearest(rows, 5, 0.9).collect()} == want
    assert candidates.nearest(rows.limit(0), 5, 0.9).count() == 0
