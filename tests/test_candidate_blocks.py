"""Candidate pairs on several blocks and partitions: nearest rows by brute force, each pair of a family once."""

import itertools

import numpy as np
import pytest

from kinfold.operators import candidates


@pytest.fixture(params=[True, False])
def merged(spark, request):
    """Partitions after a shuffle joined into few, or left as they are."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, str(request.param).lower())
    yield
    spark.conf.set(key, before)


def test_nearest_in_any_partitions(spark, monkeypatch, merged):
    monkeypatch.setattr(candidates, "TILE", 15)
    vec = np.random.default_rng(8).normal(size=(90, 6))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vec)], "id long, vec array<double>")
    u = vec / np.linalg.norm(vec, axis=1)[:, None]
    d = np.round(np.clip(1 - u @ u.T, 0, 2), 9)
    want = {(i, j) for i in range(90) for j in sorted((j for j in range(90) if j != i), key=lambda j: (d[i, j], j))[:3]}
    assert {(r["id"], r["other"]) for r in candidates.nearest(rows, 3, 2.0).collect()} == want


def test_each_pair_of_a_family_once(spark, monkeypatch, merged):
    monkeypatch.setattr(candidates, "BLOCK", 4)
    g = np.random.default_rng(2)
    views = [(int(i), int(f)) for i, f in {(i, f) for i, f in g.integers(0, (40, 5), (120, 2)).tolist()}] + [(3, None), (None, 2), (99, None)]
    views += views[:5]
    of = {}
    for i, f in views:
        if i is not None and f is not None:
            of.setdefault(i, set()).add(f)
    want = sorted((a, b) for a, b in itertools.combinations(sorted(of), 2) if of[a] & of[b])
    rows = spark.createDataFrame(views, "id long, family long")
    assert sorted(map(tuple, candidates.same_family(rows).collect())) == want
    vec = spark.createDataFrame([(i, g.normal(size=4).tolist()) for i in range(45)], "id long, vec array<double>")
    near = {(min(r["id"], r["other"]), max(r["id"], r["other"])) for r in candidates.nearest(vec, 3, 1.0).collect()}
    got = sorted(map(tuple, candidates.candidate_pairs(rows, vec, 3, 1.0, [(1, 2), (2, 1), (99, 3), (1, 1000)]).collect()))
    assert got == sorted({*want, *near, (1, 2), (3, 99)})
