"""Nearest fingerprints: what is shuffled grows with the rows, not with pairs of tiles; odd rows as in SQL."""

import time

import duckdb
import numpy as np
import pandas as pd
import pytest

from kinfold import registry
from kinfold.operators import candidates


def _shuffled(spark) -> int:
    """Bytes that all tasks until now have written to shuffles."""
    time.sleep(0.5)
    spark.range(1).rdd.count()  # a task that ends later, with which the sums are brought up to date
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    each = sc.statusStore().executorList(False)
    return sum(each.apply(i).totalShuffleWrite() for i in range(each.size()))


def test_shuffles_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(candidates, "TILE", 40)
    vec = np.random.default_rng(4).normal(size=(1200, 8))
    wrote = []
    for n in (300, 1200):
        rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vec[:n])], "id long, vec array<double>")
        before = _shuffled(spark)
        assert candidates.nearest(rows, 3, 2.0).count() == 3 * n
        wrote.append(_shuffled(spark) - before)
    assert 0 < wrote[1] < 6 * wrote[0], wrote


def test_shuffles_of_pairs_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(candidates, "TILE", 40)
    vec = np.random.default_rng(7).normal(size=(1200, 8))
    wrote = []
    for n in (300, 1200):
        rows = spark.createDataFrame([(i, i % 97, v.tolist()) for i, v in enumerate(vec[:n])], "id long, family long, vec array<double>")
        before = _shuffled(spark)
        assert candidates.candidate_pairs(rows.select("id", "family"), rows.select("id", "vec"), 3, 2.0).count() > n
        wrote.append(_shuffled(spark) - before)
    assert 0 < wrote[1] < 6 * wrote[0], wrote


@pytest.mark.parametrize("name", ["fingerprint_knn", "candidate_pairs"])
def test_odd_rows_give_the_twins_pairs(spark, monkeypatch, tmp_path, name):
    monkeypatch.setattr(candidates, "TILE", 30)
    monkeypatch.setattr(candidates, "STEP", 16)
    monkeypatch.setattr(candidates, "MEASURED", 100)
    g = np.random.default_rng(6)
    vec = g.integers(-2, 3, (140, 5)).astype("float32")  # many ties
    vec[10:60] = vec[10]  # copies
    vec[60:63] = 0
    ids = [*range(-30, 100), *range(-5, 5)]  # ids that repeat, with other vectors
    rows = [(i, v.tolist(), 0) for i, v in zip(ids, vec)] + [(None, vec[0].tolist(), 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    duck = duckdb.connect()
    duck.register("embeddings", pd.DataFrame(rows, columns=["vec_id", "embedding", "label"]).astype({"vec_id": "Int64"}))
    want = duck.sql(registry.ORACLE_SQL[name]).fetchall()
    assert want and sorted(map(tuple, registry.QUERIES[name](spark, str(tmp_path)).collect())) == sorted(want)


def test_ids_of_text_and_partitions_without_rows(spark, monkeypatch):
    monkeypatch.setattr(candidates, "TILE", 7)
    vec = np.random.default_rng(9).integers(-1, 2, (40, 4)).astype(float)
    vec[:, 0] = 1
    names = [f"{'é' if i % 3 else 'z'}{i}" for i in range(40)]
    u = vec / np.linalg.norm(vec, axis=1)[:, None]
    d = np.round(np.clip(1 - u @ u.T, 0, 2), 9)
    want = {(names[i], names[j]) for i in range(40) for j in sorted((j for j in range(40) if j != i), key=lambda j: (d[i, j], names[j]))[:4]}
    rows = spark.createDataFrame([(n, v.tolist()) for n, v in zip(names, vec)], "id string, vec array<double>")
    assert {(r["id"], r["other"]) for r in candidates.nearest(rows, 4, 2.0).collect()} == want
