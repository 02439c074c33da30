import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.operators import judges, studies
from kinfold.operators._order import running


@pytest.fixture
def ranges(spark):
    """Small tables in several ranges."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_running_totals_cross_ranges(ranges):
    x = np.random.default_rng(4).permutation(3000)
    df = ranges.createDataFrame([(int(v), int(v * 7919 % 1013), "kept") for v in x], "at int, v int, name string")
    up = running(df, [F.col("at")], {"s": F.col("v")}).orderBy("at").toPandas()
    assert (up["s"] == up["v"].cumsum()).all() and list(up.columns) == ["at", "v", "name", "s"]
    down = running(df, [F.col("at").desc()], {"m": F.col("v")}, F.max).orderBy(F.col("at").desc()).toPandas()
    assert (down["m"] == down["v"].cummax()).all()
    assert running(df.limit(0), [F.col("at")], {"s": F.col("v")}).count() == 0


def test_front_of_two_goals(ranges):
    g = np.random.default_rng(5)
    rows = [(float(a), float(b)) for a, b in g.integers(0, 60, (900, 2))]
    rows += [(70.0, 3.0), (70.0, 3.0), (70.0, 2.0)]
    want = sorted(p for p in rows if not any(q[0] >= p[0] and q[1] >= p[1] and q != p for q in rows))
    got = studies.pareto_front(ranges.createDataFrame(rows, "x double, y double"), ["x", "y"])
    assert sorted(map(tuple, got.collect())) == want


def test_similar_pairs_lose_none(spark):
    g = np.random.default_rng(6)
    rows = [(i, " ".join(f"w{min(int(k), 40)}" for k in g.zipf(1.5, 8))) for i in range(120)] + [(120, ""), (121, None)]
    weights = judges.tfidf(spark.createDataFrame(rows, "id long, text string"))
    w = {}
    for r in weights.collect():
        w.setdefault(r["id"], {})[r["token"]] = r["w"]
    dots = {(a, b): sum(v * w[b].get(t, 0.0) for t, v in w[a].items()) for a in w for b in w if a < b}
    for least in (0.2, 0.6, 0.9):
        found = {(r["a"], r["b"]) for r in judges.similar_pairs(weights, least).collect()}
        assert {p for p, s in dots.items() if s >= least} <= found
        assert len(found) < len(dots)
