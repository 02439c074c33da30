"""Every query with a DuckDB twin gives the twin's rows on the smallest tables."""

import os

import duckdb
import pytest

from kinfold import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_twin(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    twin = duck.sql(registry.ORACLE_SQL[name])
    names = sorted(df.columns)
    assert names == sorted(twin.columns)
    at = [twin.columns.index(n) for n in names]
    assert ordered(tuple(r[n] for n in names) for r in df.collect()) == ordered(tuple(r[i] for i in at) for r in twin.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_reruns_agree(spark, name):
    key = lambda rows: sorted(map(str, rows))
    first = registry.QUERIES[name](spark, DATA).collect()
    assert first
    if name != "function_library_status":
        assert key(first) == key(registry.QUERIES[name](spark, DATA).collect())
    else:
        assert len(first) == 100 and all(r["errors"] == r["unstable"] == 0 for r in first)
