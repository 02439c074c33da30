"""Name overlap by blocks of rows whose scores are the same: every pair of SQL, at odd rows and beyond one block."""

import duckdb
import pandas as pd

from kinfold import registry
from kinfold.operators import judges


def test_odd_rows_give_the_twins_pairs(spark, tmp_path):
    names = ["red bolt", "bolt red", "red", "", None, "RED-bolt bolt", "5 red", "17 5 bolt", "5", "red bolt", "é bolt", "-- "]
    rows = [(k, n, b, z) for i, n in enumerate(names) for k in (i, i + 12, 5, -5, None) for b, z in (("x", 1), ("y", 1), (None, 2), ("x", None))]
    part = pd.DataFrame(rows, columns=["p_partkey", "p_name", "p_brand", "p_size"]).astype({"p_partkey": "Int64", "p_size": "Int64"})
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = registry.QUERIES["name_match_jaccard"](spark, str(tmp_path)).select("a", "b", "score", "mergeable").collect()
    duck = duckdb.connect()
    duck.register("part", part)
    want = duck.sql(registry.ORACLE_SQL["name_match_jaccard"]).fetchall()
    assert want and sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_pairs_across_blocks_and_tasks(spark):
    rows = spark.range(101).selectExpr("id", "concat('w', id % 3, ' all ', id) AS text", "1 AS g")
    blocks = judges.name_blocks(rows, ["g"], least=7)
    assert 3 * 5 * 3 * 5 / 2 <= blocks.count() <= 200  # scores are counted for blocks, not for 5,050 pairs
    got = {(r["a"], r["b"]): r["score"] for r in judges.expanded(blocks).collect()}
    assert got == {(a, b): 2 / 4 if a % 3 == b % 3 else 1 / 5 for a in range(101) for b in range(a + 1, 101)}
    assert judges.expanded(blocks).count() == 5050
