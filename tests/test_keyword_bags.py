"""Keyword retrieval: rows with the same of the asked tokens are one, whatever their number, with the results of single rows."""

from collections import Counter

from pyspark.sql import functions as F

from kinfold.functions import scalars as S
from kinfold.operators import judges


def test_one_row_a_bag_of_asked_tokens(spark):
    library = spark.range(5000).select((5000 - F.col("id")).alias("pos"), F.format_string("part%d", "id").alias("id"), F.concat(F.lit("the red bolt of "), F.col("id").cast("string"), F.when(F.col("id") % 2 == 0, " blue").otherwise("")).alias("text"))
    asked = spark.createDataFrame([("the",), ("of",), ("blue",), ("the",), ("gone",)], "token string")
    got = {tuple(r["bag"]): (-r["t"]["order"], r["t"]["id"]) for r in judges.stand_ins(library, asked).collect()}
    assert got == {("of", "the"): (1, "part4999"), ("blue", "of", "the"): (2, "part4998")}


def test_as_row_by_row(spark):
    words = ["the", "of", "red", "bolt", "blue", "x", "nut", "large"]
    text = lambda i: " ".join(w for k, w in enumerate(words) if (i * 37 + i // 5) >> k & 1) or None
    rows = [(i % 90, f"p{i % 60}", text(i)) for i in range(200)] + [(None, "none", "the of red bolt blue nut large")]
    asks = [(i % 25, text(3 * i + 1)) for i in range(30)] + [(77, "nothing of it" * 0), (78, "zebra")]
    library, queries = spark.createDataFrame(rows, "pos long, id string, text string"), spark.createDataFrame(asks, "query_id long, text string")
    split = lambda df, *keys: [(*r[:-1], t) for r in df.select(*keys, S.tokens(F.col("text"), 2).alias("t")).collect() for t in r["t"] or ()]
    hits = Counter((q, p, i) for q, t in split(queries, "query_id") for p, i, u in split(library, "pos", "id") if t == u)
    best = {}
    for (q, p, i), n in hits.items():
        best[q] = max(best.get(q, ((-1,),)), ((n, p is not None, -(p or 0), i), i, n))
    want = sorted((q, *(best[q][1:] if q in best else (None, 0))) for q, _ in asks)
    assert sorted(map(tuple, judges.keyword_retrieval(queries, library).collect()), key=str) == sorted(want, key=str)
