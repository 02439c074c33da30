"""The toxicity stage where there is nothing to learn from."""

from pyspark.sql import functions as F

import corpus_pipeline
from kinfold.llm import toxicity


def test_no_labels_reject_nothing(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one text"), (2, None), (None, ""), (3, "another text")], "doc_id long, text string")
    for labels in ([], [(1, 0, 1), (3, 0, 1)], [(1, 0, 0)]):
        path = f"{tmp_path}/{len(labels)}"
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        kept = corpus_pipeline.clean_toxic(spark, docs, path)
        assert sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))
        rows = toxicity.labelled(docs, spark.read.parquet(f"{path}/labels.parquet"), F.lit(True))
        assert toxicity.train(rows).weights is None
