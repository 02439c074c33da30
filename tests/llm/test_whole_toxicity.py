"""Every telling word is learned, however many there are."""

import random

from pyspark.sql import functions as F

from kinfold.llm import toxicity


def test_every_insult_is_learned(spark):
    """60 insults, each in 1.7% of the toxic texts, none near another."""
    r = random.Random(3)
    name = lambda k: "".join(r.choice("jkqvwxyz") + r.choice("aeiou") for _ in range(k))
    insults = [name(4) for _ in range(60)]
    text = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(20))
    dealt = r.sample(insults * 20, 1200)
    rows = [(i, f"{text()} {w} {text()}.", 1) for i, w in enumerate(dealt)] + [(i, f"{text()}.", 0) for i in range(6000, 9000)]
    table = spark.createDataFrame(rows, "id long, text string, y int")
    model = toxicity.train(table)
    docs = spark.createDataFrame([(k, f"{text()} {w} {text()}.") for k, w in enumerate(insults)] + [(100 + k, text()) for k in range(60)], "doc_id long, text string")
    out = {x["doc_id"]: x["predicted"] for x in toxicity.scores(docs, model, F.lit(False)).collect()}
    assert sum(out[k] for k in range(60)) == 60 and sum(out[100 + k] for k in range(60)) <= 1
