"""The corpus pipeline: a list of stages, each of which reads what its predecessor kept.

Every stage takes whole rows and returns them with the columns that it was
given, whatever these are called (dots, blanks, backticks and the stage's own
names are fine); only the last adds a column, ``copies``. Defined cases: null
texts count as empty in every stage and stay null; empty texts are equal texts,
so one of them is left after exact dedup; null ids pass through, and among
equal or near texts a row with an id is preferred; rows that repeat are equal
texts. Texts of any length are read whole, each in one task. A stage that gets
no rows returns none; an empty benchmark leaves all documents clean, and
without labelled rows of both kinds toxicity rejects none. A stage's result is
written before the next begins, so a lost executor repeats tasks of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinfold.llm import bagminhash, decontaminate, exact_dedup, mixing, queries, toxicity
from kinfold.llm._work import table, written


def clean_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject. Learned from the labelled rows among ``docs``."""
    return toxicity.drop_toxic(docs, queries.toxicity_model(spark, sf_dir, docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return bagminhash.drop_near(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how often each is repeated in ``copies``."""
    return mixing.mixed(docs)


STAGES = [("toxicity", clean_toxic), ("exact dedup", exact), ("near dedup", near), ("decontamination", benchmark), ("mixing", mix)]

#: The stages hold a trained model and sketches, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
