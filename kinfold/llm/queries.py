"""The queries of this subpackage and, where SQL can say the same, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bagminhash, decontaminate, exact_dedup, html_extract, mixing, periodic_runs, quality, secrets, sentence_spans, shingle_join, token_alignment, toxicity, warc
from ._work import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_warc(table(spark, sf_dir, "pages"))
    records = warc.read_warc(spark, archives).where("kind = 'record'")
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = secrets.train_markov(secrets.training_sample(spark))
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents"), model))


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = html_extract.train(html_extract.training_pages())
    return html_extract.extract(table(spark, sf_dir, "pages"), model)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def op5_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.classes(table(spark, sf_dir, "documents"))


def op6_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_spans.drop_repeated_spans(table(spark, sf_dir, "documents"))


def fold(column: str, parts: int) -> Column:
    """The remainder of the checksum of an id written as text."""
    return F.crc32(F.col(column).cast("string")) % parts


def toxicity_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> toxicity.Model:
    return toxicity.train(toxicity.labelled(docs, table(spark, sf_dir, "labels"), fold("id", 5) != 0))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity_model(spark, sf_dir, docs), fold("doc_id", 5) == 0)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(quality.labelled(docs, table(spark, sf_dir, "labels"), "quality", fold("id", 3) != 1))
    return quality.scores(docs, model, fold("doc_id", 3) == 1)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = periodic_runs.rewritten(F.col("doc_id"), F.col("text"))
    return periodic_runs.digest(periodic_runs.periodic_runs(docs, "doc_id", text))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignment(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op13_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.join(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_secrets": op2_secrets,
    "op3_html_extract": op3_html_extract,
    "op4_mixing": op4_mixing,
    "op5_bagminhash": op5_bagminhash,
    "op6_sentence_spans": op6_sentence_spans,
    "op7_toxicity": op7_toxicity,
    "op8_decontamination": op8_decontamination,
    "op9_quality": op9_quality,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_token_alignment": op12_token_alignment,
    "op13_shingle_join": op13_shingle_join,
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
        bits AS (SELECT *, list_aggregate(list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (instr('0123456789abcdef', substr(hex, i, 1)) - 1) + 1, 4)), 'string_agg', '') AS b FROM p),
        named AS (SELECT *, list_aggregate(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
            + 16 * CAST(substr(b, 5 * k + 1, 1) AS INT) + 8 * CAST(substr(b, 5 * k + 2, 1) AS INT) + 4 * CAST(substr(b, 5 * k + 3, 1) AS INT) + 2 * CAST(substr(b, 5 * k + 4, 1) AS INT) + CAST(substr(b, 5 * k + 5, 1) AS INT), 1)), 'string_agg', '') AS digest,
            min(page_id) OVER (PARTITION BY hex) AS head FROM bits)
        SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, digest AS payload_digest,
            CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = head THEN NULL ELSE head END AS refers_to
        FROM named""",
    "op10_exact_dedup": """
        WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
        SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g USING (t)""",
}
