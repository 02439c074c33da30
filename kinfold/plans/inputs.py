"""How the queries see the driver's tables as the data of this engine, once for Spark and once for DuckDB.

embeddings are 8x8 probes; labels give designed and predicted relations of
pairs; events are action logs and usage; documents, parts and benchmark are
text; suppliers, parts and orders are study points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compare

USED = ("brightness_add_10", "flip_vertical", "identity", "invert", "posterize_4", "posterize_7", "rotate_180", "threshold_128")
NAMES = "CASE {} WHEN 0 THEN 'EXACT' WHEN 1 THEN 'PERCEPTUAL' WHEN 2 THEN 'SUBSUMPTION' WHEN 3 THEN 'SEMANTIC_PRESERVING' WHEN 4 THEN 'COMPLEMENTARY' WHEN 5 THEN 'DISTINCT' ELSE 'UNCERTAIN' END"
TRUE = NAMES.format("CAST(doc_id % 6 AS INT)")
GUESS = NAMES.format("CAST(CASE WHEN doc_id % 4 <> 0 THEN doc_id % 6 ELSE doc_id % 7 END AS INT)")
KIND = "CASE event_type WHEN 'click' THEN 'merge' WHEN 'view' THEN 'modify' WHEN 'purchase' THEN 'remove' WHEN 'signup' THEN 'parameterize' ELSE 'end' END"

TRUTH_SQL = f"truth AS (SELECT doc_id AS a, doc_id + 1000000 AS b, {TRUE} AS relation, toxic = 1 AS hard FROM labels)"
PRED_SQL = f"pred AS (SELECT a, b, relation, relation IN ('EXACT', 'PERCEPTUAL') AS mergeable FROM (SELECT doc_id AS a, doc_id + 1000000 AS b, {GUESS} AS relation FROM labels WHERE quality = 1 OR doc_id % 3 = 0))"
TEXT_SQL = "text_pred AS (SELECT l.doc_id AS a, l.doc_id + 1000000 AS b, d.n_chars % 2 = 0 AS mergeable FROM labels l JOIN documents d USING (doc_id))"
BOTH_SQL = f"{TRUTH_SQL}, {PRED_SQL}, compared AS (SELECT t.a, t.b, t.relation AS truth, t.hard, p.relation AS pred, p.mergeable AS merge FROM truth t JOIN pred p USING (a, b))"
PROBES_SQL = "probes AS (SELECT vec_id AS probe_id, list_transform(embedding, lambda x: CAST(floor(least(greatest((CAST(x AS DOUBLE) + 1) / 2, 0.0), 1.0) * 255) AS INT)) AS px FROM embeddings)"
SKILL_SQL = {
    "identity": "{0}",
    "invert": "list_transform({0}, lambda v: 255 - v)",
    "rotate_180": "list_reverse({0})",
    "flip_vertical": "list_transform(range(0, 64), lambda i: {0}[(7 - i // 8) * 8 + i % 8 + 1])",
    "threshold_128": "list_transform({0}, lambda v: CASE WHEN v > 128 THEN 255 ELSE 0 END)",
    "posterize_4": "list_transform({0}, lambda v: (v // 16) * 16)",
    "posterize_7": "list_transform({0}, lambda v: (v // 2) * 2)",
    "brightness_add_10": "list_transform({0}, lambda v: least(v + 10, 255))",
}
QUAD = "list_transform([{0}], lambda i: CAST({1}[i] AS DOUBLE))"
_q = lambda r, c: ", ".join(str(8 * y + x + 1) for y in range(r, r + 4) for x in range(c, c + 4))


def quadrants_sql(px: str) -> str:
    return "[" + ", ".join(f"list_sum({QUAD.format(_q(r, c), px)}) / 16" for r in (0, 4) for c in (0, 4)) + "]"


def dot_sql(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: CAST({a}[i] AS DOUBLE) * CAST({b}[i] AS DOUBLE)))"


def cosine_sql(a: str, b: str) -> str:
    return f"CASE WHEN sqrt({dot_sql(a, a)}) * sqrt({dot_sql(b, b)}) = 0 THEN 1.0 ELSE least(greatest(1 - {dot_sql(a, b)} / (sqrt({dot_sql(a, a)}) * sqrt({dot_sql(b, b)})), 0.0), 2.0) END"


DIFF = "list_transform(range(1, 65), lambda i: abs({0}[i] - {1}[i]))"


def out_sql(skills: dict[str, str]) -> str:
    """The tables ``probes`` and ``outs`` of functions given as expressions of ``{0}``."""
    return PROBES_SQL + ", outs AS (" + " UNION ALL ".join(f"SELECT probe_id, '{s}' AS skill, {sql.format('px')} AS px FROM probes" for s, sql in skills.items()) + ")"


def dist_sql(skills: dict[str, str]) -> str:
    """Those and ``dists``, what the outputs of each pair differ by."""
    return (
        out_sql(skills) + ", feats AS (SELECT *, " + quadrants_sql("px") + " AS q FROM outs), "
        + "dists AS (SELECT x.probe_id, x.skill AS a, y.skill AS b, list_max(" + DIFF.format("x.px", "y.px") + ") / 255.0 AS l_inf, list_sum(" + DIFF.format("x.px", "y.px") + ") / (64 * 255.0) AS perceptual, "
        + cosine_sql("x.q", "y.q") + " AS semantic, x.px = y.px AS same FROM feats x JOIN feats y ON x.probe_id = y.probe_id AND x.skill < y.skill)"
    )


OUT_SQL = out_sql({s: SKILL_SQL[s] for s in USED})
DIST_SQL = dist_sql({s: SKILL_SQL[s] for s in USED})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.probes(table(spark, sf_dir, "embeddings"))


def dists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.distances(compare.paired(battery(spark, sf_dir), USED))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1000000).alias("b"), F.expr(TRUE).alias("relation"), (F.col("toxic") == 1).alias("hard"))


def pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").where("quality = 1 OR doc_id % 3 = 0").select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1000000).alias("b"), F.expr(GUESS).alias("relation"))
    return rows.withColumn("mergeable", F.col("relation").isin("EXACT", "PERCEPTUAL"))


def text_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    return rows.select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1000000).alias("b"), (F.col("n_chars") % 2 == 0).alias("mergeable"))


def r6(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


