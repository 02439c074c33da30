"""The registered queries over the driver's tables, each with its DuckDB twin where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import images
from ..functions import scalars as S
from ..operators import calibrate, candidates, compare, gating, graph, judges, metrics, planning, studies
from . import inputs as I
from .inputs import r6, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def keep(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


# ---- execute and compare -------------------------------------------------------------------------------------------


@query("pair_worst_case", f"WITH {I.DIST_SQL} SELECT a, b, round(max(l_inf), 6) AS worst, min(probe_id) FILTER (WHERE l_inf = m) AS worst_probe, count(*) AS n_probes FROM (SELECT *, max(l_inf) OVER (PARTITION BY a, b) AS m FROM dists) GROUP BY a, b")
def pair_worst_case(spark: SparkSession, d: str) -> DataFrame:
    return r6(compare.worst_case(I.dists(spark, d)), "worst")


@query("pair_p90_mean", f"WITH {I.DIST_SQL} SELECT a, b, round(quantile_cont(l_inf, 0.9), 6) AS q, round(avg(l_inf), 6) AS mean FROM dists GROUP BY a, b")
def pair_p90_mean(spark: SparkSession, d: str) -> DataFrame:
    return r6(compare.spread(I.dists(spark, d)), "q", "mean")


@query("pair_hash_identical", f"WITH {I.DIST_SQL} SELECT a, b, bool_and(same) AS identical FROM dists GROUP BY a, b")
def pair_hash_identical(spark: SparkSession, d: str) -> DataFrame:
    return compare.hashes_identical(I.dists(spark, d))


_MEASURED = "SELECT a, b, max(l_inf) AS l_inf, max(perceptual) AS perceptual, bool_and(same) AS identical, quantile_cont(semantic, 0.9) AS semantic_q, avg(semantic) AS semantic_mean, count(*) AS n_probes FROM dists GROUP BY a, b"


@query("measure_pairs", f"WITH {I.DIST_SQL} SELECT a, b, round(l_inf, 6) AS l_inf, round(perceptual, 6) AS perceptual, identical, round(semantic_q, 5) AS semantic_q, round(semantic_mean, 5) AS semantic_mean, n_probes FROM ({_MEASURED})")
def measure_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = compare.measured(I.dists(spark, d)).drop("worst_probe")
    return rows.withColumns({"l_inf": F.round("l_inf", 6), "perceptual": F.round("perceptual", 6), "semantic_q": F.round("semantic_q", 5), "semantic_mean": F.round("semantic_mean", 5)})


@query("classify_stop_at_first", f"""WITH {I.DIST_SQL}, m AS ({_MEASURED}) SELECT a, b, CASE WHEN identical OR l_inf <= 1 / 255.0 THEN 'EXACT' WHEN perceptual <= 0.045 THEN 'PERCEPTUAL' WHEN perceptual <= 0.055 THEN 'UNCERTAIN'
    WHEN semantic_q <= 0.135 AND semantic_mean <= 0.15 THEN 'SEMANTIC_PRESERVING' WHEN semantic_q <= 0.165 THEN 'UNCERTAIN' ELSE 'DISTINCT' END AS relation FROM m""")  # fmt: skip
def classify_stop_at_first(spark: SparkSession, d: str) -> DataFrame:
    return compare.measured(I.dists(spark, d)).select("a", "b", compare.relation().alias("relation"))


_BRIGHT = "list_transform(px, lambda v: least(v + {0}, 255))"


@query("subsumption_division", f"""WITH {I.PROBES_SQL}, s AS (SELECT probe_id, k, {_BRIGHT.format('k')} AS px FROM probes, (SELECT unnest([10, 20]) AS k)), g AS (SELECT probe_id, k, {_BRIGHT.format('k')} AS px FROM probes, (SELECT unnest([0, 5, 10, 15, 20, 30]) AS k)),
    pairs AS (SELECT s.k AS sk, g.k AS gk, bool_and(list_max(list_transform(range(1, 65), lambda i: abs(s.px[i] - g.px[i]))) / 255.0 <= 1 / 255.0) AS ok FROM s JOIN g USING (probe_id) GROUP BY 1, 2), each AS (SELECT sk, bool_or(ok) AS ok FROM pairs GROUP BY 1)
    SELECT 'brighten_two' AS s_skill, 'brighten_grid' AS g_skill, bool_and(ok) AS reproduced, count(*) AS bindings, count(*) FILTER (WHERE ok) AS matched FROM each""")  # fmt: skip
def subsumption_division(spark: SparkSession, d: str) -> DataFrame:
    def grid(name: str, values: list[int]) -> DataFrame:
        rows = I.battery(spark, d).select("probe_id", "px", F.explode(F.array(*map(F.lit, values))).alias("binding"))
        return rows.select("probe_id", F.lit(name).alias("skill"), "binding", F.transform("px", lambda v: F.least(v + F.col("binding"), F.lit(255))).alias("px"))

    return compare.subsumption(grid("brighten_two", [10, 20]), grid("brighten_grid", [0, 5, 10, 15, 20, 30]))




_LEVELS = """SELECT o_orderkey, CAST(o_orderkey % 7 > 0 AS INT) * (o_orderkey % 11) AS n_probes, o_orderkey % 13 = 0 AS identical, (o_custkey % 100) / 1000.0 AS l_inf, (o_custkey % 64) / 640.0 AS perceptual,
    (o_custkey % 80) / 320.0 AS semantic_q, (o_orderkey % 40) / 200.0 AS semantic_mean, o_custkey % 2 = 0 AS complementary,
    CASE o_orderkey % 6 WHEN 1 THEN 'MUTUAL_EXACT' WHEN 2 THEN 'MUTUAL' WHEN 3 THEN 'A_SUBSUMES_B' WHEN 4 THEN 'B_SUBSUMES_A' WHEN 5 THEN 'NONE' END AS direction FROM orders"""


@query("classify_all_branches", f"""WITH m AS ({_LEVELS}) SELECT o_orderkey, CASE WHEN n_probes = 0 THEN 'DISTINCT' WHEN direction IS NULL AND (identical OR l_inf <= 1 / 255.0) THEN 'EXACT' WHEN direction IS NULL AND perceptual <= 0.045 THEN 'PERCEPTUAL'
    WHEN direction IS NULL AND perceptual <= 0.055 THEN 'UNCERTAIN' WHEN direction = 'MUTUAL_EXACT' THEN 'EXACT' WHEN direction = 'MUTUAL' THEN 'PERCEPTUAL' WHEN direction IN ('A_SUBSUMES_B', 'B_SUBSUMES_A') THEN 'SUBSUMPTION'
    WHEN semantic_q <= 0.135 AND semantic_mean <= 0.15 THEN 'SEMANTIC_PRESERVING' WHEN semantic_q <= 0.165 THEN 'UNCERTAIN' WHEN complementary THEN 'COMPLEMENTARY' ELSE 'DISTINCT' END AS relation FROM m""")  # fmt: skip
def classify_all_branches(spark: SparkSession, d: str) -> DataFrame:
    """The ordered rule over measured rows of every kind, those of parameterised and complementary pairs too."""
    table(spark, d, "orders").createOrReplaceTempView("_kinfold_orders")
    rows = spark.sql(_LEVELS.replace("FROM orders", "FROM _kinfold_orders").replace("1000.0", "1000.0D").replace("640.0", "640.0D").replace("320.0", "320.0D").replace("200.0", "200.0D"))
    return rows.select("o_orderkey", compare.relation(complementary=F.col("complementary"), direction=F.col("direction")).alias("relation"))


def _grid_sql(name: str, values: str) -> str:
    return f"{name} AS (SELECT probe_id, k, {_BRIGHT.format('k')} AS px FROM probes, (SELECT unnest([{values}]) AS k))"


def _division_sql(spec: str, gen: str) -> str:
    ok = f"SELECT s.k AS sk, g.k AS gk, bool_and(list_max(list_transform(range(1, 65), lambda i: abs(s.px[i] - g.px[i]))) / 255.0 <= 1 / 255.0) AS ok FROM {spec} s JOIN {gen} g USING (probe_id) GROUP BY 1, 2"
    return f"(SELECT bool_and(ok) FROM (SELECT sk, bool_or(ok) AS ok FROM ({ok}) GROUP BY 1))"


@query("subsumption_directions", f"""WITH {I.PROBES_SQL}, {_grid_sql('few', '10, 20')}, {_grid_sql('many', '0, 5, 10, 15, 20, 30')}, {_grid_sql('other', '7, 90')}, {_grid_sql('same', '20, 10')},
    d AS (SELECT 'few' AS a, 'many' AS b, {_division_sql('few', 'many')} AS into_b, {_division_sql('many', 'few')} AS into_a UNION ALL SELECT 'few', 'other', {_division_sql('few', 'other')}, {_division_sql('other', 'few')} UNION ALL SELECT 'few', 'same', {_division_sql('few', 'same')}, {_division_sql('same', 'few')})
    SELECT a, b, CASE WHEN into_a AND into_b THEN 'MUTUAL' WHEN into_a THEN 'A_SUBSUMES_B' WHEN into_b THEN 'B_SUBSUMES_A' ELSE 'NONE' END AS direction FROM d""")  # fmt: skip
def subsumption_directions(spark: SparkSession, d: str) -> DataFrame:
    """Both ways between one grid of brightenings and three others."""
    battery = I.battery(spark, d)

    def grid(name: str, values: list[int]) -> DataFrame:
        rows = battery.select("probe_id", "px", F.explode(F.array(*map(F.lit, values))).alias("binding"))
        return rows.select("probe_id", F.lit(name).alias("skill"), "binding", F.transform("px", lambda v: F.least(v + F.col("binding"), F.lit(255))).alias("px"))

    few = grid("few", [10, 20])
    rest = grid("many", [0, 5, 10, 15, 20, 30]).unionByName(grid("other", [7, 90])).unionByName(grid("same", [20, 10]))
    return compare.directions(compare.subsumption(few, rest).unionByName(compare.subsumption(rest, few)))


def _commute_sql() -> str:
    f = {s: I.SKILL_SQL[s] for s in ("flip_vertical", "invert", "posterize_4", "rotate_180", "threshold_128")}
    rows = []
    for a in sorted(f):
        for b in sorted(f):
            if a < b:
                ab, ba = f"(SELECT {f[b].format('px')} AS px, px AS p0, probe_id FROM probes)", f"(SELECT {f[a].format('px')} AS px, px AS p0, probe_id FROM probes)"
                rows.append(f"SELECT '{a}' AS a, '{b}' AS b, x.probe_id, {f[a].format('x.px')} AS ab, {f[b].format('y.px')} AS ba, y.px AS fa, x.px AS fb, x.p0 AS p0 FROM {ab} x JOIN {ba} y USING (probe_id)")
    return " UNION ALL ".join(rows)


@query("complementary_commute", f"WITH {I.PROBES_SQL}, c AS ({_commute_sql()}) SELECT a, b, round(max(list_max({I.DIFF.format('ab', 'ba')}) / 255.0), 6) AS commute_linf, (max(list_max({I.DIFF.format('fa', 'p0')}) / 255.0) <= 1 / 255.0 OR max(list_max({I.DIFF.format('fb', 'p0')}) / 255.0) <= 1 / 255.0) AS trivial FROM c GROUP BY a, b")
def complementary_commute(spark: SparkSession, d: str) -> DataFrame:
    rows = compare.complementary(I.battery(spark, d), ("flip_vertical", "invert", "posterize_4", "rotate_180", "threshold_128"))
    return r6(rows.select("a", "b", "commute_linf", "trivial"), "commute_linf")


@query("effect_residual_corr", f"""WITH {I.OUT_SQL}, r AS (SELECT o.probe_id, o.skill, list_transform(range(1, 65), lambda i: o.px[i] - p.px[i]) AS e FROM outs o JOIN probes p USING (probe_id)),
    s AS (SELECT x.skill AS a, y.skill AS b, sum({I.dot_sql('x.e', 'y.e')}) AS xy, sum({I.dot_sql('x.e', 'x.e')}) AS xx, sum({I.dot_sql('y.e', 'y.e')}) AS yy FROM r x JOIN r y ON x.probe_id = y.probe_id AND x.skill < y.skill GROUP BY 1, 2)
    SELECT a, b, CASE WHEN xx = 0 OR yy = 0 THEN NULL ELSE round(xy / (sqrt(xx) * sqrt(yy)), 6) END AS corr FROM s""")  # fmt: skip
def effect_residual_corr(spark: SparkSession, d: str) -> DataFrame:
    return r6(compare.effects(I.battery(spark, d), I.USED), "corr")


# ---- fingerprints and candidates -----------------------------------------------------------------------------------


@query("average_hash", f"WITH {I.PROBES_SQL} SELECT probe_id, array_to_string(list_transform(px, lambda v: CASE WHEN v >= list_sum(px) / 64.0 THEN 1 ELSE 0 END), '') AS bits FROM probes")
def average_hash(spark: SparkSession, d: str) -> DataFrame:
    return I.battery(spark, d).select("probe_id", F.array_join(S.average_hash(F.col("px")).cast("array<string>"), "").alias("bits"))


_NEAR = f"n AS (SELECT x.vec_id AS id, y.vec_id AS other, round({I.cosine_sql('x.embedding', 'y.embedding')}, 9) AS distance FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, other) AS rank FROM n)"


@query("fingerprint_knn", f"WITH {_NEAR} SELECT id, other, rank FROM k WHERE rank <= 5 AND distance <= 0.9")
def fingerprint_knn(spark: SparkSession, d: str) -> DataFrame:
    prints = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return candidates.nearest(prints, 5, 0.9).select("id", "other", F.col("rank").cast("long").alias("rank"))


@query("candidate_pairs", f"WITH {_NEAR} SELECT least(id, other) AS a, greatest(id, other) AS b FROM k WHERE rank <= 3 AND distance <= 0.9 UNION SELECT x.vec_id, y.vec_id FROM embeddings x JOIN embeddings y ON x.vec_id % 97 = y.vec_id % 97 AND x.vec_id < y.vec_id")
def candidate_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The three nearest among all rows, and families of every 97th row."""
    e = table(spark, d, "embeddings")
    return candidates.candidate_pairs(e.select(F.col("vec_id").alias("id"), (F.col("vec_id") % 97).alias("family")), e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), 3, 0.9)


@query("content_hash_dups", "SELECT sha256(coalesce(text, '')) AS sha, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash_dups(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    return rows.groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).where("n > 1")


_MASK = "list_transform({0}, lambda v: CASE WHEN v > 128 THEN 255 ELSE 0 END)"
_IS = "(len(list_distinct({0})) = 2 AND list_min({0}) = 0)"


@query("mask_iou_pairs", f"""WITH {I.PROBES_SQL}, m AS (SELECT probe_id, {_MASK.format('px')} AS m, {_MASK.format('list_reverse(px)')} AS n FROM probes), c AS (SELECT *, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN m[i] > 0 AND n[i] > 0 THEN 1 ELSE 0 END)) AS i, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN m[i] > 0 OR n[i] > 0 THEN 1 ELSE 0 END)) AS u FROM m)
    SELECT probe_id, round(CASE WHEN list_max(m) = 0 AND list_max(n) = 0 THEN 1.0 WHEN {_IS.format('m')} AND {_IS.format('n')} THEN coalesce(i / nullif(u, 0), 0) END, 6) AS iou FROM c""")  # fmt: skip
def mask_iou_pairs(spark: SparkSession, d: str) -> DataFrame:
    m = S.SKILLS["threshold_128"]
    return I.battery(spark, d).select("probe_id", F.round(S.mask_iou(m(F.col("px")), m(F.reverse("px"))), 6).alias("iou"))


@query("distinct_classes", f"WITH {I.OUT_SQL} SELECT skill, count(DISTINCT px) AS contents, count(*) AS n FROM outs GROUP BY 1")
def distinct_classes(spark: SparkSession, d: str) -> DataFrame:
    return compare.executed(I.battery(spark, d), I.USED).groupBy("skill").agg(F.countDistinct("sha").alias("contents"), F.count(F.lit(1)).alias("n"))


# ---- text judges ---------------------------------------------------------------------------------------------------

_TOK = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+'))"


@query("name_match_jaccard", f"""WITH p AS (SELECT x.p_partkey AS a, y.p_partkey AS b, {_TOK.format("x.p_name || ' ' || CAST(x.p_partkey AS VARCHAR)")} AS ta, {_TOK.format("y.p_name || ' ' || CAST(y.p_partkey AS VARCHAR)")} AS tb FROM part x JOIN part y ON x.p_brand = y.p_brand AND x.p_size = y.p_size AND x.p_partkey < y.p_partkey),
    s AS (SELECT a, b, len(list_intersect(ta, tb)) / CAST(len(list_distinct(list_concat(ta, tb))) AS DOUBLE) AS score FROM p) SELECT a, b, round(score, 6) AS score, score >= 0.5 AS mergeable FROM s""")  # fmt: skip
def name_match_jaccard(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("text"), "p_brand", "p_size")
    return judges.expanded(r6(judges.name_blocks(rows, ["p_brand", "p_size"]), "score"))


_TFIDF = """words AS (SELECT item_id AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM benchmark), tf AS (SELECT id, token, count(*) AS tf FROM words GROUP BY 1, 2), df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
    raw AS (SELECT id, token, tf * (ln((1 + (SELECT count(*) FROM benchmark)) / CAST(1 + df AS DOUBLE)) + 1) AS x FROM tf JOIN df USING (token)), w AS (SELECT id, token, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS w FROM raw)"""  # fmt: skip


@query("tfidf_cosine", f"WITH {_TFIDF}, s AS (SELECT x.id AS a, y.id AS b, sum(x.w * y.w) AS dot FROM w x JOIN w y ON x.token = y.token AND x.id < y.id GROUP BY 1, 2) SELECT a, b, round(least(dot, 1), 6) AS score FROM s WHERE round(dot, 9) >= 0.1")
def tfidf_cosine(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of items of at least 0.1."""
    weights = judges.tfidf(table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"))
    scored = judges.cosine_pairs(weights, judges.similar_pairs(weights, 0.1))
    return r6(scored.where(F.round("score", 9) >= 0.1).select("a", "b", "score"), "score")


_TOK2 = "list_filter(list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+')), lambda t: len(t) >= 2)"


@query("keyword_retrieval", f"""WITH q AS (SELECT item_id AS query_id, unnest({_TOK2.format('text')}) AS token FROM benchmark), l AS (SELECT p_partkey AS pos, 'part' || CAST(p_partkey AS VARCHAR) AS id, unnest({_TOK2.format("p_name || ' the of and is ' || p_type")}) AS token FROM part),
    h AS (SELECT query_id, pos, id, count(*) AS score FROM q JOIN l USING (token) GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS r FROM h) SELECT b.item_id AS query_id, k.id, coalesce(k.score, 0) AS score FROM benchmark b LEFT JOIN k ON b.item_id = k.query_id AND r = 1""")  # fmt: skip
def keyword_retrieval(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    lib = table(spark, d, "part").select(F.col("p_partkey").alias("pos"), F.concat(F.lit("part"), F.col("p_partkey").cast("string")).alias("id"), F.concat(F.col("p_name"), F.lit(" the of and is "), F.col("p_type")).alias("text"))
    return judges.keyword_retrieval(q, lib)


_REPLY = "CASE CAST((conv_id + turn) % 8 AS INT) WHEN 0 THEN '<think>EXACT?</think> distinct' WHEN 1 THEN 'inexact match' WHEN 2 THEN 'Perceptual twins' WHEN 3 THEN 'subsumption' WHEN 4 THEN 'semantic_preserving!' WHEN 5 THEN 'they are complementary' WHEN 6 THEN 'no idea' ELSE '<THINK>\nx\n</THINK>exact' END"


@query("llm_reply_parse", f"""WITH r AS (SELECT conv_id AS a, turn AS b, upper(trim(regexp_replace({_REPLY.replace(chr(10), "' || chr(10) || '")}, '<think>.*?</think>', '', 'gis'))) AS t FROM conversations), v AS (SELECT a, b, CASE WHEN contains(t, 'EXACT') THEN 'EXACT' WHEN contains(t, 'PERCEPTUAL') THEN 'PERCEPTUAL' WHEN contains(t, 'SUBSUMPTION') THEN 'SUBSUMPTION' WHEN contains(t, 'SEMANTIC_PRESERVING') THEN 'SEMANTIC_PRESERVING' WHEN contains(t, 'COMPLEMENTARY') THEN 'COMPLEMENTARY' ELSE 'DISTINCT' END AS relation FROM r)
    SELECT a, b, relation, relation IN ('EXACT', 'PERCEPTUAL') AS mergeable FROM v""")  # fmt: skip
def llm_reply_parse(spark: SparkSession, d: str) -> DataFrame:
    return judges.reply_verdicts(table(spark, d, "conversations").select(F.col("conv_id").alias("a"), F.col("turn").alias("b"), F.expr(_REPLY.replace("\n", "\\n")).alias("reply")))


# ---- metrics -------------------------------------------------------------------------------------------------------

_PRF = "round(coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0), 6) AS precision, round(coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0), 6) AS recall, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, tp + fn AS support"
_NAMES = "(SELECT unnest(['EXACT', 'PERCEPTUAL', 'SUBSUMPTION', 'SEMANTIC_PRESERVING', 'COMPLEMENTARY', 'DISTINCT']) AS relation)"


@query("per_relation_prf", f"WITH {I.BOTH_SQL}, c AS (SELECT relation, count(*) FILTER (WHERE truth = relation AND pred = relation) AS tp, count(*) FILTER (WHERE truth <> relation AND pred = relation) AS fp, count(*) FILTER (WHERE truth = relation AND pred <> relation) AS fn FROM {_NAMES} LEFT JOIN compared ON true GROUP BY 1) SELECT relation, tp, fp, fn, {_PRF} FROM c")
def per_relation_prf(spark: SparkSession, d: str) -> DataFrame:
    return r6(metrics.per_relation_prf(I.truth(spark, d), I.pred(spark, d)), "precision", "recall", "f1")


@query("confusion_matrix", f"WITH {I.BOTH_SQL} SELECT n.relation AS true, " + ", ".join(f"count(*) FILTER (WHERE pred = '{r}') AS {r}" for r in (*S.RELATIONS, "UNCERTAIN")) + f" FROM {_NAMES} n LEFT JOIN compared c ON c.truth = n.relation GROUP BY 1")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusion_matrix(I.truth(spark, d), I.pred(spark, d))


@query("mergeable_prf", f"WITH {I.BOTH_SQL}, c AS (SELECT count(*) FILTER (WHERE m AND merge) AS tp, count(*) FILTER (WHERE NOT m AND merge) AS fp, count(*) FILTER (WHERE m AND NOT merge) AS fn FROM (SELECT *, truth IN ('EXACT', 'PERCEPTUAL') AS m FROM compared)) SELECT tp, fp, fn, {_PRF} FROM c")
def mergeable_prf(spark: SparkSession, d: str) -> DataFrame:
    return r6(metrics.mergeable_prf(I.truth(spark, d), I.pred(spark, d)), "precision", "recall", "f1")


@query("false_merge_safety", f"WITH {I.BOTH_SQL}, x AS (SELECT 'all' AS slice, merge FROM compared WHERE truth = 'DISTINCT' UNION ALL SELECT 'hard', merge FROM compared WHERE truth = 'DISTINCT' AND hard), c AS (SELECT s.slice, count(merge) AS n, count(*) FILTER (WHERE merge) AS false_merges FROM (SELECT unnest(['all', 'hard']) AS slice) s LEFT JOIN x USING (slice) GROUP BY 1) SELECT *, round(coalesce(false_merges / nullif(CAST(n AS DOUBLE), 0), 0), 6) AS false_merge_rate, round(1 - coalesce(false_merges / nullif(CAST(n AS DOUBLE), 0), 0), 6) AS precision_on_distinct FROM c")
def false_merge_safety(spark: SparkSession, d: str) -> DataFrame:
    return r6(metrics.merge_safety(I.truth(spark, d), I.pred(spark, d)), "false_merge_rate", "precision_on_distinct")


@query("divergence", f"WITH {I.TRUTH_SQL}, {I.PRED_SQL}, {I.TEXT_SQL} SELECT t.relation AS true, count(*) AS n, count(*) FILTER (WHERE p.mergeable <> x.mergeable) AS disagree, count(*) FILTER (WHERE x.mergeable AND NOT p.mergeable) AS over_merge, count(*) FILTER (WHERE p.mergeable AND NOT x.mergeable) AS under_merge, round(count(*) FILTER (WHERE p.mergeable <> x.mergeable) / CAST(count(*) AS DOUBLE), 6) AS disagree_rate FROM truth t JOIN pred p USING (a, b) JOIN text_pred x USING (a, b) GROUP BY 1")
def divergence(spark: SparkSession, d: str) -> DataFrame:
    return r6(metrics.divergence(I.pred(spark, d), I.text_pred(spark, d), I.truth(spark, d)), "disagree_rate")


@query("abstention", f"WITH {I.PRED_SQL} SELECT count(*) AS n, round(avg(CASE WHEN relation = 'UNCERTAIN' THEN 1.0 ELSE 0.0 END), 6) AS abstention_rate FROM pred")
def abstention(spark: SparkSession, d: str) -> DataFrame:
    return r6(metrics.abstention(I.pred(spark, d)), "abstention_rate")


@query("cohen_kappa", "WITH c AS (SELECT count(*) AS n, avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0 END) AS po, avg(quality) * avg(toxic) + (1 - avg(quality)) * (1 - avg(toxic)) AS pe FROM labels) SELECT n, round((po - pe) / (1 - pe), 6) AS kappa FROM c")
def cohen_kappa(spark: SparkSession, d: str) -> DataFrame:
    return r6(metrics.cohen_kappa(table(spark, d, "labels").select(F.col("quality").alias("x"), F.col("toxic").alias("y"))), "kappa")


@query("fleiss_kappa", """WITH c AS (SELECT user_id AS item, event_type AS category, count(*) AS k FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE r <= 3 GROUP BY 1, 2), i AS (SELECT item, sum(k) AS n, sum(k * k) AS sq FROM c GROUP BY 1), f AS (SELECT * FROM i WHERE n = (SELECT max(n) FROM i)),
    p AS (SELECT count(*) AS items, CAST(max(n) AS BIGINT) AS raters, avg((sq - n) / CAST(n * (n - 1) AS DOUBLE)) AS p FROM f), s AS (SELECT category, sum(k) AS k FROM c WHERE item IN (SELECT item FROM f) GROUP BY 1), e AS (SELECT sum(CAST(k AS DOUBLE) * k) / (sum(k) * CAST(sum(k) AS DOUBLE)) AS pe FROM s) SELECT items, raters, round((p - pe) / (1 - pe), 6) AS kappa FROM p, e""")  # fmt: skip
def fleiss_kappa(spark: SparkSession, d: str) -> DataFrame:
    w = F.row_number().over(studies.Window.partitionBy("user_id").orderBy("event_id"))
    rated = table(spark, d, "events").withColumn("r", w).where("r <= 3").select(F.col("user_id").alias("item"), F.col("event_type").alias("category"))
    return r6(metrics.fleiss_kappa(rated), "kappa")


# ---- sweeps --------------------------------------------------------------------------------------------------------

_SAMPLES = "samples AS (SELECT d.n_chars / 50000.0 AS score, l.quality = 1 AS positive FROM labels l JOIN documents d USING (doc_id))"
_CURVE = "curve AS (SELECT score AS threshold, tp, tp + fp AS taken, tp / CAST(tp + fp AS DOUBLE) AS precision, tp / CAST((SELECT count(*) FROM samples WHERE positive) AS DOUBLE) AS recall FROM (SELECT DISTINCT score, count(*) FILTER (WHERE positive) OVER w AS tp, count(*) FILTER (WHERE NOT positive) OVER w AS fp FROM samples WINDOW w AS (ORDER BY score RANGE UNBOUNDED PRECEDING)) UNION ALL SELECT -1e308, 0, 0, 1.0, 0.0)"


def _samples(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    return rows.select((F.col("n_chars") / 50000.0).alias("score"), (F.col("quality") == 1).alias("positive"))


@query("select_threshold", f"WITH {_SAMPLES}, {_CURVE}, m AS (SELECT *, precision >= 0.8 AND recall >= 0.3 AS meets FROM curve) SELECT round(threshold, 6) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, meets FROM m ORDER BY meets DESC, CASE WHEN meets THEN 0 ELSE -precision END, recall DESC, threshold LIMIT 1")
def select_threshold(spark: SparkSession, d: str) -> DataFrame:
    return r6(calibrate.select_threshold(_samples(spark, d), 0.8, 0.3), "threshold", "precision", "recall")


@query("threshold_curve", f"WITH {_SAMPLES}, {_CURVE} SELECT round(threshold, 6) AS threshold, tp, taken - tp AS fp, round(precision, 6) AS precision, round(recall, 6) AS recall FROM curve WHERE threshold > -1")
def threshold_curve(spark: SparkSession, d: str) -> DataFrame:
    return r6(calibrate.curve(_samples(spark, d)).where("threshold > -1"), "threshold", "precision", "recall")


@query("select_delta", f"WITH {_SAMPLES}, g AS (SELECT unnest([0.0, 0.05, 0.1, 0.2, 0.5]) AS delta), a AS (SELECT delta, count(*) FILTER (WHERE score <= 0.08 * (1 - delta) AND positive) AS tp, count(*) FILTER (WHERE score <= 0.08 * (1 - delta)) AS taken FROM g, samples GROUP BY 1) SELECT CAST(coalesce(min(delta) FILTER (WHERE taken > 0 AND tp / CAST(taken AS DOUBLE) >= 0.875), 0.5) AS DOUBLE) AS delta FROM a")
def select_delta(spark: SparkSession, d: str) -> DataFrame:
    return calibrate.select_delta(_samples(spark, d), 0.08, (0.0, 0.05, 0.1, 0.2, 0.5), 0.875)


@query("text_operating_points", """WITH s AS (SELECT d.lang AS track, d.n_chars / 100 / 100.0 AS score, l.quality = 1 AS positive, l.toxic = 1 AS hard FROM labels l JOIN documents d USING (doc_id)), b AS (SELECT track, score, count(*) FILTER (WHERE positive) AS p, count(*) FILTER (WHERE NOT positive) AS n, count(*) FILTER (WHERE NOT positive AND hard) AS h FROM s GROUP BY 1, 2),
    c AS (SELECT track, score AS threshold, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(h) OVER w AS hfp, sum(p) OVER a AS pos, sum(n) OVER a AS neg, sum(h) OVER a AS hard FROM b WINDOW w AS (PARTITION BY track ORDER BY score DESC), a AS (PARTITION BY track)),
    m AS (SELECT track, threshold, coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0) AS precision, coalesce(tp / nullif(CAST(pos AS DOUBLE), 0), 0) AS recall, coalesce(2.0 * tp / nullif(CAST(tp + fp + pos AS DOUBLE), 0), 0) AS f1, coalesce(fp / nullif(CAST(neg AS DOUBLE), 0), 0) AS fmr, coalesce(hfp / nullif(CAST(hard AS DOUBLE), 0), 0) AS hard_fmr FROM c),
    k AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY round(f1, 12) DESC, precision DESC, fmr, hard_fmr, threshold DESC) AS k FROM m) SELECT track, round(threshold, 6) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(fmr, 6) AS fmr, round(hard_fmr, 6) AS hard_fmr FROM k WHERE k = 1""")  # fmt: skip
def text_operating_points(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    scored = rows.select(F.col("lang").alias("track"), (F.col("n_chars") / 100 / 100.0).alias("score"), (F.col("quality") == 1).alias("positive"), (F.col("toxic") == 1).alias("hard"))
    return r6(calibrate.operating_points(scored), "threshold", "precision", "recall", "f1", "fmr", "hard_fmr")


@query("cluster_split", "SELECT CASE WHEN c.c_nationkey <= 9 THEN 'calibration' ELSE 'test' END AS split, count(*) AS n FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN supplier s ON l.l_suppkey = s.s_suppkey WHERE (c.c_nationkey <= 9) = (s.s_nationkey <= 9) GROUP BY 1")
def cluster_split(spark: SparkSession, d: str) -> DataFrame:
    """Buyer and seller of every line, with their nations as families."""
    buyers = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_custkey").alias("a"), F.col("c_nationkey").cast("string").alias("family_a"))
    sellers = table(spark, d, "supplier").select(F.col("s_suppkey").alias("b"), F.col("s_nationkey").cast("string").alias("family_b"))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    pairs = lines.join(buyers, F.col("l_orderkey") == F.col("o_orderkey")).join(sellers, F.col("l_suppkey") == F.col("b")).select("a", "b", "family_a", "family_b")
    return calibrate.cluster_split(pairs, [str(k) for k in range(10)]).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


# ---- studies -------------------------------------------------------------------------------------------------------


@query("aggregate_points_ci", "WITH g AS (SELECT c_mktsegment AS segment, o_orderstatus AS status, count(o_totalprice) AS n, avg(o_totalprice) AS m, coalesce(stddev_samp(o_totalprice), 0) AS s FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) SELECT segment, status, n AS price_n, round(m, 4) AS price_mean, round(s, 4) AS price_std, round(m - CASE WHEN n > 1 THEN 1.96 * s / sqrt(n) ELSE 0 END, 4) AS price_lo, round(m + CASE WHEN n > 1 THEN 1.96 * s / sqrt(n) ELSE 0 END, 4) AS price_hi FROM g")
def aggregate_points_ci(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    rows = o.join(c, o.o_custkey == c.c_custkey).select(F.col("c_mktsegment").alias("segment"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    out = studies.aggregate_points(rows, ["price"], ["segment", "status"])
    return out.withColumns({x: F.round(x, 4) for x in ("price_mean", "price_std", "price_lo", "price_hi")})


@query("bootstrap_ci")
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    return studies.bootstrap_ci(o, "o_totalprice", ["year", "o_orderstatus"], 500, 7)


_GOALS = "g AS (SELECT l_suppkey AS id, CAST(sum(l_quantity) AS BIGINT) AS volume, CAST(round(avg(l_discount) * 10000) AS BIGINT) AS discount, count(*) AS cost FROM lineitem GROUP BY 1)"


def _goals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.sum("l_quantity").cast("long").alias("volume"), F.round(F.avg("l_discount") * 10000).cast("long").alias("discount"), F.count(F.lit(1)).alias("cost"))


@query("pareto_front", f"WITH {_GOALS} SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM g h WHERE h.volume >= g.volume AND h.discount >= g.discount AND h.cost <= g.cost AND (h.volume > g.volume OR h.discount > g.discount OR h.cost < g.cost))")
def pareto_front(spark: SparkSession, d: str) -> DataFrame:
    return studies.pareto_front(_goals(spark, d), ["volume", "discount"], ["cost"])


@query("pareto_front_two_goals", f"WITH {_GOALS} SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM g h WHERE h.volume >= g.volume AND h.cost <= g.cost AND (h.volume > g.volume OR h.cost < g.cost))")
def pareto_front_two_goals(spark: SparkSession, d: str) -> DataFrame:
    return studies.pareto_front(_goals(spark, d), ["volume"], ["cost"])


@query("construct_validity", f"WITH {_GOALS}, r AS (SELECT CAST(volume AS DOUBLE) AS x, CAST(cost AS DOUBLE) AS y, rank() OVER (ORDER BY volume) + (count(*) OVER (PARTITION BY volume) - 1) / 2.0 AS rx, rank() OVER (ORDER BY cost) + (count(*) OVER (PARTITION BY cost) - 1) / 2.0 AS ry FROM g) SELECT count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r")
def construct_validity(spark: SparkSession, d: str) -> DataFrame:
    return r6(studies.construct_validity(_goals(spark, d), "volume", "cost"), "pearson", "spearman")


@query("gate_ablation", """WITH p AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'output' ELSE 'text' END AS gate, CAST(user_id % 5 AS DOUBLE) AS rho, event_type AS composition, CAST(event_id % 7 AS INT) AS seed, 'single' AS mode, value FROM events), o AS (SELECT rho, composition, seed, mode, avg(value) AS v FROM p WHERE gate = 'output' GROUP BY ALL), t AS (SELECT rho, composition, seed, mode, avg(value) AS v FROM p WHERE gate = 'text' GROUP BY ALL)
    SELECT rho, composition, seed, mode, round(o.v - t.v, 6) AS delta_value FROM o JOIN t USING (rho, composition, seed, mode)""")  # fmt: skip
def gate_ablation(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    points = e.select(F.when(F.col("event_id") % 2 == 0, "output").otherwise("text").alias("gate"), (F.col("user_id") % 5).cast("double").alias("rho"), F.col("event_type").alias("composition"), (F.col("event_id") % 7).cast("int").alias("seed"), F.lit("single").alias("mode"), "value")
    return r6(studies.ablation(points, ["value"]), "delta_value")


_STATUS = "CASE WHEN event_id % 3 = 0 THEN 'rejected' ELSE 'applied' END"
_LOG = f"log AS (SELECT user_id, {I.KIND} AS kind, {_STATUS} AS status, CAST(event_id % 5 AS VARCHAR) AS prim, CASE WHEN event_id % 2 = 0 THEN 'x' ELSE 'y' END AS sec FROM events), ideal AS (SELECT user_id, {I.KIND} AS kind, CAST(event_id % 4 AS VARCHAR) AS prim, 'x' AS sec FROM events WHERE event_id % 4 <> 1)"
_SCORES = f"""{_LOG}, g AS (SELECT user_id, kind, prim, CASE WHEN kind IN ('merge', 'parameterize') THEN sec ELSE '' END AS sec, count(*) AS g FROM log WHERE status = 'applied' AND kind <> 'end' GROUP BY ALL), w AS (SELECT user_id, kind, prim, CASE WHEN kind IN ('merge', 'parameterize') THEN sec ELSE '' END AS sec, count(*) AS w FROM ideal WHERE kind <> 'end' GROUP BY ALL),
    c AS (SELECT user_id, CAST(sum(least(coalesce(g, 0), coalesce(w, 0))) AS BIGINT) AS tp, CAST(sum(greatest(coalesce(g, 0) - coalesce(w, 0), 0)) AS BIGINT) AS fp, CAST(sum(greatest(coalesce(w, 0) - coalesce(g, 0), 0)) AS BIGINT) AS fn FROM g FULL JOIN w USING (user_id, kind, prim, sec) GROUP BY 1)"""  # fmt: skip


def _log(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "events")
    log = e.select("user_id", F.expr(I.KIND).alias("kind"), F.expr(_STATUS).alias("status"), (F.col("event_id") % 5).cast("string").alias("primary"), F.when(F.col("event_id") % 2 == 0, "x").otherwise("y").alias("secondary"))
    ideal = e.where("event_id % 4 <> 1").select("user_id", F.expr(I.KIND).alias("kind"), (F.col("event_id") % 4).cast("string").alias("primary"), F.lit("x").alias("secondary"))
    return log, ideal


@query("score_actions", f"WITH {_SCORES} SELECT user_id, tp, fp, fn, {_PRF} FROM c")
def score_actions(spark: SparkSession, d: str) -> DataFrame:
    return r6(studies.score_actions(*_log(spark, d), by=["user_id"]), "precision", "recall", "f1")


@query("action_cost", f"WITH {_LOG} SELECT user_id, count(*) FILTER (WHERE kind <> 'end') AS cost, count(*) FILTER (WHERE kind <> 'end' AND status <> 'applied') AS nonproductive FROM log GROUP BY 1")
def action_cost(spark: SparkSession, d: str) -> DataFrame:
    return studies.action_cost(_log(spark, d)[0], ["user_id"])


@query("intrinsic_score", f"WITH {_SCORES}, k AS (SELECT user_id, count(*) FILTER (WHERE kind <> 'end') AS cost, count(*) FILTER (WHERE kind <> 'end' AND status <> 'applied') AS np FROM log GROUP BY 1) SELECT user_id, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, cost, round(CASE WHEN cost = 0 THEN 0 ELSE greatest(0, least(1, coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) * greatest(0, 1 - 0.5 * np / cost))) END, 6) AS intrinsic FROM c JOIN k USING (user_id)")
def intrinsic_score(spark: SparkSession, d: str) -> DataFrame:
    log, ideal = _log(spark, d)
    rows = studies.intrinsic_score(studies.score_actions(log, ideal, ["user_id"]), studies.action_cost(log, ["user_id"]), ["user_id"])
    return r6(rows, "f1", "intrinsic")


@query("success_by_split", "SELECT lang AS split, count(*) AS n, round(avg(CAST(quality = 1 AS INT)), 6) AS success_rate FROM labels JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((lang), ())")
def success_by_split(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select(F.col("lang").alias("split"), (F.col("quality") == 1).alias("success"))
    return r6(studies.success_by_split(rows), "success_rate")


# ---- planning ------------------------------------------------------------------------------------------------------


@query("usage_zipf", "WITH m AS (SELECT user_id AS id, count(*) AS c, min(event_id) AS f FROM events GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY f, id) AS rank FROM m) SELECT id, rank, CAST(c + greatest(1, round_even(20 / pow(rank, 1.2), 0)) AS BIGINT) AS n FROM r")
def usage_zipf(spark: SparkSession, d: str) -> DataFrame:
    rows = planning.usage_counts(table(spark, d, "events").select(F.col("event_id").alias("pos"), F.col("user_id").alias("id")))
    return rows.withColumn("rank", F.col("rank").cast("long"))


@query("hamilton_apportion", """WITH t AS (SELECT user_id % 3 AS grp, event_type AS key, CAST(count(*) AS DOUBLE) AS weight FROM events GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY key) AS pos FROM t), q AS (SELECT *, 30 * weight / sum(weight) OVER (PARTITION BY grp) AS quota FROM p),
    b AS (SELECT *, floor(quota) AS base, 30 - sum(floor(quota)) OVER (PARTITION BY grp) AS rest FROM q) SELECT grp AS "group", pos, key, CAST(base + CASE WHEN row_number() OVER (PARTITION BY grp ORDER BY quota - base DESC, pos) <= rest THEN 1 ELSE 0 END AS BIGINT) AS seats FROM b""")  # fmt: skip
def hamilton_apportion(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "events").groupBy((F.col("user_id") % 3).alias("group"), F.col("event_type").alias("key")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    t = t.withColumn("pos", F.row_number().over(studies.Window.partitionBy("group").orderBy("key")).cast("long"))
    return planning.hamilton(t, t.select("group").distinct().withColumn("k", F.lit(30)))


_GRID = [{"name": "percent", "type": "float", "default": 50.0, "min": 1.0, "max": 100.0}, {"name": "on", "type": "bool", "default": True}]


@query("param_grid", """SELECT * FROM (VALUES (0, '{"on": false, "percent": 1.0}'), (1, '{"on": false, "percent": 100.0}'), (2, '{"on": false, "percent": 50.0}'), (3, '{"on": false, "percent": 50.5}'), (4, '{"on": true, "percent": 1.0}'), (5, '{"on": true, "percent": 100.0}'), (6, '{"on": true, "percent": 50.0}'), (7, '{"on": true, "percent": 50.5}')) t(pos, params)""")
def param_grid(spark: SparkSession, d: str) -> DataFrame:
    rows = [(i, planning.json.dumps(p, sort_keys=True)) for i, p in enumerate(planning.param_grid(_GRID))]
    return spark.createDataFrame(rows, "pos int, params string")


_AXES = [(0, "blur", 0, 3.0, "gauss", '{"k":3}'), (0, "blur", 1, 5.0, "gauss", '{"k":5}'), (0, "blur", 0, 3.0, "box", '{"k":3}'), (0, "blur", 1, 5.0, "box", None), (1, "size", 0, 1.0, "gauss", '{"s":1}'), (1, "size", 0, 1.0, "box", '{"s":1}')]


@query("matched_sweep", """SELECT 'blur' AS axis, 0 AS value_pos, CAST(3.0 AS DOUBLE) AS value, '{"k":3}' AS params_a, '{"k":3}' AS params_b""")
def matched_sweep(spark: SparkSession, d: str) -> DataFrame:
    axes = spark.createDataFrame(_AXES, "axis_pos int, axis string, value_pos int, value double, skill string, params string")
    return planning.matched_sweep(axes, "gauss", "box")


@query("relation_gate", """WITH k AS (SELECT unnest(['merge', 'parameterize']) AS kind), r AS (SELECT unnest(['EXACT', 'PERCEPTUAL', 'SUBSUMPTION', 'SEMANTIC_PRESERVING', 'COMPLEMENTARY', 'DISTINCT', 'UNCERTAIN']) AS relation), d AS (SELECT unnest(['NONE', 'A_SUBSUMES_B', 'B_SUBSUMES_A']) AS direction),
    x AS (SELECT *, CASE WHEN kind = 'merge' THEN relation IN ('EXACT', 'PERCEPTUAL') ELSE relation = 'SEMANTIC_PRESERVING' OR (relation = 'SUBSUMPTION' AND direction = 'B_SUBSUMES_A') END AS allowed FROM k, r, d)
    SELECT kind, relation, direction, allowed, CASE WHEN allowed THEN '' WHEN kind = 'parameterize' AND relation = 'SUBSUMPTION' THEN 'swap operands' ELSE 'keep_separate' END AS advice FROM x""")  # fmt: skip
def relation_gate(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(k, r, x) for k in ("merge", "parameterize") for r in (*S.RELATIONS, "UNCERTAIN") for x in ("NONE", "A_SUBSUMES_B", "B_SUBSUMES_A")], "kind string, relation string, direction string")
    c = [F.col(x) for x in ("kind", "relation", "direction")]
    return rows.select("*", gating.allowed(*c).alias("allowed"), gating.advice(*c).alias("advice"))


@query("corruption_grid")
def corruption_grid(spark: SparkSession, d: str) -> DataFrame:
    """Plans over the package's own library of 100 functions."""
    numeric = lambda x: sum(p.type in ("int", "float") for p in x.params)
    library = pd.DataFrame([(k, len(x.params), numeric(x)) for k, x in images.LIBRARY.items()], columns=["id", "n_params", "numeric_params"])
    return planning.corruption_grid(spark, library, [round(0.1 * k, 1) for k in range(1, 11)], list(planning.COMPOSITIONS), [0, 1, 2, 3, 4])


# ---- integrity -----------------------------------------------------------------------------------------------------

_EDGE = "(SELECT n_nationkey AS src, n_nationkey // 2 AS dst FROM nation WHERE n_nationkey > 0 UNION ALL SELECT 3, 15)"


@query("dag_check", f"WITH RECURSIVE e AS (SELECT * FROM {_EDGE}), p AS (SELECT src, dst, 1 AS k FROM e UNION SELECT p.src, e.dst, k + 1 FROM p JOIN e ON p.dst = e.src WHERE k < 30) SELECT DISTINCT CAST(src AS BIGINT) AS node FROM p WHERE src = dst")
def dag_check(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").where("n_nationkey > 0").select(F.col("n_nationkey").cast("long").alias("src"), F.expr("cast(n_nationkey div 2 as bigint)").alias("dst"))
    return graph.cycles(n.union(spark.createDataFrame([(3, 15)], "src long, dst long")))


@query("exact_closure", """WITH l AS (SELECT n_nationkey AS a, lead(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS b FROM nation)
    SELECT CAST(x.n_nationkey AS BIGINT) AS a, CAST(y.n_nationkey AS BIGINT) AS b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey < y.n_nationkey
    WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.a = x.n_nationkey AND l.b = y.n_nationkey)""")
def exact_closure(spark: SparkSession, d: str) -> DataFrame:
    """Each nation is listed with the next of its region: what the closure lacks."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("a"), "n_regionkey")
    after = n.select(F.col("a").alias("b"), "n_regionkey")
    return graph.closure_gaps(n.join(after, "n_regionkey").where("b > a").groupBy("a").agg(F.min("b").alias("b")))


@query("coverage_check", "SELECT v.value, count(d.doc_id) AS n, v.needed FROM (VALUES ('en', 1000000), ('fr', 10), ('xx', 1)) v(value, needed) LEFT JOIN documents d ON d.lang = v.value GROUP BY 1, 3 HAVING count(d.doc_id) < v.needed")
def coverage_check(spark: SparkSession, d: str) -> DataFrame:
    return graph.coverage_gaps(table(spark, d, "documents"), "lang", {"en": 1000000, "fr": 10, "xx": 1}).select("value", "n", "needed")


@query("split_disjoint", "SELECT source, count(DISTINCT lang) AS n FROM documents GROUP BY 1 HAVING count(DISTINCT lang) > 1")
def split_disjoint(spark: SparkSession, d: str) -> DataFrame:
    return graph.in_two_splits(table(spark, d, "documents"), "source", "lang")


@query("probe_disjoint", "SELECT doc_id, sha256(coalesce(text, '')) AS sha FROM documents WHERE doc_id % 2 = 1 AND sha256(coalesce(text, '')) IN (SELECT sha256(coalesce(text, '')) FROM documents WHERE doc_id % 2 = 0)")
def probe_disjoint(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    return graph.shared(rows.where("doc_id % 2 = 1"), rows.where("doc_id % 2 = 0"), "sha").select("doc_id", "sha")


@query("designed_labels", f"WITH {I.TRUTH_SQL} SELECT l.doc_id AS a, l.doc_id + 1000000 + l.doc_id % 2 AS b, coalesce(t.relation, 'DISTINCT') AS relation, coalesce(t.hard, false) AS hard FROM labels l LEFT JOIN truth t ON t.a = l.doc_id AND t.b = l.doc_id + 1000000 + l.doc_id % 2")
def designed_labels(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "labels").select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1000000 + F.col("doc_id") % 2).alias("b"))
    return graph.labels_for(pairs, I.truth(spark, d).withColumn("spec", F.col("a"))).select("a", "b", "relation", "hard")


@query("status_counts", f"WITH {_LOG}, s AS (SELECT unnest(['applied', 'rejected', 'blocked', 'invalid', 'noop']) AS value) SELECT s.value, count(log.status) AS n FROM s LEFT JOIN log ON log.status = s.value GROUP BY 1")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return graph.zero_filled(_log(spark, d)[0], "status", ["applied", "rejected", "blocked", "invalid", "noop"])


@query("review_slice", f"WITH {I.TRUTH_SQL}, {I.PRED_SQL} SELECT t.a, t.b, t.relation, p.relation AS verdict FROM truth t LEFT JOIN pred p USING (a, b) WHERE t.relation IN ('SEMANTIC_PRESERVING', 'COMPLEMENTARY') OR p.relation = 'UNCERTAIN'")
def review_slice(spark: SparkSession, d: str) -> DataFrame:
    return judges.review_slice(I.truth(spark, d), I.pred(spark, d)).select("a", "b", "relation", "verdict")
