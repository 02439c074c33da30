"""Comparing what functions make of the same probes, and classifying their relation.

The outputs of all functions on one probe stand in one row, so pairs are
formed inside the row and only partial aggregates of pairs are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


@dataclass(frozen=True)
class Thresholds:
    """The default thresholds; placeholders until calibrated."""

    epsilon: float = 1 / 255
    perceptual: float = 0.05
    ssim_floor: float = 0.10
    semantic: float = 0.15
    quantile: float = 0.90
    complementary: float = 0.05
    correlation: float = 0.85
    delta: float = 0.10
    calibrated: bool = False
    split_hash: str = ""
    date: str = ""

    def __post_init__(self) -> None:
        if self.calibrated and not (self.split_hash and self.date):
            raise ValueError("calibrated thresholds need the hash of their split and a date")


def probes(embeddings: DataFrame) -> DataFrame:
    """probe_id, px."""
    return embeddings.select(F.col("vec_id").alias("probe_id"), S.probe(F.col("embedding")).alias("px"))


def executed(battery: DataFrame, skills: Sequence[str] = tuple(S.SKILLS)) -> DataFrame:
    """probe_id, skill, px, sha: each function on each probe."""
    rows = battery.select("probe_id", F.explode(S.outputs(F.col("px"), skills)).alias("o"))
    return rows.select("probe_id", F.col("o.skill").alias("skill"), F.col("o.px").alias("px"), S.content_hash(F.col("o.px")).alias("sha"))


def paired(battery: DataFrame, skills: Sequence[str] = tuple(S.SKILLS)) -> DataFrame:
    """probe_id, a, b, pa, pb: the outputs of each pair of functions, a before b by name."""
    names = sorted(skills)
    pair = [F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.lit(i).alias("i"), F.lit(j).alias("j")) for i, x in enumerate(names) for j, y in enumerate(names) if i < j]
    rows = battery.select("probe_id", F.transform(S.outputs(F.col("px"), names), lambda o: o["px"]).alias("o"))
    rows = rows.select("probe_id", "o", F.explode(F.array(*pair)).alias("p"))
    return rows.select("probe_id", F.col("p.a").alias("a"), F.col("p.b").alias("b"), F.get("o", F.col("p.i")).alias("pa"), F.get("o", F.col("p.j")).alias("pb"))


def distances(pairs: DataFrame) -> DataFrame:
    """probe_id, a, b, l_inf, perceptual, semantic, same (equal content)."""
    feature = S.cosine_distance(S.quadrant_means(F.col("pa")), S.quadrant_means(F.col("pb")))
    return pairs.select("probe_id", "a", "b", S.max_abs_diff(F.col("pa"), F.col("pb")).alias("l_inf"), S.mean_abs_diff(F.col("pa"), F.col("pb")).alias("perceptual"), feature.alias("semantic"), (F.col("pa") == F.col("pb")).alias("same"))


def worst(value: str, probe: str = "probe_id") -> Column:
    """(value, probe): the largest value, with the first probe that has it."""
    top = F.max(F.struct(F.col(value).alias("value"), (-F.col(probe)).alias("order")))
    return F.struct(top["value"].alias("value"), (-top["order"]).alias("probe"))


def worst_case(dists: DataFrame) -> DataFrame:
    out = dists.groupBy("a", "b").agg(worst("l_inf").alias("w"), F.count(F.lit(1)).alias("n_probes"))
    return out.select("a", "b", F.col("w.value").alias("worst"), F.col("w.probe").alias("worst_probe"), "n_probes")


def spread(dists: DataFrame, value: str = "l_inf", q: float = 0.9) -> DataFrame:
    """Linear-interpolated quantile and mean of each pair; infinite for no probes."""
    return dists.groupBy("a", "b").agg(F.coalesce(F.percentile(value, q), F.lit(S.INF)).alias("q"), F.coalesce(F.avg(value), F.lit(S.INF)).alias("mean"))


def hashes_identical(dists: DataFrame) -> DataFrame:
    return dists.groupBy("a", "b").agg(F.bool_and("same").alias("identical"))


def measured(dists: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """One row per pair with everything that classification needs, in one aggregation."""
    return dists.groupBy("a", "b").agg(
        worst("l_inf").alias("l"), F.max("perceptual").alias("perceptual"), F.bool_and("same").alias("identical"),
        F.percentile("semantic", t.quantile).alias("semantic_q"), F.avg("semantic").alias("semantic_mean"), F.count(F.lit(1)).alias("n_probes"),
    ).select("a", "b", F.col("l.value").alias("l_inf"), F.col("l.probe").alias("worst_probe"), "perceptual", "identical", "semantic_q", "semantic_mean", "n_probes")


def relation(t: Thresholds = Thresholds(), complementary: Column | None = None, direction: Column | None = None) -> Column:
    """The first level that holds, as an ordered CASE over a measured row.

    direction: the subsumption direction of parameterised pairs, null for pairs
    without parameters. No probe in common gives DISTINCT.
    """
    d = F.lit(None).cast("string") if direction is None else direction
    comp = F.lit(False) if complementary is None else complementary
    fixed = d.isNull()
    return (
        F.when(F.col("n_probes") == 0, F.lit("DISTINCT"))
        .when(fixed & (F.col("identical") | (F.col("l_inf") <= t.epsilon)), F.lit("EXACT"))
        .when(fixed & (F.col("perceptual") <= t.perceptual * (1 - t.delta)), F.lit("PERCEPTUAL"))
        .when(fixed & (F.col("perceptual") <= t.perceptual * (1 + t.delta)), F.lit("UNCERTAIN"))
        .when(d == "MUTUAL_EXACT", F.lit("EXACT"))
        .when(d == "MUTUAL", F.lit("PERCEPTUAL"))
        .when(d.isin("A_SUBSUMES_B", "B_SUBSUMES_A"), F.lit("SUBSUMPTION"))
        .when((F.col("semantic_q") <= t.semantic * (1 - t.delta)) & (F.col("semantic_mean") <= t.semantic), F.lit("SEMANTIC_PRESERVING"))
        .when(F.col("semantic_q") <= t.semantic * (1 + t.delta), F.lit("UNCERTAIN"))
        .when(comp, F.lit("COMPLEMENTARY"))
        .otherwise(F.lit("DISTINCT"))
    )


def effects(battery: DataFrame, skills: Sequence[str] = tuple(S.SKILLS)) -> DataFrame:
    """a, b, corr: cosine of the two functions' changes to the probes, over all values. Null if either changes nothing.

    The sums are decomposable, so nothing is concatenated.
    """
    names = sorted(skills)
    rows = battery.select("px", F.transform(S.outputs(F.col("px"), names), lambda o: F.zip_with(o["px"], F.col("px"), lambda x, y: (x - y).cast("double"))).alias("r"))
    pair = [F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), S.dot(F.get("r", i), F.get("r", j)).alias("xy"), S.dot(F.get("r", i), F.get("r", i)).alias("xx"), S.dot(F.get("r", j), F.get("r", j)).alias("yy")) for i, x in enumerate(names) for j, y in enumerate(names) if i < j]
    sums = rows.select(F.explode(F.array(*pair)).alias("p")).groupBy("p.a", "p.b").agg(F.sum("p.xy").alias("xy"), F.sum("p.xx").alias("xx"), F.sum("p.yy").alias("yy"))
    return sums.select("a", "b", F.try_divide(F.col("xy"), F.nullif(F.sqrt("xx") * F.sqrt("yy"), F.lit(0.0))).alias("corr"))


def complementary(battery: DataFrame, skills: Sequence[str] = tuple(S.SKILLS), t: Thresholds = Thresholds()) -> DataFrame:
    """a, b, commute_linf, trivial, corr, complementary: both change something, they commute, and their changes don't correlate."""
    names = sorted(skills)
    pair = [
        F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), S.max_abs_diff(S.SKILLS[x](S.SKILLS[y](F.col("px"))), S.SKILLS[y](S.SKILLS[x](F.col("px")))).alias("d"),
                 S.max_abs_diff(S.SKILLS[x](F.col("px")), F.col("px")).alias("da"), S.max_abs_diff(S.SKILLS[y](F.col("px")), F.col("px")).alias("db"))
        for i, x in enumerate(names) for j, y in enumerate(names) if i < j
    ]
    rows = battery.select(F.explode(F.array(*pair)).alias("p"))
    both = rows.groupBy("p.a", "p.b").agg(F.max("p.d").alias("commute_linf"), ((F.max("p.da") <= t.epsilon) | (F.max("p.db") <= t.epsilon)).alias("trivial"))
    out = both.join(effects(battery, names), ["a", "b"])
    return out.withColumn("complementary", ~F.col("trivial") & (F.col("commute_linf") <= t.epsilon) & (F.abs(F.coalesce("corr", F.lit(0.0))) <= t.correlation))


def subsumption(spec: DataFrame, gen: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Relational division: does the second function reproduce the first at every binding, on every probe?

    spec, gen: probe_id, skill, binding, px. One row per (spec skill, gen
    skill): reproduced, bindings, matched. Exact within epsilon.
    """
    s = spec.select("probe_id", F.col("skill").alias("s_skill"), F.col("binding").alias("s_binding"), F.col("px").alias("s_px"))
    g = gen.select("probe_id", F.col("skill").alias("g_skill"), F.col("binding").alias("g_binding"), F.col("px").alias("g_px"))
    hit = s.join(g, "probe_id").withColumn("ok", S.max_abs_diff(F.col("s_px"), F.col("g_px")) <= t.epsilon)
    pairs = hit.groupBy("s_skill", "g_skill", "s_binding", "g_binding").agg(F.bool_and("ok").alias("ok"))
    each = pairs.groupBy("s_skill", "g_skill", "s_binding").agg(F.bool_or("ok").alias("ok"))
    return each.groupBy("s_skill", "g_skill").agg(F.bool_and("ok").alias("reproduced"), F.count(F.lit(1)).alias("bindings"), F.count_if("ok").alias("matched"))


def directions(divisions: DataFrame) -> DataFrame:
    """a, b, direction: MUTUAL, A_SUBSUMES_B, B_SUBSUMES_A or NONE from the divisions both ways."""
    flip = divisions.select(F.col("g_skill").alias("a"), F.col("s_skill").alias("b"), F.col("reproduced").alias("a_covers_b"))
    keep = divisions.select(F.col("s_skill").alias("a"), F.col("g_skill").alias("b"), F.col("reproduced").alias("b_covers_a"))
    both = keep.join(flip, ["a", "b"]).where("a < b")
    return both.select("a", "b", F.when(F.col("a_covers_b") & F.col("b_covers_a"), "MUTUAL").when(F.col("a_covers_b"), "A_SUBSUMES_B").when(F.col("b_covers_a"), "B_SUBSUMES_A").otherwise("NONE").alias("direction"))
