"""Study tables: grouped summaries, Pareto fronts, correlation, matched ablation, action scores."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._order import running
from .metrics import prf, ratio

GROUP = ("method", "gate", "rho", "composition", "mode")
MATCH = ("rho", "composition", "seed", "mode")
Z95 = 1.96


def summary(value: str, prefix: str) -> list[Column]:
    """n, mean, sample deviation and normal 95 % bounds; not a number and infinite don't count, no values give zeros."""
    x = F.when(~F.isnan(value) & (F.abs(value) != float("inf")), F.col(value))
    n, mean, sd = F.count(x), F.coalesce(F.avg(x), F.lit(0.0)), F.coalesce(F.stddev_samp(x), F.lit(0.0))
    half = F.when(n > 1, Z95 * sd / F.sqrt(n.cast("double"))).otherwise(F.lit(0.0))
    return [n.alias(f"{prefix}_n"), mean.alias(f"{prefix}_mean"), sd.alias(f"{prefix}_std"), (mean - half).alias(f"{prefix}_lo"), (mean + half).alias(f"{prefix}_hi")]


def aggregate_points(points: DataFrame, values: Sequence[str], group: Sequence[str] = GROUP) -> DataFrame:
    return points.groupBy(*group).agg(*(c for v in values for c in summary(v, v)))


def bootstrap_ci(points: DataFrame, value: str, group: Sequence[str], samples: int = 2000, seed: int = 0) -> DataFrame:
    """Percentile bootstrap of the mean per group: n, mean, lo, hi.

    Equal values are one row with their number k, whose weight in a sample is a
    Poisson draw of mean k, seeded by the group and the value; tasks sum
    weights and weighted values over what they read, so that a group of any
    size leaves a task as two numbers a sample, and reruns agree.
    """
    names = list(group)
    counted = points.where(F.col(value).isNotNull()).groupBy(*names, F.col(value).cast("double").alias("_x")).agg(F.count(F.lit(1)).alias("_k"))
    keyed = counted.withColumn("_seed", F.pmod(F.xxhash64(*names, "_x", F.lit(seed)), F.lit(1 << 62)))

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for b in batches:
            for key, x, k, s in zip(b[names].itertuples(index=False, name=None), b["_x"], b["_k"], b["_seed"], strict=True):
                weight = np.random.default_rng(int(s)).poisson(k, samples)
                total = sums.setdefault(key, np.zeros((2, samples)))
                total[0] += weight
                total[1] += weight * x
        rows = [[*key, i, w, v] for key, (ws, vs) in sums.items() for i, (w, v) in enumerate(zip(ws, vs, strict=True))]
        yield pd.DataFrame(rows, columns=[*names, "_i", "_w", "_v"])

    kinds = ", ".join(f"`{c}` {points.schema[c].dataType.simpleString()}" for c in names)
    each = keyed.mapInPandas(drawn, f"{kinds}, _i int, _w double, _v double").groupBy(*names, "_i").agg(F.try_divide(F.sum("_v"), F.sum("_w")).alias("_m"))
    rank = lambda q: F.get(F.array_sort(F.collect_list("_m")), int(q * (samples - 1)))  # noqa: E731  of at most ``samples`` means
    bounds = each.groupBy(*names).agg(rank(0.025).alias("lo"), rank(0.975).alias("hi"))
    whole = counted.groupBy(*names).agg(F.sum("_k").alias("n"), (F.sum(F.col("_x") * F.col("_k")) / F.sum("_k")).alias("mean"))
    same = F.lit(True)
    for c in names:
        same = same & whole[c].eqNullSafe(bounds[c])
    return whole.join(bounds, same).select(*(whole[c] for c in names), "n", "mean", "lo", "hi")


def pareto_front(points: DataFrame, best: Sequence[str], least: Sequence[str] = ()) -> DataFrame:
    """Rows that no other row dominates: at least as good everywhere and better somewhere. Equal rows all stay; of three goals and more, rows with a null go.

    For two goals this is a sort and a running maximum over distinct goal
    pairs. For more, each task first leaves out what its own rows dominate, in
    order of the goals' sum, and only these local fronts are compared.
    """
    goals = [F.col(c).cast("double") for c in best] + [-F.col(c).cast("double") for c in least]
    named = points.withColumns({f"_g{i}": g for i, g in enumerate(goals)})
    keys = [f"_g{i}" for i in range(len(goals))]
    distinct = named.select(*keys).distinct()
    if len(keys) == 2:
        tops = distinct.groupBy("_g0").agg(F.max("_g1").alias("_g1"))
        # The first row to reach a maximum is the only one of those equal to it that stays.
        best_yet = running(tops, [F.col("_g0").desc()], {"_m": F.col("_g1")}, F.max)
        front = best_yet.where("_g1 <=> _m").groupBy("_m").agg(F.max("_g0").alias("_g0")).select("_g0", F.col("_m").alias("_g1"))
    else:
        kinds = ", ".join(f"{k} double" for k in keys)

        def undominated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            kept = np.zeros((0, len(keys)))
            for b in batches:
                x = np.concatenate((kept, b[keys].to_numpy(float)))
                x = x[np.argsort(-x.sum(axis=1), kind="stable")]
                kept = np.zeros((0, len(keys)))
                for row in x:  # what dominates a row has a larger sum
                    if not ((kept >= row).all(axis=1) & (kept > row).any(axis=1)).any():
                        kept = np.vstack((kept, row))
            yield pd.DataFrame(kept, columns=keys)

        complete = distinct.dropna()
        front = complete.mapInPandas(undominated, kinds).coalesce(1).mapInPandas(undominated, kinds)
    return named.join(front, keys, "left_semi").drop(*keys)


def pearson(x: str, y: str) -> Column:
    """Null for fewer than two rows or no variance; never divides by zero."""
    return F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def average_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """Average rank of ties, from counts of distinct values."""
    by = df.groupBy(column).agg(F.count(F.lit(1)).alias("_k"))
    ranked = running(by, [F.col(column)], {name: F.col("_k")}).withColumn(name, F.col(name) - (F.col("_k") - 1) / 2.0).drop("_k")
    return df.join(ranked, column)


def construct_validity(points: DataFrame, x: str, y: str) -> DataFrame:
    """n, pearson, spearman."""
    rows = points.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null")
    rows = average_ranks(average_ranks(rows, "x", "rx"), "y", "ry")
    return rows.agg(F.count(F.lit(1)).alias("n"), pearson("x", "y").alias("pearson"), pearson("rx", "ry").alias("spearman"))


def ablation(points: DataFrame, values: Sequence[str], on: str = "output", off: str = "text", match: Sequence[str] = MATCH) -> DataFrame:
    """Matched differences of the means of two gates, one row per match."""
    side = lambda gate, tag: points.where(F.col("gate") == gate).groupBy(*match).agg(*(F.avg(v).alias(f"{tag}_{v}") for v in values))
    both = side(on, "on").join(side(off, "off"), list(match))
    return both.select(*match, *((F.col(f"on_{v}") - F.col(f"off_{v}")).alias(f"delta_{v}") for v in values))


def _key(kinds: tuple[str, ...]) -> list[Column]:
    second = F.when(F.col("kind").isin("merge", "parameterize"), F.coalesce("secondary", F.lit(""))).otherwise(F.lit(""))
    return [F.col("kind"), F.coalesce("primary", F.lit("")).alias("primary"), second.alias("secondary")]


SCORED = ("merge", "parameterize", "modify", "remove")


def score_actions(log: DataFrame, ideal: DataFrame, by: Sequence[str] = (), applied_only: bool = True) -> DataFrame:
    """Multiset match of actions by (kind, primary, secondary of merges only): tp, fp, fn and their scores.

    Counts per key are compared, so repeats need no numbering.
    """
    done = log.where(F.col("status") == "applied") if applied_only else log
    got = done.where(F.col("kind").isin(*SCORED)).select(*by, *_key(SCORED)).groupBy(*by, "kind", "primary", "secondary").agg(F.count(F.lit(1)).alias("g"))
    want = ideal.where(F.col("kind").isin(*SCORED)).select(*by, *_key(SCORED)).groupBy(*by, "kind", "primary", "secondary").agg(F.count(F.lit(1)).alias("w"))
    both = got.join(want, [*by, "kind", "primary", "secondary"], "full").fillna(0, ["g", "w"])
    agg = both.groupBy(*by).agg(F.sum(F.least("g", "w")).alias("tp"), F.sum(F.greatest(F.col("g") - F.col("w"), F.lit(0))).alias("fp"), F.sum(F.greatest(F.col("w") - F.col("g"), F.lit(0))).alias("fn"))
    n = {c: F.coalesce(c, F.lit(0)) for c in ("tp", "fp", "fn")}
    return agg.select(*by, *(v.alias(c) for c, v in n.items()), *prf(n["tp"], n["fp"], n["fn"]))


def action_cost(log: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """cost: actions but for the end; nonproductive: of these, all that were not applied."""
    return log.groupBy(*by).agg(F.count_if(F.col("kind") != "end").alias("cost"), F.count_if((F.col("kind") != "end") & (F.col("status") != "applied")).alias("nonproductive"))


def intrinsic_score(scored: DataFrame, costs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """F1 times 1 - half the share of unproductive actions, in 0..1; 0 without actions."""
    rows = scored.join(costs, list(by)) if by else scored.crossJoin(costs)  # without keys: single rows
    value = F.col("f1") * F.greatest(F.lit(0.0), 1 - 0.5 * ratio(F.col("nonproductive"), F.col("cost")))
    return rows.select(*by, "f1", "cost", F.when(F.col("cost") == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))).alias("intrinsic"))


def success_by_split(scores: DataFrame) -> DataFrame:
    """split (null: overall), n, success_rate."""
    return scores.groupingSets([[F.col("split")], []], "split").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("success").cast("double")).alias("success_rate"))
