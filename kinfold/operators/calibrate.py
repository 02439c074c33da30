"""Threshold sweeps and the choice of operating points.

Sweeps aggregate by distinct score first, so what is ordered is the scores and not the rows.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._order import running
from .compare import Thresholds
from .metrics import ratio


def curve(samples: DataFrame, at_most: bool = True) -> DataFrame:
    """samples: score, positive. threshold, tp, fp, precision, recall for each distinct score, and for a threshold that takes nothing."""
    by = samples.where(F.col("score").isNotNull()).groupBy("score").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("n"))
    order = F.col("score") if at_most else F.col("score").desc()
    swept = running(by, [order], {"tp": F.col("p"), "fp": F.col("n")}).select(F.col("score").alias("threshold"), "tp", "fp")
    none = samples.sparkSession.createDataFrame([(float("-inf") if at_most else float("inf"), 0, 0)], "threshold double, tp long, fp long")
    total = by.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("pos"))
    rows = swept.unionByName(none).crossJoin(F.broadcast(total))  # one row
    return rows.select("threshold", "tp", "fp", F.when(F.col("tp") + F.col("fp") == 0, F.lit(1.0)).otherwise(ratio(F.col("tp"), F.col("tp") + F.col("fp"))).alias("precision"), ratio(F.col("tp"), F.col("pos")).alias("recall"))


def select_threshold(samples: DataFrame, min_precision: float, min_recall: float) -> DataFrame:
    """The lowest threshold of largest recall among those that meet both floors; else the best by precision, recall, lowest threshold."""
    rows = curve(samples).withColumn("meets", (F.col("precision") >= min_precision) & (F.col("recall") >= min_recall))
    order = [F.col("meets").desc(), F.when(F.col("meets"), F.lit(0.0)).otherwise(-F.col("precision")), F.col("recall").desc(), F.col("threshold")]
    return rows.orderBy(*order).limit(1).select("threshold", "precision", "recall", "meets")


def select_delta(samples: DataFrame, tau: float, grid: tuple[float, ...], min_precision: float) -> DataFrame:
    """The smallest band whose decided rows (score <= tau * (1 - delta)) reach the precision; else the largest band."""
    rows = samples.select("positive", "score", F.explode(F.array(*map(F.lit, grid))).alias("delta"))
    agg = rows.groupBy("delta").agg(F.count_if((F.col("score") <= tau * (1 - F.col("delta"))) & F.col("positive")).alias("tp"), F.count_if(F.col("score") <= tau * (1 - F.col("delta"))).alias("taken"))
    ok = (F.col("taken") > 0) & (ratio(F.col("tp"), F.col("taken")) >= min_precision)
    return agg.agg(F.coalesce(F.min(F.when(ok, F.col("delta"))), F.lit(max(grid))).alias("delta"))


def calibrated(pairs: DataFrame, base: Thresholds, date: str, min_precision: float = 0.99, min_recall: float = 0.5, grid: tuple[float, ...] = (0.0, 0.05, 0.1, 0.15, 0.2)) -> Thresholds:
    """pairs: pos, a, b, true, perceptual, semantic. Fitted thresholds with their provenance."""
    perc = pairs.select(F.col("perceptual").alias("score"), F.col("true").isin("EXACT", "PERCEPTUAL").alias("positive"))
    rest = pairs.where(~F.col("true").isin("EXACT", "PERCEPTUAL")).select(F.col("semantic").alias("score"), (F.col("true") == "SEMANTIC_PRESERVING").alias("positive"))
    p = select_threshold(perc, min_precision, min_recall).first()["threshold"]
    s = select_threshold(rest, min_precision, min_recall).first()["threshold"]
    finite = lambda x, d: x if abs(x) != float("inf") else d
    tau = finite(p, base.perceptual)
    delta = select_delta(perc, tau, grid, min_precision).first()["delta"]
    return replace(base, perceptual=tau, semantic=finite(s, base.semantic), delta=delta, calibrated=True, split_hash=split_hash(pairs), date=date)


def split_hash(pairs: DataFrame) -> str:
    """A digest of the labelled pairs and their places: SHA-256 over the number of rows and the sums of the parts of each row's SHA-256, so that no task holds all rows."""
    row = F.sha2(F.concat_ws("|", F.col("pos").cast("string"), "a", "b", "true", F.col("perceptual").cast("string"), F.col("semantic").cast("string")), 256)
    part = lambda k: F.conv(F.substring(row, 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)")
    sums = pairs.agg(F.count(F.lit(1)).cast("string").alias("n"), *(F.coalesce(F.sum(part(k)), F.lit(0)).cast("string").alias(f"s{k}") for k in range(8)))
    return sums.select(F.sha2(F.concat_ws("|", "n", *(f"s{k}" for k in range(8))), 256)).first()[0]


def operating_points(scored: DataFrame) -> DataFrame:
    """scored: track, score, positive, hard. Per track the threshold (score >= t) that is best by F1, precision, fewest false merges, fewest hard ones, highest t."""
    by = scored.where(~F.isnan("score") & F.col("score").isNotNull()).groupBy("track", "score").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("n"), F.count_if(~F.col("positive") & F.col("hard")).alias("h"))
    w = Window.partitionBy("track").orderBy(F.col("score").desc())
    all_ = Window.partitionBy("track")
    rows = by.select("track", F.col("score").alias("threshold"), F.sum("p").over(w).alias("tp"), F.sum("n").over(w).alias("fp"), F.sum("h").over(w).alias("hard_fp"), F.sum("p").over(all_).alias("pos"), F.sum("n").over(all_).alias("neg"), F.sum("h").over(all_).alias("hard"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("pos"))
    rows = rows.withColumns({"precision": p, "recall": r, "f1": ratio(2 * p * r, p + r), "fmr": ratio(F.col("fp"), F.col("neg")), "hard_fmr": ratio(F.col("hard_fp"), F.col("hard"))})
    best = Window.partitionBy("track").orderBy(F.col("f1").desc(), F.col("precision").desc(), "fmr", "hard_fmr", F.col("threshold").desc())
    return rows.withColumn("k", F.row_number().over(best)).where("k = 1").select("track", "threshold", "precision", "recall", "f1", "fmr", "hard_fmr")


def cluster_split(pairs: DataFrame, families: list[str]) -> DataFrame:
    """pairs: a, b, family_a, family_b. split: calibration if both families are listed, test if neither; mixed pairs go."""
    a, b = F.col("family_a").isin(families), F.col("family_b").isin(families)
    return pairs.withColumn("split", F.when(a & b, "calibration").when(~a & ~b, "test")).where("split is not null")
