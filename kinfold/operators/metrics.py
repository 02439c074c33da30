"""Agreement of predicted relations with the truth.

truth: a, b, relation, hard (boolean). pred: a, b, relation, mergeable.
Pairs are compared where both tables have them; abstention looks at all predictions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import RELATIONS

MERGEABLE = ("EXACT", "PERCEPTUAL")


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), (tp + fn).alias("support")]


def compared(truth: DataFrame, pred: DataFrame) -> DataFrame:
    t = truth.select("a", "b", F.col("relation").alias("true"), F.col("hard"))
    return t.join(pred.select("a", "b", F.col("relation").alias("pred"), F.col("mergeable").alias("merge")), ["a", "b"])


def _relations(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(i, r) for i, r in enumerate(RELATIONS)], "pos int, relation string")


def per_relation_prf(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """relation, tp, fp, fn, precision, recall, f1, support: one against the rest."""
    counts = compared(truth, pred).select(F.explode(F.array(F.struct(F.col("true").alias("relation"), (F.col("true") == F.col("pred")).alias("hit"), F.lit(True).alias("is_true")), F.struct(F.col("pred").alias("relation"), (F.col("true") == F.col("pred")).alias("hit"), F.lit(False).alias("is_true")))).alias("x"))
    agg = counts.groupBy("x.relation").agg(F.count_if(F.col("x.hit") & F.col("x.is_true")).alias("tp"), F.count_if(~F.col("x.hit") & ~F.col("x.is_true")).alias("fp"), F.count_if(~F.col("x.hit") & F.col("x.is_true")).alias("fn"))
    rows = F.broadcast(_relations(truth)).join(agg, "relation", "left").fillna(0, ["tp", "fp", "fn"])  # six rows
    return rows.select("relation", "tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def confusion_matrix(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """true, and a count for each relation and UNCERTAIN; zero-filled."""
    values = [*RELATIONS, "UNCERTAIN"]
    grid = compared(truth, pred).groupBy(F.col("true").alias("relation")).pivot("pred", values).count()
    return _relations(truth).join(grid, "relation", "left").fillna(0, values).select(F.col("relation").alias("true"), *values)


def mergeable_prf(truth: DataFrame, pred: DataFrame) -> DataFrame:
    right = F.col("true").isin(*MERGEABLE)
    agg = compared(truth, pred).agg(F.count_if(right & F.col("merge")).alias("tp"), F.count_if(~right & F.col("merge")).alias("fp"), F.count_if(right & ~F.col("merge")).alias("fn"))
    return agg.select("tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def merge_safety(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """slice (all, hard), n, false_merges, false_merge_rate, precision_on_distinct over truly DISTINCT pairs."""
    rows = compared(truth, pred).where(F.col("true") == "DISTINCT")
    slices = rows.select("merge", F.explode(F.when(F.col("hard"), F.array(F.lit("all"), F.lit("hard"))).otherwise(F.array(F.lit("all")))).alias("slice"))
    agg = slices.groupBy("slice").agg(F.count(F.lit(1)).alias("n"), F.count_if("merge").alias("false_merges"))
    both = rows.sparkSession.createDataFrame([("all",), ("hard",)], "slice string").join(agg, "slice", "left").fillna(0)
    rate = ratio(F.col("false_merges"), F.col("n"))
    return both.select("slice", "n", "false_merges", rate.alias("false_merge_rate"), (1 - rate).alias("precision_on_distinct"))


def divergence(output: DataFrame, text: DataFrame, truth: DataFrame) -> DataFrame:
    """true, n, disagree, over_merge, under_merge, disagree_rate: where output and text verdicts on merging part."""
    o = output.select("a", "b", F.col("mergeable").alias("o"))
    x = text.select("a", "b", F.col("mergeable").alias("x"))
    rows = truth.select("a", "b", F.col("relation").alias("true")).join(o, ["a", "b"]).join(x, ["a", "b"])
    agg = rows.groupBy("true").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o") != F.col("x")).alias("disagree"), F.count_if(F.col("x") & ~F.col("o")).alias("over_merge"), F.count_if(F.col("o") & ~F.col("x")).alias("under_merge"))
    return agg.withColumn("disagree_rate", ratio(F.col("disagree"), F.col("n")))


def abstention(pred: DataFrame) -> DataFrame:
    return pred.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg((F.col("relation") == "UNCERTAIN").cast("double")), F.lit(0.0)).alias("abstention_rate"))


def cohen_kappa(rated: DataFrame) -> DataFrame:
    """rated: x, y. Kappa of two raters; 1 if agreement by chance is certain, 0 for no rows."""
    cells = rated.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    total = cells.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)).alias("agreed"))
    sides = cells.select(F.explode(F.array(F.struct(F.col("x").cast("string").alias("c"), F.col("n").alias("nx"), F.lit(0).cast("long").alias("ny")), F.struct(F.col("y").cast("string").alias("c"), F.lit(0).cast("long").alias("nx"), F.col("n").alias("ny")))).alias("s"))
    chance = sides.groupBy("s.c").agg((F.sum("s.nx").cast("double") * F.sum("s.ny")).alias("m")).agg(F.sum("m").alias("m"))
    po, pe = F.col("agreed") / F.col("total"), F.col("m") / (F.col("total").cast("double") * F.col("total"))
    kappa = F.when(F.col("total").isNull(), F.lit(0.0)).when(pe >= 1, F.lit(1.0)).otherwise(F.try_divide(po - pe, 1 - pe))
    return total.crossJoin(chance).select(F.coalesce("total", F.lit(0)).alias("n"), kappa.alias("kappa"))  # two single rows


def fleiss_kappa(rated: DataFrame) -> DataFrame:
    """rated: item, category, one row per rating. Items with as many ratings as the most rated one count."""
    cells = rated.groupBy("item", "category").agg(F.count(F.lit(1)).alias("k"))
    items = cells.groupBy("item").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("k")).alias("sq"))
    most = items.agg(F.max("n").alias("most"))
    full = items.join(F.broadcast(most), F.col("n") == F.col("most"))  # one row
    inner = full.agg(F.count(F.lit(1)).alias("items"), F.avg((F.col("sq") - F.col("n")) / (F.col("n") * (F.col("n") - 1)).cast("double")).alias("p"), F.max("n").alias("raters"))
    shares = cells.join(full.select("item"), "item", "left_semi").groupBy("category").agg(F.sum("k").alias("k"))
    chance = shares.agg(F.sum(F.col("k").cast("double") * F.col("k")).alias("s"), F.sum("k").alias("t")).select((F.col("s") / (F.col("t").cast("double") * F.col("t"))).alias("pe"))
    return inner.crossJoin(chance).select("items", "raters", F.when(F.col("pe") >= 1, F.lit(1.0)).otherwise((F.col("p") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"))  # two single rows
