"""Mixing sources to target weights by entropy balancing.

The mix minimises the relative entropy of document rates to one copy each,
subject to a token constraint per source and to an upper bound on every rate.
The convex dual has one multiplier per source and its solution tilts rates
exponentially in document size: ``rate = min(bound, exp(multiplier * size /
mean size))``. Safeguarded Newton steps on the dual are distributed
aggregations over (source, size, count) cells, which hold the whole table
exactly. Rates are rounded into whole copies by a hash of each document; per
source the one of ``SHIFTS`` shifts of those hashes that comes nearest to the
target is taken, in one further aggregation.

Defined cases: a null text has size 0 and is taken never or as often as its
rate says, adding nothing; sources compare by code point with null last and
are a source of their own; a source without words has target 0; an empty table
gives an empty result; rows that repeat get equal copies. Clashing names among
other columns do no harm. Reruns agree, whatever the partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._work import checkpointed, small_side, whole_row

BOUND = 3.0
SHIFTS = 64
STEPS = 60
CELLS_PER_TASK = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(cells: DataFrame, bound: float = BOUND) -> DataFrame:
    """source, source_size, weight, target: shares by weight, stopped at ``bound`` times the size and reshared.

    Ranks come from range-partitioned blocks of sources and their counts, so
    no task holds all sources.
    """
    sized = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    ordered = sized.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    ordered = checkpointed(ordered.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)))
    parts = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    before = parts.withColumn("before", F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).drop("rows")
    ranked = checkpointed(ordered.join(F.broadcast(before), "part").withColumn("weight", (1 + (F.col("before") + F.col("at")) % 3).cast("double")).select("source", "source_size", "weight"))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    full, level = F.lit(False), 0.0
    most = bound * F.col("source_size")
    while True:
        taken, weight = ranked.agg(F.coalesce(F.sum(F.when(full, most)), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        level = (total - taken) / weight if weight else 0.0
        over = ~full & (F.lit(level) * F.col("weight") > most)
        if ranked.where(over).isEmpty():
            break
        full = full | (F.lit(level) * F.col("weight") > most)
    return ranked.withColumn("target", F.when(full, most).otherwise(F.lit(level) * F.col("weight")))


def balanced(cells: DataFrame, targets: DataFrame, bound: float = BOUND, steps: int = STEPS, tolerance: float = 1e-6) -> DataFrame:
    """source, mean, multiplier: the solution of the dual. A source at its stop has the multiplier infinity.

    A step is one aggregation of the cells and one update of the sources, in
    one job; the first steps guess that rates barely depend on size.
    """
    stats = cells.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    dual = targets.alias("t").join(stats.alias("s"), F.col("t.source").eqNullSafe(F.col("s.source"))).select("t.source", "target", "source_size", "mean")
    at_stop = F.col("target") >= bound * F.col("source_size") * (1 - 1e-12)
    guess = F.coalesce(F.log(F.greatest(F.try_divide(F.col("target"), "source_size"), F.lit(1e-9))), F.lit(0.0))
    dual = checkpointed(dual.select("*", guess.alias("x"), F.lit(-1e6).alias("lo"), F.lit(1e6).alias("hi"), (at_stop | (F.col("source_size") == 0)).alias("done")))
    sources, left = dual.agg(F.count(F.lit(1)), F.count_if(~F.col("done"))).first()
    for _ in range(steps):
        if not left:
            break
        c, d = cells.alias("c"), small_side(dual.where("not done").select(F.col("source").alias("d_source"), "x", "mean"), 64 * sources).alias("d")
        tilt = F.col("x") * F.col("size") / F.col("mean")
        rate = F.when(tilt < F.log(F.lit(bound)), F.exp(tilt)).otherwise(F.lit(bound))
        slope = F.when(tilt < F.log(F.lit(bound)), F.exp(tilt) * F.col("size") / F.col("mean")).otherwise(F.lit(0.0))
        moved = c.join(d, F.col("source").eqNullSafe(F.col("d_source"))).groupBy("d_source").agg(F.sum(F.col("n") * F.col("size") * rate).alias("got"), F.sum(F.col("n") * F.col("size") * slope).alias("grad"))
        both = dual.join(small_side(moved, 64 * sources), F.col("source").eqNullSafe(F.col("d_source")), "left")
        gap = F.col("got") - F.col("target")
        low, high = F.when(gap < 0, F.col("x")).otherwise(F.col("lo")), F.when(gap > 0, F.col("x")).otherwise(F.col("hi"))
        both = both.withColumn("gap", gap).withColumn("lo2", F.coalesce(low, "lo")).withColumn("hi2", F.coalesce(high, "hi"))
        newton = F.col("x") - F.try_divide(F.col("gap"), F.col("grad"))
        middle = F.when((F.col("lo2") > -1e6) & (F.col("hi2") < 1e6), (F.col("lo2") + F.col("hi2")) / 2).otherwise(F.col("x") + F.signum(-F.col("gap")) * F.greatest(F.lit(0.5), F.abs("x")))
        step = F.when(newton.isNotNull() & (newton > F.col("lo2")) & (newton < F.col("hi2")) & (F.abs(newton - F.col("x")) <= 4 + F.abs("x")), newton).otherwise(middle)
        near = F.abs("gap") <= tolerance * F.col("target")
        dual = checkpointed(both.select("source", "target", "source_size", "mean", F.when(F.col("done") | near, F.col("x")).otherwise(step).alias("x"), F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), (F.col("done") | F.coalesce(near, F.lit(False))).alias("done")))
        left = dual.agg(F.count_if(~F.col("done"))).first()[0]
    return dual.withColumn("multiplier", F.when(at_stop, F.lit(float("inf"))).otherwise(F.col("x"))).select("source", "mean", "multiplier", "target", "source_size")


def _planned(docs: DataFrame, id_col: str, text_col: str, source_col: str, bound: float) -> DataFrame:
    """``_kf``, a struct of source, size, source_size, target, rate and copies, and ``_kf_row``, a struct of the row of ``docs``. Only tables of sources are joined to it."""
    own = F.struct(F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"), (F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 40)) / F.lit(float(1 << 40))).alias("point"))
    cells = checkpointed(docs.select(own.alias("_kf")).groupBy("_kf.source", "_kf.size").agg(F.count(F.lit(1)).alias("n")))
    cells = cells.coalesce(1 + cells.count() // CELLS_PER_TASK)
    dual = checkpointed(balanced(cells, source_targets(cells, bound), bound))
    sources = dual.count()

    def rated(rows: DataFrame) -> DataFrame:
        side = small_side(dual.select(F.struct(*dual.columns).alias("_kf_dual")), 64 * sources)
        tilt = F.col("_kf_dual.multiplier") * F.col("_kf.size") / F.col("_kf_dual.mean")
        free = F.coalesce(tilt, F.lit(0.0)) < F.log(F.lit(bound))
        rate = F.when((F.col("_kf_dual.multiplier") < float("inf")) & free, F.coalesce(F.exp(tilt), F.lit(1.0))).otherwise(F.lit(bound))
        return rows.join(side, F.col("_kf.source").eqNullSafe(F.col("_kf_dual.source"))).withColumn("_kf_rate", rate)

    def copies(shift: Column) -> Column:
        return F.least(F.floor(F.col("_kf_rate") + (F.col("_kf.point") + shift) % 1.0), F.lit(int(bound))).cast("long")

    tries = rated(docs.select(own.alias("_kf"))).groupBy("_kf.source").agg(F.max("_kf_dual.target").alias("t"), *(F.sum(copies(F.lit(k / SHIFTS)) * F.col("_kf.size")).alias(f"k{k}") for k in range(SHIFTS)))
    missed = F.array(*(F.struct(F.abs(F.col(f"k{k}") - F.col("t")).alias("off"), F.lit(k / SHIFTS).alias("shift")) for k in range(SHIFTS)))
    shifts = checkpointed(tries.select(F.struct("source", F.array_min(missed)["shift"].alias("shift")).alias("_kf_shift")))
    out = rated(docs.select(own.alias("_kf"), whole_row(docs, "_kf_row"))).join(small_side(shifts, 64 * sources), F.col("_kf.source").eqNullSafe(F.col("_kf_shift.source")))
    told = F.struct("_kf.source", "_kf.size", "_kf_dual.source_size", "_kf_dual.target", F.col("_kf_rate").alias("rate"), copies(F.col("_kf_shift.shift")).alias("copies"))
    return out.withColumn("_kf", told).drop("_kf_dual", "_kf_rate", "_kf_shift")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", bound: float = BOUND) -> DataFrame:
    """One row per document: id, source, size, source_size, target, rate, copies, taken."""
    out = _planned(docs.select(id_col, text_col, source_col), id_col, text_col, source_col, bound)
    return out.select(f"_kf_row.`{id_col}`", "_kf.*", (F.col("_kf.copies") * F.col("_kf.size")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", bound: float = BOUND) -> DataFrame:
    """The documents that the mix takes, once each, with ``copies``: how often training repeats them. A column of that name in ``docs`` gives way."""
    out = _planned(docs.drop("copies"), id_col, text_col, source_col, bound)
    return out.where("_kf.copies > 0").select("_kf_row.*", "_kf.copies")
