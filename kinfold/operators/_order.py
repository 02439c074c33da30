"""Running totals over the order of a whole table, without a window that holds it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import cut


def running(df: DataFrame, order: list[Column], totals: dict[str, Column], over: Callable[[Column], Column] = F.sum) -> DataFrame:
    """``df`` with, for each name, ``over`` of that column in all rows up to and including the own one; ``order`` has no ties.

    Rows are dealt by ranges of the order. Each range is summed by itself, and
    what the ranges before it come to is added: one row a range and not of the
    table is ordered in one task. ``over`` is a sum or a maximum. The ranges are
    checkpointed, as they may be drawn anew at each evaluation.
    """
    ranged = cut(df.withColumns({f"_v_{n}": c for n, c in totals.items()}).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("_range").agg(*(over(F.col(f"_v_{n}")).alias(f"_t_{n}") for n in totals))
    parts = parts.select("_range", *(over(F.col(f"_t_{n}")).over(ahead).alias(f"_b_{n}") for n in totals))
    here = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = ranged.join(F.broadcast(parts), "_range")  # a row a range
    plus = (lambda n, own: F.coalesce(F.col(f"_b_{n}"), F.lit(0)) + own) if over is F.sum else (lambda n, own: F.greatest(f"_b_{n}", own))
    out = rows.withColumns({n: plus(n, over(F.col(f"_v_{n}")).over(here)) for n in totals})
    return out.drop("_range", *(f"_{k}_{n}" for k in "vb" for n in totals))
