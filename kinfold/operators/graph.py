"""Integrity of the relation graph: cycles, closure, duplicates, unknown ids, coverage, disjointness.

Every check returns the offending rows; an empty result means that it holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ._store import cut

def reachable(edges: DataFrame) -> DataFrame:
    """edges: src, dst. All (src, dst) with a path of any length: the relation is squared until nothing is new."""
    known = cut(edges.select("src", "dst").distinct())
    n = known.count()
    while True:
        hop = known.alias("x").join(known.alias("y"), F.col("x.dst") == F.col("y.src")).select(F.col("x.src").alias("src"), F.col("y.dst").alias("dst"))
        known = cut(known.union(hop).distinct())
        now = known.count()
        if now == n:
            return known
        n = now


def core(edges: DataFrame) -> DataFrame:
    """Edges that may lie on a cycle: those whose ends nothing enters or leaves go, until nothing changes or hardly anything does."""
    left = cut(edges.select("src", "dst").distinct())
    n = left.count()
    while n:
        inner = left.join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        left = cut(inner.select("src", "dst"))
        now = left.count()
        if now > 0.9 * n:
            break
        n = now
    return left


def cycles(edges: DataFrame) -> DataFrame:
    """Nodes that reach themselves, however long the way."""
    return reachable(core(edges)).where("src = dst").select(F.col("src").alias("node")).distinct()


def components(pairs: DataFrame) -> DataFrame:
    """pairs: a, b. node, comp (the least node of its component): least neighbours and pointer jumping."""
    both = cut(pairs.select("a", "b").union(pairs.select("b", "a")).distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("comp")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("comp").alias("c")), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c"))
        stepped = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "c").alias("comp"))
        up = labels.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        moved = cut(stepped.join(up, "comp").select("node", "old", F.least("comp", "up").alias("comp")))
        labels = moved.select("node", "comp")
        if moved.where("comp <> old").isEmpty():
            return labels


def closure_gaps(exact: DataFrame) -> DataFrame:
    """exact: a, b. Pairs of one component that are not listed. Only components with fewer pairs than they should have are looked into."""
    listed = exact.select(*S.pair_key("a", "b")).where("a <> b").distinct()
    comps = components(listed)
    size = comps.groupBy("comp").agg(F.count(F.lit(1)).alias("k"))
    have = listed.join(comps.select(F.col("node").alias("a"), "comp"), "a").groupBy("comp").agg(F.count(F.lit(1)).alias("m"))
    short = comps.join(size.join(have, "comp").where("m < k * (k - 1) / 2").select("comp"), "comp", "left_semi")
    pairs = short.select("comp", F.col("node").alias("a")).join(short.select("comp", F.col("node").alias("b")), "comp").where("a < b").select("a", "b")
    return pairs.join(listed, ["a", "b"], "left_anti")


def repeated_pairs(relations: DataFrame) -> DataFrame:
    return relations.select(*S.pair_key("a", "b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def self_pairs(relations: DataFrame) -> DataFrame:
    return relations.where("a = b")


def unknown_ids(relations: DataFrame, known: DataFrame) -> DataFrame:
    ids = relations.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return ids.join(known.select("id"), "id", "left_anti")


def labels_for(pairs: DataFrame, designed: DataFrame) -> DataFrame:
    """pairs: a, b in any order. relation (DISTINCT if not designed), direction relative to the order asked, hard."""
    keyed = pairs.withColumns({"x": F.least("a", "b"), "y": F.greatest("a", "b")})
    d = designed.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), "relation", "spec", "hard")
    out = keyed.join(d, ["x", "y"], "left")
    direction = F.when(F.col("relation") != "SUBSUMPTION", "NONE").when(F.col("a") == F.col("spec"), "B_SUBSUMES_A").when(F.col("spec").isNotNull(), "A_SUBSUMES_B").otherwise("NONE")
    return out.select("a", "b", F.coalesce("relation", F.lit("DISTINCT")).alias("relation"), direction.alias("direction"), F.coalesce("hard", F.lit(False)).alias("hard"))


def coverage_gaps(rows: DataFrame, column: str, required: dict[str, int]) -> DataFrame:
    """value, n, needed of values that occur too rarely; absent ones with 0."""
    need = rows.sparkSession.createDataFrame(sorted(required.items()), "value string, needed int")
    counts = rows.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return need.join(counts, "value", "left").fillna(0, ["n"]).where("n < needed")


def zero_filled(rows: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """value, n for all listed values."""
    counts = rows.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return rows.sparkSession.createDataFrame([(v,) for v in values], "value string").join(counts, "value", "left").fillna(0, ["n"])


def in_two_splits(rows: DataFrame, key: str, split: str = "split") -> DataFrame:
    return rows.groupBy(key).agg(F.countDistinct(split).alias("n")).where("n > 1")


def shared(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key the other table has too."""
    return rows.join(other.select(key), key, "left_semi")
