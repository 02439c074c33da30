"""Jaccard self-join on word shingles by an R-tree over count vectors.

A document's set is its distinct shingles. They are hashed into groups, and the
counts of its shingles by group are a point. Two sets can't share more than
the sum, over the groups, of the lesser of both counts; a box, which keeps the
greatest count of its points in each group, bounds what any of them can share.
So a query leaves out a box, and then a point, whose summed minima fall short
of what the threshold asks for, and the sets themselves decide the rest.

The groups are fine at the top and coarse below. At the root a group is a hash
of 64 bits, so that a count is 0 or 1, and the box is far too large to be held
anywhere: its coordinates are rows, dealt over all tasks by range. A document
asks it, without itself, twice. First for its ``ASKED`` least coordinates, more
than it may miss by a share of one in ``SPARE``: two sets at the threshold have
so many of the least coordinates of both in common, whatever the others do.
Then the few that are left ask for all their coordinates, in the box of these
few; those for which the minima don't add up to the threshold link to nothing, nor
do those for which they don't add up with points of any one size: a set that
shares 80 % of its shingles, all with sets as large as itself, needs 89 % of them.
The rest are packed, in the order of their coordinates, into leaves of at most
``LEAF_SHINGLES`` and ``LEAF_POINTS``, so that sets alike mostly meet in one. A
leaf has a box over ``BOX_GROUPS`` groups, and vectors of ``POINT_GROUPS``
groups for its points. A query visits the leaves whose box is above zero in one
of its rarest least coordinates, as many as leave too few others for a link
(a coordinate's leaves are bits, so that it tells many in one row);
then it takes the leaf's whole box, its points and at last their sets.

What is linked by then needs no other link: a leaf joins with itself first;
then of each component one document is compared with each hub, the document
with most company among those of a coordinate; and only coordinates that still
hold several components call for visits, in which documents of one component
aren't compared and the smaller of two components visits. So a group of
copies gives a handful of rows and comparisons, not all its pairs. Documents
that share many least coordinates and yet stay below the threshold are
compared, inside tasks, as often as they meet.

Defined cases: words are runs without ASCII white space, A-Z lower-cased; fewer
words than a shingle make one of them all; null texts and texts without words
have an empty set, which links with nothing, not even its like. The component
of a document is the smallest id that its links reach, itself included; null
ids don't count unless there is no other, then it is null. Rows that repeat are
rows of their own in the result. Sets are compared by 64-bit hashes. Texts of
any length are read whole; one set larger than a leaf is a leaf. Empty tables
give empty results; other columns are not looked at.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text
from ._work import checkpointed, small_side, trimmed, written
from .bagminhash import components

#: Two sets link if 100 times their intersection is at least PERCENT times their union.
PERCENT = 80
SPARE = 10
LEAF_SHINGLES, LEAF_POINTS = 1 << 15, 256
BOX_GROUPS, POINT_GROUPS = 1 << 16, 64
#: Sizes of sets that differ by less than this count as one.
BAND = 1.02
#: Leaves whose bits stand in one number.
SIDE_BY_SIDE = 64
CHUNK_BYTES = 1 << 18
_U = np.uint64


def least_shared(n: np.ndarray | int, percent: int = PERCENT):  # noqa: ANN201
    """What a set of n must share with another, at least."""
    return -(-n * percent // 100)


def asked(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """How many of a set's least coordinates are looked up: one more than it may miss, and a share to spare."""
    return np.minimum(n, n - least_shared(n, percent) + n // SPARE + 1)


def sets(held: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and offsets."""
    s, offsets = _text.shingles(*_text.words([b.lower() for b in held])[:2])
    owner = np.repeat(np.arange(len(held)), np.diff(offsets))
    order = np.lexsort((s, owner))
    s, owner = s[order], owner[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
    return s[new], np.concatenate(([0], np.cumsum(np.bincount(owner[new], minlength=len(held)))))


def _points(percent: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, held in _text.chunks(b.column(2).to_pylist(), CHUNK_BYTES, lower=False):
                s, offsets = sets(held)
                n = np.diff(offsets)
                take = asked(n, percent)
                at = np.arange(len(s)) - np.repeat(offsets[:-1], n)
                least = s[at < np.repeat(take, n)].view(np.int64)
                part = [b.column(k).slice(first, len(held)) for k in (0, 1)]
                bounds = pa.array(np.concatenate(([0], np.cumsum(take))).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*part, pa.array(n), pa.ListArray.from_arrays(bounds, pa.array(least))], ["id", "key", "n", "least"])

    return run


def _with_company(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows sorted by coordinate, those whose neighbour has the same; at the ends of a partition, where the neighbour isn't seen, the row stays."""
    held, alike = None, True
    for b in batches:
        if not len(b):
            continue
        rows = b if held is None else pd.concat([held, b], ignore_index=True)
        c = rows["coordinate"].to_numpy()
        same = c[1:] == c[:-1]
        keep = np.concatenate(([alike], same)) | np.concatenate((same, [False]))
        keep[-1] = False  # not known yet
        yield rows[keep]
        held, alike = rows.iloc[-1:], bool(same[-1]) if len(same) else alike
    if held is not None:
        yield held


def _vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for first, held in _text.chunks(b["text"].tolist(), CHUNK_BYTES, lower=False):
            s, offsets = sets(held)
            yield pd.DataFrame({"node": b["node"].iloc[first : first + len(held)].array, "vector": [s[x:y].view(np.int64) for x, y in zip(offsets[:-1], offsets[1:], strict=True)]})


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Leaves of neighbouring points."""
    leaf, held, size = TaskContext.get().partitionId() << 32, [], 0

    def row() -> pd.DataFrame:
        return pd.DataFrame({"leaf": [leaf], "points": [[{"node": k, "vector": v} for k, v in held]]})

    for b in batches:
        for node, vector in zip(b["node"], b["vector"], strict=True):
            if held and (len(held) >= LEAF_POINTS or size + len(vector) > LEAF_SHINGLES):
                yield row()
                leaf, held, size = leaf + 1, [], 0
            held.append((int(node), np.asarray(vector, np.int64).tobytes()))
            size += len(vector)
    if held:
        yield row()


class Leaf:
    """Points, their vectors of group counts, and their box."""

    def __init__(self, points: list[dict]) -> None:
        self.nodes = [int(p["node"]) for p in points]
        self.sets = [np.frombuffer(p["vector"], _U) for p in points]
        self.n = np.array([len(s) for s in self.sets])
        self.counts = np.array([counts(s, POINT_GROUPS) for s in self.sets])
        self.box = np.zeros(BOX_GROUPS, np.int64)
        for s in self.sets:
            groups, c = np.unique(s % _U(BOX_GROUPS), return_counts=True)
            self.box[groups] = np.maximum(self.box[groups], c)

    def reached(self, query: np.ndarray, percent: int) -> bool:
        """Whether the minima of the query's counts and the box add up to what the query must share."""
        groups, c = np.unique(query % _U(BOX_GROUPS), return_counts=True)
        return int(np.minimum(c, self.box[groups]).sum()) >= least_shared(len(query), percent)

    def near(self, query: np.ndarray, count: np.ndarray, percent: int, after: int = 0) -> np.ndarray:
        """Points whose summed minima with the query's counts allow a link."""
        both = np.minimum(self.counts[after:], count).sum(axis=1)
        return after + np.flatnonzero(both * (100 + percent) >= percent * (self.n[after:] + len(query)))


def counts(s: np.ndarray, groups: int) -> np.ndarray:
    return np.bincount((s % _U(groups)).astype(np.int64), minlength=groups)


def links(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are at the threshold."""
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    shared = int((b[at] == a).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _linked(found: list[tuple[int, int]]) -> pd.DataFrame:
    return pd.DataFrame({"a": [min(p) for p in found], "b": [max(p) for p in found]}, dtype="int64")


def _own_links(percent: int):  # noqa: ANN202
    """Links inside a leaf: enough of them to connect what is connected."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for points in b["points"]:
                leaf, comp = Leaf(points), np.arange(len(points))
                for i in range(len(points)):
                    for j in leaf.near(leaf.sets[i], leaf.counts[i], percent, i + 1):
                        if comp[i] != comp[j] and links(leaf.sets[i], leaf.sets[j], percent):
                            found.append((leaf.nodes[i], leaf.nodes[j]))
                            comp[comp == comp[j]] = comp[i]
            yield _linked(found)

    return run


def _visits(percent: int):  # noqa: ANN202
    """Links of a block of queries with a leaf's points of other components."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for points, comps, queries in zip(b["points"], b["comps"], b["queries"], strict=True):
                leaf, own = Leaf(points), {r["node"]: r["comp"] for r in comps}
                comp = np.array([own.get(k, k) for k in leaf.nodes])
                for q in sorted(queries, key=lambda r: r["node"]):
                    s = np.frombuffer(q["vector"], _U)
                    if not leaf.reached(s, percent):
                        continue
                    near = leaf.near(s, counts(s, POINT_GROUPS), percent)
                    met = {q["comp"]}
                    for j in near:
                        if comp[j] not in met and links(s, leaf.sets[j], percent):
                            found.append((int(q["node"]), leaf.nodes[j]))
                            met.add(comp[j])
            yield _linked(found)

    return run


def _verified(percent: int):  # noqa: ANN202
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = [links(np.frombuffer(x, _U), np.frombuffer(y, _U), percent) for x, y in zip(b["vector_a"], b["vector_b"], strict=True)]
            yield b.loc[ok, ["a", "b"]]

    return run


def fitting(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Nodes that can have a link at all. ``rows``: node, n, coordinate.

    Sets of a and b shingles link only if they share ``percent`` of 100 + ``percent`` parts of a + b. So a point stays if there is a size that
    a link allows such that enough of its coordinates are also those of other points of about that size. Sizes are bands ``BAND`` wide, a bit
    each in a coordinate's masks: those that any point has, and those that two have, so that no point counts for its own. Bands 64 apart
    share a bit, which only keeps more.
    """
    banded = rows.withColumn("band", F.floor(F.log("n") / math.log(BAND)).cast("int"))
    bit = "shiftleft(1L, pmod(band, 64))"
    masks = banded.groupBy("coordinate", "band").agg(F.count(F.lit(1)).alias("k")).groupBy("coordinate").agg(
        F.sum("k").alias("k"), F.expr(f"bit_or({bit})").alias("one"), F.expr(f"bit_or(if(k > 1, {bit}, 0L))").alias("two")
    )
    met = banded.join(masks.where("k > 1").drop("k"), "coordinate").withColumn("others", F.expr(f"one & (~{bit} | two)"))
    reach = math.ceil(math.log(100 / percent) / math.log(BAND))
    counted = met.groupBy("node", "n", "band").agg(*(F.expr(f"sum(shiftrightunsigned(others, pmod(band + {d}, 64)) & 1)").alias(f"k{d + reach}") for d in range(-reach, reach + 1)))
    asks = lambda d: (F.col("n") + F.pow(F.lit(BAND), F.col("band") + d)) * (percent / (100 + percent) * (1 - 1e-9))
    return counted.where(functools.reduce(operator.or_, (F.col(f"k{d + reach}") >= asks(d) for d in range(-reach, reach + 1)))).select("node", "n")


def side_by_side(tops: DataFrame) -> DataFrame:
    """coordinate, side, bits, top: the leaves that have a coordinate, as bits. ``tops``: coordinate, number (of a leaf), top (size and id of its largest component there).

    Leaves stand in a row only with those whose component is about as large, so that its largest one tells nearly as much as each.
    """
    bit = F.expr(f"shiftleft(1L, cast(pmod(number, {SIDE_BY_SIDE}) as int))")
    of = [F.floor(F.col("number") / SIDE_BY_SIDE).alias("side"), F.floor(F.log2("top.size")).alias("about")]
    return tops.groupBy("coordinate", *of).agg(F.bit_or(bit).alias("bits"), F.max("top").alias("top")).drop("about")


def linked_texts(points: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """node, comp of all distinct texts with a link. ``points``: node, key, n, least; ``docs``: key, text."""
    spark = points.sparkSession
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = F.col("n")
    share = F.ceil(n * percent / 100)
    enough = F.floor(share / SPARE) + 1

    def reach(laid: DataFrame) -> DataFrame:
        """How many of a point's coordinates other points have too. Coordinates in order, so that a common one is spread over partitions."""
        ordered = laid.repartitionByRange(spread, "coordinate", "node").sortWithinPartitions("coordinate")
        shared = ordered.mapInPandas(trimmed(_with_company), "node long, coordinate long")
        return shared.groupBy("node").agg(F.count(F.lit(1)).alias("reach"))

    # The root, by least coordinates, then by all.
    asking = points.select("node", "key", "n").join(reach(points.select("node", F.explode("least").alias("coordinate"))), "node").where(F.col("reach") >= enough)
    asking = written(asking.select("key", "node"), "asking")
    texts = docs.join(small_side(asking, 120 * asking.count()), "key").groupBy("node").agg(F.first("text").alias("text"))
    vectors = written(texts.mapInPandas(trimmed(_vectors), "node long, vector array<bigint>"), "vectors").withColumn("n", F.size("vector"))
    reached = reach(vectors.select("node", F.explode("vector").alias("coordinate")))
    kept = checkpointed(vectors.select("node", "n").join(reached, "node").where(F.col("reach") >= share).select("node"))
    left = vectors.join(small_side(kept, 48 * kept.count()), "node")
    kept = checkpointed(fitting(left.select("node", "n", F.explode("vector").alias("coordinate")), percent).select("node", enough.alias("enough")))
    n_kept = kept.count()
    # The leaves: the points that are left, packed in the order of their coordinates.
    vectors = written(vectors.join(small_side(kept, 48 * n_kept), "node"), "points-left")
    n_shingles = vectors.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(spread, n_shingles // (LEAF_SHINGLES * 64) + 1)
    first = [F.get("vector", 0), F.get("vector", 1), F.col("node")]
    leaves = vectors.repartitionByRange(parts, *first).sortWithinPartitions(*first).select("node", "vector")
    leaves = written(leaves.mapInPandas(trimmed(_packed), "leaf long, points array<struct<node:bigint,vector:binary>>"), "leaves")
    take = F.least(n, n - share + F.floor(n / SPARE) + 1).cast("int")
    coordinates = written(vectors.select("node", "enough", F.explode(F.slice("vector", F.lit(1), take)).alias("coordinate")), "coordinates")
    of_leaf = checkpointed(leaves.select("leaf", F.explode("points.node").alias("node")))
    each = leaves.select(F.explode("points").alias("p")).select("p.*")
    found = written(leaves.mapInPandas(trimmed(_own_links(percent)), "a long, b long"), "own-links")
    comps = checkpointed(components(found))

    def told(comps: DataFrame) -> DataFrame:
        """Coordinates that hold several components."""
        rows = coordinates.join(small_side(comps, 32 * n_kept), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        rows = rows.join(small_side(of_leaf, 32 * n_kept), "node")
        several = rows.groupBy("coordinate").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count(F.lit(1)).alias("n_points")).where("c0 <> c1")
        return written(rows.join(several.select("coordinate", "n_points"), "coordinate"), "several")

    # Of each component the point that shares most coordinates with a hub, the point with most company among those of a coordinate.
    rows = told(comps)
    company = checkpointed(rows.groupBy("node").agg(F.sum("n_points").alias("company")))
    hubs = rows.join(small_side(company, 32 * n_kept), "node").groupBy("coordinate").agg(F.max(F.struct("company", "node", "comp")).alias("hub"))
    met = rows.join(hubs, "coordinate").where("comp <> hub.comp").groupBy("comp", "node", F.col("hub.node").alias("a")).agg(F.count(F.lit(1)).alias("k"), F.first("enough").alias("enough"))
    star = met.where("k >= enough").groupBy("comp", "a").agg(F.max(F.struct("k", "node")).alias("b")).select("a", F.col("b.node").alias("b"))
    left = star.join(each.select(F.col("node").alias("a"), F.col("vector").alias("vector_a")), "a")
    both = left.join(each.select(F.col("node").alias("b"), F.col("vector").alias("vector_b")), "b")
    found = written(found.unionByName(both.mapInPandas(trimmed(_verified(percent)), "a long, b long")), "star-links")
    comps = checkpointed(components(found))
    # Visits: leaves that have one of a query's rarest coordinates, so many that the others can't be enough. Of two components the smaller one
    # visits, so that the many points of a large one stay where they are.
    sizes = comps.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
    rows = told(comps).join(small_side(sizes, 32 * n_kept), "comp", "left").withColumn("rank", F.struct(F.coalesce("size", F.lit(1)).alias("size"), "comp")).drop("size")
    of_node = Window.partitionBy("node")  # a document's least coordinates
    ranked = rows.withColumn("nth", F.row_number().over(of_node.orderBy("n_points", "coordinate"))).withColumn("reach", F.count(F.lit(1)).over(of_node))
    rare = ranked.where(F.col("nth") <= F.col("reach") - F.col("enough") + 1)
    # A coordinate's leaves are bits, SIDE_BY_SIDE leaves a row, so that a common coordinate leads a query to few rows however many leaves hold it.
    number = leaves.select("leaf").withColumn("part", F.shiftright("leaf", 32)).withColumn("nth", F.col("leaf").bitwiseAND(F.lit((1 << 32) - 1)))
    ahead = number.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    ahead = ahead.withColumn("ahead", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a partition
    number = checkpointed(number.join(F.broadcast(ahead), "part").select("leaf", (F.col("ahead") + F.col("nth")).alias("number")))
    tops = rows.groupBy("coordinate", "leaf").agg(F.max("rank").alias("top")).join(small_side(number, 32 * n_kept), "leaf")
    boxes = checkpointed(side_by_side(tops))
    # Coordinates of the same leaves (those of a common passage) lead to the same visits: one stands for all, told by count and hashes of the rows.
    of = ["n_rows", "one", "two"]
    told_by = ("side", "bits", "top")
    listed = boxes.groupBy("coordinate").agg(F.count(F.lit(1)).alias("n_rows"), F.bit_xor(F.xxhash64(*told_by)).alias("one"), F.bit_xor(F.xxhash64(*told_by, F.lit(1))).alias("two"))
    stands = listed.join(listed.groupBy(of).agg(F.min("coordinate").alias("for_all")), of).select("coordinate", "for_all")
    asked_for = rare.join(stands, "coordinate").select("node", "rank", F.col("for_all").alias("coordinate")).distinct()
    led = asked_for.join(boxes, "coordinate").where(F.col("top") > F.col("rank")).groupBy("node", "side").agg(F.first("rank").alias("rank"), F.bit_or("bits").alias("bits"))
    # Of the leaves of a row those stay that hold a larger component, and not the query itself.
    largest = rows.groupBy("leaf").agg(F.max("rank").alias("top")).join(small_side(number, 32 * n_kept), "leaf").select(F.col("leaf").alias("at"), "number", "top")
    each_bit = F.expr(f"filter(sequence(0, {SIDE_BY_SIDE - 1}), b -> (shiftrightunsigned(bits, b) & 1) = 1)")
    visits = led.select("node", "rank", "side", F.explode(each_bit).alias("b")).withColumn("number", F.col("side") * SIDE_BY_SIDE + F.col("b"))
    visits = visits.join(small_side(largest, 64 * n_kept), "number").where(F.col("top") > F.col("rank")).join(small_side(of_leaf, 32 * n_kept), "node").where("at <> leaf")
    visits = written(visits.select("node", F.col("rank.comp").alias("comp"), "at"), "visits")
    known = comps.join(of_leaf, "node").groupBy("leaf").agg(F.collect_list(F.struct("node", "comp")).alias("comps"))
    sized = visits.join(small_side(vectors.select("node", "n"), 32 * n_kept), "node")
    load = checkpointed(sized.groupBy("at").agg(F.ceil(F.greatest(F.sum("n") / LEAF_SHINGLES, F.count(F.lit(1)) / LEAF_POINTS)).alias("blocks")))
    callers = visits.join(small_side(load, 32 * n_kept), "at").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).join(each, "node")
    blocks = callers.groupBy("at", "block").agg(F.collect_list(F.struct("node", "comp", "vector")).alias("queries"))
    met = blocks.join(leaves.withColumnRenamed("leaf", "at"), "at").join(known.withColumnRenamed("leaf", "at"), "at", "left").withColumn("comps", F.coalesce("comps", F.array().cast("array<struct<node:bigint,comp:bigint>>")))
    more = written(met.select("points", "comps", "queries").mapInPandas(trimmed(_visits(percent)), "a long, b long"), "visit-links")
    return components(found.unionByName(more)) if not more.isEmpty() else comps


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per document: id, n_shingles, component_id."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).alias("id"), F.md5(text).alias("key"), text.alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    signed = own.mapInArrow(trimmed(_points(percent)), f"id {kind}, key string, n long, least array<bigint>")
    signed = written(signed.withColumn("row", F.monotonically_increasing_id()), "points")
    texts = checkpointed(signed.where("n > 0").groupBy("key").agg(F.min("row").alias("row"), F.min("id").alias("id")))
    size = 120 * texts.count()
    # Of equal texts one is asked about. The others are told, as they are fewer, so that the coordinates aren't shuffled to drop them.
    copies = signed.select("key", "row").join(small_side(texts.select("key", F.col("row").alias("first")), size), "key").where("row <> first")
    copies = checkpointed(copies.select("row"))
    points = signed.join(small_side(copies, 40 * copies.count()), "row", "left_anti").withColumnRenamed("row", "node")
    comps = linked_texts(points, own.select("key", "text"), percent)
    named = texts.join(small_side(comps.withColumnRenamed("node", "row"), size), "row", "left").withColumn("comp", F.coalesce("comp", "row"))
    least = checkpointed(named.groupBy("comp").agg(F.min("id").alias("component_id")))
    named = checkpointed(named.select("key", "comp").join(small_side(least, size), "comp").select("key", "component_id"))
    out = signed.select("id", "key", "n").join(small_side(named, size), "key", "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
