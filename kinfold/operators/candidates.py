"""Candidate pairs by nearest fingerprints, family and fixed lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ._store import cut

TILE = 4096
STEP = 256  # Rows of a tile that meet another at once.
MEASURED = 1 << 14  # Pairs that are measured at once.
BLOCK = 2048  # Fixed value: ids of a family that are listed together.


def nearest(prints: DataFrame, k: int = 5, max_distance: float = 0.5, block: str | None = None) -> DataFrame:
    """prints: id, vec. id, other, distance, rank of the ``k`` nearest others within ``max_distance``.

    Without ``block`` every pair is measured: all rows pass by each block of
    about ``TILE`` rows, of which each row's best ``k`` are kept; with it
    only pairs that agree in that column are. Distances that agree to nine
    decimals count as equal, and ``other`` decides.
    """
    if block:
        left = prints.select("id", "vec", block)
        right = prints.select(F.col("id").alias("other"), F.col("vec").alias("o_vec"), block)
        near = left.join(right, block).where("id <> other").select("id", "other", S.cosine_distance(F.col("vec"), F.col("o_vec")).alias("distance"))
    else:
        near = _all_pairs(prints.select("id", "vec"), k, max_distance)
    w = Window.partitionBy("id").orderBy("distance", "other")
    return near.withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= k) & (F.col("distance") <= max_distance))


def _all_pairs(prints: DataFrame, k: int, max_distance: float) -> DataFrame:
    """id, other, distance of each row's ``k`` nearest among all other rows.

    Rows are packed into tiles, a row each, and written once. A task holds a
    tile and reads all tiles, one by one, from what was written: neither rows
    nor partial results are copied for pairs of tiles, so disk grows with the
    rows. Equal ids are in one tile.
    """
    kind = prints.schema["id"].dataType.simpleString()
    rows = prints.where("id IS NOT NULL")
    n = -(-rows.count() // TILE) or 1
    tiled = rows.select(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("i"), F.struct("id", "vec").alias("x"))
    tiles = cut(tiled.repartitionByRange(n, "i").groupBy("i").agg(F.collect_list("x").alias("xs")))
    others = tiles.select(F.col("i").alias("j"), F.col("xs").alias("ys")).coalesce(1)
    met = others.crossJoin(tiles.hint("shuffle_replicate_nl"))  # the first side is read by each task of the second

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}
        for b in batches:
            for i, j, xs, ys in zip(b["i"].to_pylist(), b["j"].to_pylist(), b["xs"], b["ys"]):
                if i not in held:
                    held[i] = Nearest(*_unpacked(xs.values), k, max_distance)
                held[i].meet(*_unpacked(ys.values), i == j)
        for tile in held.values():
            own, near = tile.ids.take(pa.array(tile.near["row"].to_numpy(), pa.int64())), tile.near
            yield pa.RecordBatch.from_arrays([own, pa.array(near["other"], own.type), pa.array(near["distance"], pa.float64())], ["id", "other", "distance"])

    return met.mapInArrow(best, f"id {kind}, other {kind}, distance double")


def _unpacked(rows: pa.StructArray) -> tuple[pa.Array, np.ndarray]:
    """Ids and vectors, one a row."""
    ids, vecs = rows.flatten()
    if vecs.null_count or len(pc.unique(pc.list_value_length(vecs))) > 1:
        raise ValueError("vectors of one length are needed")
    return ids, vecs.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)


class Nearest:
    """The ``k`` nearest of each row of a tile among the rows that it has met."""

    def __init__(self, ids: pa.Array, vecs: np.ndarray, k: int, max_distance: float) -> None:
        self.ids, self.own, self.k = ids, ids.to_numpy(zero_copy_only=False), k
        self.x, self.lengths, self.units, _ = self._scaled(vecs)
        self.near = pd.DataFrame({"row": np.empty(0, np.int64), "distance": np.empty(0), "other": self.own[:0]})
        self.limit = np.full(len(ids), max_distance)  # of a row with k: the distance and the id of its last
        self.full, self.last = np.zeros(len(ids), bool), self.own.copy()

    @staticmethod
    def _scaled(vecs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        x = vecs.astype(np.float64)
        lengths = np.sqrt((x * x).sum(axis=1))
        odd = ~np.isfinite(lengths)
        scale = np.where(odd | (lengths == 0), 1.0, lengths)[:, None]
        return x, lengths, np.where(odd[:, None], 0.0, x / scale).astype(np.float32), odd

    def meet(self, ids: pa.Array, vecs: np.ndarray, same: bool) -> None:
        """Rows of another tile, or the ``same``. Products of 32 bits, with more than their error, tell which pairs to measure."""
        others, (y, lengths, units, odd) = ids.to_numpy(zero_copy_only=False), self._scaled(vecs)
        error = (y.shape[1] + 8) * 2.0**-23
        found = []
        for at in range(0, len(self.own), STEP):
            rows = slice(at, at + STEP)
            s = self.units[rows] @ units.T
            if odd.any():
                s[:, odd] = -np.inf
            if same:
                s[self.own[rows, None] == others] = -np.inf
            least = (1 - self.limit[rows, None] - error).astype(np.float32)
            close = s >= least
            if len(others) > self.k and np.count_nonzero(close) > 4 * self.k * len(s):
                kth = np.partition(s, -self.k, axis=1)[:, -self.k][:, None]
                close = s >= np.maximum(least, (kth - 2 * error).astype(np.float32))
            r, c = np.divmod(np.flatnonzero(close), len(others))  # faster than nonzero of two axes
            for some in range(0, len(r), MEASURED):
                found.append(self._measured(at + r[some : some + MEASURED], c[some : some + MEASURED], y, lengths, others))
        if found and (new := pd.concat(found)).size:
            touched = np.zeros(len(self.own), bool)
            touched[new["row"]] = True
            again = touched[self.near["row"]]
            new = pd.concat([self.near[again], new]).sort_values(["row", "distance", "other"]).groupby("row").head(self.k)
            last = new[(new.groupby("row").cumcount() == self.k - 1).to_numpy()]
            self.limit[last["row"]], self.last[last["row"]], self.full[last["row"]] = last["distance"], last["other"], True
            self.near = pd.concat([self.near[~again], new], ignore_index=True)

    def _measured(self, r: np.ndarray, c: np.ndarray, y: np.ndarray, lengths: np.ndarray, others: np.ndarray) -> pd.DataFrame:
        """Of the pairs of rows ``r`` and ``c`` those that come before a row's last."""
        norm = self.lengths[r] * lengths[c]
        d = np.round(np.where(norm == 0, 1.0, np.clip(1 - np.einsum("ij,ij->i", self.x[r], y[c]) / np.where(norm == 0, 1.0, norm), 0, 2)), 9)
        keep = d <= self.limit[r]
        ties = np.nonzero(keep & self.full[r] & (d == self.limit[r]))[0]
        keep[ties] = others[c[ties]] < self.last[r[ties]]
        return pd.DataFrame({"row": r[keep], "distance": d[keep], "other": others[c[keep]]})


def _families(views: DataFrame) -> DataFrame:
    """id, families: those of each id in order; ids without any are left out."""
    return views.where("id IS NOT NULL").groupBy("id").agg(F.sort_array(F.collect_set("family")).alias("families")).where(F.size("families") > 0)


def same_family(views: DataFrame) -> DataFrame:
    """views: id, family. a, b: every pair of ids that have a family in common, once.

    Ids of a family are dealt into blocks and pairs are listed from two blocks
    at a time, so no task holds pairs, and none have to be told apart: a pair
    with several families in common is listed in the first of them.
    """
    each = _families(views).select(F.explode("families").alias("family"), F.struct("id", F.when(F.size("families") > 1, F.col("families")).alias("families")).alias("x"))
    parts = each.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    blocks = each.join(parts, "family").groupBy("family", "parts", F.pmod(F.xxhash64("x.id"), "parts").cast("int").alias("i")).agg(F.collect_list("x").alias("xs"))
    own = blocks.select("family", "i", F.col("xs").alias("ps"))
    others = blocks.select("family", F.explode(F.sequence(F.lit(0), F.col("i"))).alias("i"), F.col("i").alias("j"), F.col("xs").alias("qs"))
    met = own.join(others.hint("shuffle_hash"), ["family", "i"]).select("family", (F.col("i") == F.col("j")).alias("one"), F.explode("ps").alias("p"), "qs")
    pairs = met.select("family", "one", "p", F.explode("qs").alias("q"))
    first = F.col("p.families").isNull() | F.col("q.families").isNull() | (F.array_min(F.array_intersect("p.families", "q.families")) == F.col("family"))
    return pairs.where((~F.col("one") | (F.col("p.id") < F.col("q.id"))) & first).select(F.least("p.id", "q.id").alias("a"), F.greatest("p.id", "q.id").alias("b"))


def candidate_pairs(views: DataFrame, prints: DataFrame, k: int = 5, max_distance: float = 0.5, hard: list[tuple[str, str]] = (), block: str | None = None) -> DataFrame:
    """a, b: nearest fingerprints made undirected, same family, and listed pairs of known ids.

    Pairs of a family are each listed once by themselves; of the others, which
    are no more than ``k`` a row, those go that are of a family.
    """
    pairs = nearest(prints, k, max_distance, block).select(*S.pair_key("id", "other"))
    if hard:
        listed = views.sparkSession.createDataFrame([(min(p), max(p)) for p in hard], ["a", "b"])
        known = views.select("id")
        pairs = pairs.union(listed.join(known.toDF("a"), "a", "left_semi").join(known.toDF("b"), "b", "left_semi").select("a", "b"))
    of = _families(views)
    both = pairs.distinct().join(of.toDF("a", "fa"), "a", "left").join(of.toDF("b", "fb"), "b", "left")
    other = both.where(~F.coalesce(F.arrays_overlap("fa", "fb") & (F.col("a") < F.col("b")), F.lit(False)))
    return other.select("a", "b").union(same_family(views))


def fingerprints(outputs: DataFrame) -> DataFrame:
    """outputs: id, probe_id, px. Hash bits of all probes in order and mean feature, each normalised, then both together."""
    rows = outputs.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("probe_id", S.average_hash(F.col("px")).alias("bits"), S.quadrant_means(F.col("px")).alias("f")))).alias("rows"))
    bits = S.unit(F.flatten(F.transform("rows", lambda r: F.transform(r["bits"], lambda x: x.cast("double")))))
    n = F.size(F.get(F.transform("rows", lambda r: r["f"]), 0))
    mean = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.aggregate("rows", F.lit(0.0), lambda s, r: s + F.get(r["f"], i)) / F.size("rows"))
    return rows.select("id", S.unit(F.concat(bits, S.unit(mean))).alias("vec"))
