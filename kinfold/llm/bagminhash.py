"""Near-duplicates by BagMinHash signatures, banding and exact multiset overlap.

A document is the multiset of its five-word shingles. For each shingle the
weight axis is cut into the intervals [0,1), [1,2), [2,4), [4,8) and so on;
every interval carries its own Poisson process whose rate is its length, whose
points have a time, a register and, by further splitting, a place on the
weight axis. A shingle of weight w contributes the points placed below w, and
a register keeps the least time, so that two signatures agree in a register
with the probability of the weighted Jaccard similarity. Points are generated
in order of time and only until all registers must be settled.

Texts are made distinct first. Bands of equal registers give buckets; within a
bucket each text is compared with the bucket's first text and with its hub,
the text with most company over all its buckets. Links make connected
components, and only buckets that still hold several components are looked at
again, in blocks of about ``BLOCK`` texts or ``BLOCK_BYTES`` of hashes (one
text at least), block by block, each pair in the first band that it shares: pairs of different components that agree in ``LEAST_AGREE`` registers
(four standard deviations below what the threshold expects) are compared by
their shingles, and only links leave the task. So a group of copies is never
expanded into pairs, and no candidate is dropped for being one of many. Links
are decided by the exact similarity ``THRESHOLD`` of the multisets of 64-bit
shingle hashes; classes are the connected components.

Defined cases: a null text counts as empty; all empty texts are one class;
texts of fewer than five words have one shingle of all of them. The class id is the smallest id in the class, which is also
the document that stays; a class of null ids has a null id. Rows that repeat
both id and text stay once. Empty tables give empty results; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text
from ._work import checkpointed, small_side, trimmed, whole_row, written

BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
THRESHOLD = 0.8
BLOCK, BLOCK_BYTES = 512, 16 << 20
LEAST_AGREE = 78
_U = np.uint64


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(hashes: np.ndarray, offsets: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """Least times, one row per document; infinity where a document has no shingle."""
    docs = len(offsets) - 1
    owner = np.repeat(np.arange(docs), np.diff(offsets))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    weight = np.diff(np.concatenate((first, [len(hashes)])))
    hashes, owner = hashes[first], owner[first]
    levels = 1 + np.ceil(np.log2(weight)).astype(np.int64) if len(weight) else np.zeros(0, np.int64)
    element = np.repeat(np.arange(len(hashes)), levels)
    level = np.arange(len(element)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0)).astype(np.int64)
    span = np.maximum(low, 1)
    seed = _text.mix64(hashes[element] + _text.mix64(level.astype(_U) + _U(0x51)))
    who, top = owner[element], weight[element]
    total = np.bincount(owner, weight, docs)
    least = np.full(docs * registers, np.inf)
    pending = total > 0
    horizon = np.where(pending, registers * (np.log(registers) + 2.0) / np.maximum(total, 1), 0.0)
    time, drawn = np.zeros(len(element)), np.zeros(len(element), np.int64)
    live = np.arange(len(element))
    while len(live):
        while len(live):
            block = int(np.clip(60_000 // len(live), 1, 64))
            index = drawn[live][:, None] + np.arange(block)
            base = _text.mix64(seed[live][:, None] + index.astype(_U) * _U(0x9E3779B97F4A7C15))
            gaps = -np.log(_uniform(base)) / span[live][:, None]
            gaps[:, 0] += time[live]
            times = np.cumsum(gaps, axis=1)
            second = _text.mix64(base ^ _U(0xD1B54A32D192ED03))
            register = ((second >> _U(32)) % _U(registers)).astype(np.int64)
            place = low[live][:, None] + ((second & _U(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * span[live][:, None]).astype(np.int64)
            inside = times <= horizon[who[live]][:, None]
            use = inside & (place < top[live][:, None])
            np.minimum.at(least, (who[live][:, None] * registers + register)[use], times[use])
            # A block is drawn whole: points beyond the horizon are drawn again should the horizon move.
            whole = inside.all(axis=1)
            reached = inside.sum(axis=1)
            drawn[live] += reached
            last = np.maximum(reached - 1, 0)
            time[live] = np.where(reached > 0, times[np.arange(len(live)), last], time[live])
            live = live[whole]
        pending &= ~np.isfinite(least.reshape(docs, registers)).all(axis=1)
        horizon = np.where(pending, horizon * 2, horizon)
        live = np.flatnonzero(pending[who]) if pending.any() else np.zeros(0, np.int64)
    return least.reshape(docs, registers)


def band_hashes(least: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    bits = np.ascontiguousarray(least).view(_U).reshape(len(least), bands, rows)
    out = np.zeros((len(least), bands), _U)
    for k in range(rows):
        out = _text.mix64(out * _U(0x9E3779B97F4A7C15) + bits[:, :, k])
    return out.view(np.int64)


def _key(text: Column) -> Column:
    """MD5 of the text; texts without a word share one."""
    return F.md5(F.when(text.rlike(r"[^\x09-\x0D\x20]"), text).otherwise(F.lit("")))


def _signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for first, held in _text.chunks(b["text"].tolist()):
            s, offsets = _text.shingles(*_text.words(held)[:2])
            n = np.diff(offsets)
            least = signatures(s, offsets)
            rows, small = band_hashes(least), (_text.mix64(np.ascontiguousarray(least).view(_U)) & _U(255)).astype(np.uint8)
            part = b.iloc[first : first + len(held)]
            yield pd.DataFrame({"id": part["id"].array, "key": part["key"].array, "n": n, "bands": [r if k else None for r, k in zip(rows, n, strict=True)], "regs": [r.tobytes() for r in small]})


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sorted shingle hashes of each text as bytes."""
    for b in batches:
        for first, held in _text.chunks(b["text"].tolist()):
            s, offsets = _text.shingles(*_text.words(held)[:2])
            yield pd.DataFrame({"node": b["node"].iloc[first : first + len(held)].array, "bag": [np.sort(s[x:y]).tobytes() for x, y in zip(offsets[:-1], offsets[1:], strict=True)]})


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted arrays as multisets."""
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    values, counts = np.unique(both, return_counts=True)
    ca = np.searchsorted(a, values, "right") - np.searchsorted(a, values, "left")
    shared = int(np.minimum(ca, counts - ca).sum())
    return shared / (len(a) + len(b) - shared) if len(a) + len(b) else 1.0


def _verified(threshold: float):  # noqa: ANN202
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = [overlap(np.frombuffer(x, _U), np.frombuffer(y, _U)) >= threshold for x, y in zip(b["bag_a"], b["bag_b"], strict=True)]
            yield b.loc[ok, ["a", "b"]]

    return run


def _blocks(threshold: float):  # noqa: ANN202
    """Links between two blocks of one bucket."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found: list[tuple[int, int]] = []
            for band, i, j, x, y in zip(b["band"], b["i"], b["j"], b["x"], b["y"], strict=True):
                left, right = _side(x), _side(y)
                for k in range(len(left["node"])):
                    ok = right["comp"] != left["comp"][k]
                    if i == j:
                        ok[: k + 1] = False
                    ok &= np.minimum(right["n"], left["n"][k]) >= threshold * np.maximum(right["n"], left["n"][k])
                    ok &= ~(right["bands"][:, :band] == left["bands"][k, :band]).any(axis=1)
                    where = np.flatnonzero(ok)
                    where = where[(right["regs"][where] == left["regs"][k]).sum(axis=1) >= LEAST_AGREE]
                    found += [(left["node"][k], right["node"][m]) for m in where if overlap(left["bag"][k], right["bag"][m]) >= threshold]
            yield pd.DataFrame({"a": [min(p) for p in found], "b": [max(p) for p in found]}, dtype="int64")

    return run


def _side(rows: list[dict]) -> dict:
    rows = sorted(rows, key=lambda r: r["node"])
    return {
        "node": [int(r["node"]) for r in rows], "comp": np.array([r["comp"] for r in rows], np.int64), "n": np.array([r["n"] for r in rows], np.int64),
        "bands": np.array([list(r["bands"]) for r in rows], np.int64), "regs": np.frombuffer(b"".join(r["regs"] for r in rows), np.uint8).reshape(len(rows), -1), "bag": [np.frombuffer(r["bag"], np.uint32) for r in rows],
    }


def _folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Bags of 32-bit hashes: their overlap is never less than that of the bags they stand for."""
    for b in batches:
        yield pd.DataFrame({"node": b["node"], "bag": [np.sort((np.frombuffer(x, _U) >> _U(32)).astype(np.uint32)).tobytes() for x in b["bag"]]})


def components(edges: DataFrame) -> DataFrame:
    """node, comp (the least node of its component) for all nodes with an edge (a, b). Rounds of least neighbour and pointer jumping."""
    both = checkpointed(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    size = 32 * both.count()
    labels = checkpointed(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("comp")))
    while True:
        near = both.join(small_side(labels.select(F.col("node").alias("b"), F.col("comp").alias("c")), size), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c"))
        stepped = labels.join(small_side(near, size), "node").select("node", F.col("comp").alias("old"), F.least("comp", "c").alias("comp"))
        stepped = checkpointed(stepped)
        jump = stepped.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        moved = checkpointed(stepped.join(small_side(jump, size), "comp").select("node", "old", F.least("comp", "up").alias("comp")))
        labels = moved.select("node", "comp")
        if moved.where("comp <> old").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """A row per distinct text: key (MD5 of the text), class_id, class_size (documents), stays (whether it is the class's first text), min_id, n (its rows)."""
    own = docs.select(F.col(id_col).alias("id"), _key(F.col(text_col)).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    signed = own.mapInPandas(trimmed(_signed), f"id {docs.schema[id_col].dataType.simpleString()}, key string, n long, bands array<bigint>, regs binary")
    nodes = signed.groupBy("key").agg(F.min("id").alias("min_id"), F.count(F.lit(1)).alias("n_rows"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("regs").alias("regs"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    laid = nodes.select("node", "n", F.posexplode("bands").alias("band", "h"))
    buckets = written(laid.groupBy("band", "h").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "buckets")
    members = written(laid.join(small_side(buckets, 40 * buckets.count()), ["band", "h"]), "members")
    company = checkpointed(members.groupBy("node").agg(F.sum("c").alias("company")))
    n_nodes = company.count()
    tops = members.join(small_side(company, 32 * n_nodes), "node").groupBy("band", "h").agg(F.min("node").alias("lo"), F.max(F.struct("company", "node")).alias("hub"))
    tops = written(tops.select("band", "h", "lo", F.col("hub.node").alias("hub")), "tops")
    sizes = members.select("node", "n").distinct()
    star = members.join(small_side(tops, 48 * buckets.count()), ["band", "h"]).select(F.col("node").alias("a"), F.explode(F.array_distinct(F.array("lo", "hub"))).alias("b")).where("a <> b")
    star = star.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct()
    side = lambda c, n: small_side(sizes.select(F.col("node").alias(c), F.col("n").alias(n)), 32 * n_nodes)
    pairs = star.join(side("x", "n_x"), "x").join(side("y", "n_y"), "y").where(F.least("n_x", "n_y") >= threshold * F.greatest("n_x", "n_y"))
    pairs = written(pairs.select(F.col("x").alias("a"), F.col("y").alias("b")), "pairs")
    wanted = checkpointed(members.select("node").distinct().join(nodes.select("node", "key"), "node"))
    texts = own.select("key", "text").join(small_side(wanted, 80 * n_nodes), "key").groupBy("node").agg(F.first("text").alias("text"))
    bags = written(texts.mapInPandas(trimmed(_packed), "node long, bag binary"), "bags")

    def linked(pairs: DataFrame) -> DataFrame:
        left = pairs.join(bags.select(F.col("node").alias("a"), F.col("bag").alias("bag_a")), "a")
        both = left.join(bags.select(F.col("node").alias("b"), F.col("bag").alias("bag_b")), "b")
        return written(both.mapInPandas(trimmed(_verified(threshold)), "a long, b long"), "links")

    links = linked(pairs)
    comps = checkpointed(components(links))
    # Buckets of more than one component: what is in them is compared block by block.
    told = members.select("band", "h", "node", "n").join(small_side(comps, 32 * comps.count()), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = told.groupBy("band", "h").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("words")).where("c0 <> c1 and k > 2")
    mixed = checkpointed(mixed.select("band", "h", F.ceil(F.greatest(F.col("k") / BLOCK, F.col("words") * 4 / BLOCK_BYTES)).cast("int").alias("parts")))
    apart = told.join(small_side(mixed, 32 * mixed.count()), ["band", "h"]).withColumn("i", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    apart = written(apart, "apart")
    load = bags.join(apart.select("node").distinct(), "node", "left_semi").mapInPandas(trimmed(_folded), "node long, bag binary").join(nodes.select("node", "bands", "regs"), "node")
    blocks = apart.join(load, "node").groupBy("band", "h", "i", "parts").agg(F.collect_list(F.struct("node", "comp", "n", "bands", "regs", "bag")).alias("x"))
    blocks = written(blocks, "blocks")
    left = blocks.select("band", "h", "i", F.explode(F.expr("sequence(i, parts - 1)")).alias("j"), "x")
    right = blocks.select("band", "h", F.explode(F.expr("sequence(0, i)")).alias("i"), F.col("i").alias("j"), F.col("x").alias("y"))
    more = left.join(right, ["band", "h", "i", "j"]).mapInPandas(trimmed(_blocks(threshold)), "a long, b long").distinct()
    more = linked(checkpointed(more))
    if not more.isEmpty():
        comps = checkpointed(components(links.union(more)))
    whole = nodes.select("node", "key", "min_id", "n_rows").join(small_side(comps, 32 * comps.count()), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    whole = written(whole, "classes")
    heads = whole.groupBy("comp").agg(F.min("min_id").alias("class_id"), F.sum("n_rows").alias("class_size"), F.min(F.struct(F.col("min_id").isNull().alias("no_id"), F.col("min_id").alias("id"), F.col("node").alias("node"))).alias("head"))
    return whole.join(heads, "comp").select("key", "class_id", "class_size", (F.col("node") == F.col("head.node")).alias("stays"), "min_id", F.col("n_rows").alias("n"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, class_id, class_size, kept. Rows that repeat the id and text that stay are all kept here."""
    found = near_duplicates(docs, id_col, text_col, threshold).where("class_size > 1")
    found = checkpointed(found)
    keyed = docs.select(id_col, _key(F.col(text_col)).alias("key"))
    out = keyed.join(small_side(found, 96 * found.count()), "key", "left")
    return out.select(id_col, F.when(F.col("class_size").isNull(), F.col(id_col)).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), (F.col("stays").isNull() | (F.col("stays") & F.col(id_col).eqNullSafe(F.col("min_id")))).alias("kept"))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each class. All columns stay as they are."""
    found = near_duplicates(docs, id_col, text_col, threshold).where("class_size > 1")
    found = checkpointed(found.select(F.struct("key", "stays", "min_id", "n").alias("found")))
    keyed = docs.select(F.struct(F.col(id_col).alias("id"), _key(F.col(text_col)).alias("key")).alias("own"), whole_row(docs))
    marked = keyed.join(small_side(found, 96 * found.count()), F.col("own.key") == F.col("found.key"), "left")
    kept = marked.where(F.col("found.stays").isNull() | (F.col("found.stays") & F.col("own.id").eqNullSafe(F.col("found.min_id"))))
    single = kept.where(F.coalesce(F.col("found.n"), F.lit(1)) == 1)
    many = kept.where(F.col("found.n") > 1).groupBy("own").agg(F.first("row").alias("row"))
    return single.select("row.*").unionByName(many.select("row.*"))
