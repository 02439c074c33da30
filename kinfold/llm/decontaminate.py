"""Benchmark decontamination in SQL functions only.

Item-sized windows of a document are fingerprinted by SimHash, fingerprints
within ``RADIUS`` bits of an item's are found through an index of ``BLOCKS``
blocks of bits, and candidates are decided by the exact weighted similarity of
five-word shingles, at ``THRESHOLD`` or more. Of two fingerprints that differ
in no more than RADIUS bits, at least one of the blocks differs in no more
than RADIUS // BLOCKS; each block of an item is entered under all values that
near, each block of a window is looked up once, and so none is missed. The
entries of an item are 1,811 at the radius of 19; of unrelated windows and
items of one length nearly one pair in four meets and is told apart by its bits.

Windows are laid where they can reach the threshold: a window that does must
hold so many places whose shingle is one of the item's, in whatever order they
stand, and moved on to the first of these it loses nothing and keeps its size.
So a window starts at each such place that has enough others within the item's
length; rearranged, shortened and interspersed items have theirs as well as
verbatim ones. Places are found by a join on shingles, windows and items by
their fingerprints. All other windows' fingerprints, which SQL functions can't
afford to make, could only lead to candidates that the last step refuses.
Words are runs without ASCII white space, compared in lower case. Items of
fewer than five words have one shingle of all their words and windows of that
many words.

Defined cases: null texts count as empty; empty items match nothing; empty
documents are clean; an empty benchmark leaves all documents clean; rows that
repeat are judged alike; null ids are carried through.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._work import checkpointed, small_side, whole_row

WORDS, THRESHOLD = 5, 0.8
BITS, RADIUS, BLOCKS = 64, 19, 5
#: First bit and bits of each block.
LAID = [(k * BITS // BLOCKS, (k + 1) * BITS // BLOCKS - k * BITS // BLOCKS) for k in range(BLOCKS)]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x09-\x0D\x20]+"), lambda w: w != "")


def shingles_of(words: Column, size: int = WORDS) -> Column:
    """Hashes of each ``size`` words in a row; of all words if they are fewer."""
    n = F.size(words)
    at = lambda i, k: F.get(words, i + k)
    many = F.transform(F.sequence(F.lit(0), F.greatest(n - size, F.lit(0))), lambda i: F.xxhash64(*(at(i, k) for k in range(size))))
    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(many)


def simhash(shingles: Column) -> Column:
    """64 bits as a long: bit b is set where more shingles have it set than not. Repeats weigh as often as they occur."""
    votes = lambda b: F.aggregate(shingles, F.lit(0), lambda s, h: s + F.getbit(h, b).cast("int"))
    bits = F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda b: F.when(votes(b) * 2 > F.size(shingles), F.expr("1L")).otherwise(F.expr("0L")))
    return F.aggregate(F.reverse(bits), F.expr("0L"), lambda s, x: F.shiftleft(s, 1).bitwiseOR(x))


def blocks_of(fingerprint: Column) -> Column:
    """Array of (block number, its bits): ``BLOCKS`` blocks that cover all bits."""
    return F.array(*(F.struct(F.lit(k).alias("no"), F.shiftrightunsigned(fingerprint, first).bitwiseAND(F.lit((1 << width) - 1).cast("long")).alias("bits")) for k, (first, width) in enumerate(LAID)))


def near_blocks(fingerprint: Column, radius: int = RADIUS) -> Column:
    """Array of (block number, bits) of all values of the blocks that differ from the fingerprint's in at most ``radius // BLOCKS`` bits."""
    flips = {w: [sum(1 << b for b in c) for n in range(radius // BLOCKS + 1) for c in itertools.combinations(range(w), n)] for w in {w for _, w in LAID}}

    def entered(block: Column, width: int) -> Column:
        return F.transform(F.lit(flips[width]).cast("array<bigint>"), lambda f: F.struct(block["no"].alias("no"), block["bits"].bitwiseXOR(f).alias("bits")))

    blocks = blocks_of(fingerprint)
    return F.concat(*(entered(blocks[k], w) for k, (_, w) in enumerate(LAID)))


def weighted_similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two arrays of hashes as multisets. Both sorted, equal values are numbered, so that sets do."""

    def numbered(x: Column) -> Column:
        start = F.struct(F.lit(None).cast("long").alias("last"), F.lit(0).alias("k"), F.array().cast("array<struct<h:bigint,k:int>>").alias("out"))

        def step(s: Column, h: Column) -> Column:
            k = F.when(s["last"] == h, s["k"] + 1).otherwise(F.lit(0))
            return F.struct(h.alias("last"), k.alias("k"), F.concat(s["out"], F.array(F.struct(h.alias("h"), k.alias("k")))).cast("array<struct<h:bigint,k:int>>").alias("out"))

        return F.aggregate(F.array_sort(x), start, step, lambda s: s["out"])

    x, y = numbered(a), numbered(b)
    both = F.size(F.array_intersect(x, y))
    return F.coalesce(F.try_divide(both, F.size(a) + F.size(b) - both), F.lit(0.0))


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """A row per found window that the item's windows next to it don't better: id, key (hash of the text), item, start, words, similarity."""
    if not 0 <= radius <= RADIUS:
        raise ValueError(f"radius must be from 0 to {RADIUS}")
    known = items.select(F.col(item_col).alias("item"), words_of(F.col(item_text)).alias("w")).where(F.size("w") > 0)
    known = known.select("item", F.size("w").alias("n_words"), shingles_of(F.col("w")).alias("item_shingles"))
    known = checkpointed(known.withColumn("item_print", simhash(F.col("item_shingles"))))
    n_items, n_shingles = known.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("item_shingles")), F.lit(0))).first()
    anchors = known.select(F.explode_outer("item_shingles").alias("h"), "n_words").groupBy("h").agg(F.collect_set("n_words").alias("lengths"))
    words = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), words_of(F.col(text_col)).alias("w"))
    few = [r[0] for r in known.where(F.col("n_words") < WORDS).select("n_words").distinct().collect()]  # four numbers at most
    shingles = words.select("id", "key", shingles_of(F.col("w")).alias("s"))
    for size in few:  # items too short for a whole shingle are looked for by runs of their own length
        shingles = shingles.union(words.select("id", "key", shingles_of(F.col("w"), size)))
    # outer: of an inner one the optimizer infers a filter that repeats the whole expression, once for each word
    placed = shingles.select("id", "key", F.posexplode_outer("s").alias("at", "h")).join(small_side(anchors, 64 * n_shingles), "h")
    places = placed.select("id", "key", F.explode("lengths").alias("n_words"), "at").groupBy("id", "key", "n_words").agg(F.array_sort(F.collect_set("at")).alias("at"))
    size = F.greatest(F.col("n_words") - WORDS + 1, F.lit(1))
    others = F.greatest(F.ceil(size * threshold), F.lit(1)).cast("int") - 1
    # The last of enough places lies within the window that starts at x.
    starts = places.withColumns({"size": size, "others": others}).select("id", "key", "n_words", F.filter("at", lambda x, i: F.get("at", i + F.col("others")) < x + F.col("size")).alias("starts")).where(F.size("starts") > 0)
    windows = starts.groupBy("id", "key").agg(F.flatten(F.collect_list(F.transform("starts", lambda x: F.struct(x.alias("start"), F.col("n_words").alias("n_words"))))).alias("windows"))
    windows = checkpointed(windows)
    n_windows = windows.agg(F.coalesce(F.sum(F.size("windows")), F.lit(0))).first()[0]
    with_text = docs.select(F.col(id_col).alias("d_id"), F.xxhash64(text_col).alias("d_key"), F.col(text_col).alias("d_text"))
    same = F.col("id").eqNullSafe(F.col("d_id")) & (F.col("key") == F.col("d_key"))
    cut = with_text.join(small_side(windows, 64 * n_windows), same).dropDuplicates(["d_id", "d_key"])
    inside = F.transform("windows", lambda x: F.struct(F.least(x["start"], F.greatest(F.size("w") - x["n_words"], F.lit(0))).alias("start"), x["n_words"].alias("n_words")))
    cut = cut.select("id", "key", words_of(F.col("d_text")).alias("w"), "windows")
    cut = cut.select("id", "key", shingles_of(F.col("w")).alias("s"), *(shingles_of(F.col("w"), k).alias(f"s{k}") for k in few), F.array_distinct(inside).alias("windows"))
    cut = cut.select("id", "key", "s", *(f"s{k}" for k in few), F.explode_outer("windows").alias("win"))
    own = F.slice("s", F.col("win.start") + 1, F.greatest(F.col("win.n_words") - WORDS + 1, F.lit(1)))
    for k in few:
        own = F.when(F.col("win.n_words") == k, F.slice(f"s{k}", F.col("win.start") + 1, F.lit(1))).otherwise(own)
    cut = cut.select("id", "key", F.col("win.start").alias("start"), F.col("win.n_words").alias("n_words"), own.alias("shingles"))
    cut = checkpointed(cut.withColumn("print", simhash(F.col("shingles"))))
    blocked = cut.select("*", F.explode(blocks_of(F.col("print"))).alias("block"))
    sides = known.select("item", F.col("n_words").alias("item_words"), "item_print", F.explode(near_blocks(F.col("item_print"), radius)).alias("item_block"))
    entries = sum(math.comb(w, n) for _, w in LAID for n in range(radius // BLOCKS + 1))
    met = blocked.join(small_side(sides, 64 * n_items * entries), (F.col("block") == F.col("item_block")) & (F.col("n_words") == F.col("item_words")))
    met = met.where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius)
    # A pair that meets in several blocks counts in the first.
    apart = F.arrays_zip(blocks_of(F.col("print")).alias("a"), blocks_of(F.col("item_print")).alias("b"))
    first = F.array_min(F.transform(F.filter(apart, lambda z: F.bit_count(z["a"]["bits"].bitwiseXOR(z["b"]["bits"])) <= radius // BLOCKS), lambda z: z["a"]["no"]))
    met = met.where(F.col("block.no") == first).select("id", "key", "start", "n_words", "shingles", F.col("item").alias("met_item"), F.col("item_words").alias("met_words"), F.col("item_print").alias("met_print"))
    texts = known.select("item", F.col("n_words").alias("item_words"), "item_print", "item_shingles")
    same = F.col("met_item").eqNullSafe(F.col("item")) & (F.col("met_words") == F.col("item_words")) & (F.col("met_print") == F.col("item_print"))
    near = met.join(small_side(texts, 64 * n_items + 8 * n_shingles), same)
    found = near.withColumn("similarity", weighted_similarity(F.col("shingles"), F.col("item_shingles"))).where(F.col("similarity") >= threshold)
    found = found.select("id", "key", "item", "start", F.col("n_words").alias("words"), "similarity")
    beside = Window.partitionBy("id", "key", "item").orderBy("start")  # windows of one item in one text
    better = lambda f: F.coalesce((f("similarity").over(beside) > F.col("similarity")) & (F.abs(f("start").over(beside) - F.col("start")) < F.col("words")), F.lit(False))
    return found.withColumn("_less", better(F.lag) | better(F.lead)).where(~F.col("_less")).drop("_less")


def report(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: object) -> DataFrame:
    """One row per document: id, contaminated, item_ids (sorted), n_windows, best (the largest similarity, 0 if none)."""
    found = leaks(docs, items, id_col, text_col, **how)
    found = checkpointed(found.groupBy("id", "key").agg(F.array_sort(F.collect_set("item")).alias("item_ids"), F.count(F.lit(1)).alias("n_windows"), F.max("similarity").alias("best")))
    keyed = docs.select(F.col(id_col), F.xxhash64(text_col).alias("d_key"))
    same = F.col(id_col).eqNullSafe(F.col("id")) & (F.col("d_key") == F.col("key"))
    out = keyed.join(small_side(found, 512 * found.count()), same, "left")
    none = F.array().cast(found.schema["item_ids"].dataType)
    return out.select(id_col, (F.coalesce(F.col("n_windows"), F.lit(0)) > 0).alias("contaminated"), F.coalesce(F.col("item_ids"), none).alias("item_ids"), F.coalesce(F.col("n_windows"), F.lit(0)).cast("long").alias("n_windows"), F.coalesce(F.col("best"), F.lit(0.0)).alias("best"))


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: object) -> DataFrame:
    """``docs`` without those that hold an item. All columns stay as they are."""
    found = leaks(docs, items, id_col, text_col, **how)
    found = checkpointed(found.select("id", "key").distinct())
    keyed = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key")).alias("_kf"), whole_row(docs))
    same = F.col("_kf.id").eqNullSafe(F.col("id")) & (F.col("_kf.key") == F.col("key"))
    return keyed.join(small_side(found, 32 * found.count()), same, "left_anti").select("row.*")
