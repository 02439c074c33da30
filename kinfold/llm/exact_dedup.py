"""Exact duplicates by distributed MSD radix partitioning.

Two texts are equal when they are identical after lower-casing A-Z only. The
most significant digit of a document is its length in bytes with the first 48
characters of its text; each further round splits the groups that are left by
the next run of characters, 16 times as long as the last (digits are wide, so
that long texts need few rounds). A group leaves the recursion as soon as it
is a singleton or its texts have ended, so equality is decided by the text
itself and by no digest, both in the report and in what is dropped. Rounds
after the first touch only rows that still share everything read so far.

Defined cases: a null text counts as empty; all empty texts are equal. Nulls
in the id column compare below every id; a group of null ids only has a null
``keep_id``. Where rows of a group share the largest id, exactly one of them is
kept. An empty table gives an empty result. Other columns, of whatever name,
are not looked at.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._work import checkpointed, small_side, whole_row, written

FIRST_CHARS = 48
GROWTH = 16


def normalised(text: Column) -> Column:
    """Null to empty, A-Z to a-z. ``lower`` does just that to pure ASCII and is many times faster."""
    text = F.coalesce(text, F.lit(""))
    exact = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(exact)


def _groups(keyed: DataFrame, keys: list[str], offset: int) -> tuple[DataFrame, int, int]:
    """Groups of two rows and more under ``keys``; their bytes; how many have text beyond ``offset``."""
    found = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keep_id"), F.max("chars").alias("g_chars")).where("n > 1")
    found = checkpointed(found.withColumn("next_gid", F.monotonically_increasing_id()))
    size, more = found.agg(F.sum(F.octet_length(keys[-1]) + F.lit(64)), F.count_if(F.col("g_chars") > offset)).first()
    return found.drop("g_chars"), size or 0, more


def _split(docs: DataFrame, id_col: str, text_col: str, carry: Column, first_chars: int, growth: int) -> list[DataFrame]:
    """Tables of id, ``carry``, and for members of groups keep_id, n, round and gid (its group in that round); row_no tells rows of a round apart."""
    text = F.coalesce(F.col("_kf.text"), F.lit(""))
    head = F.translate(F.substring(text, 1, first_chars), string.ascii_uppercase, string.ascii_lowercase)
    own = docs.select(F.struct(F.col(id_col).alias("id"), F.col(text_col).alias("text"), whole_row(docs)).alias("_kf"))
    keyed = own.select(F.col("_kf.id").alias("id"), F.octet_length(text).alias("bytes"), F.char_length(text).alias("chars"), head.alias("digit"), text.alias("text"), F.col("_kf.row").alias("row"))
    found, size, more = _groups(keyed.drop("text", "row"), ["bytes", "digit"], first_chars)
    rest = F.when(F.col("next_gid").isNotNull() & (F.col("chars") > first_chars), F.substring(normalised(F.col("text")), first_chars + 1, 1 << 30))
    rows = keyed.join(small_side(found, size), ["bytes", "digit"], "left").select("id", "chars", carry.alias("carry"), "keep_id", "n", F.col("next_gid").alias("gid"), rest.alias("rest"))

    def table(rows: DataFrame, number: int) -> DataFrame:
        return written(rows.withColumn("round", F.lit(number)).withColumn("row_no", F.monotonically_increasing_id()), "radix")

    rows = table(rows, 0)
    done, offset, width = [rows.where("rest is null").drop("rest", "chars")], first_chars, first_chars * growth
    while more:
        left = rows.where("rest is not null").select("id", "chars", "carry", "gid", F.substring("rest", 1, width).alias("digit"), F.substring(F.col("rest"), width + 1, 1 << 30).alias("after"))
        offset += width
        found, size, more = _groups(left.select("id", "chars", "gid", "digit"), ["gid", "digit"], offset)
        after = F.when(F.col("next_gid").isNotNull() & (F.col("chars") > offset), F.col("after"))
        rows = table(left.join(small_side(found, size), ["gid", "digit"], "left").select("id", "chars", "carry", "keep_id", "n", F.col("next_gid").alias("gid"), after.alias("rest")), len(done))
        done.append(rows.where("rest is null").drop("rest", "chars"))
        width *= growth
    return done


def _decided(docs: DataFrame, id_col: str, text_col: str, carry: Column, first_chars: int, growth: int) -> DataFrame:
    """id, carry, keep_id, n, kept of every row."""
    done = _split(docs, id_col, text_col, carry, first_chars, growth)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    top = F.col("gid").isNull() | F.col("id").eqNullSafe(F.col("keep_id"))
    # Groups whose largest id several rows have keep the first of these.
    tied = out.where(F.col("gid").isNotNull() & top).groupBy("round", "gid").agg(F.count(F.lit(1)).alias("tops"), F.min("row_no").alias("only")).where("tops > 1").drop("tops")
    tied = checkpointed(tied)
    out = out.join(small_side(tied, 40 * tied.count()), ["round", "gid"], "left")
    kept = top & (F.col("only").isNull() | (F.col("only") == F.col("row_no")))
    return out.select("id", "carry", F.when(F.col("gid").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("n"), kept.alias("kept"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first_chars: int = FIRST_CHARS, growth: int = GROWTH) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256 (of the text in lower case, told, not used)."""
    out = _decided(docs.select(id_col, text_col), id_col, text_col, F.sha2(normalised(F.col("text")), 256), first_chars, growth)
    return out.select(F.col("id").alias(id_col), "keep_id", F.col("n").alias("group_size"), "kept", F.col("carry").alias("text_sha256"))


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first_chars: int = FIRST_CHARS, growth: int = GROWTH) -> DataFrame:
    """``docs`` without the rows that are not kept. All columns stay as they are. Each row goes through the rounds with its group."""
    out = _decided(docs, id_col, text_col, F.col("row"), first_chars, growth)
    return out.where("kept").select("carry.*")
