"""Substring dedup by sliding sentence spans.

A run is at least ``MIN_SENTENCES`` consecutive sentences of ``MIN_WORDS``
words together. The shortest run from each sentence on and the shortest up to
each sentence are hashed. No others are needed: in any run that is repeated,
each sentence begins or ends a shortest run that lies in it, or is covered by
the shortest up to its last sentence. Hashes have 128 bits and are joined over
the whole table, and a sentence goes if any run that covers it occurs in a
document of a smaller id or earlier in its own text. Repeats inside a text are
told where it is read, so that the table of runs is summed up by fixed-width
values and joined in the same way at every size. A sentence ends after ``.``, ``!`` or ``?`` (and quotes or
brackets that close there) before white space, after an ideographic full stop,
or at a line break. Runs are compared in lower case with white space as one
space.

Defined cases: a null text counts as empty and stays as it is; texts without a
repeated run stay as they are, to the byte; a run that a text repeats goes
there too, but for the first; null ids are later than all others, and among
them texts come in the order of their hashes; rows that share an id are never
later than each other, so that what only they repeat stays in all, and what
goes from one row is not cut out of another of the same id;
empty tables give empty results; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._work import small_side, trimmed, written

MIN_SENTENCES, MIN_WORDS = 2, 20
_LOW = (1 << 64) - 1
BOUNDARY = re.compile(r"""(?<=[.!?])\s+|(?<=[.!?]["')\]\u00bb\u201d\u2019])\s+|(?<=[\u3002\uff01\uff1f])\s*|\s*\n\s*""")


def sentences(text: str) -> list[tuple[int, int]]:
    """Start and end of each sentence, white space around it not counted."""
    out, at = [], len(text) - len(text.lstrip())
    stop = len(text.rstrip())
    for m in BOUNDARY.finditer(text, at, stop):
        if m.start() > at:
            out.append((at, m.start()))
        at = m.end()
    if stop > at:
        out.append((at, stop))
    return out


def spans(sizes: list[int]) -> list[tuple[int, int]]:
    """First and last sentence of the shortest run from each sentence on and up to each sentence, by the sentences' words."""
    found: dict[tuple[int, int], None] = {}
    n, j = 0, 0
    for i in range(len(sizes)):
        while j < len(sizes) and (n < MIN_WORDS or j - i < MIN_SENTENCES):
            n += sizes[j]
            j += 1
        if n >= MIN_WORDS and j - i >= MIN_SENTENCES:
            found[i, j - 1] = None
        n -= sizes[i]
    n, i = 0, 0
    for j in range(len(sizes)):
        n += sizes[j]
        while j - i >= MIN_SENTENCES and n - sizes[i] >= MIN_WORDS:
            n -= sizes[i]
            i += 1
        if n >= MIN_WORDS and j - i + 1 >= MIN_SENTENCES:
            found[i, j] = None
    return list(found)


def runs(text: str) -> list[tuple[int, int, int, bool]]:
    """Hash (128 bits), first and last sentence of the runs of a text, and whether the text held the run before."""
    parts = [text[a:b].lower().split() for a, b in sentences(text)]
    found = spans([len(p) for p in parts])
    if not found:
        return []
    each = [xxhash.xxh3_128_digest(" ".join(p).encode("utf-8", "surrogatepass")) for p in parts]
    out, seen = [], set()
    for i, j in sorted(found):
        h = xxhash.xxh3_128_intdigest(b"".join(each[i : j + 1]))
        out.append((h, i, j, h in seen))
        seen.add(h)
    return out


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        found = [runs(t) for t in b["text"]]
        half = lambda shift: [[(x[0] >> shift & _LOW) - (1 << 63) for x in f] for f in found]  # noqa: E731, B023
        yield pd.DataFrame({"id": b["id"], "key": b["key"], "h1": half(64), "h2": half(0), **{c: [[x[k] for x in f] for f in found] for k, c in ((1, "first"), (2, "last"), (3, "again"))}})


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for text, covers in zip(b["text"], b["covers"], strict=True):
            where = sentences(text or "")
            gone = {k for c in (covers if covers is not None else ()) for k in range(c["first"], c["last"] + 1) if k < len(where)}
            if not gone:
                rows.append((text or "", len(where), 0, ""))
                continue
            out, at, spans = [], 0, []
            for k, (x, y) in enumerate(where):
                if k in gone:
                    end = where[k + 1][0] if k + 1 < len(where) else len(text)
                    out.append(text[at:x])
                    at = end
                    if spans and spans[-1][1] >= x - 1 and k - 1 in gone:
                        spans[-1][1] = y
                    else:
                        spans.append([x, y])
            out.append(text[at:])
            rows.append(("".join(out).strip(), len(where), len(gone), ",".join(f"{x}:{y}" for x, y in spans)))
        yield pd.DataFrame({"id": b["id"], "text": [r[0] for r in rows], "n_sentences": [r[1] for r in rows], "n_removed": [r[2] for r in rows], "removed": [r[3] for r in rows]})


def _merged(covers: Column) -> Column:
    """Sorted runs of sentences, those that touch or overlap as one."""
    last = lambda out: F.element_at(out, -1)
    both = lambda out, c: F.struct(last(out)["first"].alias("first"), F.greatest(last(out)["last"], c["last"]).alias("last"))
    join = lambda out, c: F.when((F.size(out) > 0) & (c["first"] <= last(out)["last"] + 1), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(both(out, c)))).otherwise(F.concat(out, F.array(c)))
    return F.aggregate(covers, F.array().cast("array<struct<first:int,last:int>>"), join)


def drop_repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, text (what is left), n_sentences, n_removed, removed (start:end of what went, comma-joined)."""
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))
    hashed = own.mapInPandas(trimmed(_hashed), f"id {kind}, key long, h1 array<bigint>, h2 array<bigint>, first array<int>, last array<int>, again array<boolean>")
    spans = hashed.select("id", "key", F.explode(F.arrays_zip("h1", "h2", "first", "last", "again")).alias("s")).select("id", "key", "s.*")
    spans = written(spans, "spans")
    repeated = spans.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("head"), F.min("key").alias("head_key")).where("n > 1").drop("n")
    repeated = written(repeated, "repeated")  # so that a join of two plain exchanges is left, whose hot runs are dealt anew
    after = F.when(F.col("head").isNull(), F.col("key") > F.col("head_key")).otherwise(F.col("id").isNull() | (F.col("id") > F.col("head")))
    later = spans.join(repeated.hint("merge"), ["h1", "h2"]).where(F.col("again") | after)
    covers = later.groupBy("id", "key").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("covers"))
    covers = written(covers.withColumn("covers", _merged(F.col("covers"))), "covers")
    n, k = covers.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("covers")), F.lit(0))).first()
    side = small_side(covers.select(F.col("id").alias("c_id"), F.col("key").alias("c_key"), "covers"), 56 * n + 24 * k)
    marked = own.join(side, (F.col("key") == F.col("c_key")) & F.col("id").eqNullSafe(F.col("c_id")), "left").select("id", "text", "covers")
    return marked.mapInPandas(trimmed(_cut), f"id {kind}, text string, n_sentences long, n_removed long, removed string").withColumnRenamed("id", id_col)
