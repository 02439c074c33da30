"""Periodic runs of words by Lyndon arrays, in linear time on an ordered alphabet.

A run is a stretch of words with a smallest period, which no neighbouring
word extends. Its Lyndon roots are edges of the Lyndon array, which links each
suffix to the next smaller one: under the usual order if the word after the
run is less than the word one period before it, under the reversed order if
it is greater, under both at the text's end. So two Lyndon arrays, each
computed from left to right with the previous smaller suffixes as a stack,
show all runs.

Two suffixes are compared by the length of what they share. While a suffix
starts within the stretch that was matched last (Ellert and Fischer), its
comparisons are those made one offset earlier, and are copied as long as they
end within that stretch; else matching goes on where the stretch ended. Past
it, the next suffix on the stack shares with the current one what it shares
with the one just passed, or is matched from there on. So each word is matched
once, whatever the text, and no suffix structure and no hash is needed; words
become numbers by sorting.

The right end of a run comes with its edges. Only runs of more than three
periods are looked at further, at their first root, from which less than a
period is compared back to the left; as the periods of two such runs that both
have a word in their first period differ by a factor of two, that is
n log n comparisons at the very worst, and close to none in real texts.

Defined cases: a null text has no words, as an empty one; both have no run and
collapse to an empty string. Texts of any length are read whole, in one task;
those of more than ``LONG`` words are kept in packed arrays, about 25 bytes a
word in all. Every row is taken by itself, so rows that repeat, or share an
id, each have their own result, and null ids stay null. Empty tables give
empty results; other columns are not looked at, whatever they are called.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator, MutableSequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text

LEAST_WORDS, LEAST_PERIODS = 6, 4
LONG = 1 << 20
_RUN = "struct<start:bigint,length:bigint,period:bigint>"


def lyndon_edges(text: MutableSequence[int], n: int, cells: MutableSequence[int]) -> list[tuple[int, int, int]]:
    """(i, next smaller suffix of i, length shared by both) of all edges that share more than two periods.

    ``text`` has ``n`` numbers of at least 0 and then -1; ``cells`` n + 1 zeros.
    """
    before, left, right = cells[:], cells[:], cells
    before[0] = -1
    found = []
    begin = offset = end = 0
    for i in range(1, n + 1):
        j = i - 1
        if i < end:
            # Inside the stretch that was matched last: what was found ``offset`` words ago holds here.
            copy, most = i - offset, end - i
            while True:
                twin = j - offset if j >= begin else j
                stop = before[copy] == twin
                shared = left[copy] if stop else right[twin]
                if shared >= most:
                    shared = most
                    break
                if stop:
                    before[i], left[i], j = j, shared, -2
                    break
                right[j] = shared
                if shared > 2 * (i - j):
                    found.append((j, i, shared))
                j = before[j]
                if j < 0:
                    break
            if j < 0:
                if j == -1:
                    before[i] = -1
                continue
        else:
            word = text[i]
            while j >= 0 and text[j] > word:
                j = before[j]
            if j < 0 or text[j] < word:
                before[i] = j
                continue
            shared = 1
        while j >= 0:
            while text[j + shared] == text[i + shared]:
                shared += 1
            if i + shared >= end:
                begin, offset, end = i, i - j, i + shared
            if text[j + shared] < text[i + shared]:
                before[i], left[i] = j, shared
                break
            right[j] = shared
            if shared > 2 * (i - j):
                found.append((j, i, shared))
            known, j = left[j], before[j]
            while j >= 0 and shared < known:
                right[j] = shared
                known, j = left[j], before[j]
            if j >= 0 and shared > known:
                before[i], left[i] = j, known
                break
        else:
            before[i] = -1
    return found


def runs(ranks: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of ``least_periods`` (4 at least) periods and ``least_words`` words, by start, then period."""
    if least_periods < 4:
        raise ValueError("runs of fewer than four periods are not looked for")
    n, ends = len(ranks), {}
    if n < least_words:
        return []
    top = int(ranks.max())
    for order in (ranks, top - ranks):
        if n > LONG:
            text, cells = array("q", order.astype(np.int64).tobytes()), array("i", bytes(4 * (n + 1)))
            text.append(-1)
        else:
            text, cells = [*order.tolist(), -1], [0] * (n + 1)
        for i, j, shared in sorted(lyndon_edges(text, n, cells)):
            period = j - i
            if (period, j + shared) not in ends:
                start = i
                while start and text[start - 1] == text[start - 1 + period]:
                    start -= 1
                ends[period, j + shared] = start
    return sorted((start, end - start, period) for (period, end), start in ends.items() if end - start >= max(least_words, least_periods * period))


def ranked(held: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The place of each word among the sorted words of all texts, and offsets of each text's words."""
    data = np.frombuffer(b"\n".join(held) + b"\n", np.uint8)
    blank = np.zeros(256, bool)
    blank[[9, 10, 11, 12, 13, 32]] = True
    blank = blank[data]
    edge = np.diff(blank.view(np.int8), prepend=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sizes = np.fromiter((len(b) + 1 for b in held), np.int64, len(held))
    offsets = np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes))))
    bounds = np.concatenate(([0], np.cumsum(ends - starts)))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data[~blank])])
    return pc.rank(words, tiebreaker="dense").to_numpy(), offsets


def collapsed(text: bytes, found: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one blank, without those in a run after its first period."""
    words = text.split()
    if found:
        edge = np.zeros(len(words) + 1, np.int32)
        for start, length, period in found:
            edge[start + period] += 1
            edge[start + length] -= 1
        words = [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
    return b" ".join(words)


def _found(least_words: int, least_periods: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.columns
            for first, held in _text.chunks(texts.to_pylist(), lower=False):
                ranks, offsets = ranked(held)
                found = [runs(ranks[x:y], least_words, least_periods) for x, y in zip(offsets[:-1], offsets[1:], strict=True)]
                flat = np.array([r for f in found for r in f], np.int64).reshape(-1, 3)
                each = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
                bounds = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, len(held)), pa.array(np.diff(offsets), pa.int64()), pa.ListArray.from_arrays(pa.array(bounds), each),
                     pa.array([collapsed(t, f).decode("utf-8", "surrogatepass") for t, f in zip(held, found, strict=True)], pa.string())],
                    ["id", "n_words", "runs", "collapsed"],
                )

    return run


def periodic_runs(docs: DataFrame, id_col: str | Column = "doc_id", text_col: str | Column = "text", least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """One row per document: id, n_words, runs (by start, then period), collapsed (the text without the repeats)."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    own = docs.select(col(id_col).alias("id"), col(text_col).alias("text"))
    return own.mapInArrow(_found(least_words, least_periods), f"id {own.schema['id'].dataType.simpleString()}, n_words bigint, runs array<{_RUN}>, collapsed string")


def rewritten(doc_id: Column, text: Column) -> Column:
    """The text of which one document in ten, by the checksum of its id, has its words from some place on replaced by a repetition."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int")))), " ")

    # The words are bound to a variable first, so that they are not cut anew for each word.
    changed = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(text))[0]
    return F.when((h % 10 == 0) & text.isNotNull(), changed).otherwise(text)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run's numbers and checksums of all runs and of the collapsed text."""
    # The greatest length first, then the smallest start and period.
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    told = found.withColumn("best", best).withColumn("lines", F.when(F.size("runs") > 0, F.concat(F.array_join(line, "\n"), F.lit("\n"))).otherwise(""))
    return told.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )
