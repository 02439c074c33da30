"""Alignment of two tokenizers over the same bytes, built by Spark's higher-order functions.

A text is cut at single blanks between characters that are no white space.
Neither the byte-level pattern nor any merge of the piece vocabulary (which is
checked) reaches over such a blank, so what stands between two blanks, with
the first of them, has the same tokens by itself as in the text, and tokens of
both sides end where it ends. Python only cuts and tokenises, each piece once a
task: for half a megabyte of texts it returns each text as numbers of distinct
pieces, and of these pieces the byte offsets at which the tokens of both
tokenizers end, their ids as text, and what is to be found at an offset: where
in that text the next id begins, and the ids that end there.

All else are expressions. ``array_intersect`` of the two end arrays of a piece
gives the offsets at which tokens of both end. ``transform`` cuts the text of
ids there, which makes the groups, and takes the ids at each offset, which are
the links: the tokens just before a cut end together. Both look a place up by
its offset, so that nothing is searched for or sorted and n tokens cost n,
however long a piece is. A token has at least one byte, so that a cut has one
link. A text, of a ``sequence`` of them, has the groups and links of its pieces
in order, and ``aggregate`` adds up their tokens.

How often a pair of ids is linked is counted over all documents; the counts
come back by a broadcast if the table of pairs was measured to be small, else
the few pairs that hold more than one link in ``HOT`` come by a broadcast and
the others by a shuffle in which none of them is hot.

Defined cases: null and empty texts, and texts whose joined token bytes of one
side aren't the blank and the text, have no tokens, groups or links; their
numbers are zero and their checksum is empty. Texts of any length are read
whole. Rows are taken one by one, so rows that repeat, or share an id, count
as documents each; null ids stay null. Empty tables give empty results; other
columns are not looked at.
"""

from __future__ import annotations

import itertools
import json
import os
import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text
from ._work import BROADCAST_BYTES, trimmed, written

#: Where the public vocabulary files lie; every executor reads them there.
FILES = "/opt/tokenizers"
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Fixed value: the pattern that cuts a text before the byte-level merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHUNK_BYTES, TOGETHER, KEPT = 1 << 19, 64, 1 << 19
ID_BITS = 20
#: Added to the ids of tokens that :func:`placed` takes.
MARKS = 2
#: Of all pieces in a row: the byte offsets at which each one's tokens end, its ids as text (``a1,a2|b1,b2``); by byte offset, where in that text
#: the id after it begins on either side, and the ids that end there, packed into a number; how many tokens a piece has on both sides, in a number.
PLACES = {"piece_ends_a": "array<int>", "piece_ends_b": "array<int>", "ids": "binary", "at_a": "int", "at_b": "int", "links_at": "bigint", "sizes": "bigint"}
HOT = 1024
PAIR_BYTES = 32
_BLANK = re.compile(r"(?<=\S) (?=\S)")
_LONG_BLANK = re.compile(r"\s{256}")


def byte_level() -> dict[str, int]:
    """The bytes that a byte-level vocabulary's characters stand for: printable ones for themselves, the others in order from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Side:
    """A tokenizer, which reads texts with a blank before each, and the bytes of its tokens."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], tokens: list[bytes]) -> None:
        self.encode, self.tokens = encode, tokens
        self.lengths = np.array([len(t) for t in tokens], np.int32)

    def pieces(self, pieces: list[str], plain: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all pieces, offsets of each piece's, and whether its bytes are lost. The first ``plain`` ones are read some at a time as one text."""
        want = [b" " + p.encode() for p in pieces]
        ids = list(itertools.chain.from_iterable(self.encode([" ".join(pieces[k : min(k + TOGETHER, plain)]) for k in range(0, plain, TOGETHER)] + pieces[plain:])))
        if b"".join(map(self.tokens.__getitem__, ids)) == b"".join(want):
            flat = np.array(ids, np.int32)
            at = np.searchsorted(np.cumsum(self.lengths[flat]), np.cumsum([len(w) for w in want])) + 1
            return flat, np.concatenate(([0], at)), np.zeros(len(pieces), bool)
        each = self.encode(pieces)
        lost = np.array([b"".join(map(self.tokens.__getitem__, i)) != w for i, w in zip(each, want, strict=True)], bool)
        return np.array([i for e in each for i in e], np.int32), np.concatenate(([0], np.cumsum([len(e) for e in each]))), lost


def byte_side(path: str) -> Side:
    """The byte-level file. Its merges are those of the ids' order (which is checked), so that a faster library gives the same tokens; that one fails on long white space, which the file's own library reads."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    chars, names = byte_level(), {i: t for t, i in model["vocab"].items()}
    if any(names[256 + k] != "".join(m.split(" ") if isinstance(m, str) else m) for k, m in enumerate(model["merges"])):
        raise ValueError("ids aren't in the order of the merges")
    tokens = [bytes(chars[c] for c in names[i]) if i in names and set(names[i]) <= chars.keys() else b"" for i in range(max(names) + 1)]
    fast = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens[: 256 + len(model["merges"])])}, special_tokens={})
    own = []

    def slow(text: str) -> list[int]:
        if not own:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            own.append(Tokenizer.from_file(path))
            own[0].encode_special_tokens = True
        return own[0].encode_batch_fast([text], add_special_tokens=False)[0].ids

    def encode(texts: list[str]) -> list[list[int]]:
        return [slow(f" {t}") if _LONG_BLANK.search(t) else fast.encode_ordinary(f" {t}") for t in texts]

    return Side(encode, tokens)


def piece_side(path: str) -> Side:
    import sentencepiece

    tok = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [tok.id_to_piece(i) for i in range(tok.get_piece_size())]
    if any("▁" in n.lstrip("▁") for n in names):
        raise ValueError("a piece reaches over a blank, so texts can't be cut there")
    tokens = [bytes([int(n[1:-1], 16)]) if tok.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
    return Side(lambda texts: tok.encode(texts, num_threads=1), tokens)


class Pieces:
    """What a task has found between single blanks, told by numbers, so that a piece is read once by each side; beyond ``KEPT`` of them it begins anew."""

    def __init__(self, sides: tuple[Side, Side]) -> None:
        self.sides = sides
        self.clear()

    def clear(self) -> None:
        self.place: defaultdict[str, int] = defaultdict(itertools.count().__next__)
        self.names: list[str] = []
        self.odd, self.good, self.read = np.zeros(0, bool), np.zeros(0, bool), np.zeros(0, bool)
        self.flat, self.low, self.n = [np.zeros(0, np.int32)] * 2, [np.zeros(0, np.int64)] * 2, [np.zeros(0, np.int64)] * 2

    def _numbers(self, cut: list[list[str]]) -> np.ndarray:
        codes = np.fromiter(map(self.place.__getitem__, itertools.chain.from_iterable(cut)), np.int64, sum(map(len, cut)))
        new = list(itertools.islice(self.place, len(self.names), None))
        self.names += new
        grown = lambda x: np.concatenate((x, np.zeros(len(new), x.dtype)))
        self.odd = np.concatenate((self.odd, np.array([not p or p[0].isspace() or p[-1].isspace() for p in new], bool)))
        self.good, self.read = grown(self.good), grown(self.read)
        self.low, self.n = [grown(x) for x in self.low], [grown(x) for x in self.n]
        return codes

    def cut(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of all texts, and how many each text has. Where a blank stands beside white space, it doesn't cut."""
        if len(self.names) > KEPT:
            self.clear()
        cut = [t.split(" ") if t else [] for t in texts]
        codes, of = self._numbers(cut), np.repeat(np.arange(len(cut)), [len(c) for c in cut])
        if again := np.unique(of[self.odd[codes]]).tolist():
            parts = np.split(codes, np.searchsorted(of, np.arange(1, len(cut))))
            for i in again:
                parts[i] = self._numbers([_BLANK.split(texts[i])])
            return np.concatenate(parts), np.array([len(p) for p in parts])
        return codes, np.array([len(c) for c in cut])

    def known(self, used: np.ndarray) -> np.ndarray:
        """Reads those pieces that were not read yet; which of all the sides give back whole."""
        new = used[~self.read[used]]
        if len(new):
            new = new[np.argsort(self.odd[new], kind="stable")]
            names, plain = [self.names[i] for i in new.tolist()], int((~self.odd[new]).sum())
            self.read[new] = self.good[new] = True
            for k, side in enumerate(self.sides):
                flat, bounds, lost = side.pieces(names, plain)
                self.low[k][new], self.n[k][new] = bounds[:-1] + len(self.flat[k]), np.diff(bounds)
                self.flat[k] = np.concatenate((self.flat[k], flat))
                self.good[new] &= ~lost
        return self.good[used]

    def tokens(self, k: int, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A side's ids of these pieces, and how many each has."""
        n = self.n[k][used]
        return self.flat[k][np.repeat(self.low[k][used] - np.cumsum(n) + n, n) + np.arange(n.sum())], n


def _one(x: pa.Array) -> pa.ListArray:
    """A column of one row that is an array."""
    return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)


def _laid(ids: list[np.ndarray], n: list[np.ndarray], ends: list[np.ndarray], names: list[bytes]) -> list[pa.Array]:
    """The columns ``PLACES`` of some pieces: of both sides the ids, each piece's number of them and the byte offsets where they end. ``names``: ids as text, with a comma."""
    size = int(ends[0][-1]) + 1 if len(ends[0]) else 1
    widths = np.array(list(map(len, names)), np.int32)
    low, at, first = [], [], 1
    for k in (0, 1):
        bounds, places = np.concatenate(([0], np.cumsum(n[k]))), np.concatenate(([0], np.cumsum(widths[ids[k]], dtype=np.int64)))
        dense = np.zeros(size, np.int32)
        dense[ends[k]] = places[1:] + np.repeat(first - places[bounds[:-1]], n[k])
        first = 1 + np.diff(places[bounds])
        low.append((bounds, places[bounds]))
        at.append(dense)
    (bounds_a, text_a), (bounds_b, text_b) = low
    both = np.empty(len(ids[0]) + len(ids[1]), np.int32)
    both[np.arange(len(ids[0])) + np.repeat(bounds_b[:-1], n[0])] = ids[0]
    both[np.arange(len(ids[1])) + np.repeat(bounds_a[1:], n[1])] = ids[1]
    text = np.frombuffer(bytearray().join(map(names.__getitem__, both.tolist())), np.uint8)
    text[text_a[1:] + text_b[:-1] - 1] = ord("|")
    whole = np.ones(len(text), bool)
    whole[text_a[1:] + text_b[1:] - 1] = False
    bounds = (text_a + text_b - np.arange(len(text_a))).astype(np.int32)
    texts = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(text[whole])])
    found = np.zeros(size, np.int64)
    found[ends[0]] = ids[0].astype(np.int64) << ID_BITS
    found[ends[1]] += ids[1]
    lists = [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(e.astype(np.int32))) for (bounds, _), e in zip(low, ends, strict=True)]
    return [_one(x) for x in (*lists, texts, *map(pa.array, at), pa.array(found), pa.array((n[0] << 32) + n[1]))]


def _tokenised(byte_path: str, piece_path: str, chunk_bytes: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = byte_side(byte_path), piece_side(piece_path)
        held_pieces = Pieces(sides)
        names = [b"%d," % i for i in range(max(len(s.tokens) for s in sides))]
        for b in batches:
            own, texts = b.columns
            for first, held in _text.chunks(texts.to_pylist(), chunk_bytes, lower=False):
                codes, n_pieces = held_pieces.cut([t.decode("utf-8", "surrogatepass") for t in held])
                here = np.zeros(len(held_pieces.names), bool)
                here[codes] = True
                used = np.flatnonzero(here)
                good = held_pieces.known(used)
                here[used] = good
                of = np.repeat(np.arange(len(held)), n_pieces)
                if not good.all():  # texts with such a piece have no tokens
                    whole = np.ones(len(held), bool)
                    whole[of[~here[codes]]] = False
                    codes, of, used = codes[whole[of]], of[whole[of]], used[good]
                at = np.searchsorted(of, np.arange(len(held) + 1)).astype(np.int32)
                columns = [_one(own.slice(first, len(held))), _one(pa.ListArray.from_arrays(pa.array(at), pa.array((np.cumsum(here) - 1)[codes].astype(np.int32))))]
                ids, n = zip(*(held_pieces.tokens(k, used) for k in (0, 1)), strict=True)
                ends = [np.cumsum(s.lengths[i], dtype=np.int64) for s, i in zip(sides, ids, strict=True)]
                yield pa.RecordBatch.from_arrays(columns + _laid(ids, n, ends, names), ["own", "codes", *PLACES])

    return run


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            b = batch.slice(i, 1)
            array = lambda c: b[c].flatten().to_numpy(zero_copy_only=False).astype(np.int64)  # noqa: B023, E731
            ids, sizes = [(array(f"tokens_{k}") & ((1 << ID_BITS) - 1)) - MARKS for k in "ab"], array("sizes")
            names = [b"%d," % i for i in range(max((int(x.max()) for x in ids if len(x)), default=0) + 1)]
            laid = _laid(ids, [sizes >> 32, sizes & ((1 << 32) - 1)], [array("ends_a"), array("ends_b")], names)
            yield pa.RecordBatch.from_arrays([b["own"], b["codes"], *laid], ["own", "codes", *PLACES])


def _schema(kind: str) -> str:
    return f"own array<{kind}>, codes array<array<int>>, " + ", ".join(f"{name} array<{of}>" for name, of in PLACES.items())


def tokenised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", files: str = FILES) -> DataFrame:
    """A row for some texts: own (their ids), codes (the pieces of each), and ``PLACES`` of all distinct pieces in a row."""
    own = docs.select(F.col(id_col).alias("own"), F.col(text_col).alias("text"))
    return own.mapInArrow(trimmed(_tokenised(f"{files}/{BYTE_BPE}", f"{files}/{PIECE_BPE}", CHUNK_BYTES)), _schema(own.schema["own"].dataType.simpleString()))


def placed(tokens: DataFrame) -> DataFrame:
    """Rows of :func:`tokenised` from own, codes and, of all pieces in a row, tokens_a, ends_a, tokens_b, ends_b and sizes.

    A token is its id above ``MARKS`` and, in the bits above, twice its end; a size is the piece's tokens of both sides in a number.
    """
    rows = tokens.select("own", "codes", "tokens_a", "ends_a", "tokens_b", "ends_b", "sizes")
    return rows.mapInArrow(_placed, _schema(rows.schema["own"].dataType.elementType.simpleString()))


def aligned(tokens: DataFrame) -> DataFrame:
    """One row per text of :func:`tokenised`, or of what :func:`placed` takes: id, n_a, n_b, groups (``a1,a2|b1;a3|b2,b3``) and links (both ids packed into a number)."""
    rows = tokens if set(PLACES) <= set(tokens.columns) else placed(tokens)
    cuts = rows.withColumn("cuts", F.zip_with("piece_ends_a", "piece_ends_b", F.array_intersect))

    def groups(ids: Column, at: Column) -> Column:
        def group(c: Column, i: Column) -> Column:
            before = F.get(at, i - 1)
            # What A wrote begins a piece's text, B's follows where A's ends.
            low_a, low_b = F.coalesce(F.get("at_a", before), F.lit(1)), F.coalesce(F.get("at_b", before), F.get("at_a", F.element_at(at, -1)))
            part = lambda low, side: F.substring(ids, low, F.get(side, c) - low - 1)
            return F.concat(part(low_a, "at_a"), F.lit("|").cast("binary"), part(low_b, "at_b")).cast("string")

        return F.when(F.size(at) == 1, ids.cast("string")).otherwise(F.array_join(F.transform(at, group), ";"))

    links = F.transform("cuts", lambda at: F.transform(at, lambda c: F.get("links_at", c)))
    linked = cuts.select("own", "codes", "sizes", F.zip_with("ids", "cuts", groups).alias("groups"), links.alias("links"))
    each = lambda codes, of: F.transform(codes, lambda c: F.get(F.col(of), c))

    def text(i: Column) -> Column:
        codes = F.get("codes", i)
        n = F.aggregate(codes, F.lit(0).cast("long"), lambda total, c: total + F.get(F.col("sizes"), c))
        return F.struct(F.get("own", i).alias("id"), n.alias("n"), F.array_join(each(codes, "groups"), ";").alias("groups"), F.flatten(each(codes, "links")).alias("links"))

    texts = linked.select(F.inline(F.transform(F.sequence(F.lit(0), F.size("own") - 1), text)))
    return texts.select("id", F.shiftright("n", 32).alias("n_a"), F.col("n").bitwiseAND(F.lit((1 << 32) - 1)).alias("n_b"), "groups", "links")


def pair_counts(linked: DataFrame) -> DataFrame:
    """link, count, best of each pair of ids: how many of the ``links`` of all rows hold it, and whether no pair of the same B id has more."""
    counts = linked.select(F.explode("links").alias("link")).groupBy("link").agg(F.count(F.lit(1)).alias("count"))
    counts = written(counts, "pair-counts")
    of_b = F.col("link").bitwiseAND(F.lit((1 << ID_BITS) - 1)).alias("b")
    top = counts.groupBy(of_b).agg(F.max("count").alias("top"))
    return counts.select("*", of_b).join(top, "b").select("link", "count", (F.col("count") == F.col("top")).cast("long").alias("best"))


def link_totals(linked: DataFrame, key: str = "key", limit: int = BROADCAST_BYTES) -> DataFrame:
    """key, n_best, count_sum of the rows that have links. ``limit``: bytes of the pairs up to which they are broadcast."""
    pairs = written(pair_counts(linked), "pairs")
    n, total = pairs.agg(F.count(F.lit(1)), F.sum("count")).first()
    each = linked.select(key, F.explode("links").alias("link"))
    totals = (F.sum("best").alias("n_best"), F.sum("count").alias("count_sum"))
    if n * PAIR_BYTES <= limit:
        return each.join(F.broadcast(pairs), "link").groupBy(key).agg(*totals)
    # At most HOT pairs have more than a HOT-th of all links.
    hot = pairs.where(F.col("count") > total / HOT)
    marked = each.join(F.broadcast(hot), "link", "left")
    known = marked.where("best is not null").groupBy(key).agg(*totals)
    rest = marked.where("best is null").groupBy(key, "link").agg(F.count(F.lit(1)).alias("n")).join(pairs.hint("shuffle_hash"), "link")
    rest = rest.groupBy(key).agg(F.sum(F.col("best") * F.col("n")).alias("n_best"), F.sum(F.col("count") * F.col("n")).alias("count_sum"))
    return known.unionByName(rest).groupBy(key).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def alignment(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", files: str = FILES, limit: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    found = aligned(tokenised(docs, id_col, text_col, files))
    n = F.size("links").cast("long")
    told = found.select(
        F.monotonically_increasing_id().alias("key"), "id", "n_a", "n_b", n.alias("n_groups"), n.alias("n_links"),
        F.when(F.size("links") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256"), "links",
    )
    told = written(told, "alignment")
    sums = link_totals(told.select("key", "links"), "key", limit)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return told.drop("links").join(sums, "key", "left").select("id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
