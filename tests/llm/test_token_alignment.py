"""Alignment of two tokenizers against the contract read literally, with each text tokenised whole by the libraries."""

import hashlib
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from kinfold.llm import queries, token_alignment

pytestmark = pytest.mark.skipif(not os.path.isdir(token_alignment.FILES), reason="the vocabulary files aren't here")

TEXTS = [
    None, "", " ", "  ", "a", "Hello world", "  two  blanks ", "tab\tand\nline\r\n\nend", "naïve café — 𝔘𝔫𝔦 日本語 ﬁ é   x", "<|endoftext|> and <s> </s> <unk> <0x41>", "nul \0 here", "a \x1c b\x85 　c ​",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa " * 9, "it's they'll WE'RE 123 4567 !!! ???...", "x" * 5000, "▁▁ ▁a a▁b ▁", "▁", "the the the the", "the the the the", "﻿bom � \U0010ffff",
]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    signs = "abc  \n\t.,'’é日 <>0195"
    return [*enumerate(TEXTS), *((100 + i, "".join(rng.choice(signs) for _ in range(rng.randrange(60)))) for i in range(200)), (7, "a repeated id"), (None, "no id")]


def contract(rows):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{token_alignment.FILES}/byte_bpe_50k.json")
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=f"{token_alignment.FILES}/piece_bpe_32k.model")
    chars = token_alignment.byte_level()

    def sides(text):
        if not text:
            return [], []
        x = [(i, bytes(chars[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        y = [(i, bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        return (x, y) if all(b"".join(t for _, t in s) == (" " + text).encode() for s in (x, y)) else ([], [])

    held, pairs = [], Counter()
    for doc_id, text in rows:
        ends = []
        for side in (s := sides(text)):
            at, out = 0, {}
            for n, (i, t) in enumerate(side):
                at += len(t)
                out[at] = (n, i)
            ends.append(out)
        cuts = sorted(ends[0].keys() & ends[1].keys())
        links = [(ends[0][c][1], ends[1][c][1]) for c in cuts]
        pairs.update(links)
        groups, low = [], (0, 0)
        for c in cuts:
            high = ends[0][c][0] + 1, ends[1][c][0] + 1
            groups.append("|".join(",".join(str(i) for i, _ in s[k][low[k] : high[k]]) for k in (0, 1)))
            low = high
        held.append((doc_id, len(s[0]), len(s[1]), groups, links))
    best = defaultdict(int)
    for (_, y), n in pairs.items():
        best[y] = max(best[y], n)
    return [
        (d, na, nb, len(g), len(k), sum(pairs[p] == best[p[1]] for p in k), sum(pairs[p] for p in k), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for d, na, nb, g, k in held
    ]


def key(row):
    return tuple((x is None, str(x)) for x in row)


def test_query_is_the_contract(spark, rows, tmp_path):
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'x' AS links", "1 AS `a.b`").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op12_token_alignment"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = contract(rows)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert sum(w[1] > 0 for w in want) > 200 and any(w[1] == 0 and t for w, (_, t) in zip(want, rows, strict=True))


def test_counts_of_many_pairs_come_by_a_shuffle(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = token_alignment.alignment(docs, limit=0)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(contract(rows), key=key)


def test_links_and_groups_of_one_text(spark):
    (row,) = token_alignment.aligned(token_alignment.tokenised(spark.createDataFrame([(1, "tokenisation of a tokenisation")], "doc_id long, text string"))).collect()
    groups = [[side.split(",") for side in g.split("|")] for g in row["groups"].split(";")]
    assert len(groups) == len(row["links"]) and (row["n_a"], row["n_b"]) == tuple(sum(len(g[k]) for g in groups) for k in (0, 1))
    assert row["links"] == [int(a[-1]) << token_alignment.ID_BITS | int(b[-1]) for a, b in groups]


def test_long_text_and_empty_table(spark):
    text = "".join(f"word{i % 999} and\tso  on " for i in range(60_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (row,) = token_alignment.alignment(docs).collect()
    assert tuple(row) == contract([(1, text)])[0]
    assert token_alignment.alignment(docs.limit(0)).count() == 0


def test_a_piece_is_read_once_by_each_side():
    read = []

    def encode(texts):
        read.extend(texts)
        return [list(f" {t}".encode()) for t in texts]

    side = token_alignment.Side(encode, [bytes([i]) for i in range(256)])
    pieces = token_alignment.Pieces((side, side))
    for texts in (["one two  two three", "", "four one"], ["one four", "five three"]):
        codes, n = pieces.cut(texts)
        used = np.unique(codes)
        assert pieces.known(used).all() and n.tolist() == [len(t.replace("  ", "").split(" ")) if t else 0 for t in texts]
        ids, sizes = pieces.tokens(1, used)
        assert bytes(ids.tolist()).decode() == "".join(f" {pieces.names[i]}" for i in used) and sizes.sum() == len(ids)
    assert sorted(" ".join(read).split(" ")) == sorted(["one", "two", "", "two", "three", "four", "five"] * 2)  # two blanks don't cut


def test_a_group_ends_where_both_sides_do_and_a_piece_where_it_does(spark):
    """Tokens and places by hand: A ends at 2, 5, 7, 9 and B at 3, 5, 9; pieces at 5 and 9."""
    token = lambda end, i: (end << token_alignment.ID_BITS + 1) + i + token_alignment.MARKS
    row = ([1, 2], [[1, 0], []], [token(2, 0), token(5, 7), token(7, 50256), token(9, 4)], [2, 5, 7, 9], [token(3, 0), token(5, 1), token(9, 31999)], [3, 5, 9], [5, 9], [(2 << 32) + 2, (2 << 32) + 1])
    names = "own array<bigint>, codes array<array<int>>, tokens_a array<bigint>, ends_a array<int>, tokens_b array<bigint>, ends_b array<int>, piece_ends array<int>, sizes array<bigint>"
    got = token_alignment.aligned(spark.createDataFrame([row], names)).collect()
    assert [tuple(r) for r in got] == [(1, 4, 3, "50256,4|31999;0,7|0,1", [4 << 20 | 31999, 7 << 20 | 1]), (2, 0, 0, "", [])]


def test_places_of_pieces_by_hand(spark):
    """Pieces of 5 and 4 bytes: A ends at 2, 5, 7, 9 and B at 3, 5, 9. Ids as text and places count from each piece's begin; what ends nowhere is 0."""
    ids, ends = [np.array([0, 7, 50256, 4]), np.array([0, 1, 31999])], [np.array([2, 5, 7, 9]), np.array([3, 5, 9])]
    laid = token_alignment._laid(ids, [np.array([2, 2]), np.array([2, 1])], ends, [b"%d," % i for i in range(50257)])
    a, b, text, at_a, at_b, links, sizes = (x[0].as_py() for x in laid)
    assert (a, b, text) == ([[2, 5], [7, 9]], [[3, 5], [9]], [b"0,7|0,1", b"50256,4|31999"])
    assert (at_a, at_b) == ([0, 0, 3, 0, 0, 5, 0, 7, 0, 9], [0, 0, 0, 7, 0, 9, 0, 0, 0, 15])
    assert links[5] == 7 << 20 | 1 and links[9] == 4 << 20 | 31999 and sizes == [2 << 32 | 2, 2 << 32 | 1]


def test_tokens_are_not_sorted_and_ids_not_read_back_from_text(spark, rows):
    """That was the most of what a text cost."""
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plan = token_alignment.aligned(token_alignment.tokenised(docs))._jdf.queryExecution().analyzed().toString()
    assert "array_intersect" in plan
    assert not any(f in plan for f in ("sort_array", "split(", "substring_index", "try_cast"))


def test_a_long_piece_of_many_groups(spark):
    text = "".join(f"{i}é-x" for i in range(20_000))
    (row,) = token_alignment.alignment(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert tuple(row) == contract([(1, text)])[0] and row["n_groups"] > 20_000
