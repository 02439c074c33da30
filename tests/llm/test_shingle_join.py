"""The Jaccard join against comparing all pairs of sets."""

import random
import re
from itertools import combinations

import numpy as np
import pytest

from kinfold.llm import queries, shingle_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """(id, size, component) by all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    comp = list(range(len(rows)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            comp[find(j)] = find(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min((x for x in (least.get(find(i)), d) if x is not None), default=None)
    return [(d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(3))
    shared = [" ".join(word() for _ in range(30)) for _ in range(3)]
    texts = [None, "", " \n", "one", "One", "one two three four", "one two three four", "one two three", "a b c d e", "A B C D e", "É é é é é é", "é é é é é é", "x " * 400, "x " * 5]
    for _ in range(40):
        words = [word() for _ in range(rng.choice([4, 8, 30, 120, 300]))]
        texts.append(" ".join(words))
        for _ in range(rng.randrange(9)):
            new = list(words)
            for _ in range(rng.choice([0, 1, 1, 2, max(1, len(words) // 55), max(1, len(words) // 40)])):
                k = rng.randrange(len(new))
                new[k : k + rng.randrange(2)] = [word()] if rng.random() < 0.7 else []
                new = new or ["z"]
            texts.append(rng.choice([" ", "\t", "\n "]).join(new))
    texts += [" ".join([*(word() for _ in range(rng.randrange(25))), s, *(word() for _ in range(rng.randrange(12)))]) for s in shared for _ in range(40)]
    rng.shuffle(texts)
    return [(i * 7 % 1009, t) for i, t in enumerate(texts)]


def key(row):
    return tuple((x is None, str(x)) for x in row)


@pytest.mark.parametrize("shingles,points", [(1 << 15, 256), (300, 4)])
def test_query_finds_all_links(spark, rows, tmp_path, monkeypatch, shingles, points):
    """With leaves of the usual size, and with so small ones that groups are spread over many."""
    monkeypatch.setattr(shingle_join, "LEAF_SHINGLES", shingles)
    monkeypatch.setattr(shingle_join, "LEAF_POINTS", points)
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS n", "2 AS `a.b`", "3 AS node").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op13_shingle_join"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    want = brute(rows)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert sum(d != c for d, _, c in want) > 60


def test_sets_right_at_the_threshold(spark):
    """9 of 10 shingles in common are more than 80 %, 8 of 10 of the union exactly 80 %, 15 of 19 less."""
    word = lambda tag, n: [f"{tag}{i}" for i in range(n)]
    rows = [(1, word("a", 12)), (2, word("a", 14)), (3, word("b", 19)), (4, [*word("b", 19), *word("c", 4)]), (5, word("d", 20)), (6, [*word("d", 20), "e"])]
    rows = [(i, " ".join(w)) for i, w in rows]
    got = {tuple(r) for r in shingle_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == set(brute(rows)) == {(1, 8, 1), (2, 10, 1), (3, 15, 3), (4, 19, 4), (5, 16, 5), (6, 17, 5)}


def test_bounds_never_lose_a_link():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 1 << 62, n, np.uint64))
        b = np.unique(np.concatenate((rng.choice(a, int(len(a) * rng.uniform(0.8, 1)), False), rng.integers(0, 1 << 62, int(rng.integers(0, n // 8 + 1)), np.uint64))))
        leaf = shingle_join.Leaf([{"node": 1, "vector": b.tobytes()}])
        if shingle_join.links(a, b, 80):
            assert leaf.reached(a, 80) and list(leaf.near(a, shingle_join.counts(a, shingle_join.POINT_GROUPS), 80)) == [0]
            least = [set(s[: shingle_join.asked(np.array([len(s)]))[0]].tolist()) for s in (a, b)]
            enough = max(int(shingle_join.least_shared(len(s))) // shingle_join.SPARE + 1 for s in (a, b))
            assert len(least[0] & least[1]) >= enough


def test_odd_tables(spark):
    docs = spark.createDataFrame([(None, "p q r s t u"), (None, "p q r s t u"), (5, "p q r s t u"), (5, "p q r s t u"), (None, "alone here"), (9, None), (9, "")], "doc_id long, text string")
    got = sorted(map(tuple, shingle_join.join(docs).collect()), key=key)
    assert got == sorted([(None, 2, 5), (None, 2, 5), (5, 2, 5), (5, 2, 5), (None, 1, None), (9, 0, 9), (9, 0, 9)], key=key)
    assert shingle_join.join(docs.limit(0)).count() == 0


def test_long_text(spark):
    words = [f"w{i}" for i in range(300_000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[5_000:])), (3, " ".join(words[:100_000]))], "doc_id long, text string")
    assert sorted(map(tuple, shingle_join.join(docs).collect())) == [(1, 299_996, 1), (2, 294_996, 1), (3, 99_996, 3)]


def test_points_that_fit_no_size_are_left_out_and_no_link_is(spark):
    rng = np.random.default_rng(4)
    base = [rng.integers(0, 1 << 62, n).tolist() for n in (30, 90, 100, 146, 400)]
    points = [set(rng.choice(b, int(len(b) * rng.uniform(0.7, 1)), False).tolist()) | set(rng.integers(0, 1 << 62, int(rng.integers(0, len(b) // 4))).tolist()) for b in base for _ in range(30)]
    rows = [(i, len(p), c) for i, p in enumerate(points) for c in p]
    left = {r["node"] for r in shingle_join.fitting(spark.createDataFrame(rows, "node long, n long, coordinate long")).collect()}
    linked = {k for i, j in combinations(range(len(points)), 2) if 100 * len(points[i] & points[j]) >= 80 * len(points[i] | points[j]) for k in (i, j)}
    others = [set().union(*(q for k, q in enumerate(points) if k != i)) for i in range(len(points))]
    shared = {i for i, p in enumerate(points) if 100 * len(p & others[i]) >= 80 * len(p)}
    assert linked and linked <= left and len(left) < len(shared)


def test_a_group_of_near_copies_calls_for_few_visits(spark, monkeypatch):
    """Some 100 variants link with each other, 100 with more changes with none: these aren't visited, nor do the many visit each other's leaves."""
    monkeypatch.setattr(shingle_join, "LEAF_POINTS", 8)
    seen, written = {}, shingle_join.written
    monkeypatch.setattr(shingle_join, "written", lambda df, name: seen.setdefault(name, written(df, name)) if name != "several" else written(df, name))
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(200):
        words = list(base)
        for k in rng.sample(range(5, 145), 1 if i % 2 else 5):
            words[k] = f"n{rng.randrange(10**9)}"
        rows.append((i, " ".join(words)))
    got = sorted(map(tuple, shingle_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == sorted(brute(rows))
    assert sum(d != c for d, _, c in got) == 99
    assert seen["visits"].count() <= 50


def test_leaves_of_a_common_coordinate_are_told_in_few_rows(spark):
    """1,000 leaves with one common coordinate: 999 single documents and a component of 500."""
    tops = [(7, k, (500, 3) if k == 600 else (1, 10_000 - k)) for k in range(1000)] + [(8, 5, (2, 1))]
    told = shingle_join.side_by_side(spark.createDataFrame(tops, "coordinate long, number long, top struct<size:long,comp:long>")).collect()
    assert len(told) <= 1000 // shingle_join.SIDE_BY_SIDE + 3
    met = [(r["coordinate"], r["side"] * shingle_join.SIDE_BY_SIDE + b, r["top"]) for r in told for b in range(64) if r["bits"] >> b & 1]
    assert sorted(m[:2] for m in met) == [t[:2] for t in tops]
    own = {t[:2]: t[2] for t in tops}
    assert all(tuple(top) >= own[c, k] for c, k, top in met) and [k for _, k, top in met if top["size"] == 500] == [600]
