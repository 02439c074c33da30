"""Periodic runs against brute force, and the query against the contract read literally."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from kinfold.llm import periodic_runs, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words):
    """(start, length, period): each period tried at each place, the smallest period of a stretch kept."""
    n, out = len(words), {}
    for q in range(1, n):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if length >= max(6, 4 * q) and not any(start >= a and start + length <= a + b for a, b in out):
                out[start, length] = q
    return sorted((a, b, q) for (a, b), q in out.items())


def test_runs_are_those_of_brute_force():
    rng = random.Random(11)
    for _ in range(6000):
        letters, n = rng.choice([1, 2, 2, 3, 5]), rng.randrange(45)
        words = [rng.randrange(letters) for _ in range(n)]
        for _ in range(rng.randrange(3)):
            if n > 4:
                a, p, end = rng.randrange(n - 2), rng.randrange(1, n // 3 + 1), rng.randrange(n)
                words[a:end] = [words[a + (i - a) % p] for i in range(a, end)]
        assert periodic_runs.runs(np.array(words, np.int64)) == brute(words), words


def test_edges_grow_with_the_text_only():
    """Each word is matched once: reads of the text stay in proportion on texts that repeat on every scale."""

    class Counted(list):
        reads = 0

        def __getitem__(self, i):
            Counted.reads += 1
            return super().__getitem__(i)

    a, b = [0], [0, 1]
    while len(b) < 20_000:
        a, b = b, b + a
    for words in ([0] * 20_000, b, [i % 1000 * 7 % 13 for i in range(20_000)], [bin(i).count("1") % 2 for i in range(20_000)]):
        Counted.reads = 0
        periodic_runs.lyndon_edges(Counted([*words, -1]), len(words), [0] * (len(words) + 1))
        assert Counted.reads < 14 * len(words)


def test_packed_arrays_give_the_same(monkeypatch):
    words = np.array([i % 7 for i in range(300)] + list(range(7, 90)) + [3] * 9)
    whole = periodic_runs.runs(words)
    monkeypatch.setattr(periodic_runs, "LONG", 100)
    assert periodic_runs.runs(words) == whole == [(0, 300, 7), (383, 9, 1)]


def contract(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    gone = {i for start, length, q in found for i in range(start + q, start + length)}
    start, length, period = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id, len(found), start, length, period, period and 1000 * length // period,
        sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


@pytest.fixture(scope="module")
def fixture(tmp_path_factory, spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("ab cd éf gh\x1c ij KL".split(" ")) for _ in range(rng.randrange(60)))) for i in range(300)]
    rows += [(i, rng.choice([" ", "\t\n", " "]).join(["x", "y"] * rng.randrange(9) + ["z"] * 7)) for i in range(300, 340)]
    rows += [(400, None), (401, ""), (402, " \n\x0b "), (403, "a " * 5), (404, "a " * 6), (405, "a b " * 4), (406, "a b " * 3 + "a"), (407, "a b c d " * 30), (407, "a b c d " * 30)]
    path = str(tmp_path_factory.mktemp("runs"))
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS `runs`", "2 AS `a.b`").write.parquet(f"{path}/documents.parquet")
    return path, rows


def test_query_is_the_contract(spark, fixture):
    path, rows = fixture
    got = queries.QUERIES["op11_periodic_runs"](spark, path)
    assert got.columns[:8] == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(tuple(r)[:8] for r in got.collect()) == sorted((contract(*r) for r in rows), key=lambda r: r[:2])
    assert sum(r[1] > 0 for r in (contract(*r) for r in rows)) > 40


def test_operator_keeps_texts_and_takes_odd_tables(spark):
    docs = spark.createDataFrame([("p", "so so so so so so far"), (None, "x"), ("p", None)], "id string, text string")
    got = {(r["id"], r["collapsed"], tuple(map(tuple, r["runs"]))) for r in periodic_runs.periodic_runs(docs, "id").collect()}
    assert got == {("p", "so far", ((0, 6, 1),)), (None, "x", ()), ("p", "", ())}
    assert periodic_runs.digest(periodic_runs.periodic_runs(docs.limit(0), "id")).count() == 0


def test_long_text(spark):
    text = "alpha beta gamma " * 400_000
    (got,) = periodic_runs.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert got["collapsed"] == "alpha beta gamma" and got["runs"][0][:] == (0, 1_200_000, 3)
