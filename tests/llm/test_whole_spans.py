"""What goes is what a brute force over runs of every length finds."""

import collections
import random

from kinfold.llm import sentence_spans


def every(text):
    parts = [tuple(x.lower().split()) for x in text.split(". ")]
    parts = [tuple(w.rstrip(".") for w in p) for p in parts]
    for i in range(len(parts)):
        for j in range(i + 1, len(parts)):
            if sum(map(len, parts[i : j + 1])) >= 20:
                yield tuple(parts[i : j + 1]), i, j


def covered(rows, runs):
    seen, gone = {}, collections.defaultdict(set)
    for i, t in rows:
        for h, a, b, *_ in sorted(runs(t), key=lambda x: x[1]):
            if seen.setdefault(h, (i, a)) != (i, a):
                gone[i] |= set(range(a, b + 1))
    return {i: s for i, s in gone.items() if s}


def test_all_runs(spark):
    r = random.Random(6)
    sentence = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n)).capitalize() + "."
    pool = [sentence(r.choice((1, 3, 5, 8, 11, 25, 30, 34))) for _ in range(30)]
    rows = [(1, " ".join([sentence(9), a := sentence(30), b := sentence(25), sentence(20)])), (2, " ".join([sentence(9), a, b, sentence(20)]))]
    rows += [(3, " ".join([sentence(9), *(c := [sentence(9), sentence(12), sentence(3)]), sentence(20)])), (4, " ".join([sentence(9), *c, sentence(20)]))]
    for k in range(5, 45):
        at = r.randrange(25)
        rows.append((k, " ".join([sentence(r.choice((2, 7, 31))), *pool[at : at + r.randint(1, 6)], sentence(4), *r.sample(pool, 3)])))
    want = covered(rows, every)
    assert want == covered(rows, sentence_spans.runs) and want[2] == {1, 2} and want[4] == {1, 2, 3}
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x["doc_id"]: x["n_removed"] for x in sentence_spans.drop_repeated_spans(table).collect() if x["n_removed"]} == {i: len(s) for i, s in want.items()}
