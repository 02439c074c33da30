"""Items whose parts are swapped, cut or interspersed, against all item-sized windows."""

import random
from collections import Counter

from kinfold.llm import decontaminate


def shingles(words):
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def similarity(a, b):
    shared = sum((a & b).values())
    return shared / (a.total() + b.total() - shared)


def best(text, item):
    words, n = text.split(), len(item.split())
    own = shingles(item.split())
    return max(similarity(shingles(words[i : i + n]), own) for i in range(max(1, len(words) - n + 1)))


def test_all_windows_are_found_by_brute_force(spark):
    rng = random.Random(8)
    fresh = lambda n: [f"{rng.choice('bdfgklmnprst')}{rng.choice('aeiou')}{rng.randrange(10**6)}" for _ in range(n)]
    items = [(i, fresh(n)) for i, n in enumerate((100, 100, 80, 60, 40, 25, 14))]
    texts = []
    for _, w in items:
        h, n = len(w) // 2, len(w)
        for k in range(6):
            cuts = [w[h:] + w[:h], w[: n // 3] + w[2 * n // 3 :] + w[n // 3 : 2 * n // 3], w[: n - n // 9], w[n // 9 :], w[:h] + fresh(max(1, n // 25)) + w[h:], [x for x in w if rng.random() > 0.015]]
            texts.append(fresh(rng.randrange(0, 40)) + cuts[k] + fresh(rng.randrange(0, 40)))
            texts.append(cuts[k])
    for _ in range(30):
        _, w = rng.choice(items)
        parts = [w[i : i + len(w) // rng.choice([2, 3, 4]) + 1] for i in sorted(rng.sample(range(len(w)), 3))]
        rng.shuffle(parts)
        texts.append(fresh(20) + [x for p in parts for x in p] + fresh(20))
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    bench = [(i, " ".join(w)) for i, w in items]
    want = {(d, i) for d, t in rows for i, b in bench if best(t, b) >= 0.8}
    got = decontaminate.report(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    found = {(r["doc_id"], i) for r in got for i in r["item_ids"]}
    assert found == want and len(want) > 45
    swapped = [d for d, t in enumerate(texts) if t == items[0][1][50:] + items[0][1][:50]]
    assert all((d, 0) in found for d in swapped) and all(abs(r["best"] - max(best(rows[r["doc_id"]][1], b) for _, b in bench)) < 1e-9 for r in got if r["contaminated"])
