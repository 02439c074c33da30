"""Ratios counted by hand and the dual solved slowly, against what the quality model is fitted with."""

import numpy as np

from kinfold.llm import quality


def slow_dual(x, y, upper, steps=40_000):
    """Projected gradient on the whole dual of the hinge loss with an intercept as one more feature."""
    k = (x @ x.T + 1.0) * np.outer(y, y)
    a, rate = np.zeros(len(y)), 1.0 / np.linalg.eigvalsh(k).max()
    for _ in range(steps):
        a = np.clip(a - rate * (k @ a - 1.0), 0.0, upper)
    return a, 0.5 * a @ k @ a - a.sum()


def test_hinge_fit_solves_the_dual():
    rng = np.random.default_rng(4)
    for n, d in ((30, 12), (60, 25)):
        scale = rng.normal(size=d)
        rows = [np.sort(rng.choice(d, rng.integers(1, d), replace=False)) for _ in range(n)]
        y = np.where(rng.random(n) < 0.35, 1.0, -1.0)
        x = np.zeros((n, d))
        for i, r in enumerate(rows):
            x[i, r] = scale[r]
        upper = quality.COST * n / 2 / np.where(y > 0, (y > 0).sum(), (y < 0).sum())
        alpha, least = slow_dual(x, y, upper)
        w, bias = quality.hinge_fit(rows, y, scale, epochs=3_000)
        primal = 0.5 * (w @ w + bias**2) + (upper * np.maximum(0, 1 - y * (x @ w + bias))).sum()
        assert abs(primal + least) < 1e-2 * max(1.0, abs(least))  # no gap between both
        assert np.allclose(w, x.T @ (alpha * y), atol=2e-2) and abs(bias - (alpha * y).sum()) < 2e-2


def test_ratios_are_those_of_counts(spark, monkeypatch):
    texts = [("alpha beta gamma", 1), ("alpha beta delta", 1), ("noise noise junk!!", 0), ("junk 123 noise", 0), ("alpha junk", 0), ("beta gamma alpha", 1)]
    seen = {}
    own = quality.hinge_fit
    monkeypatch.setattr(quality, "hinge_fit", lambda rows, y, scale: seen.update(rows=rows, y=y, scale=scale) or own(rows, y, scale))
    quality.train(spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(texts)], "id long, text string, y int"))
    fit = [i for i in range(len(texts)) if i % 5] if len(seen["rows"]) < len(texts) else range(len(texts))
    sets = [set(quality.features([t.encode()])[0].tolist()) for t, _ in texts]
    size = len(seen["scale"])
    count = {label: {g: 1 + sum(g in sets[i] for i in fit if texts[i][1] == label) for g in set().union(*sets)} for label in (0, 1)}
    total = {label: size + sum(len(sets[i]) for i in fit if texts[i][1] == label) for label in (0, 1)}
    for g in set().union(*sets):
        assert np.isclose(seen["scale"][g], np.log((count[1][g] / total[1]) / (count[0][g] / total[0])))
