"""Grids of instances on many grey probes: counts as image by image, and no row a probe and check."""

import itertools
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from kinfold.functions import images
from kinfold.operators import execute, instances, planning


def probes(h, w):
    g = np.random.default_rng(3)
    flat = [np.full((h, w), v, np.uint8) for v in (0, 1, 254, 255)]
    return [*flat, ((np.indices((h, w)).sum(axis=0) % 2) * 255).astype(np.uint8), *(g.integers(0, 256, (h, w)).astype(np.uint8) for _ in range(20))]


def checks_of(library):
    numeric = lambda x: sum(p.type in ("int", "float") for p in x.params)
    frame = pd.DataFrame([(k, len(x.params), numeric(x)) for k, x in library.items()], columns=["id", "n_params", "numeric_params"])
    rows = [instances.resolved((m, c, 1.0, s), planning.plan_instance(frame, 1.0, c, s, m), library) for m, c, s in itertools.product(("single", "mixed"), planning.COMPOSITIONS, range(3))]
    return sorted({tuple(r) for t in rows for r in t[["clean", "made", "domain"]].to_numpy().tolist()})


def test_counts_are_those_of_single_probes(spark):
    ids = ("flip_vertical_v1", "translate_v1", "random_crop_v1", "pad_constant_v1", "resize_bicubic_v1", "crop_center_percentage_v1", "mask_to_rgba_v1", "posterize_v1", "sepia_tone_v1", "resize_fixed_v1")
    library = {k: images.LIBRARY[k] for k in ids}
    given = [*probes(8, 8), *probes(1, 5)]
    battery = spark.createDataFrame([(execute.pack(a),) for a in given], f"image {execute.IMAGE}").coalesce(1)
    checks = checks_of(library)
    bugs = [("bug", {"mutator": m, "domain": ""}) for m in execute.MUTATORS]
    checks += [(instances.content(s), instances.content(s, [b]), "grayscale") for s in ("crop_center_percentage_v1", "mask_to_rgba_v1") for b in bugs]
    checks += [(instances.content("posterize_v1"), instances.content("posterize_v1", [("jitter", ""), ("after", "sepia_tone_v1")]), ""), (instances.content("posterize_v1"), instances.content("posterize_v1", params={"bits": 99}), "")]
    checks = [c for c in checks if "4096" not in str(c) and "2048" not in str(c)]  # large for a test
    rows = instances.executed(battery, checks, library).collect()
    built = {k: instances.build(k, library) for c in checks for k in c[:2]}
    want, got = Counter(), Counter()
    for a in {execute.content_hash(a): a for a in given}.values():
        n = sum(x.shape == a.shape and np.array_equal(x, a) for x in given)
        for c in checks:
            outs = [instances._alone(k, a, built) for k in c[:2]]
            want[(*c, *instances._compared(*outs), execute.matches_domain(a, c[2]))] += n
    for r in rows:
        got[(r["clean"], r["made"], r["domain"], r["same"], r["near"], r["inside"])] += r["n"]
    assert got == want


def test_no_row_a_probe_and_check(spark):
    g = np.random.default_rng(4)
    battery = spark.createDataFrame([(execute.pack(g.integers(0, 256, (8, 8)).astype(np.uint8)),) for _ in range(640)], f"image {execute.IMAGE}")
    clean, made = instances.content("flip_vertical_v1"), instances.content("flip_vertical_v1", [("jitter", "")])
    rows = instances.executed(battery, [(clean, clean, ""), (clean, made, "")], {"flip_vertical_v1": images.LIBRARY["flip_vertical_v1"]}).collect()
    assert sum(r["n"] for r in rows) == 2 * 640 and len(rows) < 640 / 2


@pytest.mark.parametrize("shape", [(4, 3), (1, 1), (2, 5), (4, 3, 1), (4, 3, 3), (4, 3, 4)])
def test_changes_of_many(shape):
    g = np.random.default_rng(5)
    many = np.stack([np.full(shape, v) for v in (0, 255)] + [g.integers(0, 256, shape) for _ in range(4)] + [(g.random(shape) < 0.5) * 255], axis=-1).astype(np.uint8)
    before = many.copy()
    for f, one in [(execute.jitter_many, execute.jitter), *((lambda a, m=m: execute.mutate_many(m, a), lambda a, m=m: execute.mutate(m, a)) for m in execute.MUTATORS)]:
        out = f(many)
        assert out.dtype == np.uint8 and all(np.array_equal(out[..., i], one(np.ascontiguousarray(many[..., i]))) for i in range(many.shape[-1]))
        assert np.array_equal(many, before)
