"""Functions on many grey images at once give what they give image by image, to the last bit."""

import numpy as np
import pytest

from kinfold.functions import images, stacks
from kinfold.operators import execute


def planes(h, w):
    g = np.random.default_rng(7)
    odd = [np.full((h, w), v) for v in (0, 1, 127, 128, 200, 255)] + [(g.random((h, w)) < q) * 255 for q in (0.03, 0.3, 0.5, 0.9, 0.97)] + [g.integers(0, 3, (h, w)) * 120 for _ in range(3)]
    return [p.astype(np.uint8) for p in (*odd, np.arange(h * w).reshape(h, w) % 256, *(g.integers(0, 256, (h, w)) for _ in range(8)))]


def test_every_function_runs_on_stacks():
    assert set(stacks.MANY) == set(images.LIBRARY)


@pytest.mark.parametrize("shape", [(8, 8), (5, 9), (13, 6), (1, 1), (1, 4), (24, 24)])
def test_stacks_agree_with_single_images(shape):
    given = planes(*shape)
    for skill in images.LIBRARY.values():
        for n in (len(given), 1, 3):
            try:
                want = [skill.run(p, None, 3) for p in given[:n]]
            except Exception:  # noqa: BLE001  told image by image
                continue
            got = stacks.MANY[skill.id](np.stack(given[:n], axis=-1), **skill.bind(None) | ({"seed": 3} if skill.stochastic else {}))
            for x, y in zip(want, [None] * n if got is None else np.moveaxis(got, -1, 0), strict=True):
                assert y is None or (x.dtype == y.dtype and np.array_equal(x, y)), (skill.id, shape, n)


def test_other_parameters():
    given = planes(8, 8)
    for id, p in (("pad_constant_v1", {"value": 9}), ("pad_to_square_v1", {"value": 9}), ("resize_fixed_v1", {"width": 11, "height": 3}), ("equalize_clahe_v1", {"grid": 3}), ("palette_reduce_kmeans_v1", {"k": 3}), ("halftone_dots_v1", {"cell": 3}), ("edges_canny_v1", {"low": 300, "high": 20}), ("mask_to_rgba_v1", {"thresh": 7})):
        got = stacks.MANY[id](np.stack(given, axis=-1), **images.LIBRARY[id].bind(p))
        if got is not None:
            assert all(np.array_equal(images.LIBRARY[id].run(x, p), y) for x, y in zip(given, np.moveaxis(got, -1, 0), strict=True)), id


@pytest.mark.parametrize("kind", ["uint8", "uint16", "float32", "bool"])
@pytest.mark.parametrize("shape", [(4, 3), (4, 3, 1), (4, 3, 3), (4, 3, 4)])
def test_hashes_of_many(kind, shape):
    g = np.random.default_rng(1)
    top = {"uint8": 255, "uint16": 65535}.get(kind, 1)
    many = np.stack([g.random(shape) * top, (g.random(shape) < 0.5) * top, np.zeros(shape), np.full(shape, top)]).astype(kind)
    rows, masks = execute.contents(many)
    assert execute.content_hashes(rows, masks, *shape[:2]) == [execute.content_hash(x) for x in many] and masks.tolist() == [execute.is_mask(x) for x in many]


def test_rows_of_a_mixed_battery(spark):
    g = np.random.default_rng(2)
    given = planes(8, 8)[:6] + planes(5, 4)[:3] + [g.integers(0, 256, (6, 6, 3)).astype(np.uint8), (g.random((7, 5)) * 60000).astype(np.uint16)]
    rows = spark.createDataFrame([(i, execute.pack(a)) for i, a in enumerate(given)], f"probe_id long, image {execute.IMAGE}").coalesce(1)
    asked = [(s, None, 0) for s in ("mask_to_rgba_v1", "blur_gaussian_v1", "random_crop_v1", "nothing_v1")] + [("posterize_v1", {"bits": 99}, 0)]
    got = {(r["skill_id"], r["probe_id"]): r.asDict(True) for r in execute.run_bindings(rows, asked, twice=True).collect()}
    want = [execute._one(images.LIBRARY, a, str(i), (s, execute.params_key(p), n), s, p, n, True) for i, a in enumerate(given) for s, p, n in asked]
    assert len(got) == len(want) and all(got[r["skill_id"], r["probe_id"]] == r for r in want)


def test_own_functions_under_known_names_and_unstable_ones(spark):
    rows = spark.createDataFrame([(str(i), execute.pack(a)) for i, a in enumerate(planes(8, 8))], f"probe_id string, image {execute.IMAGE}")
    wrong = execute.buggy(images.LIBRARY["invert_v1"], "roll_h")
    changed = execute.run_bindings(rows, [("invert_v1", None, 0)], {"invert_v1": wrong}, outputs=False)
    plain = execute.run_bindings(rows, [("invert_v1", None, 0)], outputs=False)
    assert changed.columns == plain.columns and "image" not in plain.columns and changed.select("sha").exceptAll(plain.select("sha")).count() > 0
    schema = execute.pa.schema(execute._RESULT)
    calls = iter(range(9))
    stacks.MANY["unstable_v1"] = lambda a: a + np.uint8(next(calls)) * (np.arange(a.shape[2]) == 1).astype(np.uint8)
    try:
        part = execute._together(images.Skill("unstable_v1", "x", None), np.zeros((2, 2, 3), np.uint8), ["a", "b", "c"], ("unstable_v1", "{}", 0), None, True, schema)
    finally:
        del stacks.MANY["unstable_v1"]
    assert part.column("status").to_pylist() == ["ok", "nondeterministic", "ok"]
