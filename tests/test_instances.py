"""All instances of a grid at once against instances one by one."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinfold.functions import images
from kinfold.operators import corrupt, execute, instances, planning

IDS = ("flip_horizontal_v1", "rotate_90_v1", "brightness_add_v1", "posterize_v1", "blur_box_v1", "translate_v1")


@pytest.fixture(scope="module")
def battery(spark):
    rng = np.random.default_rng(9)
    given = [rng.integers(0, 256, s, np.uint8) for s in ((9, 9), (9, 9, 3), (9, 9, 4), (8, 10))]
    rows = [(str(i), execute.pack(given[i % 4])) for i in range(7)]  # three probes occur twice
    return spark.createDataFrame(rows, f"probe_id string, image {execute.IMAGE}")


@pytest.fixture(scope="module")
def made(spark, battery):
    library = {k: images.LIBRARY[k] for k in IDS}
    frame = pd.DataFrame([(k, len(x.params), sum(p.type in ("int", "float") for p in x.params)) for k, x in library.items()], columns=["id", "n_params", "numeric_params"])
    plans = planning.corruption_grid(spark, frame, [0.5, 1.0], list(planning.COMPOSITIONS), [1, 2])
    return library, frame, *instances.generate(plans, battery, library)


def test_each_instance_is_checked_as_by_itself(spark, battery, made):
    library, frame, done, how = made
    assert how["probes"] == 4 and how["runs"] == 4 * how["functions"] < how["asked"] / 5
    for mode, composition, rho, seed in (("mixed", "uniform", 1.0, 2), ("single", sorted(planning.COMPOSITIONS)[0], 0.5, 1)):
        plan = planning.plan_instance(frame, rho, composition, seed, mode)
        alone = corrupt.checked(battery, library, plan, corrupt.apply_plan(library, plan, seed), seed)
        here = done.where((F.col("mode") == mode) & (F.col("composition") == composition) & (F.col("rho") == rho) & (F.col("seed") == seed))
        key = ["type", "site_id", "new_id", "n_probes", "n_same", "n_near", "ok"]
        assert sorted(map(tuple, here.select(key).collect())) == sorted(map(tuple, alone.select(key).collect()))


def test_contents_are_shared_and_rebuilt(made):
    library, _, done, _ = made
    rows = done.select("clean", "made", "site_id", "type").collect()
    assert len({r["made"] for r in rows}) < len(rows) / 3
    image = np.arange(81, dtype=np.uint8).reshape(9, 9)
    for r in {r["made"]: r for r in rows}.values():
        skill, params = instances.build(r["made"], library)
        assert instances.content_key(r["made"]) == instances.content_key(json.dumps(json.loads(r["made"]), sort_keys=True))
        assert skill.run(image, params).dtype == np.uint8
    with pytest.raises(ValueError, match="unknown step"):
        instances.build(instances.content(IDS[0], [("no", 1)]), library)


def test_a_function_runs_once_a_probe(spark, battery):
    calls = spark.sparkContext.accumulator(0)
    base = images.LIBRARY["flip_horizontal_v1"]

    def counted(a, **p):
        calls.add(1)
        return base.fn(a, **p)

    library = {"f": images.Skill("f", "geometric", counted)}
    plain, bugs = instances.content("f"), [instances.content("f", [("bug", {"mutator": m, "domain": ""})]) for m in ("roll_h", "roll_w", "invert_values")]
    seen = instances.executed(battery, [(plain, b, "") for b in [plain, *bugs, plain]], library)
    assert seen.count() == 20 and calls.value == 4 * 4


def test_artifacts(spark, made, tmp_path):
    library, _, done, _ = made
    told = {r["name"]: r for r in instances.manifests(done, len(library)).collect()}
    assert len(told) == 2 * 2 * 2 * len(planning.COMPOSITIONS) and all(r["n_skills"] == 6 + r["n_added"] for r in told.values())
    # A function that fails on a picture with alpha has no output there, clean or not, and so no equal one.
    assert sum(r["n_passed"] for r in told.values()) == done.where("ok").count() > 0.9 * done.count()
    instances.write_artifacts(done, library, str(tmp_path / "grid"))
    back = spark.read.option("basePath", str(tmp_path / "grid")).text(str(tmp_path / "grid"), wholetext=True)
    files = {(r["instance"], r["file"]): json.loads(r["value"]) for r in back.collect()}
    one = next(n for n, r in told.items() if r["n_added"] and r["mode"] == "mixed")
    assert {f for i, f in files if i == one} >= {"corruption_log.json", "library.json", "ideal_actions.json", "qa_report.json", "manifest.json"}
    assert len(files[one, "library.json"]) == told[one]["n_skills"] and len(files[one, "qa_report.json"]) == told[one]["n_defects"]
    assert files[one, "manifest.json"]["realized"] == told[one]["realized"]
