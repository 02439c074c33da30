"""Episodes judged from executed outputs as their actions come up."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.functions import images
from kinfold.operators import compare, execute
from kinfold.operators.alignment import Alignment
from kinfold.plans import curation, live

ACTS = "episode string, step long, kind string, primary string, secondary string, description string"
SKILLS = {s: {"trusted": s != "own"} for s in ("identity", "invert", "posterize_4", "posterize_7", "posterize", "brightness_add", "own")}


@pytest.fixture(scope="module")
def battery(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=64).tolist()) for i in range(30)]
    return compare.probes(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).cache()


def acts(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (6 - len(r))) for r in rows], ACTS)


def log(done, episode):
    return [(r["kind"], r["status"], r["relation"], r["binding"], r["size_before"], r["size_after"]) for r in sorted(done.log.where(F.col("episode") == episode).collect(), key=lambda r: r["step"])]


def test_verdicts_are_asked_for_when_they_are_needed(spark, battery):
    asked = []
    judge = live.probe_judge(battery)

    def watched(pairs):
        asked.append(list(pairs))
        return judge(pairs)

    rows = [("x", 1, "merge", "posterize_7", "identity"), ("x", 2, "parameterize", "posterize_4", "posterize"), ("x", 3, "merge", "posterize_7", "invert"), ("x", 4, "end")]
    rows += [("y", 1, "parameterize", "posterize_4", "posterize"), ("y", 2, "parameterize", "posterize_4", "posterize"), ("y", 3, "merge", "own", "identity"), ("y", 4, "merge", "identity", "identity")]
    rows += [("z", 1, "parameterize", "posterize", "posterize_4"), ("z", 2, "remove", "invert"), ("z", 3, "parameterize", "invert", "posterize"), ("z", 4, "modify", "identity", None, "new"), ("z", 5, "modify", "identity")]
    done = live.run_rounds(acts(spark, rows), SKILLS, watched)
    assert log(done, "x") == [("merge", "applied", "EXACT", None, 7, 6), ("parameterize", "applied", "SUBSUMPTION", "bits=4", 6, 5), ("merge", "invalid", None, None, 5, 5), ("end", "noop", None, None, 5, 5)]
    assert log(done, "y") == [("parameterize", "applied", "SUBSUMPTION", "bits=4", 7, 6), ("parameterize", "invalid", None, None, 6, 6), ("merge", "blocked", None, None, 6, 6), ("merge", "invalid", None, None, 6, 6)]
    assert log(done, "z") == [("parameterize", "rejected", "SUBSUMPTION", None, 7, 7), ("remove", "applied", None, None, 7, 6), ("parameterize", "invalid", None, None, 6, 6), ("modify", "applied", None, None, 6, 6), ("modify", "noop", None, None, 6, 6)]
    # The pair that three episodes ask for is judged once; invert is gone before its pairs come up, so they never are.
    assert asked == [[("identity", "posterize_7"), ("posterize", "posterize_4")]] and done.rounds == 2
    assert {(r["a"], r["b"], r["relation"], r["direction"], r["binding_a"]) for r in done.verdicts.collect()} == {("identity", "posterize_7", "EXACT", "NONE", None), ("posterize", "posterize_4", "SUBSUMPTION", "A_SUBSUMES_B", "bits=4")}


def test_rounds_give_what_single_episodes_give(spark, battery):
    """Many episodes at once against the library object fed with all verdicts beforehand."""
    rng = np.random.default_rng(8)
    names = [*SKILLS, "nowhere"]
    kinds = ["merge", "parameterize", "parameterize", "modify", "remove", "keep"]
    rows = [(f"e{e}", s, str(rng.choice(kinds)), str(rng.choice(names)), str(rng.choice(names)), "d" if rng.random() < 0.5 else None) for e in range(400) for s in range(int(rng.integers(1, 30)))]
    done = live.run_rounds(acts(spark, rows), SKILLS, live.probe_judge(battery), budget=9)
    known = sorted(s for s in SKILLS if s != "own")
    every = live.probe_judge(battery)([(a, b) for i, a in enumerate(known) for b in known[i + 1 :]]).collect()
    verdicts = {(r["a"], r["b"]): (r["relation"], r["direction"]) for r in every}
    want = set()
    for e in {r[0] for r in rows}:
        library = curation.Library({k: dict(v) for k, v in SKILLS.items()}, verdicts, budget=9)
        script = [dict(zip(("kind", "primary", "secondary", "description"), r[2:], strict=True)) for r in rows if r[0] == e]
        for n, h in enumerate(curation.run_episode(library, curation.scripted(script), len(script))):
            want.add((e, n, h["kind"], h["status"], h["primary"], h["size_before"], h["size_after"]))
    assert {(r["episode"], r["step"], r["kind"], r["status"], r["primary"], r["size_before"], r["size_after"]) for r in done.log.collect()} == want
    assert done.rounds <= 10 and done.verdicts.count() <= len(every)


def test_long_episode_keeps_a_budget_of_actions(spark):
    rows = spark.range(50_000).select(F.concat(F.lit("hot"), F.col("id") % 2).alias("episode"), F.col("id").alias("step"), F.lit("keep").alias("kind"), F.lit("a").alias("primary"), F.lit("b").alias("secondary"))
    state = live.begun(rows, 7)
    assert [r["todo"].count('"kind"') for r in state.collect()] == [7, 7]
    assert "WindowGroupLimit" in state._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["step"] for r in live.run_rounds(rows, {"a": {}, "b": {}}, None, 7).log.collect()) == list(range(14))


def test_judge_of_image_functions_finds_the_binding(spark):
    rng = np.random.default_rng(2)
    image = [(str(i), execute.pack(rng.integers(0, 256, (12, 12, 3), np.uint8))) for i in range(3)]
    battery = spark.createDataFrame(image, f"probe_id string, image {execute.IMAGE}")
    known = {s: images.LIBRARY[s] for s in ("blur_box_v1", "flip_horizontal_v1")}
    binding = Alignment().subsumption_grid(known["blur_box_v1"])[-1]
    known["narrow"] = execute.fixed(known["blur_box_v1"], "narrow", binding)
    known["same"] = execute.duplicate(known["flip_horizontal_v1"], "same")
    rows = [("e", 1, "merge", "flip_horizontal_v1", "same"), ("e", 2, "parameterize", "narrow", "blur_box_v1"), ("e", 3, "merge", "blur_box_v1", "same")]
    done = live.run_rounds(acts(spark, rows), {s: {"trusted": True} for s in known}, live.skill_judge(battery, known, alignment=Alignment()))
    got = log(done, "e")
    assert [r[:2] for r in got] == [("merge", "applied"), ("parameterize", "applied"), ("merge", "rejected")]
    assert [r[2] for r in got[:2]] == ["EXACT", "SUBSUMPTION"] and json.loads(got[1][3]) == binding


def test_a_judge_that_is_silent_is_an_error(spark, battery):
    with pytest.raises(ValueError, match="no verdict"):
        live.run_rounds(acts(spark, [("e", 1, "merge", "invert", "identity")]), SKILLS, lambda pairs: spark.createDataFrame([], live.VERDICT))
