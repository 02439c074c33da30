"""The benchmark run, alignment, replayed defects and the command line."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.__main__ import main
from kinfold.functions import images
from kinfold.operators import corrupt, execute, planning
from kinfold.operators.alignment import Alignment, Axis, Member, load_alignment
from kinfold.operators.compare import Thresholds
from kinfold.plans import benchmark

YAML = """
axes:
  - {name: size, values: [3, 9], members: {blur_box_v1: {param: ksize}, blur_median_v1: {param: ksize}, zoom_in_center_v1: {bindings: {"3": {factor: 1.5}}}}}
subsumption_grids:
  rotate_canvas_degrees_v1: [{degrees: 0.0}, {degrees: 90.0}, {degrees: 30.0}]
"""


@pytest.fixture(scope="module")
def battery(spark):
    r = np.random.default_rng(12)
    rows = [(f"n{k}", execute.pack(r.integers(10, 240, (20, 20, 3)).astype(np.uint8))) for k in range(3)]
    return spark.createDataFrame(rows, f"probe_id string, image {execute.IMAGE}").repartition(2)


def test_alignment(spark, tmp_path):
    (tmp_path / "a.yaml").write_text(YAML)
    x = load_alignment(str(tmp_path / "a.yaml"))
    assert x.sweep("blur_box_v1", "blur_median_v1") == [({"ksize": 3}, {"ksize": 3}), ({"ksize": 9}, {"ksize": 9})] and x.sweep("invert_v1", "blur_box_v1") == [({}, {})]
    assert [v for v, *_ in x.axes[0].matched("blur_box_v1", "zoom_in_center_v1")] == [3] and x.grid_for("zoom_in_center_v1") == [{"factor": 1.5}]
    assert len(x.subsumption_grid(images.LIBRARY["rotate_canvas_degrees_v1"])) == 3 and x.subsumption_grid(images.LIBRARY["invert_v1"]) == [{}] and len(x.subsumption_grid(images.LIBRARY["blur_box_v1"])) > 2
    assert planning.matched_sweep(x.table(spark), "blur_box_v1", "blur_median_v1").count() == 2
    for bad in (lambda: Member(), lambda: Member("k", bindings={}), lambda: Axis("e", (), {"s": Member("k")})):
        with pytest.raises(ValueError):
            bad()


def test_benchmark(spark, battery, tmp_path):
    known = {k: images.LIBRARY[k] for k in ("flip_horizontal_v1", "flip_vertical_v1", "invert_v1", "rotate_90_v1", "rotate_canvas_degrees_v1", "brightness_add_v1")}
    known["twin_v1"] = execute.duplicate(known["invert_v1"], "twin_v1")
    known["near_v1"] = execute.duplicate(known["flip_vertical_v1"], "near_v1", perceptual=True)
    truth = benchmark.designed(spark, [("invert_v1", "twin_v1", "EXACT", None, None, False), ("flip_vertical_v1", "near_v1", "PERCEPTUAL", None, None, False), ("rotate_90_v1", "rotate_canvas_degrees_v1", "SUBSUMPTION", "rotate_90_v1", "rotate_canvas_degrees_v1", False), ("flip_horizontal_v1", "invert_v1", "COMPLEMENTARY", None, None, True)])
    alignment = Alignment(grids={"rotate_canvas_degrees_v1": ({"degrees": 0.0}, {"degrees": 90.0}, {"degrees": 30.0})})
    asked = spark.createDataFrame([("twin_v1", "flip_vertical_v1")], "a string, b string")
    result = benchmark.run_benchmark(battery, known, truth, asked, Thresholds(semantic=1e-9), alignment, ("output", "name_match", "tfidf", "nothing"))
    got = {(r["a"], r["b"]): (r["relation"], r["direction"]) for r in result.track("output").collect()}
    assert got["invert_v1", "twin_v1"] == ("EXACT", "NONE") and got["flip_vertical_v1", "near_v1"] == ("PERCEPTUAL", "NONE") and got["rotate_90_v1", "rotate_canvas_degrees_v1"] == ("SUBSUMPTION", "B_SUBSUMES_A")
    assert got["flip_horizontal_v1", "invert_v1"][0] == "COMPLEMENTARY" and len(got) == 5 and "unknown track" in result.failed["nothing"]
    summary = {r["track"]: r for r in benchmark.track_summaries(result, ("output", "name_match", "nothing")).collect()}
    assert summary["output"]["f1"] == 1 and summary["nothing"]["f1"] is None
    names = benchmark.write_report(result, str(tmp_path / "r"))
    assert {"tracks.csv", "per_pair.csv", "relations.csv", "report.md", "summary.json"} <= set(names)
    assert benchmark.binding_that_absorbs(battery, "rotate_90_v1", "rotate_canvas_degrees_v1", known, alignment) == {"degrees": 90.0}
    assert benchmark.binding_that_absorbs(battery, "invert_v1", "rotate_canvas_degrees_v1", known, alignment) is None
    fit = benchmark.calibrate_from_result(result, known, sorted({s.family for s in known.values()}), Thresholds(), "2026-01-01")
    assert fit.calibrated and len(fit.split_hash) == 64
    point = benchmark.study_point("m", spark.createDataFrame([(True,), (False,)], "success boolean"), 0.1, "uniform", 3).first()
    assert point["downstream_success"] == 0.5 and point["action_f1"] is None


def test_defects(spark, battery):
    import pandas as pd

    some = {k: images.LIBRARY[k] for k in ("invert_v1", "blur_box_v1", "posterize_v1", "rotate_90_v1", "solarize_v1", "gamma_correct_v1", "flip_vertical_v1", "transpose_v1", "sepia_tone_v1", "mosaic_pixelate_v1")}
    library = pd.DataFrame([{"id": s.id, "n_params": len(s.params), "numeric_params": len(s.params)} for s in some.values()])
    plan = planning.plan_instance(library, 1.0, "uniform", 3, "single")
    made = corrupt.apply_plan(some, plan, 3)
    assert set(some) <= set(made.skills) and len(made.ideal) == len(plan) and set(made.added) == {x for x in plan["new_id"] if x}
    report = corrupt.checked(battery, some, plan, made, 3)
    assert [r for r in report.collect() if not r["ok"]] == [] and report.count() == len(plan)
    # A defect that does nothing is told.
    broken = corrupt.Corrupted({**made.skills, **some}, [], [], ())
    assert not report.sparkSession.createDataFrame([], report.schema).count() and corrupt.checked(battery, some, plan, broken, 3).where("type = 'implementation_bug' and ok").isEmpty()
    for p in images.LIBRARY["blur_bilateral_v1"].params:
        assert corrupt.alternative(p, 1) != p.default and p.coerce(corrupt.alternative(p, 1)) is not None


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "g.yaml").write_text("exact:\n- [flip_vertical_v1, rotate_180_v1]\nhard_negatives:\n- [invert_v1, solarize_v1]\n")
    (tmp_path / "acts.json").write_text(json.dumps([{"kind": "merge", "primary": "flip_vertical_v1", "secondary": "rotate_180_v1"}]))
    said = lambda *a: (main([*map(str, a)], spark), json.loads(capsys.readouterr().out))[1]
    assert said("config")["quantile"] == 0.9 and said("skills", "--out", tmp_path / "s.json")["skills"] == 100
    assert said("build-queries", "--out", tmp_path / "q")["queries"] == 10 and said("run-downstream", "--solver", "expected")["all"] == 1.0
    assert "report.md" in said("run-benchmark", "--probes", 1, "--size", 16, "--truth", tmp_path / "g.yaml", "--out", tmp_path / "b")["files"]
    assert said("curate", "--actions", tmp_path / "acts.json", "--truth", tmp_path / "g.yaml")["skills"] == 99
    assert said("audit", tmp_path / "s.json", tmp_path / "none", "--out", tmp_path / "audit.json") == {"present": 1, "asked": 2}
