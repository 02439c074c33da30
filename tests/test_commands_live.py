"""Commands for live curation, audits by rules, and whole grids."""

import json

import pytest

from kinfold.__main__ import main
from kinfold.functions import images


@pytest.fixture
def said(spark, capsys):
    def run(*a):
        main([*map(str, a)], spark)
        return json.loads(capsys.readouterr().out)

    return run


def test_curate_judges_by_execution(said, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"kind": "merge", "primary": "rotate_180_v1", "secondary": "flip_vertical_v1"}, {"kind": "remove", "primary": "invert_v1"}, {"kind": "merge", "primary": "invert_v1", "secondary": "solarize_v1"}, {"kind": "end"}]))
    out = said("curate", "--actions", tmp_path / "a.json", "--probes", 1, "--size", 16)
    assert [(r["kind"], r["status"]) for r in out["log"]] == [("merge", "rejected"), ("remove", "applied"), ("merge", "invalid"), ("end", "noop")]
    assert (out["skills"], out["judged"], out["rounds"]) == (99, 1, 2)


def test_audit_by_rules(said, spark, tmp_path):
    spark.createDataFrame([("m", "g", 0.1, "uniform", 1, "single"), ("m", "g", 0.1, "uniform", 1, "single"), (" ", "g", 0.1, "uniform", 2, "single")], "method string, gate string, rho double, composition string, seed int, mode string").write.parquet(str(tmp_path / "points"))
    out = said("audit", tmp_path / "nothing", "--points", tmp_path / "points", "--out", tmp_path / "audit.json")
    assert out["present"] == 0 and out["rules"]["fail"] == 2 and out["rules"]["pending"] > 10
    told = {r["name"]: r for r in json.loads((tmp_path / "audit.json").read_text())["rules"]}
    assert told["a point is there once"]["n_bad"] == 2 and told["a point has its method, composition and mode"]["n_bad"] == 1


def test_whole_grid(said, spark, tmp_path, monkeypatch):
    few = {k: images.LIBRARY[k] for k in ("flip_horizontal_v1", "rotate_90_v1", "rotate_180_v1", "translate_v1")}
    monkeypatch.setattr(images, "LIBRARY", few)
    out = said("corrupt-grid", "--rhos", "0.5,1.0", "--seeds", "0", "--probes", 1, "--size", 12, "--out", tmp_path / "grid")
    assert out["instances"] == 12 and out["runs"] < out["asked"] and out["passed"] == out["defects"]
    assert spark.read.option("basePath", str(tmp_path / "grid")).text(str(tmp_path / "grid")).select("instance").distinct().count() == 12
