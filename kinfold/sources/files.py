"""Files in and out: study points, reviews, manifests, registries, configuration; CSV, JSON and Markdown reports."""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import asdict, fields, replace
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.images import Param, Skill
from ..operators.compare import Thresholds

REQUIRED = ("rho", "downstream_success", "compression", "action_cost", "intrinsic_score")
POINT = "method string, gate string, rho string, composition string, seed string, mode string, downstream_success string, compression string, action_cost string, intrinsic_score string, action_f1 string, metadata string"


def load_thresholds(path: str | None = None) -> Thresholds:
    """The ``thresholds`` of a YAML file over the defaults; unknown keys are errors."""
    if path is None:
        return Thresholds()
    data = yaml.safe_load(Path(path).read_text()) or {}
    if not isinstance(data, dict):
        raise TypeError("the configuration is no mapping")
    given = data.get("thresholds", {})
    if extra := set(given) - {f.name for f in fields(Thresholds)}:
        raise ValueError(f"unknown thresholds {sorted(extra)}")
    return Thresholds(**given)


def study_points(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, or JSON: a list or an object with ``points``. Blank is 0 where a number is required and null where it may be absent; a point without method or composition is an error when it is read."""
    if path.endswith(".csv"):
        raw = spark.read.option("header", True).csv(path)
    else:
        raw = spark.read.option("multiLine", True).json(path)
        if "points" in raw.columns:
            raw = raw.select(F.explode("points").alias("p")).select("p.*")
    for c in POINT.split(", "):
        name = c.split()[0]
        if name not in raw.columns:
            raw = raw.withColumn(name, F.lit(None).cast("string"))
    text = lambda c: F.col(c).cast("string")
    out = raw.select("method", F.coalesce("gate", F.lit("")).alias("gate"), "composition", S.required_double(text("seed")).cast("int").alias("seed"), F.coalesce("mode", F.lit("single")).alias("mode"), *(S.required_double(text(c)).alias(c) for c in REQUIRED), S.optional_double(text("action_f1")).alias("action_f1"), F.col("metadata"))
    named = lambda c: F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.raise_error(F.lit(f"a study point has no {c}"))).otherwise(F.col(c)).alias(c)
    return out.select(*(named(c) if c in ("method", "composition") else F.col(c) for c in out.columns))


def review_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """annotator (the file), a, b, label from JSON lists of labelled pairs."""
    return spark.read.option("multiLine", True).schema("a string, b string, label string").json(paths).withColumn("annotator", F.input_file_name())


def relation_graph(spark: SparkSession, path: str) -> DataFrame:
    """a, b, relation, spec, gen, hard from a YAML mapping of relation names to pairs."""
    data = yaml.safe_load(Path(path).read_text())
    rows = []
    for name, pairs in data.items():
        for p in pairs if isinstance(pairs, list) else []:
            x, y = (p["spec"], p["gen"]) if isinstance(p, dict) else (p[0], p[1])
            sub = name == "subsumption"
            relation = "DISTINCT" if name == "hard_negatives" else name.upper()
            rows.append((min(x, y), max(x, y), relation, x if sub else None, y if sub else None, name == "hard_negatives"))
    return spark.createDataFrame(rows, "a string, b string, relation string, spec string, gen string, hard boolean")


def save_registry(skills: list[Skill], path: str) -> None:
    """Everything of a function but its code."""
    rows = [{"id": s.id, "family": s.family, "name": s.name, "description": s.description, "stochastic": s.stochastic, "trusted": s.trusted, "params": [asdict(p) for p in s.params]} for s in skills]
    write_json(path, {"schema_version": "1", "skills": rows})


def load_registry(path: str, resolver: dict[str, Skill]) -> list[Skill]:
    """Functions by id, with their code from ``resolver`` and everything else as it was saved; ids must be unique and the version 1."""
    data = json.loads(Path(path).read_text())
    if data.get("schema_version") != "1":
        raise ValueError("schema_version must be '1'")
    ids = [r["id"] for r in data["skills"]]
    if len(ids) != len(set(ids)):
        raise ValueError("ids repeat")
    out = []
    for r in data["skills"]:
        params = tuple(Param(**{**p, "choices": tuple(p.get("choices") or ())}) for p in r.get("params", []))
        if len({p.name for p in params}) != len(params):
            raise ValueError(f"{r['id']}: parameter names repeat")
        out.append(replace(resolver[r["id"]], **{k: r[k] for k in ("family", "name", "description", "stochastic", "trusted") if k in r}, params=params))
    return out


def write_json(path: str, data: Any) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(data, indent=2, sort_keys=True) + "\n")


def write_csv(df: DataFrame, path: str, places: int = 4) -> None:
    """One file with a header; doubles to ``places``, nulls blank."""
    rounded = [F.format_string(f"%.{places}f", c).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes]
    df.select(*rounded).coalesce(1).write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def per_pair(verdicts: DataFrame) -> DataFrame:
    """verdicts: a, b, track, mergeable, score. One row per pair with the columns of each track."""
    return verdicts.groupBy("a", "b").pivot("track").agg(F.first("mergeable").alias("mergeable"), F.first("score").alias("score"))


def markdown(title: str, tables: dict[str, DataFrame], limit: int = 200) -> str:
    """A report of small tables; the first ``limit`` rows of each, and a note where there are more."""
    out = [f"# {title}"]
    for name, df in tables.items():
        rows = df.limit(limit + 1).collect()
        out += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join(f"{v:.4f}" if isinstance(v, float) else "" if v is None else str(v) for v in r) + " |" for r in rows[:limit]]
        out += ["", "More rows follow."] if len(rows) > limit else []
    return "\n".join(out) + "\n"


def file_sha256(path: str) -> str | None:
    if not os.path.isfile(path):
        return None
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def artifacts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, present, sha: what a run left behind."""
    return spark.createDataFrame([(p, os.path.exists(p), file_sha256(p)) for p in paths], "path string, present boolean, sha string")


def audit(spark: SparkSession, checks: dict[str, tuple[bool, bool]]) -> DataFrame:
    """name -> (present, valid). status: pass, fail, or pending where it is absent."""
    rows = [(k, "pending" if not there else "pass" if ok else "fail") for k, (there, ok) in checks.items()]
    return spark.createDataFrame(rows, "name string, status string")
