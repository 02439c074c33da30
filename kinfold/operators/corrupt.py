"""Replaying a plan of defects on a library, and checking by execution that every defect does what it says."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, replace
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.images import Param, Skill
from . import execute
from .planning import derive_seed, sample_values


def alternative(p: Param, seed: int) -> Any:
    """Another value of a parameter than its default, the same at each call."""
    spec = {"name": p.name, "type": p.type, "default": p.default, "min": p.min, "max": p.max, "choices": p.choices}
    other = [v for v in sample_values(spec) if v != p.default]
    if not other and p.type in ("int", "float"):
        other = [p.default + 1 if p.max is None or p.default + 1 <= p.max else p.default - 1]
    if not other:
        return p.default
    return other[int(np.random.default_rng(derive_seed(seed, "alternative", p.name)).integers(len(other)))]


def wrong_default(skill: Skill, seed: int) -> Skill:
    """One default replaced by another legal value."""
    for i, p in enumerate(skill.params):
        value = alternative(p, seed)
        if value != p.default:
            return replace(skill, params=(*skill.params[:i], replace(p, default=value), *skill.params[i + 1 :]), is_buggy=True)
    return skill


def baked(skill: Skill, seed: int) -> dict[str, Any]:
    """Parameters of a specialisation: the first numeric one off its default."""
    p = next(x for x in skill.params if x.type in ("int", "float"))
    return {p.name: alternative(p, seed)}


@dataclass
class Corrupted:
    """The library with its defects; relations as (a, b, relation, spec, gen, hard); ideal actions as (kind, primary, secondary)."""

    skills: dict[str, Skill]
    relations: list[tuple[str, str, str, str | None, str | None, bool]]
    ideal: list[tuple[str, str, str]]
    added: tuple[str, ...]


def apply_plan(library: Mapping[str, Skill], plan: pd.DataFrame, seed: int = 0) -> Corrupted:
    """plan: type, site_id, new_id, detail, ideal_kind, primary, secondary, as :func:`planning.plan_instance` gives it. The given library stays as it is."""
    skills, relations, ideal, added = dict(library), [], [], []
    for r in plan.to_dict("records"):
        site, new, detail = library[r["site_id"]], r["new_id"], json.loads(r["detail"] or "{}")
        kind = r["type"]
        if kind in ("implementation_bug", "domain_scoped_bug"):
            skills[site.id] = execute.buggy(skills[site.id], detail["mutator"], detail.get("domain", ""))
        elif kind == "param_schema_bug":
            skills[site.id] = wrong_default(skills[site.id], seed)
        elif kind == "metadata_mislead":
            other = library[sorted(library)[(sorted(library).index(site.id) + 1) % len(library)]]
            skills[site.id] = replace(skills[site.id], name=other.name, description=other.description)
        elif kind == "duplicate":
            perceptual = detail["variant"] == "perceptual"
            skills[new] = execute.duplicate(site, new, perceptual)
            relations.append((*sorted((site.id, new)), "PERCEPTUAL" if perceptual else "EXACT", None, None, False))
        elif kind == "subsumption":
            skills[new] = execute.fixed(site, new, baked(site, seed))
            relations.append((*sorted((site.id, new)), "SUBSUMPTION", new, site.id, False))
        elif kind == "dead_skill":
            skills[new] = execute.composed(site, library[detail["compose_with"]], new)
        else:
            raise ValueError(f"unknown type of defect {kind!r}")
        if new:
            added.append(new)
        ideal.append((r["ideal_kind"], r["primary"], r["secondary"] or ""))
    return Corrupted(skills, relations, ideal, tuple(added))


QA = "type string, site_id string, new_id string, probe_id string, same boolean, near boolean, in_domain boolean"


def checked(battery: DataFrame, library: Mapping[str, Skill], plan: pd.DataFrame, made: Corrupted, seed: int = 0) -> DataFrame:
    """One row per defect: type, site_id, new_id, n_probes, n_same, n_near, ok and what is wrong.

    The clean and the corrupted function run inside the rows of the probes;
    only counts are shuffled. Sites with several defects are held to change in
    some way only, as the defects may hide each other.
    """
    rows = plan[["type", "site_id", "new_id", "detail"]].to_dict("records")
    shared = plan.groupby("site_id")["type"].agg(lambda t: len(set(t))).to_dict()

    def outcome(r: dict, image: np.ndarray) -> tuple[bool, bool, bool]:
        detail = json.loads(r["detail"] or "{}")
        clean, other = library[r["site_id"]], made.skills[r["new_id"] or r["site_id"]]
        try:
            x = clean.run(image, baked(clean, seed) if r["type"] == "subsumption" else None)
            y = other.run(image)
            return bool(x.shape == y.shape and np.array_equal(x, y)), execute.l_inf(x, y) <= 1 / 255 + 1e-6, execute.matches_domain(image, detail.get("domain", ""))
        except Exception:  # noqa: BLE001  an error of a function is a difference
            return False, False, execute.matches_domain(image, detail.get("domain", ""))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for probe_id, packed in zip(b["probe_id"], b["image"], strict=True):
                image = execute.unpack(packed)
                yield pd.DataFrame([(r["type"], r["site_id"], r["new_id"], str(probe_id), *outcome(r, image)) for r in rows], columns=[c.split()[0] for c in QA.split(", ")])

    seen = battery.select("probe_id", "image").mapInPandas(run, QA).groupBy("type", "site_id", "new_id")
    agg = seen.agg(F.count(F.lit(1)).alias("n_probes"), F.count_if("same").alias("n_same"), F.count_if("near").alias("n_near"), F.count_if(F.col("in_domain") & ~F.col("same")).alias("inside"), F.count_if(~F.col("in_domain") & ~F.col("same")).alias("outside"))
    many = F.col("site_id").isin([s for s, n in shared.items() if n > 1])
    changed = F.col("n_same") < F.col("n_probes")
    perceptual = F.col("new_id").isin([r["new_id"] for r in rows if r["type"] == "duplicate" and json.loads(r["detail"])["variant"] == "perceptual"])
    ok = (
        F.when(F.col("type") == "implementation_bug", changed)
        .when(F.col("type") == "domain_scoped_bug", many | (F.col("outside") == 0))
        .when(F.col("type") == "duplicate", F.when(perceptual, (F.col("n_near") == F.col("n_probes")) & changed).otherwise(F.col("n_same") == F.col("n_probes")))
        .when(F.col("type") == "subsumption", F.col("n_same") == F.col("n_probes"))
        .when(F.col("type") == "metadata_mislead", many | (F.col("n_same") == F.col("n_probes")))
        .otherwise(F.lit(True))
    )
    return agg.select("type", "site_id", "new_id", "n_probes", "n_same", "n_near", ok.alias("ok"))


def qa_counts(report: DataFrame) -> DataFrame:
    """type, n, passed."""
    return report.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("passed"))


def extended(designed: DataFrame, made: Corrupted) -> DataFrame:
    """The designed relations with those that the defects add."""
    return designed.unionByName(designed.sparkSession.createDataFrame(made.relations, designed.schema)) if made.relations else designed


def ids(made: Corrupted) -> Sequence[str]:
    return sorted(made.skills)
