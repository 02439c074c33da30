"""Apportionment, usage counts, parameter grids, and the plan of seeded defects."""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Mapping, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._order import running

# The defect types in order, and the weights of the named compositions (1 where none is given).
TYPES = ("implementation_bug", "metadata_mislead", "duplicate", "subsumption", "param_schema_bug", "domain_scoped_bug", "dead_skill")
ADDING = ("duplicate", "subsumption", "dead_skill")
COMPOSITIONS: dict[str, dict[str, float]] = {
    "uniform": {},
    "duplicate_heavy": {"duplicate": 4.0, "subsumption": 2.0},
    "metadata_heavy": {"metadata_mislead": 4.0, "dead_skill": 2.0},
}
IDEAL = {
    "implementation_bug": "modify", "metadata_mislead": "modify", "duplicate": "merge", "subsumption": "parameterize",
    "param_schema_bug": "modify", "domain_scoped_bug": "modify", "dead_skill": "remove",
}
MUTATORS = ("roll_h", "roll_w", "swap_channels", "zero_border", "invert_values")
DOMAINS = ("rgba", "grayscale", "uint16")


def derive_seed(root: int, *labels: object) -> int:
    """64 bits of BLAKE2b over the root and the labels, with a unit separator between them."""
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, (root, *labels))).encode(), digest_size=8).digest(), "big")


def hamilton(weights: DataFrame, seats: DataFrame, key: str = "key") -> DataFrame:
    """weights: group, pos, key, weight. seats: group, k. Largest remainders; ties go to the first ``pos``."""
    total = Window.partitionBy("group")
    quota = F.col("k") * F.col("weight") / F.sum("weight").over(total)
    rows = weights.join(seats, "group").withColumn("quota", quota).withColumn("base", F.floor("quota"))
    rows = rows.withColumn("left", F.col("k") - F.sum("base").over(total))
    by = Window.partitionBy("group").orderBy((F.col("quota") - F.col("base")).desc(), "pos")
    return rows.select("group", "pos", key, (F.col("base") + (F.row_number().over(by) <= F.col("left")).cast("int")).cast("long").alias("seats"))


def usage_counts(mentions: DataFrame, base: int = 20, alpha: float = 1.2) -> DataFrame:
    """mentions: pos, id. n: mentions plus a Zipf bonus by rank of first mention, half to even and 1 at least."""
    by = mentions.groupBy("id").agg(F.count(F.lit(1)).alias("mentions"), F.min("pos").alias("first"))
    rows = running(by, [F.col("first"), F.col("id")], {"rank": F.lit(1)}).withColumn("rank", F.col("rank").cast("int"))
    bonus = F.greatest(F.lit(1), F.bround(base / F.pow("rank", F.lit(alpha))).cast("int"))
    return rows.select("id", "rank", (F.col("mentions") + bonus).cast("long").alias("n"))


def sample_values(spec: Mapping[str, Any]) -> list[Any]:
    """Default, ends and middle of a number, each once and in order; all of a boolean or an enum; the default of a string."""
    kind, default = spec["type"], spec.get("default")
    if kind == "bool":
        return [True, False]
    if kind == "enum":
        return list(spec["choices"])
    if kind == "str":
        return [default]
    out = [default, spec.get("min"), spec.get("max")]
    if spec.get("min") is not None and spec.get("max") is not None:
        middle = (spec["min"] + spec["max"]) / 2
        out.append(int(middle) if kind == "int" else middle)
    return list(dict.fromkeys(x for x in out if x is not None))


def param_grid(specs: Sequence[Mapping[str, Any]], most: int = 12) -> list[dict[str, Any]]:
    """The product of sampled values, cut to 8 times ``most`` in order, then sorted by JSON text and cut to ``most``."""
    product = itertools.islice(itertools.product(*(sample_values(s) for s in specs)), 8 * most)
    rows = [dict(zip((s["name"] for s in specs), v, strict=True)) for v in product]
    return sorted(rows, key=lambda r: json.dumps(r, sort_keys=True))[:most]


def matched_sweep(axes: DataFrame, a: str, b: str) -> DataFrame:
    """axes: axis_pos, axis, value_pos, value, skill, params. value, params_a, params_b of the first axis that has both."""
    left = axes.where(F.col("skill") == a).select("axis_pos", "axis", "value_pos", "value", F.col("params").alias("params_a"))
    right = axes.where(F.col("skill") == b).select("axis_pos", "value_pos", F.col("params").alias("params_b"))
    both = left.join(right, ["axis_pos", "value_pos"]).where("params_a is not null and params_b is not null")
    first = both.agg(F.min("axis_pos").alias("first"))
    return both.join(F.broadcast(first), F.col("axis_pos") == F.col("first")).select("axis", "value_pos", "value", "params_a", "params_b")  # one row


def _shares(composition: str, k: int) -> dict[str, int]:
    weight = {t: COMPOSITIONS[composition].get(t, 1.0) for t in TYPES}
    quota = {t: k * w / sum(weight.values()) for t, w in weight.items()}
    out = {t: int(q) for t, q in quota.items()}
    for t in sorted(TYPES, key=lambda t: (out[t] - quota[t], TYPES.index(t)))[: k - sum(out.values())]:
        out[t] += 1
    return out


def plan_instance(library: pd.DataFrame, rho: float, composition: str, seed: int, mode: str) -> pd.DataFrame:
    """One row per defect: type, site_id, new_id, detail, ideal_kind, primary, secondary.

    library: id, n_params, numeric_params. Types that need parameters choose
    among the functions that have them, in an order shuffled by the seed; what
    they can't place goes round the types that take any function.
    """
    if composition not in COMPOSITIONS:
        raise KeyError(f"unknown composition {composition!r}")
    ids = sorted(library["id"])
    k = int(np.round(rho * len(ids)))
    order = list(np.random.default_rng(derive_seed(seed, "sites")).permutation(ids))
    numeric = set(library.loc[library["numeric_params"] > 0, "id"])
    some = set(library.loc[library["n_params"] > 0, "id"])
    pools = {"subsumption": numeric, "param_schema_bug": some}
    want, free, chosen, spill = _shares(composition, k), list(order), {}, 0
    for t in (*pools, *(t for t in TYPES if t not in pools)):
        fit = [s for s in free if s in pools.get(t, (s,))][: want[t]]
        spill += want[t] - len(fit)
        chosen[t] = fit
        free = [s for s in free if s not in set(fit)]
    flexible = [t for t in TYPES if t not in pools and want[t] > 0] or ["implementation_bug"]
    for i, s in enumerate(free[:spill]):
        chosen[flexible[i % len(flexible)]].append(s)
    rows = []
    for t in TYPES:
        for s in chosen[t]:
            rows.append(_entry(t, s, seed, ids))
            if mode == "mixed":
                rng = np.random.default_rng(derive_seed(seed, "extra", s))
                if rng.random() < 0.5:
                    rows.append(_entry(str(rng.choice([x for x in TYPES if x != t and (x not in pools or s in pools[x])])), s, seed, ids))
    return pd.DataFrame(sorted(rows, key=lambda r: (r[1], TYPES.index(r[0]))), columns=["type", "site_id", "new_id", "detail", "ideal_kind", "primary", "secondary"])


def _entry(t: str, site: str, seed: int, ids: list[str]) -> tuple[str, ...]:
    rng = np.random.default_rng(derive_seed(seed, t, site))
    new = f"{site}__{t}_{seed}" if t in ADDING else ""
    detail: dict[str, Any] = {}
    if t in ("implementation_bug", "domain_scoped_bug"):
        detail["mutator"] = str(rng.choice(MUTATORS))
    if t == "domain_scoped_bug":
        detail["domain"] = str(rng.choice(DOMAINS))
    if t == "duplicate":
        detail["variant"] = str(rng.choice(("exact", "perceptual")))
    if t == "dead_skill":
        detail["compose_with"] = str(rng.choice([x for x in ids if x != site] or [site]))
    primary, secondary = (new, site) if t in ("duplicate", "subsumption") else (new or site, "")
    return t, site, new, json.dumps(detail, sort_keys=True), IDEAL[t], primary, secondary


def corruption_grid(spark: SparkSession, library: pd.DataFrame, rhos: Sequence[float], compositions: Sequence[str], seeds: Sequence[int], modes: Sequence[str] = ("single", "mixed")) -> DataFrame:
    """The plans of all instances, one task group per instance. library is a driver table of a few hundred functions."""
    grid = spark.createDataFrame([(m, c, float(r), s) for m, c, r, s in itertools.product(modes, compositions, rhos, seeds)], "mode string, composition string, rho double, seed int")
    names = "mode string, composition string, rho double, seed int, type string, site_id string, new_id string, detail string, ideal_kind string, primary string, secondary string"

    def plan(key: tuple, _: pd.DataFrame) -> pd.DataFrame:
        mode, composition, rho, seed = key
        rows = plan_instance(library, rho, composition, seed, mode)
        for i, v in enumerate(key):
            rows.insert(i, ("mode", "composition", "rho", "seed")[i], v)
        return rows

    return grid.groupBy("mode", "composition", "rho", "seed").applyInPandas(plan, names)
