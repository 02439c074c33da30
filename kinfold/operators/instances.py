"""All instances of a grid of defects, generated and checked at once, each distinct function run once on each distinct probe.

The libraries of a grid hold nearly the same functions: a function is told by
its content, which is the function of the clean library that it was made from,
the defects put on it with their resolved details, and the parameters it is
run with. A check compares two contents. Instances become rows of a table of
defects, each with the contents that its check compares; the distinct checks
of all instances, which no number of instances with the same defects makes
more, are executed on the battery in one pass, in which an output is computed
once a probe and kept until its last check; probes of equal content are run
once and counted as often as they occur, grey ones of one shape many at a time. Counts come back to the instances by
a join on contents.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import replace
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import images, stacks
from ..functions.images import Skill
from . import corrupt, execute
from ._store import cut

KEY = ["mode", "composition", "rho", "seed"]
_KEYS = "mode string, composition string, rho double, seed int"
DEFECT = f"{_KEYS}, type string, site_id string, new_id string, detail string, ideal_kind string, primary string, secondary string, clean string, made string, domain string, several boolean, perceptual boolean"
CHECK = "clean string, made string, domain string, n long, same boolean, near boolean, inside boolean"
TOGETHER = 2**13  # Fixed value: pixels of probes that run together; outputs of one function are up to 8,192 times as large.


def content(base: str, steps: Sequence[tuple[str, Any]] = (), params: Mapping[str, Any] | None = None) -> str:
    """A function's content as JSON: equal contents give equal outputs."""
    return json.dumps([base, [list(s) for s in steps], dict(params or {})], sort_keys=True)


def content_key(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def build(text: str, library: Mapping[str, Skill]) -> tuple[Skill, dict[str, Any]]:
    """The function of a content, and the parameters to run it with."""
    base, steps, params = json.loads(text)
    skill = library[base]
    for kind, detail in steps:
        if kind == "bug":
            skill = execute.buggy(skill, detail["mutator"], detail.get("domain", ""))
        elif kind == "default":
            skill = replace(skill, params=tuple(replace(p, default=detail["value"]) if p.name == detail["name"] else p for p in skill.params))
        elif kind == "jitter":
            skill = execute.duplicate(skill, skill.id, perceptual=True)
        elif kind == "fixed":
            skill = execute.fixed(skill, skill.id, detail)
        elif kind == "after":
            skill = execute.composed(skill, library[detail], skill.id)
        else:
            raise ValueError(f"unknown step {kind!r}")
    return skill, params


def _step(kind: str, site: Skill, detail: dict[str, Any], seed: int) -> tuple[str, Any] | None:
    """What a defect does to a function; None if it leaves the outputs alone."""
    if kind in ("implementation_bug", "domain_scoped_bug"):
        return "bug", {"mutator": detail["mutator"], "domain": detail.get("domain", "")}
    if kind == "param_schema_bug":
        wrong = corrupt.wrong_default(site, seed)
        return next((("default", {"name": p.name, "value": p.default}) for p, q in zip(wrong.params, site.params, strict=True) if p.default != q.default), None)
    if kind == "duplicate":
        return ("jitter", "") if detail["variant"] == "perceptual" else None
    if kind == "subsumption":
        return "fixed", corrupt.baked(site, seed)
    return ("after", detail["compose_with"]) if kind == "dead_skill" else None


def resolved(key: tuple, plan: pd.DataFrame, library: Mapping[str, Skill]) -> pd.DataFrame:
    """The plan of one instance (mode, composition, rho, seed) with the contents that the checks of its defects compare (``DEFECT``)."""
    seed, rows = int(key[3]), plan.to_dict("records")
    on: dict[str, list] = {}
    for r in rows:  # what happens to a site itself, in the order of the plan
        if not r["new_id"] and (step := _step(r["type"], library[r["site_id"]], json.loads(r["detail"]), seed)):
            on.setdefault(r["site_id"], []).append(step)
    kinds = Counter(site for site, _ in {(r["site_id"], r["type"]) for r in rows})
    for r in rows:
        site, detail = library[r["site_id"]], json.loads(r["detail"])
        step = _step(r["type"], site, detail, seed)
        clean = content(site.id, params=corrupt.baked(site, seed) if r["type"] == "subsumption" else None)
        made = content(site.id, ([step] if step else []) if r["new_id"] else on.get(site.id, []))
        r |= dict(zip(KEY, key, strict=True)) | {"clean": clean, "made": made, "domain": detail.get("domain", ""), "several": kinds[site.id] > 1, "perceptual": detail.get("variant") == "perceptual"}
    return pd.DataFrame(rows, columns=[c.split()[0] for c in DEFECT.split(", ")])


def defects(plans: DataFrame, library: Mapping[str, Skill]) -> DataFrame:
    """A row per defect of each instance (``DEFECT``). plans: as :func:`planning.corruption_grid` gives them."""
    return plans.groupBy(*KEY).applyInPandas(lambda key, plan: resolved(key, plan, library), DEFECT)


def distinct_checks(rows: DataFrame) -> list[tuple[str, str, str]]:
    """(clean, made, domain) of all instances: bounded by the functions, defects and details there are, not by the instances."""
    return sorted(tuple(r) for r in rows.select("clean", "made", "domain").distinct().collect())


def _folded(text: str, library: Mapping[str, Skill]) -> tuple[tuple, ...] | None:
    """A content as steps from the input on: the library's own function with all its parameters, then what is done to its outputs. None where only the built function tells."""
    base, steps, params = json.loads(text)
    own = lambda s: s in stacks.MANY and images.LIBRARY.get(s) is library.get(s)
    if not own(base):
        return None
    values, given, after, free = {p.name: p.default for p in library[base].params}, dict(params or {}), [], True
    for kind, detail in steps:
        if kind in ("default", "fixed"):
            more = {detail["name"]: detail["value"]} if kind == "default" else detail
            if not free or set(more) - set(values):
                return None
            values, free = values | more, kind == "default"
        elif kind == "bug":
            after.append(("bug", detail["mutator"], detail.get("domain", "")))
        elif kind == "jitter":
            after.append(("jitter",))
        elif kind == "after" and own(detail):
            after.append(("run", detail, "{}"))
            free = False
        else:
            return None
    if given and (not free or set(given) - set(values)):
        return None
    return ("run", base, execute.params_key(values | given)), *after


def _stepped(step: tuple, a: np.ndarray, library: Mapping[str, Skill]) -> np.ndarray:
    """One step on HxWxN or HxWxCxN, what grey probes have become."""
    if not a.size:
        raise ValueError("told image by image")
    if step[0] == "bug":  # the probes are grey bytes
        return execute.mutate_many(step[1], a) if step[2] in ("", "grayscale") else a
    if step[0] == "jitter":
        return execute.jitter_many(a)
    if a.ndim != 3:
        raise ValueError("told image by image")
    skill = library[step[1]]
    out = stacks.MANY[skill.id](np.ascontiguousarray(a), **skill.bind(json.loads(step[2])), **({"seed": 0} if skill.stochastic else {}))
    if out is None or out.dtype != np.uint8:
        raise ValueError("told image by image")
    return out


def _alone(key: str, image: np.ndarray, built: Mapping[str, tuple]) -> np.ndarray | None:
    skill, params = built[key]
    try:
        return skill.run(image, params)
    except Exception:  # noqa: BLE001  a function that fails on a probe has no output there
        return None


def _compared(x: np.ndarray | None, y: np.ndarray | None) -> tuple[bool, bool]:
    both = x is not None and y is not None
    return both and bool(x.shape == y.shape and np.array_equal(x, y)), both and execute.l_inf(x, y) <= 1 / 255 + 1e-6


def _compared_many(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for stacks of bytes, image by image."""
    if x is y:
        return (np.ones(x.shape[-1], bool),) * 2
    if x.shape[:2] != y.shape[:2]:
        return (np.zeros(x.shape[-1], bool),) * 2
    if x.shape != y.shape or (x.ndim == 4 and x.shape[2] not in (1, 3)):
        told = [_compared(x[..., i], y[..., i]) for i in range(x.shape[-1])]
        return np.array([t[0] for t in told]), np.array([t[1] for t in told])
    gap = (np.maximum(x, y) - np.minimum(x, y)).reshape(-1, x.shape[-1]).max(axis=0, initial=0)
    return gap == 0, gap <= 1


def executed(battery: DataFrame, checks: Sequence[tuple[str, str, str]], library: Mapping[str, Skill]) -> DataFrame:
    """Rows of checks and outcomes (``CHECK``); n: on how many probes a check came out like that. Outputs stay inside the task.

    Grey probes of one shape run together, a row per check and outcome of each
    such stack; contents that begin alike (the function with its parameters,
    then each change to its outputs) share what they have in common. Other
    probes, and contents with functions that aren't the library's own, run one
    by one.
    """
    last = {k: i for i, c in enumerate(checks) for k in c[:2]}
    folded = {k: _folded(k, library) for k in last}
    needed: dict[tuple, int] = {}
    for k, steps in folded.items():
        for n in range(1, len(steps or ()) + 1):
            needed[steps[:n]] = max(needed.get(steps[:n], 0), last[k])
    gone: dict[int, list] = {}
    for key, i in (*needed.items(), *last.items()):
        gone.setdefault(i, []).append(key)

    def single(image: np.ndarray, built: dict) -> Iterator[tuple[bool, bool, bool]]:
        held: dict[Any, np.ndarray | None] = {}
        for i, (clean, made, domain) in enumerate(checks):
            for k in (clean, made):
                if k not in held:
                    held[k] = _alone(k, image, built)
            yield *_compared(held[clean], held[made]), execute.matches_domain(image, domain)
            for k in gone.get(i, ()):
                held.pop(k, None)

    def together(given: list[np.ndarray], built: dict) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        stack, held = np.stack(given, axis=-1), {}

        def out(steps: tuple) -> np.ndarray:
            if steps not in held:
                held[steps] = _stepped(steps[-1], out(steps[:-1]) if len(steps) > 1 else stack, library)
            return held[steps]

        def whole(key: str) -> np.ndarray | list:
            if key not in held:
                try:
                    held[key] = out(folded[key] or ())
                except Exception:  # noqa: BLE001  told image by image
                    held[key] = [_alone(key, a, built) for a in given]
            return held[key]

        for i, (clean, made, domain) in enumerate(checks):
            x, y = whole(clean), whole(made)
            if isinstance(x, list) or isinstance(y, list):
                told = [_compared(*((v[n] if isinstance(v, list) else v[..., n]) for v in (x, y))) for n in range(len(given))]
                same, near = (np.array([t[j] for t in told]) for j in (0, 1))
            else:
                same, near = _compared_many(x, y)
            yield same, near, execute.matches_domain(given[0], domain)
            for k in gone.get(i, ()):
                held.pop(k, None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        built = {k: build(k, library) for k in last}
        names = [c.split()[0] for c in CHECK.split(", ")]
        for b in batches:
            counts, given = b["n"].to_numpy(np.int64), [execute.unpack(r) for r in b["image"]]
            for at in execute.alike(given, TOGETHER):
                if len(at) == 1:
                    rows = [(*c, int(counts[at[0]]), *o) for c, o in zip(checks, single(given[at[0]], built), strict=True)]
                else:
                    n, rows = counts[at], []
                    for c, (same, near, inside) in zip(checks, together([given[i] for i in at], built), strict=True):
                        kinds = 2 * same + near
                        rows += [(*c, int(n[kinds == k].sum()), k > 1, k % 2 == 1, inside) for k in np.unique(kinds).tolist()]
                yield pd.DataFrame(rows, columns=names)

    probes = battery.groupBy("image").agg(F.count(F.lit(1)).alias("n"))
    spread = 4 * max(8, battery.sparkSession.sparkContext.defaultParallelism)
    return probes.repartition(spread).mapInPandas(run, CHECK)


def judged(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """``rows`` with n_probes, n_same, n_near and ok: whether the defect does what its type says. Of several defects on one site each may hide the others."""
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    sums = seen.groupBy("clean", "made", "domain").agg(F.sum("n").alias("n_probes"), n(F.col("same")).alias("n_same"), n(F.col("near")).alias("n_near"), n(~F.col("inside") & ~F.col("same")).alias("outside"))
    told = rows.join(sums, ["clean", "made", "domain"])
    changed, whole = F.col("n_same") < F.col("n_probes"), F.col("n_same") == F.col("n_probes")
    ok = (
        F.when(F.col("type") == "implementation_bug", changed)
        .when(F.col("type") == "domain_scoped_bug", F.col("several") | (F.col("outside") == 0))
        .when(F.col("type") == "duplicate", F.when(F.col("perceptual"), (F.col("n_near") == F.col("n_probes")) & changed).otherwise(whole))
        .when(F.col("type") == "subsumption", whole)
        .when(F.col("type") == "metadata_mislead", F.col("several") | whole)
        .otherwise(F.lit(True))
    )
    return told.withColumn("ok", ok)


def generate(plans: DataFrame, battery: DataFrame, library: Mapping[str, Skill]) -> tuple[DataFrame, dict[str, int]]:
    """All instances with every defect checked, and how many runs that took: ``functions`` and ``probes`` that are distinct, ``runs`` done, ``asked`` (what instances one by one would run)."""
    rows = cut(defects(plans, library))
    checks = distinct_checks(rows)
    done = cut(judged(rows, executed(battery, checks, library)))
    functions, probes = len({k for c in checks for k in c[:2]}), battery.select("image").distinct().count()
    return done, {"functions": functions, "probes": probes, "runs": functions * probes, "asked": 2 * rows.count() * battery.count()}


def manifests(done: DataFrame, n_base: int) -> DataFrame:
    """One row per instance: its name, sites, added functions, size, defects by type (JSON), how many passed."""
    kinds = done.groupBy(*KEY, "type").agg(F.count(F.lit(1)).alias("k"))
    counts = kinds.groupBy(*KEY).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "k"))))).alias("realized"))
    whole = done.groupBy(*KEY).agg(F.countDistinct("site_id").alias("n_sites"), F.count_if(F.col("new_id") != "").alias("n_added"), F.count(F.lit(1)).alias("n_defects"), F.count_if("ok").alias("n_passed"))
    name = F.format_string("rho%03d_%s_seed%d_%s", F.bround(F.col("rho") * 100).cast("int"), "composition", "seed", "mode")
    return whole.join(counts, KEY).select(name.alias("name"), *KEY, F.lit(n_base).alias("n_base"), "n_sites", "n_added", (F.lit(n_base) + F.col("n_added")).alias("n_skills"), "n_defects", "n_passed", "realized")


def artifacts(done: DataFrame, library: Mapping[str, Skill]) -> DataFrame:
    """instance, file, body: the log of defects, the functions, the added relations, the ideal actions, the report of checks and the manifest of each instance, as JSON."""
    name = F.format_string("rho%03d_%s_seed%d_%s", F.bround(F.col("rho") * 100).cast("int"), "composition", "seed", "mode")
    of = done.withColumn("instance", name)

    def file(called: str, rows: DataFrame, *columns: str) -> DataFrame:
        return rows.groupBy("instance").agg(F.to_json(F.array_sort(F.collect_list(F.struct(*columns)))).alias("body")).select("instance", F.lit(called).alias("file"), "body")

    relation = F.when(F.col("type") == "subsumption", "SUBSUMPTION").when(F.col("perceptual"), "PERCEPTUAL").otherwise("EXACT")
    related = of.where("type IN ('duplicate', 'subsumption')").select("instance", F.least("site_id", "new_id").alias("a"), F.greatest("site_id", "new_id").alias("b"), relation.alias("relation"))
    base = of.sparkSession.createDataFrame([(s,) for s in library], "skill_id string").crossJoin(of.select("instance").distinct())  # a row a function of each instance: what library.json lists
    changed = of.where("new_id = ''").groupBy("instance", F.col("site_id").alias("skill_id")).agg(F.first("made").alias("content"))
    own = base.join(changed, ["instance", "skill_id"], "left").select("instance", "skill_id", F.coalesce("content", F.concat(F.lit('["'), "skill_id", F.lit('", [], {}]'))).alias("content"))
    added = of.where("new_id <> ''").select("instance", F.col("new_id").alias("skill_id"), F.col("made").alias("content"))
    told = manifests(done, len(library))
    parts = [
        file("corruption_log.json", of, "site_id", "type", "new_id", "detail"), file("library.json", own.unionByName(added), "skill_id", "content"), file("g_rho.json", related, "a", "b", "relation"),
        file("ideal_actions.json", of, "site_id", "ideal_kind", "primary", "secondary"), file("qa_report.json", of, "site_id", "type", "new_id", "n_probes", "n_same", "n_near", "ok"),
        told.select(F.col("name").alias("instance"), F.lit("manifest.json").alias("file"), F.to_json(F.struct(*told.columns)).alias("body")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_artifacts(done: DataFrame, library: Mapping[str, Skill], path: str) -> None:
    """One folder an instance and file below ``path``, written by the tasks."""
    artifacts(done, library).write.partitionBy("instance", "file").text(path)
