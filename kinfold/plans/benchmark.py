"""The benchmark run: verdicts of every track on every pair, their scores, calibration, study points and reports."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.images import Skill
from ..operators import calibrate, compare, execute, judges, metrics
from ..operators.alignment import Alignment
from ..operators.compare import Thresholds
from ..sources import files

PAIR = "probe_id string, a string, b string, binding int, l_inf double, perceptual double, semantic double, same boolean, commute double, da double, db double, xy double, xx double, yy double"
HIT = "a string, b string, side string, spec int, gen int, ok boolean"


def _mean_gap(x: np.ndarray, y: np.ndarray) -> float:
    a, b = execute.canonical(x)[0], execute.canonical(y)[0]
    return float(np.abs(a - b).mean()) if a.shape == b.shape else float("inf")


def _feature_gap(x: np.ndarray, y: np.ndarray) -> float:
    """Cosine distance of the means of a 4 x 4 grid of cells."""
    parts = []
    for image in (x, y):
        v = execute.canonical(image)[0]
        cells = [c.mean() for row in np.array_split(v, min(4, v.shape[0]), axis=0) for c in np.array_split(row, min(4, v.shape[1]), axis=1)]
        parts.append(np.resize(np.asarray(cells, np.float64), 16))
    n = np.linalg.norm(parts[0]) * np.linalg.norm(parts[1])
    return float(np.clip(1 - parts[0] @ parts[1] / n, 0, 2)) if n else 1.0


class _Runs:
    """Outputs of functions on one image, each computed once."""

    def __init__(self, known: Mapping[str, Skill], image: np.ndarray) -> None:
        self.known, self.image, self.held = known, image, {}

    def __call__(self, skill: str, params: dict | None = None, image: np.ndarray | None = None) -> np.ndarray | None:
        key = (skill, execute.params_key(params)) if image is None else None
        if key in self.held:
            return self.held[key]
        try:
            out = self.known[skill].run(self.image if image is None else image, params)
        except Exception:  # noqa: BLE001  a function that fails on a probe has no output there
            out = None
        if key:
            self.held[key] = out
        return out


def pair_distances(battery: DataFrame, pairs: Sequence[tuple[str, str]], known: Mapping[str, Skill], alignment: Alignment = Alignment()) -> DataFrame:
    """A row per probe, pair and matched binding; see ``PAIR``. Outputs stay inside the probe's task."""
    sweeps = {(a, b): alignment.sweep(a, b) for a, b in pairs}

    def measure(runs: _Runs, a: str, b: str, k: int, pa: dict, pb: dict) -> tuple | None:
        x, y = runs(a, pa), runs(b, pb)
        if x is None or y is None:
            return None
        effect = [None] * 6
        if k == 0:
            yx, xy = runs(b, pb, x), runs(a, pa, y)
            effect[:3] = [execute.l_inf(yx, xy) if yx is not None and xy is not None else float("inf"), execute.l_inf(x, runs.image), execute.l_inf(y, runs.image)]
            base, u, v = (execute.canonical(i)[0] for i in (runs.image, x, y))
            if base.shape == u.shape == v.shape:
                effect[3:] = [float(((u - base) * (v - base)).sum()), float(((u - base) ** 2).sum()), float(((v - base) ** 2).sum())]
        return a, b, k, execute.l_inf(x, y), _mean_gap(x, y), _feature_gap(x, y), bool(x.shape == y.shape and np.array_equal(x, y)), *effect

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for probe_id, packed in zip(part["probe_id"], part["image"], strict=True):
                runs = _Runs(known, execute.unpack(packed))
                rows = [(str(probe_id), *m) for (a, b), sweep in sweeps.items() for k, (pa, pb) in enumerate(sweep) if (m := measure(runs, a, b, k, pa, pb)) is not None]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in PAIR.split(", ")])

    return battery.select("probe_id", "image").mapInPandas(run, PAIR)


def subsumption_directions(battery: DataFrame, pairs: Sequence[tuple[str, str]], known: Mapping[str, Skill], alignment: Alignment = Alignment(), t: Thresholds = Thresholds()) -> DataFrame:
    """a, b, direction of the pairs of which one has parameters: is there, for each binding of one, a binding of the other that agrees on every probe?"""
    free = [(a, b) for a, b in pairs if known[a].params or known[b].params]
    grids = {s: alignment.subsumption_grid(known[s]) for s in {s for p in free for s in p}}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for packed in part["image"]:
                runs, rows = _Runs(known, execute.unpack(packed)), []
                for a, b in free:
                    for i, p in enumerate(grids[a]):
                        for j, q in enumerate(grids[b]):
                            x, y = runs(a, p), runs(b, q)
                            ok = x is not None and y is not None and execute.l_inf(x, y) <= t.epsilon
                            rows += [(a, b, "a", i, j, ok), (a, b, "b", j, i, ok)]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in HIT.split(", ")])

    hits = battery.select("image").mapInPandas(run, HIT).groupBy("a", "b", "side", "spec", "gen").agg(F.bool_and("ok").alias("ok"))
    found = hits.groupBy("a", "b", "side", "spec").agg(F.bool_or("ok").alias("ok")).groupBy("a", "b").agg(F.bool_and(F.col("ok") | (F.col("side") != "a")).alias("a_found"), F.bool_and(F.col("ok") | (F.col("side") != "b")).alias("b_found"))
    return found.select("a", "b", F.when(F.col("a_found") & F.col("b_found"), "MUTUAL_EXACT").when(F.col("a_found"), "B_SUBSUMES_A").when(F.col("b_found"), "A_SUBSUMES_B").otherwise("NONE").alias("direction"))


def binding_that_absorbs(battery: DataFrame, spec: str, gen: str, known: Mapping[str, Skill], alignment: Alignment = Alignment(), t: Thresholds = Thresholds()) -> dict | None:
    """The first binding of ``gen`` that gives the outputs of ``spec`` at its defaults on every probe."""
    grid = alignment.subsumption_grid(known[gen])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for packed in part["image"]:
                runs = _Runs(known, execute.unpack(packed))
                x = runs(spec)
                yield pd.DataFrame([(j, x is not None and (y := runs(gen, q)) is not None and execute.l_inf(x, y) <= t.epsilon) for j, q in enumerate(grid)], columns=["gen", "ok"])

    best = battery.select("image").mapInPandas(run, "gen int, ok boolean").groupBy("gen").agg(F.bool_and("ok").alias("ok")).where("ok").agg(F.min("gen")).first()[0]
    return None if best is None else grid[best]


@dataclass
class Result:
    """truth: a, b, relation, spec, gen, hard. verdicts: a, b, track, relation, direction, mergeable, score. failed: track to reason."""

    truth: DataFrame
    verdicts: DataFrame
    distances: DataFrame
    failed: dict[str, str]

    def track(self, name: str) -> DataFrame:
        return self.verdicts.where(F.col("track") == name)


def output_verdicts(battery: DataFrame, pairs: Sequence[tuple[str, str]], known: Mapping[str, Skill], t: Thresholds = Thresholds(), alignment: Alignment = Alignment()) -> tuple[DataFrame, DataFrame]:
    """Verdicts from outputs, and the measured distances. Pairs without a probe in common are DISTINCT."""
    spark = battery.sparkSession
    dists = pair_distances(battery, pairs, known, alignment)
    numbered = dists.withColumn("probe_id", F.xxhash64("probe_id", "binding"))
    plain = compare.measured(numbered, t)
    effects = dists.where("binding = 0").groupBy("a", "b").agg(F.max("commute").alias("commute"), F.max("da").alias("da"), F.max("db").alias("db"), F.sum("xy").alias("xy"), F.sum("xx").alias("xx"), F.sum("yy").alias("yy"))
    corr = F.coalesce(F.try_divide(F.col("xy"), F.nullif(F.sqrt("xx") * F.sqrt("yy"), F.lit(0.0))), F.lit(0.0))
    both = (F.col("da") > t.epsilon) & (F.col("db") > t.epsilon) & (F.col("commute") <= t.epsilon) & (F.abs(corr) <= t.correlation)
    asked = spark.createDataFrame(list(pairs), "a string, b string")
    rows = asked.join(plain, ["a", "b"], "left").join(effects, ["a", "b"], "left").join(subsumption_directions(battery, pairs, known, alignment, t), ["a", "b"], "left").fillna(0, ["n_probes"])
    relation = compare.relation(t, F.coalesce(both, F.lit(False)), F.col("direction"))
    told = rows.withColumn("relation", relation)
    direction = F.when(F.col("relation") == "SUBSUMPTION", F.col("direction")).otherwise(F.lit("NONE"))
    verdicts = told.select("a", "b", F.lit("output").alias("track"), "relation", direction.alias("direction"), F.col("relation").isin("EXACT", "PERCEPTUAL").alias("mergeable"), F.coalesce("perceptual", "l_inf", F.lit(float("nan"))).alias("score"))
    return verdicts, plain


def run_benchmark(battery: DataFrame, known: Mapping[str, Skill], truth: DataFrame, candidates: DataFrame | None = None, t: Thresholds = Thresholds(), alignment: Alignment = Alignment(), tracks: Sequence[str] = ("output", "name_match", "tfidf")) -> Result:
    """Designed and candidate pairs, judged by each track. A track that fails leaves no verdicts and its reason.

    truth: a, b, relation, spec, gen, hard, with a before b. The pairs of a
    library are a driver's table: a few thousand at most.
    """
    spark = battery.sparkSession
    asked = truth.select("a", "b") if candidates is None else truth.select("a", "b").union(candidates.select(F.least("a", "b"), F.greatest("a", "b"))).distinct()
    pairs = sorted((r["a"], r["b"]) for r in asked.distinct().collect())
    if unknown := {s for p in pairs for s in p} - set(known):
        raise ValueError(f"unknown functions {sorted(unknown)}")
    told = spark.createDataFrame([(a, b, known[a].name, known[b].name) for a, b in pairs], "a string, b string, name_a string, name_b string")
    specs = spark.createDataFrame([(s.id, s.name, s.description, s.family) for s in known.values()], "id string, name string, description string, family string")
    dists = spark.createDataFrame([], "a string, b string, l_inf double, worst_probe long, perceptual double, identical boolean, semantic_q double, semantic_mean double, n_probes long")
    merged = lambda df, track: df.select("a", "b", F.lit(track).alias("track"), F.when(F.col("mergeable"), "EXACT").otherwise("DISTINCT").alias("relation"), F.lit("NONE").alias("direction"), "mergeable", "score")
    parts, failed = [], {}
    for track in tracks:
        try:
            if track == "output":
                part, dists = output_verdicts(battery, pairs, known, t, alignment)
            elif track == "name_match":
                part = merged(judges.name_match(told), track)
            elif track == "tfidf":
                part = merged(judges.cosine_pairs(judges.tfidf(judges.text_surface(specs)), told.select("a", "b")), track)
            else:
                raise ValueError(f"unknown track {track!r}")
            parts.append(part.persist())
            parts[-1].count()
        except Exception as e:  # noqa: BLE001  a failed judge is a result: its verdicts go, the others stay
            parts, failed[track] = [p for p in parts if p is not None], f"{type(e).__name__}: {e}"[:200]
    if not parts:
        raise RuntimeError(f"no track could be run: {failed}")
    verdicts = parts[0]
    for part in parts[1:]:
        verdicts = verdicts.unionByName(part)
    whole = asked.distinct().join(truth, ["a", "b"], "left")
    whole = whole.select("a", "b", F.coalesce("relation", F.lit("DISTINCT")).alias("relation"), "spec", "gen", F.coalesce("hard", F.lit(False)).alias("hard"))
    return Result(whole, verdicts, dists, failed)


def track_summaries(result: Result, tracks: Sequence[str] = ("output", "name_match", "tfidf")) -> DataFrame:
    """track, status, n, precision, recall, f1 of merging, false_merge_rate, hard_false_merge_rate, abstention_rate; nulls where a track did not run."""
    spark, rows = result.truth.sparkSession, []
    for name in tracks:
        pred = result.track(name)
        if name in result.failed or pred.isEmpty():
            rows.append((name, result.failed.get(name, "not run"), *[None] * 7))
            continue
        m, safe = metrics.mergeable_prf(result.truth, pred).first(), {r["slice"]: r for r in metrics.merge_safety(result.truth, pred).collect()}
        gone = metrics.abstention(pred).first()
        rows.append((name, "ok", int(gone["n"]), float(m["precision"]), float(m["recall"]), float(m["f1"]), float(safe["all"]["false_merge_rate"]), float(safe["hard"]["false_merge_rate"]), float(gone["abstention_rate"])))
    return spark.createDataFrame(rows, "track string, status string, n long, precision double, recall double, f1 double, false_merge_rate double, hard_false_merge_rate double, abstention_rate double")


def calibrate_from_result(result: Result, known: Mapping[str, Skill], families: Sequence[str], base: Thresholds, date: str, **how: object) -> Thresholds:
    """Thresholds fitted on the pairs whose functions both belong to ``families``."""
    of = result.truth.sparkSession.createDataFrame([(s.id, s.family) for s in known.values()], "id string, family string")
    rows = result.truth.join(result.distances, ["a", "b"]).join(of.select(F.col("id").alias("a"), F.col("family").alias("family_a")), "a").join(of.select(F.col("id").alias("b"), F.col("family").alias("family_b")), "b")
    fit = calibrate.cluster_split(rows, list(families)).where("split = 'calibration'")
    return calibrate.calibrated(fit.select(F.xxhash64("a", "b").alias("pos"), "a", "b", F.col("relation").alias("true"), "perceptual", F.col("semantic_q").alias("semantic")), base, date, **how)


def study_point(method: str, scores: DataFrame, rho: float, composition: str, seed: int, mode: str = "single", gate: str = "", compression: float = 0.0, action_cost: float = 0.0, intrinsic: float = 0.0, action_f1: float | None = None) -> DataFrame:
    """One study row from the scores of downstream tasks (success) and what an episode came to."""
    done = scores.agg(F.coalesce(F.avg(F.col("success").cast("double")), F.lit(0.0)).alias("downstream_success"))
    given = {"method": method, "gate": gate, "rho": float(rho), "composition": composition, "seed": int(seed), "mode": mode, "compression": float(compression), "action_cost": float(action_cost), "intrinsic_score": float(intrinsic)}
    return done.select(*(F.lit(v).alias(k) for k, v in given.items()), "downstream_success", F.lit(action_f1).cast("double").alias("action_f1"))


def write_report(result: Result, out: str, t: Thresholds = Thresholds()) -> list[str]:
    """CSV tables, a Markdown report and a JSON summary below the local folder ``out`` of the driver; the tables are bounded by the library's pairs."""
    where = Path(out)
    where.mkdir(parents=True, exist_ok=True)
    tracks = [r["track"] for r in result.verdicts.select("track").distinct().orderBy("track").collect()]
    tables = {"tracks": track_summaries(result, sorted({*tracks, *result.failed}))}
    if "output" in tracks:
        tables |= {"relations": metrics.per_relation_prf(result.truth, result.track("output")), "confusion": metrics.confusion_matrix(result.truth, result.track("output"))}
        tables |= {f"divergence_{x}": metrics.divergence(result.track("output"), result.track(x), result.truth) for x in tracks if x != "output"}
    positive = result.verdicts.where("track <> 'output'").join(result.truth.select("a", "b", F.col("relation").isin("EXACT", "PERCEPTUAL").alias("positive"), "hard"), ["a", "b"])
    tables["operating_points"] = calibrate.operating_points(positive.select("track", "score", "positive", "hard"))
    tables["per_pair"] = files.per_pair(result.verdicts.select("a", "b", "track", "mergeable", "score"))
    for name, df in tables.items():
        df.toPandas().to_csv(where / f"{name}.csv", index=False, float_format="%.4f")
    (where / "report.md").write_text(files.markdown("Benchmark", tables))
    files.write_json(str(where / "summary.json"), {"thresholds": asdict(t), "failed": result.failed, "tracks": json.loads(tables["tracks"].toPandas().to_json(orient="records"))})
    return sorted(p.name for p in where.iterdir())


def designed(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "a string, b string, relation string, spec string, gen string, hard boolean")
