"""Command line: ``python -m kinfold COMMAND``. Every command prints a short JSON summary of what it did."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence
from dataclasses import asdict

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import images
from .operators import constraints, corrupt, execute, instances, planning, studies
from .operators.alignment import Alignment, load_alignment
from .plans import benchmark, curation, downstream, live
from .sources import files, probes


def _library() -> pd.DataFrame:
    return pd.DataFrame([{"id": s.id, "n_params": len(s.params), "numeric_params": sum(p.type in ("int", "float") for p in s.params)} for s in images.LIBRARY.values()])


def _battery(spark: SparkSession, a: argparse.Namespace):  # noqa: ANN202
    return probes.battery(spark, dict.fromkeys(probes.DOMAINS, a.probes), a.size, a.seed)


def run(a: argparse.Namespace, spark: SparkSession) -> dict:
    if a.command == "config":
        return asdict(files.load_thresholds(a.config))
    if a.command == "skills":
        if a.out:
            files.save_registry(list(images.LIBRARY.values()), a.out)
        return {"skills": len(images.LIBRARY), "families": sorted({s.family for s in images.LIBRARY.values()})}
    if a.command == "build-probes":
        _battery(spark, a).write.mode("overwrite").parquet(a.out)
        return {"probes": spark.read.parquet(a.out).count()}
    if a.command in ("freeze-oracle", "freeze-sweep-oracle"):
        battery = spark.read.parquet(a.battery) if a.battery else _battery(spark, a)
        if a.command == "freeze-oracle":
            rows = execute.freeze_oracle(battery)
        else:
            alignment = load_alignment(a.alignment)
            members = sorted({s for x in alignment.axes for s in x.members} | set(alignment.grids))
            rows = execute.run_bindings(battery, [(s, p, 0) for s in members for p in (*alignment.grid_for(s), *alignment.grids.get(s, ()))], twice=True).drop("image")
        rows.write.mode("overwrite").parquet(a.out)
        return {r["status"]: r["n"] for r in spark.read.parquet(a.out).groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
    if a.command == "build-queries":
        downstream.build_queries(spark, a.repeats).write.mode("overwrite").parquet(a.out)
        return {"queries": spark.read.parquet(a.out).count()}
    if a.command == "run-benchmark":
        alignment, t = load_alignment(a.alignment) if a.alignment else Alignment(), files.load_thresholds(a.config)
        truth = files.relation_graph(spark, a.truth)
        result = benchmark.run_benchmark(_battery(spark, a), images.LIBRARY, truth, None, t, alignment)
        if a.calibrate:
            t = benchmark.calibrate_from_result(result, images.LIBRARY, a.calibrate.split(","), t, a.date)
            result = benchmark.run_benchmark(_battery(spark, a), images.LIBRARY, truth, None, t, alignment)
        return {"files": benchmark.write_report(result, a.out, t), "failed": result.failed}
    if a.command == "corrupt":
        plan = planning.plan_instance(_library(), a.rho, a.composition, a.seed, a.mode)
        made = corrupt.apply_plan(images.LIBRARY, plan, a.seed)
        report = corrupt.checked(_battery(spark, a), images.LIBRARY, plan, made, a.seed)
        found = {r["type"]: [r["n"], r["passed"]] for r in corrupt.qa_counts(report).collect()}
        if a.out:
            files.write_json(a.out, {"plan": plan.to_dict("records"), "ideal": made.ideal, "relations": made.relations, "checks": found})
        return {"defects": len(plan), "added": len(made.added), "checks": found}
    if a.command == "corrupt-grid":
        rhos, seeds = [float(x) for x in a.rhos.split(",")], [int(x) for x in a.seeds.split(",")]
        plans = planning.corruption_grid(spark, _library(), rhos, list(planning.COMPOSITIONS), seeds)
        done, how = instances.generate(plans, _battery(spark, a), images.LIBRARY)
        instances.write_artifacts(done, images.LIBRARY, a.out)
        found = instances.manifests(done, len(images.LIBRARY)).agg(F.count(F.lit(1)).alias("instances"), F.sum("n_defects").alias("defects"), F.sum("n_passed").alias("passed")).first()
        return found.asDict() | how
    if a.command == "curate":
        actions = json.loads(open(a.actions).read())
        if not a.truth:  # judged from executed outputs as the actions come up
            alignment = load_alignment(a.alignment) if a.alignment else Alignment()
            rows = [("episode", i, *(x.get(k) for k in live.ACTION)) for i, x in enumerate(actions)]
            acts = spark.createDataFrame(rows, "episode string, step long, " + ", ".join(f"{k} string" for k in live.ACTION))
            done = live.run_rounds(acts, {i: {} for i in images.LIBRARY}, live.skill_judge(_battery(spark, a), images.LIBRARY, alignment=alignment), a.budget)
            log = [r.asDict() for r in done.log.orderBy("step").collect()]
            return {"log": log, "skills": log[-1]["size_after"] if log else len(images.LIBRARY), "judged": done.verdicts.count(), "rounds": done.rounds}
        truth = files.relation_graph(spark, a.truth).collect()
        verdicts = {(r["a"], r["b"]): (r["relation"], "NONE" if r["spec"] is None else "B_SUBSUMES_A" if r["spec"] == r["a"] else "A_SUBSUMES_B") for r in truth}
        library = curation.Library({i: {} for i in images.LIBRARY}, verdicts, budget=a.budget)
        log = curation.run_episode(library, curation.scripted(actions))
        return {"log": log, "skills": len(library.skills)}
    if a.command == "run-downstream":
        queries = downstream.build_queries(spark, a.repeats)
        plans = {"expected": lambda q: downstream.expected_plans(q), "none": lambda q: downstream.no_plans(q), "keyword": lambda q: downstream.keyword_plans(q, downstream.library_table(spark))}[a.solver](queries)
        scores = downstream.evaluate(queries, plans)
        if a.out:
            downstream.write_scores(scores, a.out)
        return {str(r["split"] or "all"): r["success_rate"] for r in studies.success_by_split(scores).collect()}
    if a.command == "study":
        points = files.study_points(spark, a.points)
        values = ["downstream_success", "compression", "action_cost", "intrinsic_score", "action_f1"]
        tables = {"groups": studies.aggregate_points(points, values), "front": studies.pareto_front(points, ["downstream_success", "compression"], ["action_cost"]).drop("metadata"), "validity": studies.construct_validity(points, "intrinsic_score", "downstream_success"), "ablation": studies.ablation(points, values)}
        with open(a.out, "w") as f:
            f.write(files.markdown("Study", tables))
        return {name: df.count() for name, df in tables.items()}
    if a.command == "audit":
        rows = files.artifacts(spark, a.paths).collect()
        tables = {t: spark.read.parquet(p) for t in ("probes", "queries", "instances", "files", "points") if (p := getattr(a, t))}
        rules = [r.asDict() for r in constraints.audit(**tables).orderBy("table", "name").collect()] if tables else []
        files.write_json(a.out, {"artifacts": [r.asDict() for r in rows], "rules": rules})
        told = {"rules": {k: sum(r["status"] == k for r in rules) for k in constraints.STATUSES}} if rules else {}
        return {"present": sum(r["present"] for r in rows), "asked": len(rows)} | told
    raise ValueError(a.command)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("kinfold")
    commands = p.add_subparsers(dest="command", required=True)

    def add(name: str, *options: tuple, out: bool | None = False) -> None:
        c = commands.add_parser(name)
        for flag, kind, default in options:
            c.add_argument(f"--{flag}", type=kind, default=default)
        if out is not None:
            c.add_argument("--out", required=out)

    shape = (("probes", int, 5), ("size", int, 48), ("seed", int, 1234))
    add("config", ("config", str, None), out=None)
    add("skills")
    add("build-probes", *shape, out=True)
    add("freeze-oracle", *shape, ("battery", str, None), out=True)
    add("freeze-sweep-oracle", *shape, ("battery", str, None), ("alignment", str, None), out=True)
    add("build-queries", ("repeats", int, 1), out=True)
    add("run-benchmark", *shape, ("truth", str, None), ("alignment", str, None), ("config", str, None), ("calibrate", str, None), ("date", str, ""), out=True)
    add("corrupt", *shape, ("rho", float, 0.1), ("composition", str, "uniform"), ("mode", str, "single"))
    add("corrupt-grid", *shape, ("rhos", str, "0.1,0.5,1.0"), ("seeds", str, "0"), out=True)
    add("curate", *shape, ("actions", str, None), ("truth", str, None), ("alignment", str, None), ("budget", int, 200), out=None)
    add("run-downstream", ("repeats", int, 1), ("solver", str, "expected"))
    add("study", ("points", str, None), out=True)
    add("audit", *((t, str, None) for t in ("probes", "queries", "instances", "files", "points")), out=True)
    commands.choices["audit"].add_argument("paths", nargs="*")
    return p


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("kinfold").getOrCreate()
    print(json.dumps(run(a, spark), indent=2, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
