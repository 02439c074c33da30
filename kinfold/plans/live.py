"""Live curation: episodes whose structural actions are judged from executed outputs when they come up.

Episodes run side by side in rounds. In a round every episode that isn't over
goes on, in its task, until an action needs a verdict that nobody has asked
for yet; it stops there and says which pair. The distinct pairs of all
episodes are executed on the battery and classified once, with the binding by
which one absorbs the other, and join the table of verdicts; then the next
round begins from the table of states. So a pair is judged once, whichever
episodes ask for it and however many, and never if no library still holds both
when its action comes up. There are no more rounds than structural actions in
an episode.

The state of an episode is one row: the changes to the library, what is left
of the budget, the log, and the actions that are still to come. Of these no
more than the budget allows for are kept, before episodes are brought together,
so an episode of any number of actions is no large row. States are written
after each round; verdicts are bounded by the pairs of the library.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.images import Skill
from ..operators import compare
from ..operators._store import cut
from ..operators.alignment import Alignment
from ..operators.compare import Thresholds
from . import benchmark
from .curation import Library

VERDICT = "a string, b string, relation string, direction string, binding_a string, binding_b string"
ACTION = ("kind", "primary", "secondary", "name", "description", "default")
_LOG = "array<struct<step:bigint,kind:string,status:string,primary:string,secondary:string,relation:string,binding:string,reason:string,size_before:int,size_after:int>>"
_STATE = f"episode string, over boolean, need_a string, need_b string, todo string, library string, log {_LOG}"


class Unjudged(Exception):
    """No verdict on this pair yet."""


@dataclass
class LiveLibrary(Library):
    """A library that stops where a verdict is missing, and absorbs with the binding that the outputs show.

    verdicts: (a, b) in order of name to (relation, direction, binding of a
    that gives b's outputs, binding of b that gives a's).
    """

    bindings: dict[tuple[str, str], tuple[str | None, str | None]] = field(default_factory=dict)
    last: tuple[str | None, str | None] = (None, None)

    def relation(self, a: str, b: str) -> tuple[str, str]:
        if (min(a, b), max(a, b)) not in self.verdicts:
            raise Unjudged(min(a, b), max(a, b))
        told = super().relation(a, b)
        self.last = told[0], None
        return told

    def _parameterize(self, a: dict[str, Any]) -> tuple[str, str]:
        status, reason = super()._parameterize(a)
        if status == "applied":
            x, y = a["primary"], a["secondary"]
            binding = self.bindings.get((min(x, y), max(x, y)), (None, None))[x < y]
            self.skills[y]["absorbed"][x] = binding
            self.last = self.last[0], binding
        return status, reason


def _advance(skills: dict[str, dict[str, Any]], verdicts: dict[tuple[str, str], tuple], budget: int) -> Callable:
    relations = {k: v[:2] for k, v in verdicts.items()}
    bindings = {k: v[2:] for k, v in verdicts.items()}

    def one(row: dict[str, Any]) -> dict[str, Any]:
        held, todo, log = json.loads(row["library"]), json.loads(row["todo"]), [dict(x) for x in row["log"]]
        library = LiveLibrary(
            {k: dict(v) for k, v in skills.items() if k not in held["gone"]} | held["changed"], relations, budget, held["taken"], used=held["used"], bindings=bindings
        )
        need, over, done = (None, None), False, 0
        for a in todo:
            if not library.budget_remaining:
                break
            before, library.last = len(library.skills), (None, None)
            try:
                told = library.apply(a)
            except Unjudged as e:
                need = e.args
                break
            done += 1
            relation, binding = library.last
            log.append({"step": a["step"], "relation": relation, "binding": binding, "size_before": before} | {k: told[k] for k in ("kind", "status", "primary", "secondary", "reason", "size_after")})
            if told["kind"] == "end":
                over = True
                break
        over = over or need[0] is None
        changed = {k: v for k, v in library.skills.items() if v != skills.get(k)}
        held = {"gone": [k for k in skills if k not in library.skills], "changed": changed, "taken": library.taken, "used": library.used}
        return {"episode": row["episode"], "over": over, "need_a": need[0], "need_b": need[1], "todo": json.dumps(todo[done:] if not over else []), "library": json.dumps(held), "log": log}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([one(r) for r in b.to_dict("records")], columns=[c.split()[0] for c in _STATE.split(", ")])

    return run


def begun(actions: DataFrame, budget: int) -> DataFrame:
    """The first state of each episode. actions: episode, step, and any of ``ACTION``; ties of a step go by kind, primary, secondary."""
    order = [F.col(c) for c in ("step", "kind", "primary", "secondary")]
    nth = F.row_number().over(Window.partitionBy("episode").orderBy(*order))
    # The optimizer limits this window before its shuffle, so a long episode sends a budget's rows a task.
    first = actions.withColumn("nth", nth).where(F.col("nth") <= budget)
    row = F.struct("nth", F.col("step").cast("long").alias("step"), *(F.col(c) for c in ACTION if c in actions.columns))
    todo = F.to_json(F.array_sort(F.collect_list(row)))
    none = {"gone": [], "changed": {}, "taken": 0, "used": {}}
    return first.groupBy(F.col("episode").cast("string").alias("episode")).agg(todo.alias("todo")).select(
        "episode", F.lit(False).alias("over"), F.lit(None).cast("string").alias("need_a"), F.lit(None).cast("string").alias("need_b"), "todo", F.lit(json.dumps(none)).alias("library"), F.array().cast(_LOG).alias("log"),
    )


@dataclass
class Curated:
    """states: one row an episode (``library`` as JSON: gone, changed, taken, used). verdicts: what was asked for and judged. rounds: how many it took."""

    states: DataFrame
    verdicts: DataFrame
    rounds: int

    @property
    def log(self) -> DataFrame:
        return self.states.select("episode", F.explode("log").alias("r")).select("episode", "r.*")


def run_rounds(actions: DataFrame, skills: Mapping[str, Mapping[str, Any]], judge: Callable[[Sequence[tuple[str, str]]], DataFrame], budget: int = 50) -> Curated:
    """All episodes, each from the library ``skills`` (id to trusted and the like). ``judge`` gives verdicts (``VERDICT``) of pairs in order of name."""
    spark = actions.sparkSession
    own = {k: dict(v) for k, v in skills.items()}
    known: dict[tuple[str, str], tuple] = {}
    states, rounds = cut(begun(actions, budget).mapInPandas(_advance(own, known, budget), _STATE)), 1
    while True:
        # No more pairs than the library has.
        asked = sorted(tuple(r) for r in states.where("NOT over").select("need_a", "need_b").distinct().collect())
        if not asked:
            break
        known |= {(r["a"], r["b"]): (r["relation"], r["direction"], r["binding_a"], r["binding_b"]) for r in judge(asked).collect()}
        if missing := [p for p in asked if p not in known]:
            raise ValueError(f"no verdict on {missing}")
        live = states.where("NOT over").mapInPandas(_advance(own, dict(known), budget), _STATE)
        states, rounds = cut(states.where("over").unionByName(live)), rounds + 1
    return Curated(states, spark.createDataFrame([(*k, *v) for k, v in sorted(known.items())], VERDICT), rounds)


# ---- judges --------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Grid:
    """A function with one parameter: its name, its values in order, the default, and the expression."""

    param: str
    values: tuple[int, ...]
    default: int
    fn: Callable[[Column, int], Column]


#: Functions on 8x8 probes that have a parameter.
GRIDS = {
    "posterize": Grid("bits", tuple(range(1, 9)), 4, lambda px, k: F.transform(px, lambda v: F.shiftleft(F.shiftright(v, 8 - k), 8 - k))),
    "brightness_add": Grid("amount", (0, 5, 10, 15, 20, 30), 20, lambda px, k: F.transform(px, lambda v: F.least(v + k, F.lit(255)))),
}


def probe_judge(battery: DataFrame, t: Thresholds = Thresholds(), grids: Mapping[str, Grid] = GRIDS) -> Callable[[Sequence[tuple[str, str]]], DataFrame]:
    """Verdicts on 8x8 probes (``compare.probes``), by expressions alone: all asked pairs in one pass over the battery for distances and one for bindings."""

    def out(skill: str, px: Column, k: int | None = None) -> Column:
        return S.SKILLS[skill](px) if skill in S.SKILLS else grids[skill].fn(px, grids[skill].default if k is None else k)

    def bindings(skill: str) -> Sequence[int | None]:
        return grids[skill].values if skill in grids else (None,)

    def judge(pairs: Sequence[tuple[str, str]]) -> DataFrame:
        asked = battery.sparkSession.createDataFrame(list(pairs), "a string, b string")
        px = F.col("px")
        each = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), out(a, px).alias("pa"), out(b, px).alias("pb")) for a, b in pairs))
        told = compare.measured(compare.distances(battery.select("probe_id", F.explode(each).alias("p")).select("probe_id", "p.*")), t)
        free = [(a, b) for a, b in pairs if a in grids or b in grids]
        if free:
            made = sorted({(s, n) for p in free for s in p for n in range(len(bindings(s)))})  # each output once a probe
            place = {m: n for n, m in enumerate(made)}
            outs = F.array(*(out(s, px, bindings(s)[n]) for s, n in made))
            met = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(place[a, i]).alias("x"), F.lit(place[b, j]).alias("y")) for a, b in free for i in range(len(bindings(a))) for j in range(len(bindings(b)))))
            rows = battery.select(outs.alias("o")).select("o", F.explode(met).alias("h")).select("h.a", "h.b", "h.i", "h.j", F.get("o", F.col("h.x")).alias("pa"), F.get("o", F.col("h.y")).alias("pb"))
            hits = rows.groupBy("a", "b", "i", "j").agg(F.bool_and(S.max_abs_diff(F.col("pa"), F.col("pb")) <= t.epsilon).alias("ok"))
            side = lambda at, best: hits.groupBy("a", "b", at).agg(F.bool_or("ok").alias("ok")).groupBy("a", "b").agg(F.bool_and("ok").alias(best))
            ways = side("i", "a_found").join(side("j", "b_found"), ["a", "b"])
            own = lambda s: grids[s].values.index(grids[s].default) if s in grids else 0
            default = hits.join(battery.sparkSession.createDataFrame([(a, b, own(a), own(b)) for a, b in free], "a string, b string, da int, db int"), ["a", "b"])
            first = default.groupBy("a", "b").agg(F.min(F.when(F.col("ok") & (F.col("j") == F.col("db")), F.col("i"))).alias("i"), F.min(F.when(F.col("ok") & (F.col("i") == F.col("da")), F.col("j"))).alias("j"))
            directed = ways.join(first, ["a", "b"]).select("a", "b", "i", "j", F.when(F.col("a_found") & F.col("b_found"), "MUTUAL_EXACT").when(F.col("a_found"), "B_SUBSUMES_A").when(F.col("b_found"), "A_SUBSUMES_B").otherwise("NONE").alias("d"))
        else:
            directed = asked.select("a", "b", F.lit(None).cast("int").alias("i"), F.lit(None).cast("int").alias("j"), F.lit(None).cast("string").alias("d"))
        named = [(s, k, f"{g.param}={v}", v == g.default) for s, g in grids.items() for k, v in enumerate(g.values)]
        names = battery.sparkSession.createDataFrame(named, "s string, k int, name string, own boolean")

        def binding(df: DataFrame, skill: str, at: str) -> DataFrame:
            """The binding at that place of the grid, the default where none gives the outputs; null without parameters."""
            own = names.select(F.col("s").alias(skill), F.col("k").alias("_k"), F.col("name").alias("_n"), "own")
            found = df.join(F.broadcast(own), (df[skill] == own[skill]) & F.when(df[at].isNull(), own["own"]).otherwise(df[at] == own["_k"]), "left").drop(own[skill])
            return found.withColumnRenamed("_n", f"binding_{skill}").drop("_k", "own")

        rows = binding(binding(asked.join(told, ["a", "b"], "left").join(directed, ["a", "b"], "left").fillna(0, ["n_probes"]), "a", "i"), "b", "j")
        rows = rows.withColumn("relation", compare.relation(t, direction=F.col("d")))
        return rows.select("a", "b", "relation", F.when(F.col("relation") == "SUBSUMPTION", F.col("d")).otherwise("NONE").alias("direction"), "binding_a", "binding_b")

    return judge


def skill_judge(battery: DataFrame, known: Mapping[str, Skill], t: Thresholds = Thresholds(), alignment: Alignment = Alignment()) -> Callable[[Sequence[tuple[str, str]]], DataFrame]:
    """Verdicts of the library's own functions on images: ``benchmark.output_verdicts``, and the bindings that absorb."""

    def judge(pairs: Sequence[tuple[str, str]]) -> DataFrame:
        verdicts, _ = benchmark.output_verdicts(battery, pairs, known, t, alignment)
        rows = []
        for r in verdicts.collect():  # a row a pair that was asked for
            found: list[str | None] = [None, None]
            if r["relation"] in ("SUBSUMPTION", "SEMANTIC_PRESERVING"):
                for n, (spec, gen) in enumerate(((r["b"], r["a"]), (r["a"], r["b"]))):
                    if known[gen].params:
                        given = benchmark.binding_that_absorbs(battery, spec, gen, known, alignment, t)
                        found[n] = json.dumps(known[gen].defaults() if given is None else given, sort_keys=True)
            rows.append((r["a"], r["b"], r["relation"], r["direction"], *found))
        return battery.sparkSession.createDataFrame(rows, VERDICT)

    return judge
