"""Suites of constraints over tables, checked in one scan of each table however many rules there are.

A rule is a predicate of a row, the uniqueness of a value, the presence of a
value in another table, or its absence there. Each table's rows become events
(rule, value, side): those that break a predicate, and the values that other
kinds compare; a row that keeps all predicates and has no such value gives one
event for the count of rows. The events of all tables are grouped by rule and
value once, after partial aggregation, so that a predicate costs a row a task
and a value that many rows have is no large group; what a group breaks is read
off its two counts. Of the offending rows a sample of bounded size is kept:
keys fall into ``SLOTS`` slots by their hash and each slot keeps the least, so
that samples merge, are the same at each run, and don't grow.

Defined cases: a predicate that is null is broken; null values are no values,
so they are never doubled, missing or shared (a rule of its own says that they
must not be there); a table without rows keeps all rules. Uniqueness counts all
rows of a value that occurs more than once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import cut

SLOTS = 8
KINDS = ("row", "unique", "present", "absent")
STATUSES = ("pass", "warn", "fail", "pending")


@dataclass(frozen=True)
class Rule:
    """``what``: the predicate of a row rule, else the value. ``other``: (table, value) for present and absent. ``severity``: the status if it is broken."""

    name: str
    table: str
    kind: str
    what: str
    other: tuple[str, str] | None = None
    severity: str = "fail"

    def __post_init__(self) -> None:
        if self.kind not in KINDS or self.severity not in STATUSES[1:3]:
            raise ValueError(f"{self.name}: unknown kind or severity")
        if (self.kind in ("present", "absent")) != (self.other is not None):
            raise ValueError(f"{self.name}: present and absent need another table, others have none")


def hex64(column: str) -> str:
    """The predicate of 64 hexadecimal digits."""
    return f"{column} RLIKE '^[0-9a-fA-F]{{64}}$'"


def _events(table: str, df: DataFrame, key: str, rules: Sequence[Rule]) -> DataFrame:
    """number, value, side, key: what one scan of a table tells of all rules."""
    event = lambda n, value, side, keep: F.when(keep, F.struct(F.lit(n).alias("number"), value.cast("string").alias("value"), F.lit(side).alias("side")))
    made = [F.struct(F.lit(-1).alias("number"), F.lit(table).alias("value"), F.lit(0).alias("side"))]
    for n, r in enumerate(rules):
        if r.table == table:
            what = F.expr(r.what)
            made.append(event(n, F.lit(None), 0, ~F.coalesce(what.cast("boolean"), F.lit(False))) if r.kind == "row" else event(n, what, 0, what.isNotNull()))
        if r.other and r.other[0] == table:
            value = F.expr(r.other[1])
            made.append(event(n, value, 1, value.isNotNull()))
    rows = df.select(F.expr(key).cast("string").alias("key"), F.array_compact(F.array(*made)).alias("made"))
    return rows.select("key", F.inline("made"))


def report(tables: Mapping[str, tuple[DataFrame, str]], rules: Sequence[Rule]) -> DataFrame:
    """One row per rule: name, table, kind, n_rows, n_bad, status, least (of the offending keys, as text), sample. tables: name to (rows, key expression); a table that isn't there leaves its rules pending."""
    if len({r.name for r in rules}) < len(rules):
        raise ValueError("two rules have one name")
    parts = [_events(t, df, key, rules) for t, (df, key) in tables.items()]
    events = parts[0]
    for p in parts[1:]:
        events = events.unionByName(p)
    slot = F.pmod(F.xxhash64("key"), F.lit(SLOTS))
    own = F.col("side") == 0
    least = [F.min(F.when(own & (slot == k), F.col("key"))).alias(f"s{k}") for k in range(SLOTS)]  # the least of all is among them
    groups = events.groupBy("number", "value").agg(F.count_if(own).alias("n"), F.count_if(~own).alias("m"), *least)
    spark = events.sparkSession
    known = spark.createDataFrame([(n, r.name, r.table, r.kind, r.severity, r.table in tables and (not r.other or r.other[0] in tables)) for n, r in enumerate(rules)], "number int, name string, table string, kind string, severity string, there boolean")
    named = groups.join(F.broadcast(known.select("number", "kind")), "number", "left")  # a row a rule
    bad = F.when(F.col("kind") == "unique", F.col("n") > 1).when(F.col("kind") == "present", F.col("m") == 0).when(F.col("kind") == "absent", F.col("m") > 0).otherwise(F.lit(True))
    which = F.when(F.col("number") == -1, F.col("value"))
    sums = named.groupBy("number", which.alias("of")).agg(F.sum(F.when(bad, F.col("n")).otherwise(0)).alias("n_bad"), *(F.min(F.when(bad, F.col(f"s{k}"))).alias(f"s{k}") for k in range(SLOTS)))
    sums = cut(sums)  # a row a rule and a table; read twice
    broken, sizes = sums.where("number >= 0").drop("of"), sums.where("number = -1").select(F.col("of").alias("table"), F.col("n_bad").alias("n_rows"))
    told = known.join(broken, "number", "left").join(F.broadcast(sizes), "table", "left")
    n_bad = F.coalesce("n_bad", F.lit(0))
    sample = F.array_sort(F.array_compact(F.array(*(F.col(f"s{k}") for k in range(SLOTS)))))
    status = F.when(~F.col("there"), "pending").when(n_bad == 0, "pass").otherwise(F.col("severity"))
    return told.select("name", "table", "kind", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), n_bad.alias("n_bad"), status.alias("status"), F.array_min(sample).alias("least"), sample.alias("sample"))


def checks(rows: DataFrame) -> DataFrame:
    """One row per table: its worst status, its rows and the names of the broken rules."""
    worst = F.max(F.when(F.col("status") == "fail", 3).when(F.col("status") == "warn", 2).when(F.col("status") == "pending", 1).otherwise(0))
    named = F.array_sort(F.collect_list(F.when(F.col("status").isin("fail", "warn"), F.col("name"))))  # no more than rules
    out = rows.groupBy("table").agg(worst.alias("w"), F.max("n_rows").alias("n_rows"), named.alias("broken"))
    return out.select("table", F.element_at(F.array(*(F.lit(s) for s in ("pass", "pending", "warn", "fail"))), F.col("w") + 1).alias("status"), "n_rows", "broken")


# ---- the suites of this engine's own manifests ---------------------------------------------------------------------

#: probes: probe_id, sha256, domain, height, width, license struct<name, redistributable, allows_derivatives>
PROBE_RULES = (
    Rule("probe_id is there", "probes", "row", "probe_id IS NOT NULL AND probe_id <> ''"),
    Rule("probe_id is unique", "probes", "unique", "probe_id"),
    Rule("sha256 has 64 digits", "probes", "row", hex64("sha256")),
    Rule("the licence has a name", "probes", "row", "trim(license.name) <> '' AND lower(trim(license.name)) <> 'unknown'"),
    Rule("the licence allows use", "probes", "row", "license.redistributable AND license.allows_derivatives"),
    Rule("a probe has pixels", "probes", "row", "height > 0 AND width > 0"),
)
#: queries: query_id, split, input_id, input_sha256, reference_sha256, pipeline array<string>, expected array<string>
QUERY_RULES = (
    Rule("query_id is unique", "queries", "unique", "query_id"),
    Rule("input_id is unique", "queries", "unique", "input_id"),
    Rule("input_sha256 has 64 digits", "queries", "row", hex64("input_sha256")),
    Rule("reference_sha256 has 64 digits", "queries", "row", hex64("reference_sha256")),
    Rule("a query has steps", "queries", "row", "size(pipeline) > 0"),
    Rule("expected functions are the steps' in order", "queries", "row", "array_distinct(pipeline) = expected"),
    Rule("no input is a probe", "queries", "absent", "lower(input_sha256)", ("probes", "lower(sha256)")),
    Rule("no id is a probe's", "queries", "absent", "input_id", ("probes", "probe_id")),
    Rule("splits share no function", "used", "absent", "IF(split = 'dev', skill_id, NULL)", ("used", "IF(split <> 'dev', skill_id, NULL)")),
)
#: instances: name, n_sites, n_added, n_base, n_skills, n_defects, n_passed; files: instance, file
INSTANCE_RULES = (
    Rule("an instance is there once", "instances", "unique", "name"),
    Rule("sizes add up", "instances", "row", "n_skills = n_base + n_added"),
    Rule("all defects do what they say", "instances", "row", "n_passed = n_defects", severity="warn"),
    *(Rule(f"{f} is there", "instances", "present", f"concat(name, '/{f}')", ("files", "concat(instance, '/', file)")) for f in ("corruption_log.json", "library.json", "g_rho.json", "ideal_actions.json")),
)
#: points: method, composition, mode, rho, seed
POINT_RULES = (
    Rule("a point has its method, composition and mode", "points", "row", "trim(method) <> '' AND trim(composition) <> '' AND trim(mode) <> ''"),
    Rule("a point is there once", "points", "unique", "concat_ws('|', method, gate, rho, composition, seed, mode)"),
)


def audit(**tables: DataFrame) -> DataFrame:
    """The rules of all manifests that there are: probes, queries, instances, files, points. What isn't given is pending."""
    keys = {"probes": "probe_id", "queries": "query_id", "instances": "name", "files": "file", "points": "method", "used": "query_id"}
    if "queries" in tables:
        tables["used"] = tables["queries"].select("query_id", "split", F.explode("expected").alias("skill_id"))
    return report({t: (df, keys[t]) for t, df in tables.items()}, [*PROBE_RULES, *QUERY_RULES, *INSTANCE_RULES, *POINT_RULES])
