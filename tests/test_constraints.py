"""Constraint suites: counts, samples, one scan a table, and the suites of the engine's own manifests."""

import pytest
from pyspark.sql import functions as F

from kinfold.operators import constraints
from kinfold.operators.constraints import Rule

HEX = "a" * 64


def by_name(df):
    return {r["name"]: r for r in df.collect()}


def test_every_kind(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "b", None), (3, "b", 7), (4, None, -1), (None, "z", 9), (6, "b", 2)], "id long, v string, n long")
    right = spark.createDataFrame([("a",), ("b",), (None,), ("q",)], "w string")
    rules = [
        Rule("positive", "left", "row", "n > 0"), Rule("alone", "left", "unique", "v"), Rule("known", "left", "present", "v", ("right", "w")), Rule("new", "left", "absent", "v", ("right", "w")),
        Rule("id", "left", "unique", "id"), Rule("used", "right", "present", "w", ("left", "v"), severity="warn"), Rule("later", "gone", "row", "x > 0"), Rule("all fine", "right", "row", "w IS NULL OR length(w) = 1"),
    ]
    got = by_name(constraints.report({"left": (left, "id"), "right": (right, "w")}, rules))
    want = {"positive": (6, 2, "fail", "2"), "alone": (6, 3, "fail", "2"), "known": (6, 1, "fail", None), "new": (6, 4, "fail", "1"), "id": (6, 0, "pass", None), "used": (4, 1, "warn", "q"), "later": (0, 0, "pending", None), "all fine": (4, 0, "pass", None)}
    assert {k: (r["n_rows"], r["n_bad"], r["status"], r["least"]) for k, r in got.items()} == want
    tables = {r["table"]: (r["status"], r["n_rows"], r["broken"]) for r in constraints.checks(constraints.report({"left": (left, "id"), "right": (right, "w")}, rules)).collect()}
    assert tables == {"left": ("fail", 6, ["alone", "known", "new", "positive"]), "right": ("warn", 4, ["used"]), "gone": ("pending", 0, [])}


def test_samples_are_bounded_and_the_same_however_rows_are_dealt(spark):
    rows = spark.range(20_000).select(F.col("id"), (F.col("id") % 3).alias("v"), F.lit("one").alias("hot"))
    rules = [Rule("v", "t", "row", "v = 0"), Rule("hot", "t", "unique", "hot")]
    first, second = (by_name(constraints.report({"t": (rows.repartition(n), "id")}, rules)) for n in (1, 7))
    assert first == second and len(first["v"]["sample"]) == constraints.SLOTS and first["v"]["n_bad"] == 13_333
    assert first["hot"]["n_bad"] == 20_000 and first["hot"]["least"] == "0" and all(int(k) % 3 for k in first["v"]["sample"])


def test_a_table_is_read_once_for_all_rules(spark, tmp_path):
    spark.range(100).select("id", (F.col("id") % 10).alias("v")).write.parquet(str(tmp_path / "t"))
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            reads.add(len(b))
            yield b

    df = spark.read.parquet(str(tmp_path / "t")).mapInPandas(counted, "id long, v long")
    rules = [Rule(f"r{k}", "t", "row", f"v <> {k}") for k in range(12)] + [Rule("u", "t", "unique", "v"), Rule("p", "t", "present", "v", ("t", "id"))]
    got = by_name(constraints.report({"t": (df, "id")}, rules))
    assert reads.value == 100 and got["r3"]["n_bad"] == 10 and got["r11"]["n_bad"] == 0 and got["u"]["n_bad"] == 100 and got["p"]["status"] == "pass"


def test_empty_tables_and_bad_rules(spark):
    empty = spark.createDataFrame([], "id long, v string")
    got = by_name(constraints.report({"t": (empty, "id")}, [Rule("a", "t", "row", "v = 'x'"), Rule("b", "t", "unique", "v")]))
    assert all((r["n_rows"], r["n_bad"], r["status"], r["sample"]) == (0, 0, "pass", []) for r in got.values())
    for wrong in (dict(kind="none"), dict(kind="present"), dict(kind="row", other=("t", "v")), dict(kind="row", severity="pass")):
        with pytest.raises(ValueError):
            Rule("n", "t", what="v", **wrong)
    with pytest.raises(ValueError, match="one name"):
        constraints.report({"t": (empty, "id")}, [Rule("a", "t", "row", "v = 'x'")] * 2)


def test_audit_of_manifests(spark):
    licence = "license struct<name: string, redistributable: boolean, allows_derivatives: boolean>"
    good, bad = ("CC0", True, True), (" Unknown", True, False)
    probes = spark.createDataFrame([("p1", HEX, 4, 4, good), ("p2", HEX[:-1], 4, 0, good), ("p2", "B" * 64, 4, 4, bad)], f"probe_id string, sha256 string, height int, width int, {licence}")
    queries = [("q1", "dev", "i1", "c" * 64, HEX, ["f", "g", "f"], ["f", "g"]), ("q2", "test", "i1", "b" * 64, HEX, ["g"], ["g"]), ("q3", "test", "p1", "d" * 64, "x", [], ["h"])]
    queries = spark.createDataFrame(queries, "query_id string, split string, input_id string, input_sha256 string, reference_sha256 string, pipeline array<string>, expected array<string>")
    got = by_name(constraints.audit(probes=probes, queries=queries))
    broken = {k: r["n_bad"] for k, r in got.items() if r["status"] == "fail"}
    assert broken == {
        "probe_id is unique": 2, "sha256 has 64 digits": 1, "the licence has a name": 1, "the licence allows use": 1, "a probe has pixels": 1, "input_id is unique": 2, "reference_sha256 has 64 digits": 1, "a query has steps": 1,
        "expected functions are the steps' in order": 1, "no input is a probe": 1, "no id is a probe's": 1, "splits share no function": 1,
    }
    assert {r["status"] for r in got.values() if r["table"] in ("instances", "points")} == {"pending"}
