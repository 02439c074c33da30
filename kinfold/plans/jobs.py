"""Queries that execute functions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import images
from ..operators import constraints, execute, instances, planning
from ..sources import probes
from . import downstream, inputs, live
from .inputs import table
from .queries import query


def _grey_probes(spark: SparkSession, d: str) -> DataFrame:
    """The embeddings as 8x8 images of one plane."""

    @F.pandas_udf(execute.IMAGE)
    def packed(px):  # noqa: ANN001, ANN202
        import numpy as np
        import pandas as pd

        return pd.DataFrame([execute.pack(np.asarray(p, np.uint8).reshape(8, 8)) for p in px])

    return inputs.battery(spark, d).select(F.col("probe_id").cast("string").alias("probe_id"), packed("px").alias("image"))


@query("oracle_freeze")
def oracle_freeze(spark: SparkSession, d: str) -> DataFrame:
    """Hashes of all functions of the library on every probe, each run twice."""
    return execute.freeze_oracle(_grey_probes(spark, d).repartition(4 * max(8, spark.sparkContext.defaultParallelism)))


_AT = {"flip_horizontal_v1": "8 * r + 7 - c", "flip_vertical_v1": "8 * (7 - r) + c", "rotate_90_v1": "8 * c + 7 - r", "rotate_180_v1": "63 - 8 * r - c", "rotate_270_v1": "8 * (7 - c) + r", "transpose_v1": "8 * c + r"}
_MOVED = ", ".join(f"('{s}', [{', '.join(str(eval(at, {'r': i // 8, 'c': i % 8})) for i in range(64))}])" for s, at in _AT.items())  # noqa: S307  the fixed expressions above


@query("geometric_functions", f"""WITH {inputs.PROBES_SQL}, f AS (SELECT * FROM (VALUES {_MOVED}) v(skill_id, moved))
    SELECT CAST(probe_id AS VARCHAR) AS probe_id, skill_id, sha256(list_aggregate(list_transform(moved, lambda i: CAST(px[i + 1] AS VARCHAR)), 'string_agg', ',')) AS sha FROM probes, f""")
def geometric_functions(spark: SparkSession, d: str) -> DataFrame:
    """What the library's own geometric functions make of every probe, value by value."""
    rows = execute.run_bindings(_grey_probes(spark, d), [(s, None, 0) for s in _AT])

    @F.pandas_udf("string")
    def listed(image):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([",".join(map(str, execute.unpack(r).reshape(-1).tolist())) for r in image.to_dict("records")])

    return rows.where("status = 'ok'").select("probe_id", "skill_id", F.sha2(listed("image"), 256).alias("sha"))


@query("function_library_status")
def function_library_status(spark: SparkSession, d: str) -> DataFrame:
    """All 100 functions on a synthetic battery: outcomes and distinct contents per function."""
    battery = probes.battery(spark, dict.fromkeys(probes.DOMAINS, 2), 24)
    rows = execute.freeze_oracle(battery)
    return rows.groupBy("skill_id").agg(F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "error").alias("errors"), F.count_if(F.col("status") == "nondeterministic").alias("unstable"), F.countDistinct("sha").alias("contents"))


@query("probe_battery")
def probe_battery(spark: SparkSession, d: str) -> DataFrame:
    rows = probes.battery(spark, dict.fromkeys(probes.DOMAINS, 5), 32)
    return rows.select("probe_id", "domain", "format", "sha", F.col("image.h").alias("h"), F.col("image.w").alias("w"))


@query("downstream_success")
def downstream_success(spark: SparkSession, d: str) -> DataFrame:
    queries = downstream.build_queries(spark, 2)
    expected = downstream.evaluate(queries, downstream.expected_plans(queries)).withColumn("solver", F.lit("expected"))
    keyword = downstream.evaluate(queries, downstream.keyword_plans(queries, downstream.library_table(spark))).withColumn("solver", F.lit("keyword"))
    return expected.unionByName(keyword).select("solver", "query_id", "split", "status", "predicates_ok", "success")


def _plans(spark: SparkSession, ids: list[str], rhos: list[float], seeds: list[int]) -> DataFrame:
    numeric = lambda x: sum(p.type in ("int", "float") for p in x.params)
    library = pd.DataFrame([(k, len(images.LIBRARY[k].params), numeric(images.LIBRARY[k])) for k in ids], columns=["id", "n_params", "numeric_params"])
    return planning.corruption_grid(spark, library, rhos, list(planning.COMPOSITIONS), seeds)


@query("corruption_instances")
def corruption_instances(spark: SparkSession, d: str) -> DataFrame:
    """The 300 instances of the geometric functions, every defect checked on all embeddings; ``runs`` of distinct functions and probes where instances one by one ask for ``asked``."""
    library = {k: x for k, x in images.LIBRARY.items() if x.family == "geometric"}
    plans = _plans(spark, list(library), [round(0.1 * k, 1) for k in range(1, 11)], [0, 1, 2, 3, 4])
    done, how = instances.generate(plans, _grey_probes(spark, d), library)
    return instances.manifests(done, len(library)).select("*", F.lit(how["functions"]).alias("functions"), F.lit(how["runs"]).alias("runs"), F.lit(how["asked"]).alias("asked"))


_FEW = {"rhos": [0.5, 1.0], "seeds": [3, 7]}


def _defects_sql() -> str:
    """The same checks value by value: moves of the 64 places, the changes that defects make, and what they come to on every probe."""
    library = {k: images.LIBRARY[k] for k in _AT}
    frame = pd.DataFrame([(k, 0, 0) for k in library], columns=["id", "n_params", "numeric_params"])
    grid = [(m, c, r, n) for m in ("single", "mixed") for c in planning.COMPOSITIONS for r in _FEW["rhos"] for n in _FEW["seeds"]]
    rows = pd.concat([instances.resolved((m, c, r, n), planning.plan_instance(frame, r, c, n, m), library) for m, c, r, n in grid])

    def moved(px: str, at: str) -> str:
        return f"list_transform([{', '.join(str(eval(at, {'r': i // 8, 'c': i % 8})) for i in range(64))}], lambda i: {px}[i + 1])"  # noqa: S307  the fixed expressions above

    changes = {"roll_h": lambda px: moved(px, "8 * ((r - 1) % 8) + c"), "roll_w": lambda px: moved(px, "8 * r + (c - 1) % 8"), "invert_values": lambda px: f"list_transform({px}, lambda v: 255 - v)"}
    changes |= {"swap_channels": changes["roll_h"], "zero_border": lambda px: f"list_transform(range(0, 64), lambda i: CASE WHEN i // 8 IN (0, 7) OR i % 8 IN (0, 7) THEN 0 ELSE {px}[i + 1] END)"}

    def ctes(text: str, n: int) -> list[tuple[str, str]]:
        base, steps, _ = json.loads(text)
        out = [(f"f{n}_0", f"SELECT probe_id, {moved('px', _AT[base])} AS px FROM probes")]
        for kind, detail in steps:
            px, last = "px", out[-1][0]
            if kind == "bug":
                sql = changes[detail["mutator"]](px) if detail["domain"] in ("", "grayscale") else px
            else:
                sql = moved(px, _AT[detail]) if kind == "after" else f"list_transform(range(0, 64), lambda i: least(px[i + 1] + (i // 8 + i % 8) % 2, 255))"
            out.append((f"f{n}_{len(out)}", f"SELECT probe_id, {sql} AS px FROM {last}"))
        return out

    texts = sorted({t for c in ("clean", "made") for t in rows[c]})
    tables, final = [], []
    for n, t in enumerate(texts):
        tables += ctes(t, n)
        final.append(f"SELECT {n} AS f, probe_id, px FROM {tables[-1][0]}")
    place = {t: n for n, t in enumerate(texts)}
    pairs = ", ".join(f"({a}, {b})" for a, b in sorted({(place[r["clean"]], place[r["made"]]) for r in rows.to_dict("records")}))
    values = ", ".join(f"('{r['mode']}', '{r['composition']}', {r['rho']}, {r['seed']}, '{r['type']}', '{r['site_id']}', '{r['new_id']}', {place[r['clean']]}, {place[r['made']]})" for r in rows.to_dict("records"))
    return f"""WITH {inputs.PROBES_SQL}, {", ".join(f"{name} AS ({sql})" for name, sql in tables)}, f AS ({" UNION ALL ".join(final)}),
        c AS (SELECT a, b, count(*) AS n_probes, count(*) FILTER (WHERE x.px = y.px) AS n_same, count(*) FILTER (WHERE list_max({inputs.DIFF.format("x.px", "y.px")}) <= 1) AS n_near FROM (VALUES {pairs}) p(a, b) JOIN f x ON x.f = p.a JOIN f y ON y.f = p.b AND y.probe_id = x.probe_id GROUP BY a, b)
        SELECT mode, composition, CAST(rho AS DOUBLE) AS rho, seed, type, site_id, new_id, n_probes, n_same, n_near FROM (VALUES {values}) d(mode, composition, rho, seed, type, site_id, new_id, x, y) JOIN c ON c.a = d.x AND c.b = d.y"""


@query("corruption_defects", _defects_sql())
def corruption_defects(spark: SparkSession, d: str) -> DataFrame:
    """What the defects on six functions that move pixels come to on all embeddings."""
    done, _ = instances.generate(_plans(spark, list(_AT), _FEW["rhos"], _FEW["seeds"]), _grey_probes(spark, d), images.LIBRARY)
    return done.select("mode", "composition", "rho", "seed", "type", "site_id", "new_id", "n_probes", "n_same", "n_near")


_GRID_SQL = {"posterize": "list_transform({0}, lambda v: (v // CAST(pow(2, 8 - {1}) AS INT)) * CAST(pow(2, 8 - {1}) AS INT))", "brightness_add": "list_transform({0}, lambda v: least(v + {1}, 255))"}
_LIBRARY = (*inputs.USED, *live.GRIDS, "custom")
_NAMES = "CASE {0} " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate((*_LIBRARY, "nowhere"))) + " END"
_ACTIONS = f"""SELECT concat(CAST(user_id AS STRING), '-', CAST(event_id % 7 AS STRING)) AS episode, event_id AS step,
    CASE event_type WHEN 'click' THEN 'merge' WHEN 'signup' THEN 'parameterize' WHEN 'view' THEN 'modify' WHEN 'purchase' THEN CASE WHEN value < 20 THEN 'remove' ELSE 'parameterize' END ELSE CASE WHEN value < 100 THEN 'keep' ELSE 'end' END END AS kind,
    {_NAMES.format(f"CAST((event_id * 5 + user_id) % {len(_LIBRARY) + 1} AS INT)")} AS x_id, {_NAMES.format(f"CAST((event_id * 3 + user_id * 2) % {len(_LIBRARY) + 1} AS INT)")} AS y_id,
    CASE WHEN event_id % 2 = 0 THEN props END AS description FROM {{0}}"""
_BUDGET = 12


def _episodes_sql() -> str:
    own = {s: inputs.SKILL_SQL[s] for s in inputs.USED} | {s: _GRID_SQL[s].format("{0}", g.default) for s, g in live.GRIDS.items()}
    bound = [f"SELECT probe_id, '{s}' AS skill, 0 AS k, CAST(NULL AS VARCHAR) AS name, true AS own, {inputs.SKILL_SQL[s].format('px')} AS px FROM probes" for s in inputs.USED]
    bound += [f"SELECT probe_id, '{s}', {k}, '{g.param}={v}', {v == g.default}, {_GRID_SQL[s].format('px', v)} FROM probes" for s, g in live.GRIDS.items() for k, v in enumerate(g.values)]
    grids = ", ".join(f"'{s}'" for s in live.GRIDS)
    best = lambda side, other: f"coalesce(min_by(h.name_{side}, h.{side}) FILTER (h.ok AND h.own_{other}), max(h.name_{side}) FILTER (h.own_{side}))"
    known = lambda x: f"(a.{x}_id <> 'nowhere' AND NOT list_contains(r.gone, a.{x}_id))"
    return f"""WITH RECURSIVE {inputs.dist_sql(own)},
    m AS (SELECT a, b, max(l_inf) AS l_inf, max(perceptual) AS perceptual, bool_and(same) AS identical, quantile_cont(semantic, 0.9) AS semantic_q, avg(semantic) AS semantic_mean FROM dists GROUP BY a, b),
    bound AS ({" UNION ALL ".join(bound)}),
    h AS (SELECT x.skill AS a, y.skill AS b, x.k AS i, y.k AS j, x.name AS name_i, y.name AS name_j, x.own AS own_i, y.own AS own_j, bool_and(list_max({inputs.DIFF.format("x.px", "y.px")}) / 255.0 <= 1 / 255.0) AS ok
        FROM bound x JOIN bound y ON x.probe_id = y.probe_id AND x.skill < y.skill AND (x.skill IN ({grids}) OR y.skill IN ({grids})) GROUP BY ALL),
    way AS (SELECT a, b, (SELECT bool_and(o) FROM (SELECT bool_or(ok) AS o FROM h p WHERE p.a = h.a AND p.b = h.b GROUP BY p.i)) AS a_found, (SELECT bool_and(o) FROM (SELECT bool_or(ok) AS o FROM h p WHERE p.a = h.a AND p.b = h.b GROUP BY p.j)) AS b_found,
        {best("i", "j")} AS binding_a, {best("j", "i")} AS binding_b FROM h GROUP BY a, b),
    judged AS (SELECT m.a, m.b, binding_a, binding_b, CASE WHEN way.a IS NULL THEN NULL WHEN a_found AND b_found THEN 'MUTUAL_EXACT' WHEN a_found THEN 'B_SUBSUMES_A' WHEN b_found THEN 'A_SUBSUMES_B' ELSE 'NONE' END AS d, m.* EXCLUDE (a, b) FROM m LEFT JOIN way ON m.a = way.a AND m.b = way.b),
    told AS (SELECT a, b, binding_a, binding_b, d, CASE WHEN d IS NULL AND (identical OR l_inf <= 1 / 255.0) THEN 'EXACT' WHEN d IS NULL AND perceptual <= 0.045 THEN 'PERCEPTUAL' WHEN d IS NULL AND perceptual <= 0.055 THEN 'UNCERTAIN' WHEN d = 'MUTUAL_EXACT' THEN 'EXACT'
        WHEN d IN ('A_SUBSUMES_B', 'B_SUBSUMES_A') THEN 'SUBSUMPTION' WHEN semantic_q <= 0.135 AND semantic_mean <= 0.15 THEN 'SEMANTIC_PRESERVING' WHEN semantic_q <= 0.165 THEN 'UNCERTAIN' ELSE 'DISTINCT' END AS relation FROM judged),
    both_ways AS (SELECT a AS x, b AS y, relation, d = 'B_SUBSUMES_A' AS inside, binding_b AS binding FROM told UNION ALL SELECT b, a, relation, d = 'A_SUBSUMES_B', binding_a FROM told),
    acts AS (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY step) AS nth FROM ({_ACTIONS.format("events").replace("STRING", "VARCHAR")})),
    run AS (
        SELECT episode, CAST(0 AS BIGINT) AS nth, CAST([] AS VARCHAR[]) AS gone, CAST(NULL AS BIGINT) AS step, CAST('' AS VARCHAR) AS kind, CAST('' AS VARCHAR) AS status, CAST('' AS VARCHAR) AS x_id, CAST('' AS VARCHAR) AS y_id, CAST(NULL AS VARCHAR) AS relation, CAST(NULL AS VARCHAR) AS binding, 0 AS size_before, 0 AS size_after FROM acts WHERE nth = 1
        UNION ALL
        SELECT episode, nth, CASE WHEN status = 'applied' AND kind IN ('merge', 'parameterize', 'remove') THEN list_append(gone, x_id) ELSE gone END, step, kind, status, x_id, y_id, CASE WHEN status IN ('applied', 'rejected') AND kind IN ('merge', 'parameterize') THEN relation END, CASE WHEN status = 'applied' AND kind = 'parameterize' THEN binding END,
            CAST({len(_LIBRARY)} - len(gone) AS INT), CAST({len(_LIBRARY)} - len(gone) - CASE WHEN status = 'applied' AND kind IN ('merge', 'parameterize', 'remove') THEN 1 ELSE 0 END AS INT)
        FROM (SELECT r.episode, a.nth, r.gone, a.step, a.kind, a.x_id, a.y_id, v.relation, v.binding, CASE
            WHEN a.kind IN ('merge', 'parameterize') AND NOT ({known("x")} AND {known("y")} AND a.x_id <> a.y_id) THEN 'invalid'
            WHEN a.kind IN ('merge', 'parameterize') AND 'custom' IN (a.x_id, a.y_id) THEN 'blocked'
            WHEN a.kind = 'merge' THEN CASE WHEN v.relation IN ('EXACT', 'PERCEPTUAL') THEN 'applied' ELSE 'rejected' END
            WHEN a.kind = 'parameterize' THEN CASE WHEN v.relation = 'SEMANTIC_PRESERVING' OR (v.relation = 'SUBSUMPTION' AND v.inside) THEN 'applied' ELSE 'rejected' END
            WHEN a.kind IN ('remove', 'modify') AND NOT {known("x")} THEN 'invalid' WHEN a.kind = 'remove' OR (a.kind = 'modify' AND a.description IS NOT NULL) THEN 'applied' ELSE 'noop' END AS status
            FROM run r JOIN acts a ON a.episode = r.episode AND a.nth = r.nth + 1 LEFT JOIN both_ways v ON v.x = a.x_id AND v.y = a.y_id WHERE r.kind <> 'end' AND r.nth < {_BUDGET}))
    SELECT episode, step, kind, status, x_id AS "primary", y_id AS "secondary", relation, binding, size_before, size_after FROM run WHERE nth > 0"""


@query("curation_episodes", _episodes_sql())
def curation_episodes(spark: SparkSession, d: str) -> DataFrame:
    """Users' events as episodes against a library of functions on probes, judged on all embeddings as the actions come up."""
    table(spark, d, "events").createOrReplaceTempView("_kinfold_events")
    acts = spark.sql(_ACTIONS.format("_kinfold_events")).withColumnsRenamed({"x_id": "primary", "y_id": "secondary"})
    skills = {s: {"trusted": s != "custom"} for s in _LIBRARY}
    done = live.run_rounds(acts, skills, live.probe_judge(inputs.battery(spark, d)), _BUDGET)
    return done.log.select("episode", "step", "kind", "status", "primary", "secondary", "relation", "binding", "size_before", "size_after")


_RULES = (
    ("documents", "doc_id", "doc_id is there", "row", "doc_id IS NOT NULL", None), ("documents", "doc_id", "doc_id is unique", "unique", "doc_id", None), ("documents", "doc_id", "a document has text", "row", "length(trim(text)) > 0", None),
    ("documents", "doc_id", "n_chars is right", "row", "n_chars = length(text)", None), ("documents", "doc_id", "the language is known", "row", "lang IN ('en', 'fr', 'de')", None), ("documents", "doc_id", "a document has a source", "row", "length(source) > 0", None),
    ("documents", "doc_id", "no text is there twice", "unique", "md5(text)", None), ("documents", "doc_id", "no document is a benchmark item", "absent", "md5(trim(text))", ("benchmark", "md5(trim(text))")), ("documents", "doc_id", "a document has a label", "present", "doc_id", ("labels", "doc_id")),
    ("labels", "doc_id", "a label has its document", "present", "doc_id", ("documents", "doc_id")), ("labels", "doc_id", "a document has one label", "unique", "doc_id", None), ("labels", "doc_id", "labels are 0 or 1", "row", "quality IN (0, 1) AND toxic IN (0, 1)", None), ("labels", "doc_id", "what is toxic isn't good", "row", "NOT (toxic = 1 AND quality = 1)", None),
    ("pages", "page_id", "page_id is unique", "unique", "page_id", None), ("pages", "page_id", "an address is there once", "unique", "url", None), ("pages", "page_id", "an address is one", "row", "url LIKE 'http%://%'", None), ("pages", "page_id", "a page has a body", "row", "html LIKE '%<body%'", None),
    ("benchmark", "item_id", "item_id is unique", "unique", "item_id", None), ("benchmark", "item_id", "an item has ten words", "row", "length(text) - length(replace(text, ' ', '')) >= 9", None),
)


def _rules_sql() -> str:
    def bad(t: str, kind: str, what: str, other: tuple[str, str] | None) -> str:
        if kind == "row":
            return f"NOT coalesce(({what}), false)"
        if kind == "unique":
            return f"{what} IN (SELECT {what} FROM {t} GROUP BY 1 HAVING count(*) > 1)"
        return f"{what} {'NOT ' if kind == 'present' else ''}IN (SELECT {other[1]} FROM {other[0]} WHERE {other[1]} IS NOT NULL)"

    sql = lambda s: s.replace("'", "''")
    return " UNION ALL ".join(f"""SELECT '{sql(name)}' AS name, '{t}' AS "table", '{kind}' AS kind, (SELECT count(*) FROM {t}) AS n_rows, count(*) AS n_bad, CASE WHEN count(*) = 0 THEN 'pass' ELSE 'fail' END AS status, min(CAST({key} AS VARCHAR)) AS least FROM {t} WHERE {bad(t, kind, what, other)}""" for t, key, name, kind, what, other in _RULES)


@query("constraint_suite", _rules_sql())
def constraint_suite(spark: SparkSession, d: str) -> DataFrame:
    """Nineteen rules over four tables, each read once."""
    rules = [constraints.Rule(name, t, kind, what, other) for t, _, name, kind, what, other in _RULES]
    keys = {t: key for t, key, *_ in _RULES}
    return constraints.report({t: (table(spark, d, t), key) for t, key in keys.items()}, rules).drop("sample")
