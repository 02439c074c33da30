"""Task queries: built from templates, planned by solvers, executed, scored by predicates and references."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import images, kernels
from ..functions.images import Skill
from ..operators._order import running
from ..operators.execute import IMAGE, canonical, content_hash, is_mask, l_inf, pack, unpack
from ..operators.planning import derive_seed

# Tasks: split, instruction, steps (id, parameters), predicates (kind, height, width). No function is in both splits.
TEMPLATES: tuple[tuple, ...] = (
    ("dev", "Turn the picture upside down.", (("flip_vertical_v1", {}),), (("changed_from_input", None, None),)),
    ("dev", "Square the frame with black bars, then shrink it to a 32 pixel icon.", (("pad_to_square_v1", {"value": 0}), ("resize_fixed_v1", {"width": 32, "height": 32})), (("exact_shape", 32, 32),)),
    ("dev", "Keep a quarter of the scene around its middle.", (("crop_center_percentage_v1", {"percent": 25.0}),), (("exact_shape", None, None),)),
    ("dev", "Give an old photo look: sepia with a dark rim.", (("sepia_tone_v1", {}), ("vignette_v1", {"strength": 0.8})), (("changed_from_input", None, None),)),
    ("dev", "Clean the speckle with a median of three.", (("blur_median_v1", {"ksize": 3}),), (("changed_from_input", None, None),)),
    ("test", "Show only what stands out in green.", (("channel_isolate_v1", {"channel": "green"}),), (("changed_from_input", None, None),)),
    ("test", "Lay it out as two by two tiles.", (("tile_2x2_v1", {}),), (("exact_shape", None, None),)),
    ("test", "Split ink from paper by Otsu's cut and thicken the strokes.", (("threshold_otsu_v1", {}), ("morphology_dilate_v1", {"ksize": 3})), (("binary_mask", None, None),)),
    ("test", "Drop to four levels of tone.", (("quantize_uniform_v1", {"levels": 4}),), (("changed_from_input", None, None),)),
    ("test", "Make it monochrome with the weights for high definition.", (("grayscale_bt709_v1", {}),), (("channels_equal", None, None),)),
)
STEP = "array<struct<skill_id:string,params:string>>"
QUERY = f"query_id string, pos int, split string, instruction string, steps {STEP}, predicates array<struct<kind:string,height:int,width:int>>, input_sha string, reference_sha string, image {IMAGE}, reference {IMAGE}"


def fold(known: dict[str, Skill], image: np.ndarray, steps: list, allow_untrusted: bool = False, seed: int = 0) -> tuple[np.ndarray | None, str]:
    """Run steps in order up to the first that fails: the image, or None and why."""
    for s in steps:
        skill = known.get(s["skill_id"])
        if skill is None:
            return None, f"unknown: {s['skill_id']}"
        if not (skill.trusted or allow_untrusted):
            return None, f"untrusted: {s['skill_id']}"
        try:
            image = skill.run(image, json.loads(s["params"] or "{}"), seed)
        except Exception as e:  # noqa: BLE001  an error of a function is a result
            return None, f"error: {e}"[:200]
    return image, "ok"


def build_queries(spark: SparkSession, repeats: int = 1, size: int = 40, seed: int = 17) -> DataFrame:
    """Templates times repeats, each with a held-out input and the reference output; one row per query."""
    known = images.LIBRARY
    if missing := {s for t in TEMPLATES for s, _ in t[2]} - set(known):
        raise ValueError(f"templates name unknown functions: {sorted(missing)}")
    rows = spark.range(len(TEMPLATES) * repeats).select(F.col("id").cast("int").alias("pos"))

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for pos in b["pos"]:
                split, told, steps, wanted = TEMPLATES[pos % len(TEMPLATES)]
                name = f"q{pos:04d}"
                g = np.random.default_rng(derive_seed(seed, "query", name))
                a = kernels.resize(g.integers(0, 256, (max(2, size // 4), max(2, size // 4), 3)).astype(np.uint8), size + pos % 3, size + 2 * (pos % 2))
                packed = [{"skill_id": s, "params": json.dumps(p, sort_keys=True)} for s, p in steps]
                ref, why = fold(known, a, packed)
                if ref is None:
                    raise ValueError(f"{name}: the reference fails: {why}")
                preds = [{"kind": k, "height": h, "width": w} if (h or k != "exact_shape") else {"kind": k, "height": ref.shape[0], "width": ref.shape[1]} for k, h, w in wanted]
                out.append((name, pos, split, told, packed, preds, content_hash(a), content_hash(ref), pack(a), pack(ref)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ("query_id", "pos", "split", "instruction", "steps", "predicates", "input_sha", "reference_sha", "image", "reference")])

    return rows.mapInPandas(make, QUERY)


def predicate(kind: str, h: int | None, w: int | None, out: np.ndarray, source: np.ndarray, tolerance: float = 0.0) -> bool:
    if kind == "exact_shape":
        return out.shape[:2] == (h, w)
    if kind == "channels_equal":
        v = out.astype(np.float64) / 255.0  # whatever the type, as the metric is defined on bytes
        return out.ndim == 2 or out.shape[2] == 1 or float(max(np.abs(v[..., 0] - v[..., 1]).max(), np.abs(v[..., 1] - v[..., 2]).max())) <= tolerance
    if kind == "binary_mask":
        return is_mask(out)
    if kind == "rgba":
        return out.ndim == 3 and out.shape[2] == 4
    if kind == "changed_from_input":
        return content_hash(out) != content_hash(source)
    raise ValueError(f"unknown predicate {kind!r}")


def expected_plans(queries: DataFrame) -> DataFrame:
    """The reference's own steps."""
    return queries.select("query_id", F.col("steps").alias("plan"))


def no_plans(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.array().cast(STEP).alias("plan"))


def keyword_plans(queries: DataFrame, library: DataFrame) -> DataFrame:
    """library: pos, id, text. One step, of the function whose words overlap most with the instruction; an empty plan without any."""
    from ..operators.judges import keyword_retrieval

    hit = keyword_retrieval(queries.select("query_id", F.col("instruction").alias("text")), library)
    step = F.array(F.struct(F.col("id").alias("skill_id"), F.lit("{}").alias("params")))
    return hit.select("query_id", F.when(F.col("id").isNotNull(), step).otherwise(F.array().cast(STEP)).alias("plan"))


def library_table(spark: SparkSession, known: dict[str, Skill] | None = None) -> DataFrame:
    rows = [(i, s.id, f"{s.name} {s.description} {s.family}") for i, s in enumerate((known or images.LIBRARY).values())]
    return spark.createDataFrame(rows, "pos int, id string, text string")


def evaluate(queries: DataFrame, plans: DataFrame, known: dict[str, Skill] | None = None, epsilon: float = 1 / 255, perceptual: float = 0.05) -> DataFrame:
    """query_id, split, status, used, predicates_ok, l_inf, success: predicates hold and the reference is met within epsilon or the perceptual bound."""
    library = known or images.LIBRARY

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                a, ref = unpack(r["image"]), unpack(r["reference"])
                if content_hash(a) != r["input_sha"]:
                    got, status = None, "error: input differs from its hash"
                else:
                    got, status = fold(library, a, list(r["plan"]))
                ok = got is not None and all(predicate(p["kind"], p["height"], p["width"], got, a) for p in r["predicates"])
                gap = l_inf(got, ref) if got is not None else None
                near = False
                if gap is not None:
                    x, y = canonical(got)[0], canonical(ref)[0]
                    near = gap <= epsilon or (x.shape == y.shape and float(np.abs(x - y).mean()) <= perceptual)
                out.append((r["query_id"], r["split"], status, [s["skill_id"] for s in r["plan"]], ok, gap, bool(ok and near)))
            yield pd.DataFrame(out, columns=["query_id", "split", "status", "used", "predicates_ok", "l_inf", "success"])

    return queries.join(plans, "query_id").mapInPandas(run, "query_id string, split string, status string, used array<string>, predicates_ok boolean, l_inf double, success boolean")


def relevance(queries: DataFrame) -> DataFrame:
    """skill_id and the queries that expect it."""
    rows = queries.select("query_id", F.explode(F.array_distinct(F.transform("steps", lambda s: s["skill_id"]))).alias("skill_id"))
    return rows.groupBy("skill_id").agg(F.sort_array(F.collect_list("query_id")).alias("query_ids"))


def mentions(queries: DataFrame) -> DataFrame:
    """pos, id: every function that a query expects, in order, for usage counts."""
    rows = queries.select("pos", F.posexplode(F.transform("steps", lambda s: s["skill_id"])).alias("k", "id"))
    return running(rows, [F.col("pos"), F.col("k")], {"at": F.lit(1)}).select((F.col("at") - 1).alias("pos"), "id")


def write_scores(scores: DataFrame, path: str) -> None:
    """CSV with ids joined by spaces and nulls as blanks."""
    scores.withColumn("used", F.array_join("used", " ")).write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


