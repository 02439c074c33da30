"""Scalar expressions: pairs, vectors, 8x8 probes, tokens, keys."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")
SIDE = 8
#: Functions on one-channel 8x8 probes, values 0 to 255 in row-major order.
SKILLS: dict[str, Callable[[Column], Column]] = {
    "identity": lambda px: px,
    "invert": lambda px: F.transform(px, lambda v: 255 - v),
    "rotate_180": lambda px: F.reverse(px),
    "flip_vertical": lambda px: F.flatten(F.transform(F.sequence(F.lit(SIDE - 1), F.lit(0), F.lit(-1)), lambda r: F.slice(px, r * SIDE + 1, F.lit(SIDE)))),
    "flip_horizontal": lambda px: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(SIDE - 1)), lambda r: F.reverse(F.slice(px, r * SIDE + 1, F.lit(SIDE))))),
    "transpose": lambda px: F.transform(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1)), lambda i: F.get(px, (i % SIDE) * SIDE + F.floor(i / SIDE).cast("int"))),
    "threshold_128": lambda px: F.transform(px, lambda v: F.when(v > 128, F.lit(255)).otherwise(F.lit(0))),
    "posterize_4": lambda px: F.transform(px, lambda v: F.shiftleft(F.shiftright(v, 4), 4)),
    "posterize_7": lambda px: F.transform(px, lambda v: F.shiftleft(F.shiftright(v, 1), 1)),
    "brightness_add_10": lambda px: F.transform(px, lambda v: F.least(v + 10, F.lit(255))),
    "solarize_128": lambda px: F.transform(px, lambda v: F.when(v >= 128, 255 - v).otherwise(v)),
}


def pair_key(a: str, b: str) -> list[Column]:
    """The two ids of an unordered pair as columns ``a`` and ``b``."""
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def probe(vector: Column) -> Column:
    """A unit vector of 64 numbers as an 8x8 probe: (x + 1) / 2 clipped to 0..1, times 255, floored."""
    return F.transform(vector, lambda x: F.floor(F.least(F.greatest((x.cast("double") + 1) / 2, F.lit(0.0)), F.lit(1.0)) * 255).cast("int"))


def outputs(px: Column, skills: Sequence[str] = tuple(SKILLS)) -> Column:
    """What each function makes of one probe: an array of (pos, skill, px)."""
    return F.array(*(F.struct(F.lit(i).alias("pos"), F.lit(s).alias("skill"), SKILLS[s](px).alias("px")) for i, s in enumerate(skills)))


def max_abs_diff(a: Column, b: Column) -> Column:
    """The largest difference on the scale of 0 to 1; infinite if the shapes differ."""
    return F.when(F.size(a) != F.size(b), F.lit(INF)).otherwise(F.coalesce(F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y))) / 255.0, F.lit(0.0)))


def mean_abs_diff(a: Column, b: Column) -> Column:
    """A stand-in for a perceptual distance; infinite if the shapes differ."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0), lambda s, v: s + v)
    return F.when(F.size(a) != F.size(b), F.lit(INF)).otherwise(F.coalesce(F.try_divide(total, F.size(a) * 255.0), F.lit(0.0)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, clipped to 0..2; 1 if either vector is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(1.0)).otherwise(F.least(F.greatest(1 - dot(a, b) / norm, F.lit(0.0)), F.lit(2.0)))


def unit(v: Column) -> Column:
    """L2-normalised; zero stays zero."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm == 0, F.lit(0.0)).otherwise(x / norm))


def quadrant_means(px: Column) -> Column:
    """A stand-in for image features: the mean of each quadrant of an 8x8 probe."""
    half = SIDE // 2
    rows = lambda r, c: [SIDE * y + x for y in range(r, r + half) for x in range(c, c + half)]
    return F.array(*(sum((F.get(px, i) for i in rows(r, c)), F.lit(0)).cast("double") / (half * half) for r in (0, half) for c in (0, half)))


def average_hash(px: Column) -> Column:
    """64 bits, in order: is the value at least the mean?"""
    mean = F.aggregate(px, F.lit(0), lambda s, v: s + v) / F.size(px).cast("double")
    return F.transform(px, lambda v: (v >= mean).cast("int"))


def content_hash(px: Column, h: int = SIDE, w: int = SIDE) -> Column:
    """SHA-256 of version, shape and values, as text."""
    return F.sha2(F.concat_ws("|", F.lit("v1"), F.lit(f"{h}x{w}"), F.array_join(F.transform(px, lambda v: v.cast("string")), ",")), 256)


def is_binary_mask(px: Column) -> Column:
    """Exactly two values, of which one is 0 and the other the largest."""
    return (F.size(F.array_distinct(px)) == 2) & (F.array_min(px) == 0)


def mask_iou(a: Column, b: Column) -> Column:
    """Intersection over union of two masks; 1 if both are empty, null if either isn't a mask."""
    both = F.aggregate(F.zip_with(a, b, lambda x, y: ((x > 0) & (y > 0)).cast("int")), F.lit(0), lambda s, v: s + v)
    either = F.aggregate(F.zip_with(a, b, lambda x, y: ((x > 0) | (y > 0)).cast("int")), F.lit(0), lambda s, v: s + v)
    empty = (F.array_max(a) == 0) & (F.array_max(b) == 0)
    return F.when(empty, F.lit(1.0)).when(is_binary_mask(a) & is_binary_mask(b), F.coalesce(F.try_divide(both.cast("double"), either), F.lit(1.0)))


def tokens(text: Column, least: int = 1) -> Column:
    """Distinct lower-case runs of ASCII letters and digits of at least ``least`` characters."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1)))
    return found if least < 2 else F.filter(found, lambda t: F.char_length(t) >= least)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))


def params_key(params: Column) -> Column:
    """A map as compact JSON with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(params))))


def merge_params(defaults: Column, given: Column) -> Column:
    """``given`` over ``defaults``."""
    return F.map_concat(F.map_filter(defaults, lambda k, _: ~F.array_contains(F.map_keys(given), k)), given)


def value_key(v: Column) -> Column:
    """5 and 5.0 share the key 5."""
    return F.when(v == F.floor(v), v.cast("bigint").cast("string")).otherwise(v.cast("string"))


def strip_reasoning(reply: Column) -> Column:
    return F.trim(F.regexp_replace(reply, r"(?is)<think>.*?</think>", ""))


# The relations, in the order in which a reply is searched for them.
RELATIONS = ("EXACT", "PERCEPTUAL", "SUBSUMPTION", "SEMANTIC_PRESERVING", "COMPLEMENTARY", "DISTINCT")


def reply_relation(reply: Column) -> Column:
    """The first relation, in the fixed order, whose name occurs in the reply; else DISTINCT."""
    text, out = F.upper(strip_reasoning(reply)), None
    for r in RELATIONS:
        out = (F.when if out is None else out.when)(text.contains(r), F.lit(r))
    return out.otherwise(F.lit("DISTINCT"))


def reply_action(reply: Column) -> Column:
    """The JSON object between the first and the last brace, as (kind, primary, secondary, rationale); null if there is none."""
    parsed = F.from_json(F.regexp_extract(reply, r"(?s)\{.*\}", 0), "kind string, primary string, secondary string, rationale string")
    return F.when(parsed["kind"].isNotNull(), parsed)


def instance_name(rho: Column, composition: Column, seed: Column, mode: Column) -> Column:
    return F.format_string("rho%03d_%s_seed%d_%s", F.bround(rho * 100).cast("int"), composition, seed, mode)


def optional_double(text: Column) -> Column:
    """Blank and unreadable to null."""
    return F.nullif(F.trim(text), F.lit("")).try_cast("double")


def required_double(text: Column, default: float = 0.0) -> Column:
    return F.coalesce(optional_double(text), F.lit(default))
