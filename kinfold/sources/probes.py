"""Synthetic probes: images of eight domains from seeds, as a Spark table."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..operators.execute import IMAGE, content_hash, pack
from ..operators.planning import derive_seed

Image = np.ndarray
# Channel formats in the order in which they take turns.
FORMATS = ("rgb", "rgba", "gray", "gray16", "palette")


def ramp(t: np.ndarray, g: np.random.Generator) -> Image:
    a, b = g.integers(0, 256, 3), g.integers(0, 256, 3)
    return K.u8(a + (b - a) * t[:, :, None])


def grid(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.mgrid[0:n, 0:n] / max(n - 1, 1)


def linear(g: np.random.Generator, n: int) -> Image:
    return ramp(grid(n)[1], g)


def radial(g: np.random.Generator, n: int) -> Image:
    y, x = grid(n)
    return ramp(np.clip(np.hypot(y - 0.5, x - 0.5) * 1.42, 0, 1), g)


def angular(g: np.random.Generator, n: int) -> Image:
    y, x = grid(n)
    return K.from_hsv((np.arctan2(y - 0.5, x - 0.5) / (2 * np.pi) + g.random()) * 180, np.full((n, n), 255.0), np.full((n, n), 255.0))


def value_noise(g: np.random.Generator, n: int) -> Image:
    return K.resize(g.integers(0, 256, (max(2, n // 8), max(2, n // 8), 3)).astype(np.uint8), n, n)


def white_noise(g: np.random.Generator, n: int) -> Image:
    return g.integers(0, 256, (n, n, 3)).astype(np.uint8)


def checkerboard(g: np.random.Generator, n: int) -> Image:
    k = int(g.integers(2, 9))
    i = np.arange(n) * k // n
    return ramp(((i[:, None] + i[None, :]) % 2).astype(float), g)


def stripes(g: np.random.Generator, n: int) -> Image:
    y, x = grid(n)
    t = g.random() * np.pi
    return ramp(0.5 + 0.5 * np.sin(2 * np.pi * g.integers(2, 12) * (x * np.cos(t) + y * np.sin(t))), g)


def gabor(g: np.random.Generator, n: int) -> Image:
    y, x = grid(n)
    wave = np.cos(2 * np.pi * g.integers(2, 10) * (x - 0.5)) * np.exp(-((x - 0.5) ** 2 + (y - 0.5) ** 2) / 0.08)
    return ramp(0.5 + 0.5 * wave, g)


def shapes(g: np.random.Generator, n: int) -> Image:
    out = np.full((n, n, 3), g.integers(0, 256, 3), np.uint8)
    y, x = np.mgrid[0:n, 0:n]
    for k in range(int(g.integers(3, 9))):
        cy, cx, r = g.integers(0, n), g.integers(0, n), int(g.integers(2, max(3, n // 3)))
        on = (np.hypot(y - cy, x - cx) <= r, (abs(y - cy) <= r) & (abs(x - cx) <= r // 2 + 1), abs((y - cy) - (x - cx)) <= 1)[k % 3]
        out[on] = g.integers(0, 256, 3)
    return out


def document(g: np.random.Generator, n: int) -> Image:
    """Lines of word-like bars on paper."""
    out = np.full((n, n, 3), 245, np.uint8)
    for top in range(4, n - 6, 8):
        at = 4
        while at < n - 8:
            size = int(g.integers(3, max(4, n // 6)))
            out[top : top + 4, at : min(at + size, n - 4)] = int(g.integers(0, 60))
            at += size + 3
    return out


def colour_chart(g: np.random.Generator, n: int) -> Image:
    patches = g.integers(0, 256, (4, 6, 3)).astype(np.uint8)
    return K.resize(patches, n, n, "nearest")


DOMAINS = {
    "gradient": (linear, radial, angular), "texture": (value_noise, white_noise), "pattern": (checkerboard, stripes, gabor),
    "shapes": (shapes,), "document": (document,), "color_chart": (colour_chart,),
}


def formatted(a: Image, kind: str) -> Image:
    if kind == "rgba":
        alpha = np.broadcast_to(np.linspace(0, 255, a.shape[1]).astype(np.uint8), a.shape[:2])
        return np.dstack([a, alpha])
    if kind == "gray":
        return K.luma(a)
    if kind == "gray16":
        return K.luma(a).astype(np.uint16) * 257
    return K.luma(a) // 32 * 36 if kind == "palette" else a


def degenerates() -> dict[str, Image]:
    """Images at the edges of what functions must stand."""
    dot = np.zeros((16, 16, 3), np.uint8)
    dot[8, 8] = 255
    return {
        "black": np.zeros((16, 16, 3), np.uint8), "white": np.full((16, 16, 3), 255, np.uint8), "gray": np.full((16, 16), 128, np.uint8), "one_pixel": np.full((1, 1, 3), 77, np.uint8),
        "row": np.arange(32, dtype=np.uint8)[None, :], "column": np.arange(32, dtype=np.uint8)[:, None], "dot": dot,
    }


def battery(spark: SparkSession, counts: dict[str, int], size: int = 64, seed: int = 1234) -> DataFrame:
    """probe_id, domain, format, sha, image. ``counts``: probes of each domain; degenerate ones are added."""
    rows = spark.createDataFrame([(d, n) for d, n in counts.items()], "domain string, n int").select("domain", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[dict[str, Any]] = []
            for d, i in zip(b["domain"], b["i"], strict=True):
                if d == "degenerate":
                    name, a = list(degenerates().items())[i]
                    out.append({"probe_id": f"degenerate_{name}", "domain": d, "format": "gray" if a.ndim == 2 else "rgb", "sha": content_hash(a), "image": pack(a)})
                    continue
                g = np.random.default_rng(derive_seed(seed, "probe", d, int(i)))
                kind = FORMATS[i % len(FORMATS)]
                a = formatted(DOMAINS[d][i % len(DOMAINS[d])](g, size), kind)
                out.append({"probe_id": f"{d}_{i:03d}", "domain": d, "format": kind, "sha": content_hash(a), "image": pack(a)})
            yield pd.DataFrame(out, columns=["probe_id", "domain", "format", "sha", "image"])

    edge = spark.range(len(degenerates())).select(F.lit("degenerate").alias("domain"), F.col("id").cast("int").alias("i"))
    return rows.unionByName(edge).repartition("domain", "i").mapInPandas(make, f"probe_id string, domain string, format string, sha string, image {IMAGE}")


def natural_pool(images: DataFrame, n: int, licenses: tuple[int, ...] = (4, 7, 8), factor: int = 4, seed: int = 0) -> DataFrame:
    """Rows with a permissive license in a seeded order, as many as there may be tries: ``n * factor``."""
    ok = images.where(F.coalesce("license", F.lit(-1)).isin(*licenses))
    return ok.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n * factor)
