"""The library of image functions: ``fn(image, params, seed) -> image``, told by id, with typed parameters.

Geometric functions keep the channels they get; colour functions work on RGB.
Kernels are this package's own, so results agree with other image libraries in
meaning and not always in the last bit.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import numpy as np

from . import kernels as K

Image = np.ndarray


@dataclass(frozen=True)
class Param:
    name: str
    type: str
    default: Any
    min: float | None = None
    max: float | None = None
    choices: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.type == "enum" and not self.choices:
            raise ValueError(f"{self.name}: an enum needs choices")
        if self.min is not None and self.max is not None and self.min > self.max:
            raise ValueError(f"{self.name}: min is above max")
        self.coerce(self.default)

    def coerce(self, v: Any) -> Any:
        """The value in its type, within its range. A boolean is no number; 3.0 is a whole number."""
        if self.type in ("int", "float"):
            if isinstance(v, bool) or not isinstance(v, int | float) or (self.type == "int" and v != int(v)):
                raise ValueError(f"{self.name}: {v!r} is no {self.type}")
            v = int(v) if self.type == "int" else float(v)
            if (self.min is not None and v < self.min) or (self.max is not None and v > self.max):
                raise ValueError(f"{self.name}: {v!r} is out of range")
        elif self.type == "bool" and not isinstance(v, bool):
            raise ValueError(f"{self.name}: {v!r} is no bool")
        elif self.type == "enum" and v not in self.choices:
            raise ValueError(f"{self.name}: {v!r} is not among {self.choices}")
        elif self.type == "str" and not isinstance(v, str):
            raise ValueError(f"{self.name}: {v!r} is no string")
        return v


@dataclass(frozen=True)
class Skill:
    id: str
    family: str
    fn: Callable[..., Image]
    params: tuple[Param, ...] = ()
    description: str = ""
    name: str = ""
    stochastic: bool = False
    trusted: bool = True
    is_buggy: bool = field(default=False, compare=False)
    is_dead: bool = field(default=False, compare=False)

    def defaults(self) -> dict[str, Any]:
        return {p.name: p.default for p in self.params}

    def bind(self, given: dict[str, Any] | None) -> dict[str, Any]:
        """Defaults overlaid with what is given, coerced; unknown names are errors."""
        given = given or {}
        known = {p.name: p for p in self.params}
        if extra := set(given) - set(known):
            raise ValueError(f"{self.id}: unknown parameters {sorted(extra)}")
        return {n: p.coerce(given.get(n, p.default)) for n, p in known.items()}

    def run(self, image: Image, params: dict[str, Any] | None = None, seed: int = 0) -> Image:
        bound = self.bind(params)
        out = self.fn(image, **bound, **({"seed": seed} if self.stochastic else {}))
        if not isinstance(out, np.ndarray):
            raise TypeError(f"{self.id}: the output is no array")
        return np.ascontiguousarray(out)

    def comparator_view(self) -> dict[str, Any]:
        """What the output path may see: no name and no description."""
        return {"id": self.id, "family": self.family, "stochastic": self.stochastic, "trusted": self.trusted, "n_params": len(self.params)}


LIBRARY: dict[str, Skill] = {}


def skill(id: str, family: str, *params: tuple, stochastic: bool = False) -> Callable:
    """Register a function under ``id`` and version 1. Parameters as (name, type, default, min, max) or (name, 'enum', default, choices)."""

    def keep(fn: Callable[..., Image]) -> Callable[..., Image]:
        typed = tuple(Param(p[0], p[1], p[2], choices=p[3]) if p[1] == "enum" else Param(*p) for p in params)
        key = f"{id}_v1"
        if key in LIBRARY:
            raise ValueError(f"{key} is registered twice")
        LIBRARY[key] = Skill(key, family, fn, typed, description=" ".join((fn.__doc__ or id.replace("_", " ")).split()), name=id.replace("_", " "), stochastic=stochastic)
        return fn

    return keep


def plain(id: str, family: str, fn: Callable[..., Image], *params: tuple, stochastic: bool = False) -> None:
    skill(id, family, *params, stochastic=stochastic)(fn)


# ---- geometric -----------------------------------------------------------------------------------------------------

G = "geometric"
plain("flip_horizontal", G, lambda a: a[:, ::-1])
plain("flip_vertical", G, lambda a: a[::-1])
plain("rotate_90", G, lambda a: np.rot90(a))
plain("rotate_180", G, lambda a: np.rot90(a, 2))
plain("rotate_270", G, lambda a: np.rot90(a, 3))
plain("transpose", G, lambda a: a.swapaxes(0, 1))


def turned(a: Image, degrees: float = 0.0) -> Image:
    """Rotation on a canvas that grows; exact for right angles."""
    if degrees % 90 == 0:
        return np.rot90(a, int(degrees // 90) % 4)
    h, w = a.shape[:2]
    t = np.deg2rad(degrees)
    c, s = np.cos(t), np.sin(t)
    nh, nw = int(np.ceil(abs(h * c) + abs(w * s))), int(np.ceil(abs(h * s) + abs(w * c)))
    m = np.array([[c, s, 0], [-s, c, 0]])
    m[:, 2] = np.array([nw / 2, nh / 2]) - m[:, :2] @ np.array([w / 2, h / 2])
    return K.warp(a, m, nh, nw)


plain("rotate_canvas_degrees", G, turned, ("degrees", "float", 0.0, -360.0, 360.0))
plain("rotate_45", G, lambda a: turned(a, 45.0))


@skill("translate", G, ("dx_frac", "float", 0.0, -1.0, 1.0), ("dy_frac", "float", 0.0, -1.0, 1.0))
def translate(a: Image, dx_frac: float, dy_frac: float) -> Image:
    h, w = a.shape[:2]
    return K.warp(a, np.array([[1, 0, dx_frac * w], [0, 1, dy_frac * h]]), h, w)


@skill("shear_horizontal", G, ("shear", "float", 0.2, -2.0, 2.0))
def shear_horizontal(a: Image, shear: float) -> Image:
    h, w = a.shape[:2]
    return K.warp(a, np.array([[1, shear, max(0.0, -shear) * h], [0, 1, 0]]), h, w + int(abs(shear) * h))


@skill("shear_vertical", G, ("shear", "float", 0.2, -2.0, 2.0))
def shear_vertical(a: Image, shear: float) -> Image:
    h, w = a.shape[:2]
    return K.warp(a, np.array([[1, 0, 0], [shear, 1, max(0.0, -shear) * w]]), h + int(abs(shear) * w), w)


def scaled(a: Image, sy: float, sx: float, how: str = "bilinear") -> Image:
    return K.resize(a, max(1, round(a.shape[0] * sy)), max(1, round(a.shape[1] * sx)), how)


plain("scale_xy", G, lambda a, sx, sy: scaled(a, sy, sx), ("sx", "float", 1.0, 0.05, 8.0), ("sy", "float", 1.0, 0.05, 8.0))


def centre(a: Image, h: int, w: int) -> Image:
    h, w = min(max(1, h), a.shape[0]), min(max(1, w), a.shape[1])
    y, x = (a.shape[0] - h) // 2, (a.shape[1] - w) // 2
    return a[y : y + h, x : x + w]


plain("crop_center_percentage", G, lambda a, percent: centre(a, round(a.shape[0] * percent / 100), round(a.shape[1] * percent / 100)), ("percent", "float", 50.0, 1.0, 100.0))


@skill("crop_bounding_box", G, ("left", "float", 0.25, 0.0, 1.0), ("top", "float", 0.25, 0.0, 1.0), ("width", "float", 0.5, 0.0, 1.0), ("height", "float", 0.5, 0.0, 1.0))
def crop_bounding_box(a: Image, left: float, top: float, width: float, height: float) -> Image:
    """A box by shares of the sides. One that lies in the middle is cut like a centred crop."""

    def span(n: int, start: float, share: float) -> slice:
        size = min(max(1, round(n * share)), n)
        at = (n - size) // 2 if abs(start - (1 - share) / 2) < 1e-9 else round(n * start)
        return slice(at := min(max(0, at), n - size), at + size)

    return a[span(a.shape[0], top, height), span(a.shape[1], left, width)]


@skill("random_crop", G, ("size_frac", "float", 0.5, 0.05, 1.0), stochastic=True)
def random_crop(a: Image, size_frac: float, seed: int = 0) -> Image:
    g = np.random.default_rng(seed)
    h, w = max(1, int(a.shape[0] * size_frac)), max(1, int(a.shape[1] * size_frac))
    y, x = int(g.integers(0, a.shape[0] - h + 1)), int(g.integers(0, a.shape[1] - w + 1))
    return a[y : y + h, x : x + w]


plain("zoom_in_center", G, lambda a, factor: K.resize(centre(a, int(a.shape[0] / factor), int(a.shape[1] / factor)), *a.shape[:2]), ("factor", "float", 2.0, 1.0, 8.0))
for how in ("nearest", "bilinear", "bicubic"):
    plain(f"resize_{how}", G, lambda a, scale, how=how: scaled(a, scale, scale, how), ("scale", "float", 0.5, 0.05, 8.0))
plain("resize_fixed", G, lambda a, width, height: K.resize(a, height, width), ("width", "int", 128, 1, 4096), ("height", "int", 128, 1, 4096))


def padded(a: Image, border: tuple, mode: str, **how: Any) -> Image:
    return np.pad(a, [*border, (0, 0)][: a.ndim], mode=mode, **how)


BORDER = ("border", "int", 8, 0, 256)
plain("pad_reflect", G, lambda a, border: padded(a, ((border,) * 2,) * 2, "symmetric"), BORDER)
plain("pad_replicate", G, lambda a, border: padded(a, ((border,) * 2,) * 2, "edge"), BORDER)


def framed(a: Image, border: tuple, value: int) -> Image:
    """Constant border; of several channels only the first takes the value."""
    out = padded(a, border, "constant")
    if value:
        inside = padded(np.ones(a.shape[:2], bool), border, "constant")
        (out if out.ndim == 2 else out[:, :, 0])[~inside] = value
    return out


plain("pad_constant", G, lambda a, border, value: framed(a, ((border,) * 2,) * 2, value), BORDER, ("value", "int", 0, 0, 255))


@skill("pad_to_square", G, ("value", "int", 0, 0, 255))
def pad_to_square(a: Image, value: int) -> Image:
    h, w = a.shape[:2]
    n = max(h, w)
    return framed(a, (((n - h) // 2, n - h - (n - h) // 2), ((n - w) // 2, n - w - (n - w) // 2)), value)


plain("tile_2x2", G, lambda a: np.tile(a, (2, 2, 1)[: a.ndim]))

# ---- colour --------------------------------------------------------------------------------------------------------

C = "color"


def on_rgb(f: Callable[..., Any]) -> Callable[..., Image]:
    """A function of RGB doubles, clipped and truncated to bytes."""
    return lambda a, **p: K.u8(f(K.rgb(a).astype(np.float64), **p))


plain("grayscale_bt601", C, lambda a: K.luma(a))
plain("grayscale_bt709", C, lambda a: K.luma(a, K.BT709))
plain("invert", C, lambda a: 255 - K.rgb(a))
plain("brightness_add", C, on_rgb(lambda v, delta: v + delta), ("delta", "float", 0.0, -255.0, 255.0))
plain("brightness_multiply", C, on_rgb(lambda v, gain: v * gain), ("gain", "float", 1.0, 0.0, 8.0))
plain("exposure_stops", C, on_rgb(lambda v, stops: v * 2.0**stops), ("stops", "float", 0.0, -4.0, 4.0))
plain("contrast_scale", C, on_rgb(lambda v, factor: (v - 127.5) * factor + 127.5), ("factor", "float", 1.0, 0.0, 4.0))
plain("gamma_correct", C, on_rgb(lambda v, gamma: (v / 255) ** gamma * 255), ("gamma", "float", 1.0, 0.1, 5.0))


def tinted(a: Image, turn: float = 0.0, gain: float = 1.0) -> Image:
    h, s, v = K.hsv(a)
    return K.from_hsv(h + turn / 2, np.clip(s * gain, 0, 255), v)


plain("saturation_gain", C, lambda a, factor: tinted(a, gain=factor), ("factor", "float", 1.0, 0.0, 4.0))
plain("desaturate_partial", C, on_rgb(lambda v, amount: v * (1 - amount) + (v @ np.array(K.BT601))[:, :, None] * amount), ("amount", "float", 0.5, 0.0, 1.0))
plain("hue_shift", C, lambda a, degrees: tinted(a, turn=degrees), ("degrees", "float", 0.0, -180.0, 180.0))
# The sepia matrix.
SEPIA = np.array([[0.393, 0.769, 0.189], [0.349, 0.686, 0.168], [0.272, 0.534, 0.131]])
plain("sepia_tone", C, on_rgb(lambda v: v @ SEPIA.T))
plain("color_temperature_shift", C, on_rgb(lambda v, amount: v + np.array([amount, 0, -amount])), ("amount", "float", 20.0, -128.0, 128.0))
plain("color_balance_rgb", C, on_rgb(lambda v, r_gain, g_gain, b_gain: v * np.array([r_gain, g_gain, b_gain])), *((f"{c}_gain", "float", 1.0, 0.0, 4.0) for c in "rgb"))
plain("channel_isolate", C, on_rgb(lambda v, channel: v * np.array([channel == c for c in ("red", "green", "blue")])), ("channel", "enum", "red", ("red", "green", "blue")))
plain("channel_swap_rgb_bgr", C, lambda a: K.rgb(a)[:, :, ::-1])
plain("threshold_binary", C, lambda a, thresh: K.mask(a, thresh), ("thresh", "int", 128, 0, 255))
plain("solarize", C, on_rgb(lambda v, thresh: np.where(v >= thresh, 255 - v, v)), ("thresh", "int", 128, 0, 255))
plain("posterize", C, lambda a, bits: K.rgb(a) >> (8 - bits) << (8 - bits), ("bits", "int", 4, 1, 8))
plain("quantize_uniform", C, on_rgb(lambda v, levels: np.round(np.round(v / 255 * (levels - 1)) / (levels - 1) * 255)), ("levels", "int", 8, 2, 64))


def stretched(v: np.ndarray, low: float, high: float) -> np.ndarray:
    return v if high <= low else (v - low) * 255.0 / (high - low)


plain("linear_contrast_stretch", C, on_rgb(lambda v: stretched(v, v.min(), v.max())))
plain("contrast_stretching_percentile", C, on_rgb(lambda v, low_pct, high_pct: stretched(v, *np.percentile(v, [low_pct, high_pct]))), ("low_pct", "float", 2.0, 0.0, 49.0), ("high_pct", "float", 98.0, 51.0, 100.0))
plain("levels_adjust", C, on_rgb(lambda v, black, white: stretched(v, black, max(white, black + 1))), ("black", "float", 0.0, 0.0, 254.0), ("white", "float", 255.0, 1.0, 255.0))
plain("equalize_histogram_global", C, lambda a: K.on_luma(K.equalize, a))
plain("equalize_clahe", C, lambda a, clip, grid: K.on_luma(lambda p: K.clahe(p, clip, grid), a), ("clip", "float", 2.0, 0.5, 40.0), ("grid", "int", 8, 1, 32))

# ---- filtering -----------------------------------------------------------------------------------------------------

KS = ("ksize", "int", 5, 1, 31)
rounded = lambda v: K.u8(np.rint(v))
plain("blur_gaussian", "blur", lambda a, ksize, sigma: rounded(K.gaussian(a, K.odd(ksize), sigma)), KS, ("sigma", "float", 0.0, 0.0, 20.0))
plain("blur_box", "blur", lambda a, ksize: rounded(K.box(a, K.odd(ksize))), KS)
plain("blur_median", "blur", lambda a, ksize: K.median(a if a.dtype == np.uint8 else K.u8(a), K.odd(ksize)), KS)
plain("blur_bilateral", "blur", lambda a, d, sigma: rounded(K.bilateral(K.rgb(a), d, sigma)), ("d", "int", 9, 1, 25), ("sigma", "float", 75.0, 1.0, 200.0))


@skill("blur_motion", "blur", ("length", "int", 9, 1, 51), ("angle", "float", 0.0, -180.0, 180.0))
def blur_motion(a: Image, length: int, angle: float) -> Image:
    """Mean along a line of the given angle."""
    n = K.odd(length)
    k, r, t = np.zeros((n, n)), n // 2, np.deg2rad(angle)
    for s in np.linspace(-r, r, 4 * n):
        k[int(round(r - s * np.sin(t))), int(round(r + s * np.cos(t)))] = 1
    return rounded(K.convolve(a, k / k.sum()))


plain("sharpen_unsharp", "sharpen", lambda a, ksize, amount: K.u8((v := a.astype(np.float64)) + amount * (v - K.gaussian(a, K.odd(ksize)))), KS, ("amount", "float", 1.0, 0.0, 5.0))
# Small kernels.
SHARPEN = np.array([[0, -1, 0], [-1, 5, -1], [0, -1, 0]], float)
EMBOSS = np.array([[-2, -1, 0], [-1, 1, 1], [0, 1, 2]], float)
SOBEL = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]], float)
SCHARR = np.array([[-3, 0, 3], [-10, 0, 10], [-3, 0, 3]], float)
PREWITT = np.array([[-1, 0, 1], [-1, 0, 1], [-1, 0, 1]], float)
LAPLACE = np.array([[2, 0, 2], [0, -8, 0], [2, 0, 2]], float)
plain("sharpen_laplacian_kernel", "sharpen", lambda a: K.u8(K.convolve(a, SHARPEN)))
plain("high_pass_spatial", "frequency", lambda a, ksize: K.u8(a.astype(np.float64) - K.gaussian(a, K.odd(ksize)) + 128), ("ksize", "int", 9, 1, 31))
plain("emboss", "stylize", lambda a: K.u8(K.convolve(K.luma(a), EMBOSS) + 128))
for name, kernel in (("sobel", SOBEL), ("scharr", SCHARR), ("prewitt", PREWITT)):
    plain(f"edges_{name}", "edges", lambda a, k=kernel: K.u8(np.hypot(K.convolve(K.luma(a), k), K.convolve(K.luma(a), k.T))))
plain("edges_laplacian", "edges", lambda a: K.u8(np.abs(K.convolve(K.luma(a), LAPLACE))))


@skill("edges_canny", "edges", ("low", "int", 100, 0, 500), ("high", "int", 200, 0, 500))
def edges_canny(a: Image, low: int, high: int) -> Image:
    """Thin edges above the high threshold, and those above the low one that touch them."""
    p = K.luma(a)
    gx, gy = K.convolve(p, SOBEL), K.convolve(p, SOBEL.T)
    m = np.abs(gx) + np.abs(gy)
    side = np.round(np.rad2deg(np.arctan2(gy, gx)) / 45).astype(int) % 4
    q = np.pad(m, 1)
    at = lambda dy, dx: q[1 + dy : 1 + dy + m.shape[0], 1 + dx : 1 + dx + m.shape[1]]
    ahead = np.choose(side, [at(0, 1), at(1, 1), at(1, 0), at(1, -1)])
    behind = np.choose(side, [at(0, -1), at(-1, -1), at(-1, 0), at(-1, 1)])
    thin = (m >= ahead) & (m > behind)
    weak = K.label((thin & (m > min(low, high))).astype(np.uint8))
    strong = np.unique(weak[thin & (m > max(low, high))])
    return (np.isin(weak, strong[strong > 0]) * 255).astype(np.uint8)


def spread(sigma: float) -> int:
    return K.odd(2 * round(3 * sigma) + 1)


plain("difference_of_gaussians", "edges", lambda a, sigma1, sigma2: K.u8(np.abs(K.gaussian(p := K.luma(a), spread(sigma1), sigma1) - K.gaussian(p, spread(sigma2), sigma2))), ("sigma1", "float", 1.0, 0.1, 20.0), ("sigma2", "float", 2.0, 0.1, 20.0))


@skill("gabor_filter", "texture", ("ksize", "int", 15, 3, 51), ("sigma", "float", 4.0, 0.5, 20.0), ("theta", "float", 0.0, 0.0, 180.0), ("lambd", "float", 10.0, 2.0, 40.0))
def gabor_filter(a: Image, ksize: int, sigma: float, theta: float, lambd: float) -> Image:
    return K.u8(np.abs(K.convolve(K.luma(a), gabor_kernel(ksize, sigma, theta, lambd))))


def gabor_kernel(ksize: int, sigma: float, theta: float, lambd: float) -> np.ndarray:
    r, t = K.odd(ksize) // 2, np.deg2rad(theta)
    y, x = np.mgrid[-r : r + 1, -r : r + 1]
    u, v = x * np.cos(t) + y * np.sin(t), -x * np.sin(t) + y * np.cos(t)
    k = np.exp(-(u**2 + 0.25 * v**2) / (2 * sigma**2)) * np.cos(2 * np.pi * u / lambd)
    return k / max(np.abs(k).sum(), 1e-9)


def disc(a: Image, cutoff: float, inside: bool) -> Image:
    """Keep the frequencies within (or beyond) a disc of ``cutoff`` cycles a pixel."""

    def one(p: Image) -> np.ndarray:
        f = np.fft.fft2(p.astype(np.float64))
        near = np.hypot(np.fft.fftfreq(p.shape[0])[:, None], np.fft.fftfreq(p.shape[1])[None, :]) <= cutoff
        return K.u8(np.real(np.fft.ifft2(f * (near == inside))) + (0 if inside else 128))

    return K.as_planes(one, K.rgb(a))


plain("low_pass_fft", "frequency", lambda a, cutoff: disc(a, cutoff, True), ("cutoff", "float", 0.25, 0.01, 0.5))
plain("high_pass_fft", "frequency", lambda a, cutoff: disc(a, cutoff, False), ("cutoff", "float", 0.25, 0.01, 0.5))
MK = ("ksize", "int", 3, 1, 31)
plain("morphology_dilate", "morphology", lambda a, ksize: K.dilate(a, K.odd(ksize)), MK)
plain("morphology_erode", "morphology", lambda a, ksize: K.erode(a, K.odd(ksize)), MK)
plain("morphology_open", "morphology", lambda a, ksize: K.dilate(K.erode(a, K.odd(ksize)), K.odd(ksize)), MK)
plain("morphology_close", "morphology", lambda a, ksize: K.erode(K.dilate(a, K.odd(ksize)), K.odd(ksize)), MK)


@skill("denoise_nlmeans", "denoise", ("strength", "float", 10.0, 1.0, 50.0))
def denoise_nlmeans(a: Image, strength: float) -> Image:
    """Mean of pixels near by, weighted by how alike their 3x3 patches are."""
    v = K.rgb(a).astype(np.float64)
    h, w = v.shape[:2]
    total, norm = np.zeros_like(v), np.zeros((h, w))
    for dy in range(-4, 5):
        for dx in range(-4, 5):
            o = v[K.reflect(np.arange(h) + dy, h)][:, K.reflect(np.arange(w) + dx, w)]
            g = np.exp(-np.maximum(K.box(((o - v) ** 2).mean(axis=2), 3), 0) / strength**2)
            total += o * g[:, :, None]
            norm += g
    return rounded(total / norm[:, :, None])


@skill("add_gaussian_noise", "noise", ("sigma", "float", 10.0, 0.0, 128.0), stochastic=True)
def add_gaussian_noise(a: Image, sigma: float, seed: int = 0) -> Image:
    v = K.rgb(a).astype(np.float64)
    return K.u8(v + np.random.default_rng(seed).normal(0.0, sigma, v.shape))


@skill("add_salt_pepper_noise", "noise", ("amount", "float", 0.05, 0.0, 1.0), stochastic=True)
def add_salt_pepper_noise(a: Image, amount: float, seed: int = 0) -> Image:
    out = K.rgb(a).copy()
    u = np.random.default_rng(seed).random(out.shape[:2])
    out[u < amount / 2] = 0
    out[u > 1 - amount / 2] = 255
    return out


# ---- reconstruction, segmentation, style ---------------------------------------------------------------------------


def repaired(a: Image, rounds: int, keep: float) -> Image:
    """Fill the brightest 3 % from their surroundings; images under 5 pixels a side stay."""
    v = K.rgb(a)
    if min(v.shape[:2]) < 5:
        return v
    p = K.luma(v)
    return K.fill_in(v, p >= max(np.percentile(p, 97), 1), rounds, keep)


plain("inpaint_telea", "reconstruction", lambda a: repaired(a, 0, 1.0))
plain("inpaint_ns", "reconstruction", lambda a: repaired(a, 20, 0.2))


@skill("flood_fill_center", "reconstruction", ("tolerance", "int", 20, 0, 255))
def flood_fill_center(a: Image, tolerance: int) -> Image:
    v = K.rgb(a).copy()
    v[K.flood(v, v.shape[0] // 2, v.shape[1] // 2, tolerance)] = (255, 0, 0)
    return v


@skill("connected_components_colormap", "segmentation")
def connected_components_colormap(a: Image) -> Image:
    ids = K.label(K.mask(a))
    top = max(int(ids.max()), 1)
    on = ids > 0
    return K.from_hsv(ids * 179.0 / top, np.where(on, 255.0, 0.0), np.where(on, 255.0, 0.0))


@skill("contours_draw", "segmentation")
def contours_draw(a: Image) -> Image:
    """Outer rims of the components, green on the image."""
    m = K.mask(a) > 0
    outside = K.flood(np.pad(np.where(m, 255, 0).astype(np.uint8), 1), 0, 0, 0)
    near = np.lib.stride_tricks.sliding_window_view(outside, (3, 3)).any(axis=(2, 3))
    out = K.rgb(a).copy()
    out[m & near] = (0, 255, 0)
    return out


@skill("distance_transform", "segmentation")
def distance_transform(a: Image) -> Image:
    d = K.chamfer(K.mask(a))
    return K.u8(d * 255.0 / d.max()) if d.max() > 0 else K.u8(d)


plain("threshold_otsu", "segmentation", lambda a: K.mask(a, K.otsu(K.luma(a))))
plain("threshold_adaptive_mean", "segmentation", lambda a, blocksize, c: np.where((p := K.luma(a)) > np.rint(K.box(p, max(3, K.odd(blocksize)))) - c, 255, 0).astype(np.uint8), ("blocksize", "int", 11, 3, 99), ("c", "int", 2, -32, 32))


@skill("palette_reduce_kmeans", "quantize", ("k", "int", 8, 2, 64))
def palette_reduce_kmeans(a: Image, k: int) -> Image:
    """k-means on the distinct colours, seeded by their quantiles."""
    v = K.rgb(a)
    colours, inverse, counts = np.unique(v.reshape(-1, 3), axis=0, return_inverse=True, return_counts=True)
    x = colours.astype(np.float64)
    means = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)]
    for _ in range(10):
        near = ((x[:, None] - means[None]) ** 2).sum(axis=2).argmin(axis=1)
        for j in range(len(means)):
            if (near == j).any():
                means[j] = np.average(x[near == j], axis=0, weights=counts[near == j])
    return K.u8(means)[near][inverse.reshape(-1)].reshape(v.shape)


@skill("dither_floyd_steinberg", "quantize", ("levels", "int", 2, 2, 16))
def dither_floyd_steinberg(a: Image, levels: int) -> Image:
    p = np.pad(K.luma(a).astype(np.float64), ((0, 1), (1, 1)))
    step = 255.0 / (levels - 1)
    for y in range(p.shape[0] - 1):
        for x in range(1, p.shape[1] - 1):
            new = min(max(round(p[y, x] / step) * step, 0.0), 255.0)
            e, p[y, x] = p[y, x] - new, new
            p[y, x + 1] += e * 7 / 16
            p[y + 1, x - 1] += e * 3 / 16
            p[y + 1, x] += e * 5 / 16
            p[y + 1, x + 1] += e / 16
    return K.u8(p[:-1, 1:-1])


@skill("pixel_sort_rows", "stylize", ("threshold", "int", 128, 0, 255))
def pixel_sort_rows(a: Image, threshold: int) -> Image:
    """In each row the pixels brighter than the threshold, sorted among their own places."""
    v, p = K.rgb(a).copy(), K.luma(a)
    for y in range(v.shape[0]):
        at = np.flatnonzero(p[y] > threshold)
        v[y, at] = v[y, at[np.argsort(p[y, at], kind="stable")]]
    return v


plain("mosaic_pixelate", "stylize", lambda a, block: K.resize(K.resize(a, max(1, a.shape[0] // block), max(1, a.shape[1] // block)), *a.shape[:2], "nearest"), ("block", "int", 8, 1, 128))
plain("vignette", "stylize", on_rgb(lambda v, strength: v * np.outer(*(K.gaussian_line(n, n / (2 * strength)) / K.gaussian_line(n, n / (2 * strength)).max() for n in v.shape[:2]))[:, :, None]), ("strength", "float", 0.5, 0.1, 2.0))
# The two colours of the gradient map.
DUOTONE = np.array([[30, 20, 80], [255, 220, 120]], float)
plain("gradient_map_duotone", "stylize", lambda a: K.u8(DUOTONE[0] + (DUOTONE[1] - DUOTONE[0]) * (K.luma(a) / 255.0)[:, :, None]))
plain("checkerboard_synthesize", "synthesis", lambda a, squares: np.repeat((((np.arange(a.shape[0]) * squares // a.shape[0])[:, None] + (np.arange(a.shape[1]) * squares // a.shape[1])[None, :]) % 2 * 255).astype(np.uint8)[:, :, None], 3, axis=2), ("squares", "int", 8, 1, 64))


@skill("border_frame", "synthesis", ("width", "int", 8, 1, 128), ("value", "int", 0, 0, 255))
def border_frame(a: Image, width: int, value: int) -> Image:
    v = K.rgb(a)
    y, x = np.ogrid[: v.shape[0], : v.shape[1]]
    rim = (np.minimum(y, v.shape[0] - 1 - y) < width) | (np.minimum(x, v.shape[1] - 1 - x) < width)
    return np.where(rim[:, :, None], np.uint8(value), v)


@skill("overlay_grid", "synthesis", ("spacing", "int", 16, 2, 128), ("value", "int", 0, 0, 255))
def overlay_grid(a: Image, spacing: int, value: int) -> Image:
    v = K.rgb(a).copy()
    v[::spacing] = value
    v[:, ::spacing] = value
    return v


@skill("sketch_pencil", "stylize")
def sketch_pencil(a: Image) -> Image:
    p = K.luma(a).astype(np.float64)
    return K.u8(p * 256 / np.maximum(256 - K.gaussian(255 - p, 21), 1))


plain("cartoonize", "stylize", lambda a: rounded(K.bilateral(K.rgb(a), 9, 75.0)) & np.where((p := K.median(K.luma(a), 5)) > np.rint(K.box(p, 9)) - 2, 255, 0).astype(np.uint8)[:, :, None])
plain("equalize_per_channel", "reconstruction", lambda a: K.as_planes(K.equalize, K.rgb(a)))


@skill("blur_background_composite", "reconstruction", ("ksize", "int", 15, 1, 51))
def blur_background_composite(a: Image, ksize: int) -> Image:
    v = K.rgb(a).astype(np.float64)
    h, w = v.shape[:2]
    y, x = np.ogrid[:h, :w]
    away = np.clip(np.hypot((y - (h - 1) / 2) / max(h / 2, 1), (x - (w - 1) / 2) / max(w / 2, 1)), 0, 1)[:, :, None]
    return K.u8(v * (1 - away) + K.gaussian(K.rgb(a), K.odd(ksize)) * away)


plain("mask_to_rgba", "mask", lambda a, thresh: np.dstack([K.rgb(a), K.mask(a, thresh)]), ("thresh", "int", 128, 0, 255))


@skill("halftone_dots", "stylize", ("cell", "int", 6, 2, 32))
def halftone_dots(a: Image, cell: int) -> Image:
    """Per cell a black disc on white, the larger the darker the cell."""
    p = K.luma(a).astype(np.float64)
    h, w = p.shape
    cy, cx = np.arange(h) // cell, np.arange(w) // cell
    ids = cy[:, None] * (cx[-1] + 1) + cx[None, :]
    mean = (np.bincount(ids.ravel(), p.ravel()) / np.bincount(ids.ravel()))[ids]
    y, x = np.ogrid[:h, :w]
    away = np.hypot(y % cell - (cell - 1) / 2, x % cell - (cell - 1) / 2)
    return np.where(away <= (1 - mean / 255) * cell / 2 * np.sqrt(2), 0, 255).astype(np.uint8)


@skill("value_noise_synthesize", "synthesis", ("scale", "int", 8, 1, 64), stochastic=True)
def value_noise_synthesize(a: Image, scale: int, seed: int = 0) -> Image:
    small = np.random.default_rng(seed).integers(0, 256, (max(2, a.shape[0] // scale), max(2, a.shape[1] // scale), 3)).astype(np.uint8)
    return K.resize(small, *a.shape[:2])


@skill("swirl_distort", "stylize", ("strength", "float", 5.0, -20.0, 20.0))
def swirl_distort(a: Image, strength: float) -> Image:
    v = K.rgb(a)
    h, w = v.shape[:2]
    y, x = np.meshgrid(np.arange(h) - h / 2, np.arange(w) - w / 2, indexing="ij")
    r = np.hypot(y, x)
    t = np.arctan2(y, x) + strength * np.exp(-r / max(min(h, w) / 2, 1)) * 0.2
    return K.sample(v, r * np.sin(t) + h / 2, r * np.cos(t) + w / 2, border="reflect")
