"""The library's functions on many grey images at once.

A stack is HxWxN: N planes of bytes of one shape, the last axis counts the
images. ``MANY[id](stack, **parameters)`` gives HxWxN, or HxWxCxN of colours,
each image as the function itself makes it from that plane, to the last bit;
None where it can't, and then the function runs image by image. On a grey image
the three channels of RGB are equal, so one is counted and repeated.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np

from . import images as L
from . import kernels as K

Stack = np.ndarray
PIECE = 2**14  # Fixed value: numbers that are counted together.
MANY: dict[str, Callable[..., Stack | None]] = {}


def many(*ids: str) -> Callable:
    def keep(f: Callable) -> Callable:
        MANY.update({f"{i}_v1": f for i in ids})
        return f

    return keep


def grey3(p: Stack) -> Stack:
    return np.repeat(p[:, :, None], 3, axis=2)


# ---- value by value, and what takes any number of channels ---------------------------------------------------------


def _table(id: str, params: tuple, w: int) -> np.ndarray:
    """What each value becomes in each column: matrix products round the last columns of a row in another way. Asked anew for each stack and run, so that a second run is one."""
    return L.LIBRARY[id].fn(every(w), **dict(params))


def every(w: int) -> np.ndarray:
    return np.repeat(np.arange(256, dtype=np.uint8)[:, None], w, axis=1)


def _looked_up(table: np.ndarray, a: Stack) -> Stack:
    return table[a, np.arange(a.shape[1])[:, None]]


def _by_value(id: str) -> Callable[..., Stack]:
    def f(a: Stack, **p: Any) -> Stack:
        out = _looked_up(_table(id, tuple(p.items()), a.shape[1]), a)
        return out if out.ndim == 3 else out.swapaxes(2, 3)

    return f


for _id in (
    "grayscale_bt601", "grayscale_bt709", "invert", "brightness_add", "brightness_multiply", "exposure_stops", "contrast_scale", "gamma_correct", "saturation_gain", "desaturate_partial", "hue_shift", "sepia_tone", "color_temperature_shift",
    "color_balance_rgb", "channel_isolate", "channel_swap_rgb_bgr", "threshold_binary", "solarize", "posterize", "quantize_uniform", "levels_adjust", "gradient_map_duotone", "mask_to_rgba",
):
    MANY[f"{_id}_v1"] = _by_value(f"{_id}_v1")
for _id in (
    "flip_horizontal", "flip_vertical", "rotate_90", "rotate_180", "rotate_270", "transpose", "rotate_canvas_degrees", "rotate_45", "translate", "shear_horizontal", "shear_vertical", "scale_xy", "crop_center_percentage", "crop_bounding_box", "random_crop",
    "zoom_in_center", "resize_nearest", "resize_bilinear", "resize_bicubic", "pad_reflect", "pad_replicate", "tile_2x2", "mosaic_pixelate", "blur_gaussian", "blur_box", "blur_median", "blur_motion", "sharpen_unsharp", "sharpen_laplacian_kernel",
    "high_pass_spatial", "morphology_dilate", "morphology_erode", "morphology_open", "morphology_close",
):
    MANY[f"{_id}_v1"] = L.LIBRARY[f"{_id}_v1"].fn


@many("resize_fixed")
def resize_fixed(a: Stack, width: int, height: int) -> Stack:
    """``K.sample`` row by row, in pieces of a row that stay near the processor: the four products and their sums in the same order. Weights aren't negative and make up one, so nothing has to be clipped."""
    h, w, n = a.shape
    y, x = (np.arange(height) + 0.5) * (h / height) - 0.5, (np.arange(width) + 0.5) * (w / width) - 0.5
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = y - y0, (x - x0)[:, None]
    v = a.astype(np.float64)
    out = np.empty((height, width, n), np.uint8)
    tops, bottoms = np.clip(y0, 0, h - 1), np.clip(y0 + 1, 0, h - 1)
    some = max(1, PIECE // n)
    for at in range(0, width, some):
        cols = slice(at, at + some)
        left, right, f = v[:, np.clip(x0[cols], 0, w - 1)], v[:, np.clip(x0[cols] + 1, 0, w - 1)], fx[cols]
        row, part = np.empty(left.shape[1:]), np.empty(left.shape[1:])
        for i in range(height):
            np.multiply(left[tops[i]], (1 - fy[i]) * (1 - f), out=row)
            for side, line, weight in ((right, tops[i], (1 - fy[i]) * f), (left, bottoms[i], fy[i] * (1 - f)), (right, bottoms[i], fy[i] * f)):
                row += np.multiply(side[line], weight, out=part)
            row += 0.5
            out[i, cols] = row
    return out


@many("pad_constant")
def pad_constant(a: Stack, border: int, value: int) -> Stack:
    return np.pad(a, ((border, border), (border, border), (0, 0)), constant_values=value)


@many("pad_to_square")
def pad_to_square(a: Stack, value: int) -> Stack:
    h, w = a.shape[:2]
    n = max(h, w)
    return np.pad(a, (((n - h) // 2, n - h - (n - h) // 2), ((n - w) // 2, n - w - (n - w) // 2), (0, 0)), constant_values=value)


# ---- by luma -------------------------------------------------------------------------------------------------------


def luma(a: Stack) -> Stack:
    return _looked_up(_table("grayscale_bt601_v1", (), a.shape[1]), a)


def mask(a: Stack, level: int | np.ndarray = 127) -> Stack:
    return np.where(luma(a) > level, 255, 0).astype(np.uint8)


@many("emboss")
def emboss(a: Stack) -> Stack:
    return K.u8(K.convolve(luma(a), L.EMBOSS) + 128)


def _edges(k: np.ndarray) -> Callable[[Stack], Stack]:
    return lambda a: K.u8(np.hypot(K.convolve(p := luma(a), k), K.convolve(p, k.T)))


MANY |= {"edges_sobel_v1": _edges(L.SOBEL), "edges_scharr_v1": _edges(L.SCHARR), "edges_prewitt_v1": _edges(L.PREWITT)}


@many("edges_laplacian")
def edges_laplacian(a: Stack) -> Stack:
    return K.u8(np.abs(K.convolve(luma(a), L.LAPLACE)))


@many("difference_of_gaussians")
def difference_of_gaussians(a: Stack, sigma1: float, sigma2: float) -> Stack:
    p = luma(a)
    return K.u8(np.abs(K.gaussian(p, L.spread(sigma1), sigma1) - K.gaussian(p, L.spread(sigma2), sigma2)))


@many("gabor_filter")
def gabor_filter(a: Stack, **p: Any) -> Stack:
    return K.u8(np.abs(K.convolve(luma(a), L.gabor_kernel(**p))))


@many("threshold_adaptive_mean")
def threshold_adaptive_mean(a: Stack, blocksize: int, c: int) -> Stack:
    p = luma(a)
    return np.where(p > np.rint(K.box(p, max(3, K.odd(blocksize)))) - c, 255, 0).astype(np.uint8)


@many("sketch_pencil")
def sketch_pencil(a: Stack) -> Stack:
    p = luma(a).astype(np.float64)
    return K.u8(p * 256 / np.maximum(256 - K.gaussian(255 - p, 21), 1))


@many("threshold_otsu")
def threshold_otsu(a: Stack) -> Stack:
    p, n = luma(a), a.shape[2]
    c = np.bincount((p.reshape(-1, n).astype(int) + 256 * np.arange(n)).ravel(), minlength=256 * n).reshape(n, 256).astype(float)
    w, m = np.cumsum(c, axis=1), np.cumsum(c * np.arange(256), axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        between = (m[:, -1:] * w / w[:, -1:] - m) ** 2 / (w * (w[:, -1:] - w))
    return mask(a, np.where(np.isfinite(between), between, -1).argmax(axis=1))


@many("dither_floyd_steinberg")
def dither_floyd_steinberg(a: Stack, levels: int) -> Stack:
    p = np.pad(luma(a).astype(np.float64), ((0, 1), (1, 1), (0, 0)))
    step = 255.0 / (levels - 1)
    for y in range(p.shape[0] - 1):
        for x in range(1, p.shape[1] - 1):
            new = np.clip(np.rint(p[y, x] / step) * step, 0.0, 255.0)
            e = p[y, x] - new
            p[y, x] = new
            p[y, x + 1] += e * 7 / 16
            p[y + 1, x - 1] += e * 3 / 16
            p[y + 1, x] += e * 5 / 16
            p[y + 1, x + 1] += e / 16
    return K.u8(p[:-1, 1:-1])


@many("pixel_sort_rows")
def pixel_sort_rows(a: Stack, threshold: int) -> Stack:
    p = luma(a)
    on, out = p > threshold, a.copy()
    places = np.argsort(~on, axis=1, kind="stable")
    order = np.argsort(np.where(on, p.astype(int), 256), axis=1, kind="stable")
    np.put_along_axis(out, places, np.take_along_axis(a, order, axis=1), axis=1)
    return grey3(out)


@many("halftone_dots")
def halftone_dots(a: Stack, cell: int) -> Stack:
    p = luma(a).astype(np.float64)
    h, w, n = p.shape
    ys, xs = range(0, h, cell), range(0, w, cell)
    mean = np.empty_like(p)
    for y in ys:
        for x in xs:
            part = p[y : y + cell, x : x + cell]
            mean[y : y + cell, x : x + cell] = part.sum(axis=(0, 1)) / (part.shape[0] * part.shape[1])
    y, x = np.ogrid[:h, :w]
    away = np.hypot(y % cell - (cell - 1) / 2, x % cell - (cell - 1) / 2)[:, :, None]
    return np.where(away <= (1 - mean / 255) * cell / 2 * np.sqrt(2), 0, 255).astype(np.uint8)


# ---- joined pixels -------------------------------------------------------------------------------------------------


def _ring(q: Stack) -> Stack:
    return np.lib.stride_tricks.sliding_window_view(q, (3, 3), axis=(0, 1))


def _rim(a: Stack, value: float = 0) -> Stack:
    return np.pad(a, ((1, 1), (1, 1), (0, 0)), constant_values=value)


def label(on: Stack) -> Stack:
    """Components of each plane, numbered in reading order; least labels spread until no plane changes."""
    h, w, n = on.shape
    own = np.arange(1, h * w + 1).reshape(h, w, 1)
    ids, big = np.where(on, own, 0), h * w + 2
    while True:
        q = _rim(np.where(on, ids, big), big)
        rows = np.minimum(np.minimum(q[:-2], q[1:-1]), q[2:])
        new = np.where(on, np.minimum(np.minimum(rows[:, :-2], rows[:, 1:-1]), rows[:, 2:]), 0)
        if (new == ids).all():
            break
        ids = new
    rank = np.cumsum((on & (ids == own)).reshape(h * w, n), axis=0)
    return np.where(on, np.take_along_axis(rank, np.maximum(ids.reshape(h * w, n) - 1, 0), axis=0).reshape(h, w, n), 0)


def flood(near: Stack, y: int, x: int) -> Stack:
    got = np.zeros(near.shape, bool)
    got[y, x] = True
    while True:
        q = _rim(got)
        new = near & (q[1:-1, 1:-1] | q[:-2, 1:-1] | q[2:, 1:-1] | q[1:-1, :-2] | q[1:-1, 2:])
        if (new == got).all():
            return got
        got = new


@many("edges_canny")
def edges_canny(a: Stack, low: int, high: int) -> Stack:
    p = luma(a)
    gx, gy = K.convolve(p, L.SOBEL), K.convolve(p, L.SOBEL.T)
    m = np.abs(gx) + np.abs(gy)
    side = np.round(np.rad2deg(np.arctan2(gy, gx)) / 45).astype(int) % 4
    q = _rim(m)
    at = lambda dy, dx: q[1 + dy : 1 + dy + m.shape[0], 1 + dx : 1 + dx + m.shape[1]]
    ahead = np.choose(side, [at(0, 1), at(1, 1), at(1, 0), at(1, -1)])
    behind = np.choose(side, [at(0, -1), at(-1, -1), at(-1, 0), at(-1, 1)])
    thin = (m >= ahead) & (m > behind)
    weak = label(thin & (m > min(low, high)))
    strong, n = thin & (m > max(low, high)), np.broadcast_to(np.arange(m.shape[2]), m.shape)
    kept = np.zeros((m.shape[2], m.shape[0] * m.shape[1] + 1), bool)
    kept[n[strong], weak[strong]] = True
    kept[:, 0] = False
    return (kept[n, weak] * 255).astype(np.uint8)


@many("connected_components_colormap")
def connected_components_colormap(a: Stack) -> Stack:
    ids = label(mask(a) > 0)
    on = ids > 0
    return K.from_hsv(ids * 179.0 / np.maximum(ids.max(axis=(0, 1)), 1), np.where(on, 255.0, 0.0), np.where(on, 255.0, 0.0))


@many("contours_draw")
def contours_draw(a: Stack) -> Stack:
    m = mask(a) > 0
    outside = flood(~_rim(m), 0, 0)
    rim = m & _ring(outside).any(axis=(3, 4))
    return np.stack([np.where(rim, np.uint8(v), a) for v in (0, 255, 0)], axis=2)


@many("flood_fill_center")
def flood_fill_center(a: Stack, tolerance: int) -> Stack:
    y, x = a.shape[0] // 2, a.shape[1] // 2
    got = flood(np.abs(a.astype(int) - a[y, x]) <= tolerance, y, x)
    return np.stack([np.where(got, np.uint8(v), a) for v in (255, 0, 0)], axis=2)


@many("distance_transform")
def distance_transform(a: Stack) -> Stack:
    """A plane is left as it is once a round brings it no nearer, as by itself."""
    m = mask(a)
    d, open_ = np.where(m > 0, 1e9, 0.0), (m == 0).any(axis=(0, 1))
    d[:, :, ~open_] = float(max(m.shape[:2]))
    while open_.any():
        q, new = _rim(d, 1e9), d
        for dy in (0, 1, 2):
            for dx in (0, 1, 2):
                if (dy, dx) != (1, 1):
                    new = np.minimum(new, q[dy : dy + d.shape[0], dx : dx + d.shape[1]] + (0.955 if 1 in (dy, dx) else 1.3693))
        open_ &= ~np.isclose(new, d).all(axis=(0, 1))
        d = np.where(open_, new, d)
    top = d.max(axis=(0, 1))
    return K.u8(np.where(top > 0, d * 255.0 / np.where(top > 0, top, 1), d))


# ---- by plane, repeated --------------------------------------------------------------------------------------------


@many("linear_contrast_stretch")
def linear_contrast_stretch(a: Stack) -> Stack:
    v = a.astype(np.float64)
    return grey3(_stretched(v, v.min(axis=(0, 1)), v.max(axis=(0, 1))))


@many("contrast_stretching_percentile")
def contrast_stretching_percentile(a: Stack, low_pct: float, high_pct: float) -> Stack:
    v = a.astype(np.float64)
    return grey3(_stretched(v, *np.percentile(grey3(v), [low_pct, high_pct], axis=(0, 1, 2))))


def _stretched(v: Stack, low: np.ndarray, high: np.ndarray) -> Stack:
    return K.u8(np.where(high <= low, v, (v - low) * 255.0 / np.where(high <= low, 1, high - low)))


def equalize(p: Stack) -> Stack:
    flat = p.reshape(-1, p.shape[2])
    size = len(flat)
    upto = np.stack([(flat <= x).sum(axis=0) for x in flat]).reshape(p.shape)
    first = (flat == flat.min(axis=0)).sum(axis=0)
    return np.where(first == size, p, np.rint(np.clip((upto - first) * 255.0 / np.maximum(size - first, 1), 0, 255)).astype(np.uint8))


def _luma_rounded(w: int) -> np.ndarray:
    return np.rint(K.rgb(every(w)).astype(np.float64) @ np.array(K.BT601)).astype(np.uint8)


def _on_luma(a: Stack, f: Callable[[Stack], Stack]) -> Stack:
    y = _looked_up(_luma_rounded(a.shape[1]), a)
    return grey3(K.u8(np.rint(a + (f(y).astype(np.float64) - y))))


@many("equalize_histogram_global")
def equalize_histogram_global(a: Stack) -> Stack:
    return _on_luma(a, equalize)


@many("equalize_per_channel")
def equalize_per_channel(a: Stack) -> Stack:
    return grey3(equalize(a))


@many("equalize_clahe")
def equalize_clahe(a: Stack, clip: float, grid: int) -> Stack | None:
    """Where a tile is one pixel, whose curve is 0 below its value and 255 from there on."""
    h, w = a.shape[:2]
    if not h == w <= grid:
        return None

    def f(p: Stack) -> Stack:
        i = np.arange(h)
        at = lambda y, x: np.where(p >= p[y][:, x], 255.0, 0.0)
        y = np.clip((i + 0.5) - 0.5, 0, h - 1)
        y0 = np.floor(y).astype(int)
        y1 = np.minimum(y0 + 1, h - 1)
        fy, fx = (y - y0)[:, None, None], (y - y0)[None, :, None]
        return np.rint((at(y0, y0) * (1 - fx) + at(y0, y1) * fx) * (1 - fy) + (at(y1, y0) * (1 - fx) + at(y1, y1) * fx) * fy).astype(np.uint8)

    return _on_luma(a, f)


def _disc(inside: bool) -> Callable[..., Stack]:
    def f(a: Stack, cutoff: float) -> Stack:
        p = np.ascontiguousarray(np.moveaxis(a, 2, 0)).astype(np.float64)
        near = np.hypot(np.fft.fftfreq(a.shape[0])[:, None], np.fft.fftfreq(a.shape[1])[None, :]) <= cutoff
        out = K.u8(np.real(np.fft.ifft2(np.fft.fft2(p) * (near == inside))) + (0 if inside else 128))
        return grey3(np.moveaxis(out, 0, 2))

    return f


MANY |= {"low_pass_fft_v1": _disc(True), "high_pass_fft_v1": _disc(False)}


def bilateral(a: Stack, d: int, sigma: float) -> Stack:
    r = max(1, d // 2)
    v = a.astype(np.float64)
    h, w = v.shape[:2]
    total, norm = np.zeros_like(v), np.zeros_like(v)
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            if dy * dy + dx * dx <= r * r:
                o = v[K.reflect(np.arange(h) + dy, h)][:, K.reflect(np.arange(w) + dx, w)]
                gap = 3 * np.abs(o - v)
                g = np.exp(-(dy * dy + dx * dx) / (2 * sigma**2) - gap**2 / (2 * sigma**2))
                total += o * g
                norm += g
    return total / norm


@many("blur_bilateral")
def blur_bilateral(a: Stack, d: int, sigma: float) -> Stack:
    return grey3(L.rounded(bilateral(a, d, sigma)))


@many("cartoonize")
def cartoonize(a: Stack) -> Stack:
    p = K.median(luma(a), 5)
    return grey3(L.rounded(bilateral(a, 9, 75.0)) & np.where(p > np.rint(K.box(p, 9)) - 2, 255, 0).astype(np.uint8))


@many("denoise_nlmeans")
def denoise_nlmeans(a: Stack, strength: float) -> Stack:
    v = a.astype(np.float64)
    h, w = v.shape[:2]
    total, norm = np.zeros_like(v), np.zeros_like(v)
    for dy in range(-4, 5):
        for dx in range(-4, 5):
            o = v[K.reflect(np.arange(h) + dy, h)][:, K.reflect(np.arange(w) + dx, w)]
            g = np.exp(-np.maximum(K.box((o - v) ** 2, 3), 0) / strength**2)
            total += o * g
            norm += g
    return grey3(L.rounded(total / norm))


def _repaired(rounds: int, keep: float) -> Callable[[Stack], Stack]:
    ring = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]

    def f(a: Stack) -> Stack:
        h, w = a.shape[:2]
        if min(h, w) < 5:
            return grey3(a)
        p = luma(a)
        hole = p >= np.maximum(np.percentile(p, 97, axis=(0, 1)), 1)
        hole &= ~hole.all(axis=(0, 1))
        v, known = a.astype(np.float64), ~hole
        around = lambda x, dy, dx: x[np.clip(np.arange(h) + dy, 0, h - 1)][:, np.clip(np.arange(w) + dx, 0, w - 1)]
        while not known.all():
            n = sum(around(known, *o).astype(float) for o in ring)
            s = sum(around(np.where(known, v, 0), *o) for o in ring)
            new = ~known & (n > 0)
            v[new] = s[new] / n[new]
            known = known | new
        for _ in range(rounds):
            s = sum(around(v, *o) for o in ring) / 8
            v[hole] = keep * v[hole] + (1 - keep) * s[hole]
        return grey3(K.u8(np.rint(v)))

    return f


MANY |= {"inpaint_telea_v1": _repaired(0, 1.0), "inpaint_ns_v1": _repaired(20, 0.2)}


@many("palette_reduce_kmeans")
def palette_reduce_kmeans(a: Stack, k: int) -> Stack:
    """Planes with fewer distinct values than ``k`` have means that nothing is near to."""
    v = np.moveaxis(a, 2, 0).reshape(a.shape[2], -1)
    x = np.sort(v, axis=1).astype(np.float64)
    fresh = np.hstack([np.ones((len(x), 1), bool), x[:, 1:] != x[:, :-1]])
    distinct = fresh.sum(axis=1)
    firsts = np.argsort(~fresh, axis=1, kind="stable")
    means = np.full((len(x), k), np.inf)
    for u in np.unique(distinct):
        at = np.linspace(0, u - 1, min(k, u)).astype(int)
        rows = np.flatnonzero(distinct == u)[:, None]
        means[rows, np.arange(len(at))] = x[rows, firsts[rows, at]]
    v = v.astype(np.float64)
    for _ in range(10):
        s = (v[:, :, None] - means[:, None]) ** 2
        near = (s + s + s).argmin(axis=2)
        for j in range(k):
            mine = near == j
            n = mine.sum(axis=1)
            means[:, j] = np.where(n > 0, np.where(mine, v, 0).sum(axis=1) / np.maximum(n, 1), means[:, j])
    out = np.take_along_axis(K.u8(np.where(np.isfinite(means), means, 0)), near, axis=1)
    return grey3(np.moveaxis(out.reshape(-1, *a.shape[:2]), 0, 2))


@many("vignette")
def vignette(a: Stack, strength: float) -> Stack:
    lines = (K.gaussian_line(n, n / (2 * strength)) / K.gaussian_line(n, n / (2 * strength)).max() for n in a.shape[:2])
    return grey3(K.u8(a.astype(np.float64) * np.outer(*lines)[:, :, None]))


@many("blur_background_composite")
def blur_background_composite(a: Stack, ksize: int) -> Stack:
    h, w = a.shape[:2]
    y, x = np.ogrid[:h, :w]
    away = np.clip(np.hypot((y - (h - 1) / 2) / max(h / 2, 1), (x - (w - 1) / 2) / max(w / 2, 1)), 0, 1)[:, :, None]
    return grey3(K.u8(a.astype(np.float64) * (1 - away) + K.gaussian(a, K.odd(ksize)) * away))


@many("swirl_distort")
def swirl_distort(a: Stack, strength: float) -> Stack:
    h, w = a.shape[:2]
    y, x = np.meshgrid(np.arange(h) - h / 2, np.arange(w) - w / 2, indexing="ij")
    r = np.hypot(y, x)
    t = np.arctan2(y, x) + strength * np.exp(-r / max(min(h, w) / 2, 1)) * 0.2
    return grey3(K.sample(a, r * np.sin(t) + h / 2, r * np.cos(t) + w / 2, border="reflect"))


@many("border_frame")
def border_frame(a: Stack, width: int, value: int) -> Stack:
    y, x = np.ogrid[: a.shape[0], : a.shape[1]]
    rim = (np.minimum(y, a.shape[0] - 1 - y) < width) | (np.minimum(x, a.shape[1] - 1 - x) < width)
    return grey3(np.where(rim[:, :, None], np.uint8(value), a))


@many("overlay_grid")
def overlay_grid(a: Stack, spacing: int, value: int) -> Stack:
    v = a.copy()
    v[::spacing] = value
    v[:, ::spacing] = value
    return grey3(v)


# ---- noise, and what doesn't look at the values --------------------------------------------------------------------


@many("add_gaussian_noise")
def add_gaussian_noise(a: Stack, sigma: float, seed: int = 0) -> Stack:
    noise = np.random.default_rng(seed).normal(0.0, sigma, (*a.shape[:2], 3))
    return K.u8(a.astype(np.float64)[:, :, None] + noise[..., None])


@many("add_salt_pepper_noise")
def add_salt_pepper_noise(a: Stack, amount: float, seed: int = 0) -> Stack:
    out, u = a.copy(), np.random.default_rng(seed).random(a.shape[:2])
    out[u < amount / 2] = 0
    out[u > 1 - amount / 2] = 255
    return grey3(out)


def _blind(id: str) -> Callable[..., Stack]:
    """One output for all, by shape and seed only."""
    return lambda a, **p: np.repeat(L.LIBRARY[id].fn(np.zeros(a.shape[:2], np.uint8), **p)[..., None], a.shape[2], axis=-1)


MANY |= {i: _blind(i) for i in ("checkerboard_synthesize_v1", "value_noise_synthesize_v1")}
