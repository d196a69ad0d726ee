"""Pixel operators on whole images, as numpy arrays (height, width[, 3]) of bytes.

They are for recognisers, which run them inside the pass over page images; nothing here depends on Spark. Results follow
the usual definitions (replicated edges, cubic convolution, contrast-limited equalisation by interpolated tiles) and may
differ from another library's in the last gray level.
"""

from __future__ import annotations

import math

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

#: Weights of gray and of luma, sizes, limits, and the scales of the presets.
GRAY, LUMA = (0.299, 0.587, 0.114), (0.2989, 0.5870, 0.1140)
LONGEST = 1600
TILES, CLIP = 8, 2.0
BLOCK, OFFSET = 31, 10
DARK, LEAST_DARK, STEEPEST, FLATTEST = 128, 1500, 12.0, 0.05
#: preset: (whether it scales before it turns the image, sides below this, their scale, the scale of others).
PRESETS = {"clean_doc": (False, 2200, 1.5, 1.0), "photo": (True, 1800, 1.6, 1.25), "low_light": (False, 1800, 1.7, 1.3)}
DIM, STRONG = 110, 75


def _bytes(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def gray(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else _bytes(image[..., :3] @ np.array(GRAY))


def edge_level(image: np.ndarray) -> float:
    """Mean absolute difference along rows plus that along columns, of the luma."""
    y = image.astype(np.float32) if image.ndim == 2 else image[..., :3].astype(np.float32) @ np.array(LUMA, np.float32)
    return sum(float(np.abs(np.diff(y, axis=k)).mean()) for k in (0, 1) if y.shape[k] > 1)


def median3(image: np.ndarray) -> np.ndarray:
    near = sliding_window_view(np.pad(image, 1, mode="edge"), (3, 3))
    return np.median(near.reshape(*image.shape, 9), axis=-1).astype(np.uint8)


def sharpen(image: np.ndarray) -> np.ndarray:
    """The centre five times, less its four neighbours; the image is mirrored at its edges."""
    p = np.pad(image.astype(np.int32), 1, mode="reflect")
    return _bytes(5 * p[1:-1, 1:-1] - p[:-2, 1:-1] - p[2:, 1:-1] - p[1:-1, :-2] - p[1:-1, 2:])


def equalize(image: np.ndarray, clip: float = CLIP, tiles: int = TILES) -> np.ndarray:
    """Contrast-limited adaptive equalisation: each tile's histogram is clipped and what is cut off is spread evenly;
    a pixel takes the bilinear mean of the maps of the four tiles around it."""
    height, width = image.shape
    padded = np.pad(image, ((0, -height % tiles), (0, -width % tiles)), mode="symmetric")
    th, tw = padded.shape[0] // tiles, padded.shape[1] // tiles
    parts = padded.reshape(tiles, th, tiles, tw).swapaxes(1, 2).reshape(tiles * tiles, -1)
    counts = np.stack([np.bincount(p, minlength=256) for p in parts])
    limit = max(1, int(clip * th * tw / 256))
    over = np.maximum(counts - limit, 0).sum(axis=1)
    even = np.minimum(counts, limit) + (over // 256)[:, None]
    for row, rest in zip(even, over % 256):
        if rest:
            row[:: max(1, 256 // rest)][:rest] += 1
    maps = np.rint(np.cumsum(even, axis=1) * (255 / (th * tw))).clip(0, 255).reshape(tiles, tiles, 256)

    def between(n: int, size: int):
        at = (np.arange(n) / size) - 0.5
        low = np.floor(at).astype(int)
        return low.clip(0, tiles - 1), (low + 1).clip(0, tiles - 1), at - low

    (y0, y1, fy), (x0, x1, fx) = between(height, th), between(width, tw)
    look = lambda y, x: maps[y[:, None], x[None, :], image]
    top = look(y0, x0) * (1 - fx) + look(y0, x1) * fx
    low = look(y1, x0) * (1 - fx) + look(y1, x1) * fx
    return _bytes(top * (1 - fy[:, None]) + low * fy[:, None])


def threshold(image: np.ndarray, block: int = BLOCK, offset: float = OFFSET) -> np.ndarray:
    """255 where a pixel is brighter than the Gaussian mean of the block around it less the offset, else 0."""
    half = block // 2
    sigma = 0.3 * ((block - 1) * 0.5 - 1) + 0.8
    kernel = np.exp(-((np.arange(block) - half) ** 2) / (2 * sigma**2))
    kernel /= kernel.sum()
    smooth = image.astype(np.float64)
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (half, half)
        p = np.pad(smooth, pad, mode="edge")
        n = image.shape[axis]
        smooth = sum(w * p.take(range(k, k + n), axis=axis) for k, w in enumerate(kernel))
    return np.where(image.astype(np.float64) > np.rint(smooth) - offset, 255, 0).astype(np.uint8)


def _hull(points: np.ndarray) -> np.ndarray:
    """The convex hull of points sorted by their first, then second coordinate."""

    def half(run):
        kept: list = []
        for p in run:
            while len(kept) > 1 and (kept[-1][0] - kept[-2][0]) * (p[1] - kept[-2][1]) <= (kept[-1][1] - kept[-2][1]) * (p[0] - kept[-2][0]):
                kept.pop()
            kept.append(p)
        return kept[:-1]

    listed = points.tolist()
    return np.array(half(listed) + half(listed[::-1]), np.float64)


def skew(binary: np.ndarray) -> float:
    """The turn, in degrees, that straightens the smallest rectangle around the dark pixels; 0 for few of them and for
    steep tilts."""
    if (binary < DARK).sum() < LEAST_DARK:
        return 0.0
    rows = [(y, x) for y, line in enumerate(binary < DARK) if line.any() for x in np.flatnonzero(line)[[0, -1]]]
    hull = _hull(np.unique(np.array(rows), axis=0))
    if len(hull) < 3:
        return 0.0
    sides = np.roll(hull, -1, axis=0) - hull
    turn = np.arctan2(sides[:, 1], sides[:, 0])
    along, across = np.stack([np.cos(turn), np.sin(turn)], 1), np.stack([-np.sin(turn), np.cos(turn)], 1)
    area = np.ptp(hull @ along.T, axis=0) * np.ptp(hull @ across.T, axis=0)
    angle = 45 - (math.degrees(turn[int(area.argmin())]) + 45) % 90
    return angle if abs(angle) <= STEEPEST else 0.0


def _cubic(t: np.ndarray) -> np.ndarray:
    """Weights of the four neighbours at distance 1 + t, t, 1 - t, 2 - t (cubic convolution, a = -0.75)."""
    a = -0.75
    near = lambda d: ((a + 2) * d - (a + 3)) * d * d + 1
    far = lambda d: ((a * d - 5 * a) * d + 8 * a) * d - 4 * a
    return np.stack([far(1 + t), near(t), near(1 - t), far(2 - t)], axis=-1)


def rotate(image: np.ndarray, angle: float) -> np.ndarray:
    """Turned counter-clockwise about its middle, same size, edges replicated; tilts under FLATTEST change nothing."""
    if abs(angle) < FLATTEST:
        return image
    height, width = image.shape[:2]
    cy, cx, t = height // 2, width // 2, math.radians(angle)
    xs, out = np.arange(width) - cx, np.empty_like(image)
    for top in range(0, height, 64):  # in bands, so that memory stays small
        ys = np.arange(top, min(height, top + 64))[:, None] - cy
        x, y = math.cos(t) * xs - math.sin(t) * ys + cx, math.sin(t) * xs + math.cos(t) * ys + cy
        x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
        wx, wy = _cubic(x - x0), _cubic(y - y0)
        total = 0.0
        for i in range(4):
            for j in range(4):
                w = wy[..., i] * wx[..., j]
                total = total + (w if image.ndim == 2 else w[..., None]) * image[(y0 + i - 1).clip(0, height - 1), (x0 + j - 1).clip(0, width - 1)]
        out[top : top + len(ys)] = _bytes(total)
    return out


def resize(image: np.ndarray, factor: float) -> np.ndarray:
    """Both sides times the factor, truncated, by cubic convolution."""
    out = image.astype(np.float64)
    for axis in (0, 1):
        n, new = image.shape[axis], int(image.shape[axis] * factor)
        at = (np.arange(new) + 0.5) * n / new - 0.5
        low = np.floor(at).astype(int)
        weights, shape = _cubic(at - low), [1] * image.ndim
        shape[axis] = new
        out = sum(weights[:, k].reshape(shape) * out.take((low + k - 1).clip(0, n - 1), axis=axis) for k in range(4))
    return _bytes(out)


def fit(image: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Shrunk so that the longer side is at most `longest`, by windowed sinc of three lobes; never to nothing."""
    if max(image.shape[:2]) <= longest:
        return image
    scale = longest / max(image.shape[:2])
    sizes = [int(n * scale) for n in image.shape[:2]]
    if min(sizes) < 1:
        return image
    out = image.astype(np.float64)
    for axis, new in enumerate(sizes):
        n = image.shape[axis]
        step = n / new
        centre = (np.arange(new) + 0.5) * step
        taps = np.arange(int(math.ceil(6 * step)) + 1)
        at = np.floor(centre - 3 * step).astype(int)[:, None] + taps
        d = (at + 0.5 - centre[:, None]) / step
        w = np.where((np.abs(d) < 3) & (at >= 0) & (at < n), np.sinc(d) * np.sinc(d / 3), 0)
        w /= w.sum(axis=1, keepdims=True)
        shape = [1] * image.ndim
        shape[axis] = new
        out = sum(w[:, k].reshape(shape) * out.take(at[:, k].clip(0, n - 1), axis=axis) for k in taps)
    return _bytes(out)


def preset_of(image: np.ndarray, preset: str) -> str:
    """The preset that is meant: a known one itself; else by brightness and contrast."""
    asked = preset.strip().lower()
    if asked in PRESETS:
        return asked
    g = gray(image)
    return "low_light" if g.mean() < DIM else "photo" if g.std() > STRONG else "clean_doc"


def prepare(image: np.ndarray, preset: str = "auto") -> tuple[np.ndarray, str]:
    """The colour image, straightened and scaled as its preset says, and the preset. The cleaned gray image only serves
    to find the tilt."""
    name = preset_of(image, preset)
    scale_first, small, up, else_up = PRESETS[name]
    factor = up if max(image.shape[:2]) < small else else_up
    scaled = lambda x: x if factor == 1 else resize(x, factor)
    image = scaled(image) if scale_first else image
    image = rotate(image, skew(threshold(equalize(median3(gray(image))))))
    return (image if scale_first else scaled(image)), name
