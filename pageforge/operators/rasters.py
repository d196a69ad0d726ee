"""Preparation of gray rasters, as array columns in row-major order whose sides are known, with array functions, single
characters in batches.

Everything else is an expression on a raster `px` (SQL), so steps compose without a shuffle and rows stay rows. Blurs, scaling
and Gaussian means are separable: each is a table of weights per output row and column, worked out from a rule, and a pass
along rows, then one along columns. Sums are rounded to six decimals before they become levels, so that results don't
depend on the order of additions.

Defined results: edges are repeated, but for `blur3`, which mirrors them; levels are cut to 0..255; a null raster gives
null.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Block and offset of the threshold, limit of the equalisation, levels and sizes of tilts, scales of the
#: presets as (scales first, sides below this, their scale, the scale of others), border of single characters.
BLOCK, OFFSET, CLIP = 31, 10, 2.0
DARK, LEAST_DARK, STEEPEST, FLATTEST = 128, 1500, 12.0, 0.05
PRESETS = {"clean_doc": (False, 2200, 1.5, 1.0), "photo": (True, 1800, 1.6, 1.25), "low_light": (False, 1800, 1.7, 1.3)}
SMALL_CHAR, BORDER = 64, 8
#: Characters that are prepared at once.
CHARS = 500

Weights = list[dict[int, float]]


def let(value: str, name: str, body: str) -> str:
    """body with `name` for a value that is worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def cubic(n: int, new: int, a: float = -0.75) -> Weights:
    """For each of `new` places the weights of `n` cells, by cubic convolution."""
    near, far = lambda d: ((a + 2) * d - (a + 3)) * d * d + 1, lambda d: ((a * d - 5 * a) * d + 8 * a) * d - 4 * a
    found = []
    for k in range(new):
        at = (k + 0.5) * n / new - 0.5
        low, row = math.floor(at), {}
        t = at - low
        for i, w in enumerate((far(1 + t), near(t), near(1 - t), far(2 - t))):
            place = min(n - 1, max(0, low + i - 1))
            row[place] = row.get(place, 0.0) + w
        found.append(row)
    return found


def gaussian(n: int, block: int = BLOCK) -> Weights:
    """For each of n cells the Gaussian weights of the block around it, edges repeated."""
    half, sigma = block // 2, 0.3 * ((block - 1) * 0.5 - 1) + 0.8
    kernel = [math.exp(-((k - half) ** 2) / (2 * sigma**2)) for k in range(block)]
    found = []
    for k in range(n):
        row: dict[int, float] = {}
        for i, w in enumerate(kernel):
            place = min(n - 1, max(0, k + i - half))
            row[place] = row.get(place, 0.0) + w / sum(kernel)
        found.append(row)
    return found


def blur3(n: int) -> Weights:
    """For each of n cells a quarter, a half and a quarter of its neighbours and itself, mirrored at the edges."""
    found = []
    for k in range(n):
        row: dict[int, float] = {}
        for i, w in ((k - 1, 0.25), (k, 0.5), (k + 1, 0.25)):
            place = abs(i) if i < n else max(0, 2 * n - 2 - i)
            row[place] = row.get(place, 0.0) + w
        found.append(row)
    return found


def _table(weights: Weights) -> tuple[int, str, str]:
    """(entries of a row, places, weights) as SQL arrays, rows filled up with weights of 0."""
    width = max(len(r) for r in weights)
    rows = [sorted(r.items()) + [(0, 0.0)] * (width - len(r)) for r in weights]
    return width, f"array({', '.join(str(i) for r in rows for i, _ in r)})", f"array({', '.join(f'{w:.17e}D' for r in rows for _, w in r)})"


def linear(px: str, width: int, down: Weights, across: Weights, height: int) -> str:
    """Doubles: every output cell is the sum of cells by the weights of its row and its column."""
    (n, ci, cw), (m, ri, rw), new = _table(across), _table(down), len(across)
    cell = f"sequence(0, {height * new - 1})"
    first = f"transform({cell}, k -> aggregate(sequence(0, {n - 1}), 0D, (s, t) -> s + p[CAST(k div {new} * {width} AS INT) + {ci}[k % {new} * {n} + t]] * {cw}[k % {new} * {n} + t]))"
    second = (
        f"transform(sequence(0, {len(down) * new - 1}), k -> round(aggregate(sequence(0, {m - 1}), 0D, (s, t) -> "
        f"s + q[{ri}[CAST(k div {new} * {m} AS INT) + t] * {new} + k % {new}] * {rw}[CAST(k div {new} * {m} AS INT) + t]), 6))"
    )
    return let(px, "p", let(first, "q", second))


def levels(values: str) -> str:
    return f"transform({values}, v -> CAST(least(255, greatest(0, floor(v + 0.5D))) AS INT))"


def resize(px: str, height: int, width: int, new_height: int, new_width: int) -> str:
    return levels(linear(px, width, cubic(height, new_height), cubic(width, new_width), height))


def threshold(px: str, height: int, width: int, block: int = BLOCK, offset: int = OFFSET) -> str:
    """255 where a pixel is brighter than the Gaussian mean around it less the offset, else 0."""
    mean = linear("o", width, gaussian(height, block), gaussian(width, block), height)
    return let(px, "o", let(mean, "g", f"transform(o, (v, k) -> IF(v > floor(g[k] + 0.5D) - {offset}, 255, 0))"))


def median3(px: str, height: int, width: int) -> str:
    """The 3 by 3 median."""
    at = lambda dy, dx: f"p[CAST(least({height - 1}, greatest(0, k div {width} + ({dy}))) * {width} + least({width - 1}, greatest(0, k % {width} + ({dx}))) AS INT)]"
    near = ", ".join(at(y, x) for y in (-1, 0, 1) for x in (-1, 0, 1))
    return let(px, "p", f"transform(sequence(0, {height * width - 1}), k -> sort_array(array({near}))[4])")


def _between(n: int, size: int, grid: int) -> list[tuple[int, int, float]]:
    """Per cell the two parts of the grid it lies between, and how far it is from the first."""
    found = []
    for k in range(n):
        at = k / size - 0.5
        low = math.floor(at)
        found.append((min(grid - 1, max(0, low)), min(grid - 1, max(0, low + 1)), at - low))
    return found


def equalize(px: str, height: int, width: int, grid: int = 8, clip: float = CLIP) -> str:
    """Contrast-limited equalisation: each part of the grid has its histogram cut at a limit, what is over is spread over
    all levels, and a pixel takes the mean of the cumulative maps of the four parts around it. A map is needed only at the
    levels that occur, so it is summed up from the part's own levels."""
    if height % grid or width % grid:
        raise ValueError(f"a raster of {height} by {width} can't be cut into {grid} by {grid} equal parts")
    th, tw = height // grid, width // grid
    many, limit = th * tw, max(1, int(clip * th * tw / 256))
    part = f"transform(sequence(0, {many - 1}), c -> p[CAST((t div {grid} * {th} + c div {tw}) * {width} + t % {grid} * {tw} + c % {tw} AS INT)])"
    counts = "transform(array_distinct(a), u -> struct(u AS u, size(filter(a, z -> z = u)) AS c))"
    over = f"aggregate(h, 0, (s, x) -> s + greatest(0, x.c - {limit}))"
    parts = f"transform(sequence(0, {grid * grid - 1}), t -> {let(part, 'a', let(counts, 'h', f'struct(h AS h, {over} AS over)'))})"
    rows, cols = _between(height, th, grid), _between(width, tw, grid)
    column = lambda table, k: f"array({', '.join(str(r[k]) if k < 2 else f'{r[k]:.17e}D' for r in table)})"
    y, x = f"CAST(k div {width} AS INT)", f"k % {width}"

    def mapped(a: int, b: int) -> str:
        tile = f"m[{column(rows, a)}[{y}] * {grid} + {column(cols, b)}[{x}]]"
        rest = "e.over % 256"
        sums = f"aggregate(e.h, 0, (s, z) -> s + IF(z.u <= v, least({limit}, z.c), 0)) + e.over div 256 * (v + 1)"
        spread = f"IF({rest} > 0, least({rest}, v div greatest(1, 256 div greatest(1, {rest})) + 1), 0)"
        return let(tile, "e", f"floor(({sums} + {spread}) * {255 / many:.17e}D + 0.5D)")

    fy, fx = f"{column(rows, 2)}[{y}]", f"{column(cols, 2)}[{x}]"
    mixed = f"round(({mapped(0, 0)} * (1 - {fx}) + {mapped(0, 1)} * {fx}) * (1 - {fy}) + ({mapped(1, 0)} * (1 - {fx}) + {mapped(1, 1)} * {fx}) * {fy}, 6)"
    return let(px, "p", let(parts, "m", levels(f"transform(p, (v, k) -> {mixed})")))


def skew(px: str, height: int, width: int, least: int = LEAST_DARK, steepest: float = STEEPEST, below: int = DARK) -> str:
    """The turn in degrees that straightens the smallest rectangle around the dark pixels; 0 for fewer than `least` of them
    and for turns above `steepest`. The rectangle lies along a side of the convex hull, which is folded point by point."""
    row = f"filter(sequence(0, {width - 1}), x -> p[y * {width} + x] < {below})"
    ends = "CASE WHEN size(r) = 0 THEN array() WHEN size(r) = 1 THEN array(struct(y AS y, r[0] AS x)) ELSE array(struct(y AS y, r[0] AS x), struct(y AS y, element_at(r, -1) AS x)) END"
    points = f"flatten(transform(sequence(0, {height - 1}), y -> {let(row, 'r', ends)}))"
    cross = "(s[i].y - s[i - 1].y) * (d.x - s[i - 1].x) - (s[i].x - s[i - 1].x) * (d.y - s[i - 1].y)"
    kept = f"IF(size(s) < 2, size(s), 1 + size(filter(sequence(1, size(s) - 1), i -> {cross} > 0)))"
    half = lambda run: f"aggregate({run}, CAST(array() AS array<struct<y:int,x:int>>), (s, d) -> concat(slice(s, 1, {kept}), array(d)), s -> slice(s, 1, size(s) - 1))"
    along, over = "f.y * q.y + f.x * q.x", "f.y * q.x - f.x * q.y"
    extent = lambda e: f"(array_max(transform(h, q -> {e})) - array_min(transform(h, q -> {e})))"
    side = "struct(h[(i + 1) % size(h)].y - h[i].y AS y, h[(i + 1) % size(h)].x - h[i].x AS x)"
    angle = "round(45D - pmod(degrees(atan2(CAST(f.x AS DOUBLE), CAST(f.y AS DOUBLE))) + 45D, 90D), 6)"
    box = f"struct({extent(along)} * {extent(over)} / CAST(f.y * f.y + f.x * f.x AS DOUBLE) AS area, abs({angle}) AS off, {angle} AS angle)"
    best = f"array_min(transform(sequence(0, size(h) - 1), i -> {let(side, 'f', box)})).angle"
    hull = f"concat({half('e')}, {half('reverse(e)')})"
    found = let(hull, "h", f"IF(size(h) < 3, 0D, {let(best, 'b', f'IF(abs(b) > {steepest}D, 0D, b)')})")
    return let(px, "p", f"IF(size(filter(p, v -> v < {below})) < {least}, 0D, {let(points, 'e', f'IF(size(e) < 2, 0D, {found})')})")


def rotate(px: str, height: int, width: int, angle: str) -> str:
    """Turned counter-clockwise by `angle` degrees about the middle, same size, by cubic convolution; tilts under FLATTEST
    change nothing."""
    cy, cx = height // 2, width // 2
    near = lambda d: f"((1.25D * {d} - 2.25D) * {d} * {d} + 1D)"
    far = lambda d: f"(((-0.75D * {d} + 3.75D) * {d} - 6D) * {d} + 3D)"
    weights = lambda t: f"array({far(f'(1D + {t})')}, {near(t)}, {near(f'(1D - {t})')}, {far(f'(2D - {t})')})"
    y, x = f"(k div {width} - {cy})", f"(k % {width} - {cx})"
    place = f"struct(round(sin(g) * {x} + cos(g) * {y} + {cy}, 9) AS y, round(cos(g) * {x} - sin(g) * {y} + {cx}, 9) AS x)"
    tap = f"p[CAST(least({height - 1}, greatest(0, floor(o.y) + t div 4 - 1)) * {width} + least({width - 1}, greatest(0, floor(o.x) + t % 4 - 1)) AS INT)]"
    total = f"round(aggregate(sequence(0, 15), 0D, (s, t) -> s + wy[CAST(t div 4 AS INT)] * wx[t % 4] * {tap}), 6)"
    pixel = let(place, "o", let(weights("(o.y - floor(o.y))"), "wy", let(weights("(o.x - floor(o.x))"), "wx", total)))
    turned = let(f"radians({angle})", "g", levels(f"transform(sequence(0, {height * width - 1}), k -> {pixel})"))
    return let(px, "p", f"IF(abs({angle}) < {FLATTEST}D, p, {turned})")


def prepared(px: str, height: int, width: int, preset: str, least: int = LEAST_DARK, grid: int = 8) -> tuple[str, int, int]:
    """The raster, straightened and scaled as the preset says, and its sides. The cleaned raster only serves to find the
    tilt."""
    scale_first, small, up, else_up = PRESETS[preset]
    factor = up if max(height, width) < small else else_up
    new_height, new_width = int(height * factor), int(width * factor)
    grow = lambda p: resize(p, height, width, new_height, new_width) if factor != 1 else p
    h, w = (new_height, new_width) if scale_first else (height, width)
    clean = threshold(equalize(median3("r", h, w), h, w, grid), h, w)
    turned = let(skew(clean, h, w, least), "turn", rotate("r", h, w, "turn"))
    return (let(grow(px), "r", turned) if scale_first else grow(let(px, "r", turned))), new_height, new_width


def _matrix(weights: Weights, n: int) -> np.ndarray:
    found = np.zeros((len(weights), n))
    for k, row in enumerate(weights):
        found[k, list(row)] = list(row.values())
    return found


def single_char(rows: DataFrame, height: int, width: int) -> DataFrame:
    """rows with px, characters' rasters, as their recogniser gets them: enlarged, blurred, black on white, with a white border.

    Each output cell of the mean takes every cell of its row and column, so the passes are matrix products on a batch of
    rasters, rather than expressions cell by cell.
    """
    scale = 3 if max(height, width) < SMALL_CHAR else 2
    h, w = height * scale, width * scale
    passes = [(_matrix(f(h), n), _matrix(f(w), m)) for f, n, m in ((lambda k: cubic(k // scale, k), height, width), (blur3, h, w), (gaussian, h, w))]
    linear_ = lambda x, down, across: np.round(down @ (x @ across.T), 6)
    level = lambda x: np.clip(np.floor(x + 0.5), 0, 255)
    at = rows.columns.index("px")

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, CHARS):
                part = batch.slice(k, CHARS)
                px, there = part.column(at), np.asarray(part.column(at).is_valid())
                sizes = px.drop_null().value_lengths().to_numpy()
                if (sizes < height * width).any():
                    raise ValueError(f"a raster has fewer than {height} by {width} levels")
                first = np.cumsum(sizes) - sizes
                flat = px.drop_null().flatten().to_numpy(zero_copy_only=False)
                x = flat[first[:, None] + np.arange(height * width)].reshape(-1, height, width).astype(float)
                blurred = level(linear_(level(linear_(x, *passes[0])), *passes[1]))
                dark = blurred <= np.floor(linear_(blurred, *passes[2]) + 0.5) - OFFSET
                framed = np.full((len(x), h + 2 * BORDER, w + 2 * BORDER), 255, np.int32)
                framed[:, BORDER:-BORDER, BORDER:-BORDER][dark] = 0
                ends = np.concatenate([[0], np.cumsum(np.where(there, framed[0].size if len(x) else 0, 0))])
                made = pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=np.append(~there, False)), pa.array(framed.ravel()))
                columns = [made if c == at else part.column(c) for c in range(part.num_columns)]
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    kinds = ", ".join(f"`{f.name}` {'array<int>' if f.name == 'px' else f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, kinds)
