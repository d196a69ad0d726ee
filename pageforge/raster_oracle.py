"""The raster steps in DuckDB's SQL, over rows (vec_id, y, x, v), as chains of common table expressions."""

from __future__ import annotations

from pageforge.operators import rasters
from pageforge.queries import TILE_DARK, TILE_GRID


def _values(weights) -> str:
    rows = ", ".join(f"({o}, {i}, {w:.17e})" for o, row in enumerate(weights) for i, w in row.items())
    return f"(VALUES {rows}) {{}}(o, i, w)"


def linear(source: str, down, across, made: str = "CAST(least(255, greatest(0, floor({} + 0.5::DOUBLE))) AS INTEGER)") -> str:
    value = made.format("round(sum(s.v * r.w * c.w), 6)")
    return f"SELECT s.vec_id, r.o AS y, c.o AS x, {value} AS v FROM {source} s JOIN {_values(down).format('r')} ON s.y = r.i JOIN {_values(across).format('c')} ON s.x = c.i GROUP BY ALL"


def resize(source: str, h: int, w: int, new_h: int, new_w: int) -> str:
    return linear(source, rasters.cubic(h, new_h), rasters.cubic(w, new_w))


def threshold(source: str, h: int, w: int) -> str:
    mean = linear(source, rasters.gaussian(h), rasters.gaussian(w), "floor({} + 0.5::DOUBLE)")
    return f"SELECT s.vec_id, s.y, s.x, CASE WHEN s.v > g.v - {rasters.OFFSET} THEN 255 ELSE 0 END AS v FROM {source} s JOIN ({mean}) g USING (vec_id, y, x)"


def median(source: str, h: int, w: int) -> str:
    return f"""SELECT a.vec_id, a.y, a.x, list_sort(list(b.v))[5] AS v FROM {source} a, (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx)
 JOIN {source} b ON b.vec_id = a.vec_id AND b.y = least({h - 1}, greatest(0, a.y + dy)) AND b.x = least({w - 1}, greatest(0, a.x + dx)) GROUP BY ALL"""


def equalize(source: str, h: int, w: int, grid: int) -> str:
    th, tw = h // grid, w // grid
    limit = max(1, int(rasters.CLIP * th * tw / 256))
    near = lambda at, size: f"floor(({at} + 0.0::DOUBLE) / {size} - 0.5)"
    return f"""WITH hist AS (SELECT vec_id, y // {th} AS ty, x // {tw} AS tx, v, count(*) AS c FROM {source} GROUP BY ALL),
 over AS (SELECT vec_id, ty, tx, CAST(sum(greatest(0, c - {limit})) AS BIGINT) AS o FROM hist GROUP BY ALL),
 four AS (SELECT s.*, dy, dx, CAST(least({grid - 1}, greatest(0, {near('y', th)} + dy)) AS BIGINT) AS ty, CAST(least({grid - 1}, greatest(0, {near('x', tw)} + dx)) AS BIGINT) AS tx,
  CASE dy WHEN 0 THEN 1 - (y::DOUBLE / {th} - 0.5 - {near('y', th)}) ELSE y::DOUBLE / {th} - 0.5 - {near('y', th)} END AS fy,
  CASE dx WHEN 0 THEN 1 - (x::DOUBLE / {tw} - 0.5 - {near('x', tw)}) ELSE x::DOUBLE / {tw} - 0.5 - {near('x', tw)} END AS fx
  FROM {source} s, (SELECT unnest([0, 1]) AS dy), (SELECT unnest([0, 1]) AS dx)),
 maps AS (SELECT f.vec_id, f.y, f.x, f.v, dy, dx, fy, fx, floor((sum(CASE WHEN c IS NULL THEN 0 ELSE least(c, {limit}) END) + any_value(o // 256 * (f.v + 1)
  + CASE WHEN o % 256 > 0 THEN least(o % 256, f.v // greatest(1, 256 // greatest(1, o % 256)) + 1) ELSE 0 END)) * {255 / (th * tw):.17e} + 0.5) AS m
  FROM four f JOIN over USING (vec_id, ty, tx) LEFT JOIN hist g ON g.vec_id = f.vec_id AND g.ty = f.ty AND g.tx = f.tx AND g.v <= f.v
  GROUP BY f.vec_id, f.y, f.x, f.v, dy, dx, fy, fx)
 SELECT vec_id, y, x, CAST(least(255, greatest(0, floor(round(sum(m * fy * fx), 6) + 0.5))) AS INTEGER) AS v FROM maps GROUP BY vec_id, y, x"""


def skew(source: str, least: int, steepest: float) -> str:
    """A side of the hull has all points on one side; of the rectangles along them, the smallest."""
    return f"""WITH dark AS (SELECT vec_id, y, x FROM {source} WHERE v < {rasters.DARK}),
 enough AS (SELECT vec_id FROM dark GROUP BY vec_id HAVING count(*) >= {least}),
 ends AS (SELECT vec_id, y, min(x) AS x FROM dark JOIN enough USING (vec_id) GROUP BY vec_id, y UNION SELECT vec_id, y, max(x) FROM dark JOIN enough USING (vec_id) GROUP BY vec_id, y),
 sides AS (SELECT a.vec_id, b.y - a.y AS dy, b.x - a.x AS dx, a.y AS ay, a.x AS ax FROM ends a JOIN ends b ON a.vec_id = b.vec_id AND (a.y <> b.y OR a.x <> b.x)),
 boxes AS (SELECT s.vec_id, dy, dx, min(dy * (e.x - ax) - dx * (e.y - ay)) AS lowest, max(dy * (e.x - ax) - dx * (e.y - ay)) AS highest,
  (max(dy * e.y + dx * e.x) - min(dy * e.y + dx * e.x)) * (max(dy * e.x - dx * e.y) - min(dy * e.x - dx * e.y)) / CAST(dy * dy + dx * dx AS DOUBLE) AS area
  FROM sides s JOIN ends e ON e.vec_id = s.vec_id GROUP BY s.vec_id, dy, dx, ay, ax),
 turns AS (SELECT vec_id, area, round(45 - (((degrees(atan2(dx::DOUBLE, dy::DOUBLE)) + 45) % 90 + 90) % 90), 6) AS angle FROM boxes WHERE lowest >= 0 AND highest > 0),
 best AS (SELECT vec_id, angle FROM turns QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY area, abs(angle), angle) = 1)
 SELECT DISTINCT s.vec_id, CAST(CASE WHEN abs(angle) <= {steepest} THEN angle ELSE 0 END AS DOUBLE) AS angle FROM {source} s LEFT JOIN best USING (vec_id)"""


def rotate(source: str, angles: str, h: int, w: int) -> str:
    near = lambda d: f"((1.25::DOUBLE * {d} - 2.25::DOUBLE) * {d} * {d} + 1)"
    far = lambda d: f"(((-0.75::DOUBLE * {d} + 3.75::DOUBLE) * {d} - 6) * {d} + 3)"
    weight = lambda t, k: f"CASE {k} WHEN 0 THEN {far(f'(1 + {t})')} WHEN 1 THEN {near(t)} WHEN 2 THEN {near(f'(1 - {t})')} ELSE {far(f'(2 - {t})')} END"
    cy, cx = h // 2, w // 2
    return f"""WITH spot AS (SELECT s.vec_id, s.y, s.x, s.v, angle, round(sin(radians(angle)) * (x - {cx}) + cos(radians(angle)) * (y - {cy}) + {cy}, 9) AS py,
  round(cos(radians(angle)) * (x - {cx}) - sin(radians(angle)) * (y - {cy}) + {cx}, 9) AS px FROM {source} s JOIN {angles} USING (vec_id)),
 taps AS (SELECT p.vec_id, p.y, p.x, p.v, angle, ({weight('(py - floor(py))', 'i')}) * ({weight('(px - floor(px))', 'j')}) * t.v AS z
  FROM spot p, (SELECT unnest(range(4)) AS i), (SELECT unnest(range(4)) AS j)
  JOIN {source} t ON t.vec_id = p.vec_id AND t.y = least({h - 1}, greatest(0, floor(py) + i - 1)) AND t.x = least({w - 1}, greatest(0, floor(px) + j - 1)))
 SELECT vec_id, y, x, CASE WHEN abs(angle) < {rasters.FLATTEST} THEN v ELSE CAST(least(255, greatest(0, floor(round(sum(z), 6) + 0.5))) AS INTEGER) END AS v
 FROM taps GROUP BY vec_id, y, x, v, angle"""


def prepared(preset: str) -> tuple[str, str, int]:
    """(tables, name of the last, its width)."""
    first, _, up, _ = rasters.PRESETS[preset]
    side = int(8 * up)
    n = side if first else 8
    steps = [("p0", resize("pixels", 8, 8, side, side) if first else "SELECT vec_id, y, x, v FROM pixels"), ("p1", median("p0", n, n)), ("p2", equalize("p1", n, n, TILE_GRID)),
             ("p3", threshold("p2", n, n)), ("p4", skew("p3", TILE_DARK, rasters.STEEPEST)), ("p5", rotate("p0", "p4", n, n))]
    if not first:
        steps.append(("p6", resize("p5", 8, 8, side, side)))
    return ", ".join(f"{name} AS MATERIALIZED ({sql})" for name, sql in steps), steps[-1][0], side


def raster_sql(tables: str) -> dict[str, str]:
    """tables: the common table expressions up to pixels (vec_id, y, x, v)."""
    def text(made: str, width: int, before: str = "") -> str:
        return f"WITH {tables}{before} SELECT vec_id, string_agg(v, ',' ORDER BY y * {width} + x) AS px FROM ({made}) GROUP BY vec_id"

    thin = ", thin AS (SELECT vec_id, y, x, CASE WHEN (k * 7 + vec_id) % 3 = 0 THEN v ELSE 255 END AS v FROM pixels)"
    blurred = f", big AS ({resize('pixels', 8, 8, 24, 24)}), soft AS ({linear('big', rasters.blur3(24), rasters.blur3(24))}), black AS ({threshold('soft', 24, 24)})"
    framed = f"""SELECT vec_id, y, x, coalesce(b.v, 255) AS v
 FROM (SELECT * FROM (SELECT DISTINCT vec_id FROM pixels), (SELECT unnest(range(40)) AS y), (SELECT unnest(range(40)) AS x)) LEFT JOIN (SELECT vec_id, y + {rasters.BORDER} AS y, x + {rasters.BORDER} AS x, v FROM black) b USING (vec_id, y, x)"""
    found = {
        "tile_threshold": text(threshold("pixels", 8, 8), 8),
        "tile_equalize": text(equalize("pixels", 8, 8, TILE_GRID), 8),
        "tile_skew": f"WITH {tables}{thin}, a AS ({skew('thin', TILE_DARK, 45.0)}), b AS ({skew('thin', TILE_DARK, rasters.STEEPEST)}) SELECT vec_id, a.angle AS wide, b.angle AS turn FROM a JOIN b USING (vec_id)",
        "tile_rotate": text(rotate("pixels", "angles", 8, 8), 8, ", angles AS (SELECT DISTINCT vec_id, CAST(vec_id % 25 - 12 AS DOUBLE) AS angle FROM pixels)"),
        "tile_enlarge": text(resize("pixels", 8, 8, 13, 12), 12),
        "char_raster": text(framed, 40, blurred),
    }
    for preset, name in (("clean_doc", "tile_clean"), ("photo", "tile_photo"), ("low_light", "tile_low_light")):
        steps, last, width = prepared(preset)
        found[name] = text(f"SELECT * FROM {last}", width, f", {steps}")
    return found
