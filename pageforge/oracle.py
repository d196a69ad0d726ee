"""The same queries in DuckDB's SQL."""

from __future__ import annotations

from pageforge.plans.synthetic import SQL as WORDS
from pageforge.queries import DECISIONS, SUFFIXES
from pageforge.raster_oracle import raster_sql

#: The white space that is stripped, as RE2 classes.
_REST = r"\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WS, WS_NOT_LF = r"[\x09-\x0d\x1c-\x20" + _REST, r"[\x09\x0b-\x0d\x1c-\x20" + _REST


def strip(t: str) -> str:
    return rf"regexp_replace({t}, '^{WS}+|{WS}+\z', '', 'g')"


def breaks(t: str) -> str:
    t = rf"regexp_replace({t}, '\r\n?', chr(10), 'g')"
    t = f"regexp_replace({t}, '{WS_NOT_LF}+\\n', chr(10), 'g')"
    return strip(rf"regexp_replace({t}, '\n{{3,}}', chr(10) || chr(10), 'g')")


def clean(t: str) -> str:
    t = rf"regexp_replace(replace({t}, chr(160), ' '), '[^\x00-\x7F]+', ' ', 'g')"
    return strip(f"regexp_replace({t}, '{WS}+', ' ', 'g')")


def first(t: str, pattern: str) -> str:
    return f"nullif(regexp_extract({t}, '{pattern}'), '')"


TURNS = f"turns AS (SELECT conv_id, turn AS page_index, {strip("coalesce(text, '')")} AS t FROM conversations)"
THR = "thr AS (SELECT page_id, greatest(8, 0.65 * list_sort(list(greatest(1, y2 - y1)))[count(*) // 2 + 1]) AS thr FROM words GROUP BY page_id)"
FOLD = f"""o AS MATERIALIZED (SELECT page_id, seq, (y1 + y2) / 2.0::DOUBLE AS yc, row_number() OVER (PARTITION BY page_id ORDER BY (y1 + y2) / 2.0, x1, seq) AS rn FROM words),
{THR}, f AS (SELECT page_id, rn, yc AS m, 1 AS k, 0 AS line_no FROM o WHERE rn = 1 UNION ALL
 SELECT o.page_id, o.rn, CASE WHEN abs(o.yc - f.m) <= thr THEN (f.m * f.k + o.yc) / (f.k + 1) ELSE o.yc END, CASE WHEN abs(o.yc - f.m) <= thr THEN f.k + 1 ELSE 1 END, CASE WHEN abs(o.yc - f.m) <= thr THEN f.line_no ELSE f.line_no + 1 END
 FROM f JOIN o ON o.page_id = f.page_id AND o.rn = f.rn + 1 JOIN thr ON thr.page_id = f.page_id), grouped AS (SELECT o.page_id, o.seq, f.line_no FROM f JOIN o USING (page_id, rn))"""
LINES = f"""{WORDS}, {FOLD}, line_rows AS (SELECT page_id, line_no, round(sum(ca) / (count(*) * 100.0::DOUBLE), 6) AS conf, min(x1) AS bx1, min(y1) AS by1, max(x2) AS bx2, max(y2) AS by2, count(*) AS n_words,
 {strip(f"string_agg({strip('text')}, ' ' ORDER BY x1, y1, (y1 + y2) / 2.0, seq)")} AS line_text FROM words JOIN grouped USING (page_id, seq) GROUP BY page_id, line_no HAVING line_text <> '')"""
CV = "CASE WHEN count(*) < 2 OR sum({0}) <= 0 THEN 0 ELSE sqrt(greatest(0, CAST(count(*) * sum({0} * {0}) - sum({0}) * sum({0}) AS DOUBLE))) / sum({0}) END"
STATS = f"""{WORDS}, s0 AS (SELECT page_id, count(*) AS n, CAST(sum(length({strip('text')})) AS BIGINT) AS chars, round(sum(ca) / (count(*) * 100.0::DOUBLE), 9) AS avg_a, round(sum(cb) / (count(*) * 100.0::DOUBLE), 9) AS avg_b,
 round(count(*) FILTER (WHERE cb >= 50) / count(*)::DOUBLE, 9) AS ratio_b, round({CV.format('(y2 - y1)')}, 9) AS height_cv, round({CV.format('ca')}, 9) AS conf_cv FROM words GROUP BY page_id),
 stats AS (SELECT *, avg_a * (1 + least(chars / 200.0::DOUBLE, 5)) AS score_a, avg_b * (1 + least(chars / 200.0::DOUBLE, 5)) AS score_b FROM s0)"""
TILES = "tiles AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(trunc(least(255, greatest(0, (CAST(v AS DOUBLE) + 0.5) * 255))) AS INTEGER)) AS px FROM embeddings)"
PIXELS = "pixels AS (SELECT vec_id, label, k, k // 8 AS y, k % 8 AS x, px[k + 1] AS v FROM tiles, (SELECT unnest(range(64)) AS k))"
EDGE = "edges AS (SELECT a.vec_id, sum(CASE WHEN b.x = a.x - 1 THEN abs(a.v - b.v) END) / 56.0::DOUBLE + sum(CASE WHEN b.y = a.y - 1 THEN abs(a.v - b.v) END) / 56.0::DOUBLE AS e FROM pixels a JOIN pixels b ON a.vec_id = b.vec_id AND ((a.y = b.y AND b.x = a.x - 1) OR (a.x = b.x AND b.y = a.y - 1)) GROUP BY a.vec_id)"
ROUTES = f"""{STATS}, {TILES}, {PIXELS}, {EDGE}, de AS (SELECT page_id, round(CASE WHEN page_id % 2 = 0 THEN e / 4 ELSE e END, 6) AS edge FROM (SELECT DISTINCT page_id FROM words) JOIN edges ON vec_id = page_id % 500),
 hw AS (SELECT stats.*, coalesce(edge, 0) AS edge, CASE WHEN n = 0 OR (chars >= 100 AND avg_a >= 0.78) OR (chars >= 150 AND avg_a >= 0.72) THEN false
 ELSE (n >= 8 AND height_cv > 0.35 AND avg_a < 0.70) OR (n >= 10 AND conf_cv > 0.45 AND avg_a < 0.68) OR (chars >= 30 AND avg_a < 0.72 AND coalesce(edge, 0) >= 22) OR (chars >= 15 AND avg_a < 0.60 AND coalesce(edge, 0) >= 25) END AS handwritten FROM stats LEFT JOIN de USING (page_id)),
 routes AS (SELECT *, CASE WHEN handwritten THEN 'paddleocr(handwritten)' WHEN avg_b < 0.20 THEN 'paddleocr(conf_low_fallback)' WHEN ratio_b < 0.40 AND avg_b < 0.45 THEN 'paddleocr(conf_weak_fallback)' WHEN score_b < 0.25 AND score_a > score_b + 0.20 THEN 'paddleocr(score_fallback)'
 WHEN score_b >= CAST(0.85 AS DOUBLE) * score_a AND avg_b >= 0.45 THEN 'tesseract(printed)' WHEN score_a > score_b + 0.25 THEN 'paddleocr(score_fallback)' ELSE 'tesseract(printed)' END AS engine_used FROM hw)"""
GUTTER = f"""{WORDS}, band AS (SELECT DISTINCT page_id, w_px FROM words WHERE w_px > 1.1 * h_px AND (y1 + y2) / 2.0 > 0.15 * h_px AND (y1 + y2) / 2.0 < 0.85 * h_px),
 px AS (SELECT page_id, w_px, c FROM band, (SELECT unnest(range(160, 400)) AS c)),
 covered AS (SELECT DISTINCT page_id, unnest(range(greatest(x1, 160), least(x2, 400))) AS c FROM words WHERE (y1 + y2) / 2.0 > 0.15 * h_px AND (y1 + y2) / 2.0 < 0.85 * h_px),
 free AS (SELECT page_id, w_px, c, c - row_number() OVER (PARTITION BY page_id ORDER BY c) AS island FROM px ANTI JOIN covered USING (page_id, c)),
 gaps AS (SELECT page_id, w_px, min(c) AS start, count(*) AS len FROM free GROUP BY page_id, w_px, island),
 widest AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY len DESC, start) AS r FROM gaps),
 geo AS (SELECT page_id, median(y2 - y1) AS median_h FROM words GROUP BY page_id),
 geometry AS (SELECT page_id, median_h, CAST(coalesce(CASE WHEN len > 0.02 * w_px THEN least(start + len / 2.0, 0.22 * w_px) END, -1) AS DOUBLE) AS sidebar FROM geo LEFT JOIN (SELECT * FROM widest WHERE r = 1) USING (page_id)),
 zoned AS (SELECT words.*, median_h, CASE WHEN (y1 + y2) / 2.0 < CAST(0.12 AS DOUBLE) * h_px THEN 'HEADER' WHEN (y1 + y2) / 2.0 > CAST(0.92 AS DOUBLE) * h_px THEN 'FOOTER' WHEN sidebar <> -1 AND (x1 + x2) / 2.0 < sidebar THEN 'SIDEBAR' ELSE 'BODY' END AS zone FROM words JOIN geometry USING (page_id))"""
ZONES = f"""{GUTTER}, o AS MATERIALIZED (SELECT *, (y1 + y2) / 2.0::DOUBLE AS yc, row_number() OVER (PARTITION BY page_id, zone ORDER BY (y1 + y2) / 2.0, seq) AS rn FROM zoned),
 f AS (SELECT page_id, zone, rn, yc AS y, 0 AS row_no FROM o WHERE rn = 1 UNION ALL SELECT o.page_id, o.zone, o.rn, CASE WHEN abs(o.yc - f.y) < CAST(0.65 AS DOUBLE) * median_h THEN f.y ELSE o.yc END, CASE WHEN abs(o.yc - f.y) < CAST(0.65 AS DOUBLE) * median_h THEN f.row_no ELSE f.row_no + 1 END
 FROM f JOIN o ON o.page_id = f.page_id AND o.zone = f.zone AND o.rn = f.rn + 1),
 parts AS (SELECT o.page_id, o.zone, f.row_no, x1, yc, seq, text, w_px, x1 - lag(x2) OVER (PARTITION BY o.page_id, o.zone, f.row_no ORDER BY x1, yc, seq) AS gap FROM f JOIN o USING (page_id, zone, rn)),
 zrows AS (SELECT page_id, zone, row_no, {strip("string_agg(CASE WHEN gap IS NULL THEN '' WHEN zone = 'BODY' AND gap > CAST(0.035 AS DOUBLE) * w_px THEN '   |   ' ELSE ' ' END || text, '' ORDER BY x1, yc, seq)")} AS row_text FROM parts GROUP BY page_id, zone, row_no)"""
_list = ", ".join(f"'{x}'" for x in SUFFIXES)
_near = "SELECT a.vec_id, a.k, {} AS v FROM pixels a, (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx) JOIN pixels b ON b.vec_id = a.vec_id AND b.y = least(7, greatest(0, a.y + dy)) AND b.x = least(7, greatest(0, a.x + dx)) GROUP BY a.vec_id, a.k, a.v"
_tile = "SELECT vec_id, string_agg(v, ',' ORDER BY k) AS px FROM ({}) GROUP BY vec_id"
MOBILE = "CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN '+91-' WHEN 2 THEN '+91' ELSE '0' END || '9' || lpad(c_custkey::VARCHAR, 9, '0')"

#: A word without one of its letters, and without two, with their places.
_one = "list_transform(range(1, length(w) + 1), lambda i: {'i': i, 'v': left(w, i - 1) || substr(w, i + 1)})"
_two = (
    "flatten(list_transform(range(1, length(w)), lambda i: list_transform(range(i + 1, length(w) + 1), lambda j: "
    "{'i': i, 'j': j, 'v': left(w, i - 1) || substr(w, i + 1, j - i - 1) || substr(w, j + 1)})))"
)


def _keys(kind: int, cut: str, *places: str) -> str:
    """Keys of a word's cuts: the kind, what is left, and a place."""
    made = ", ".join(f"'{kind}:' || x.v || ':' || ({p})" for p in places or ("''",))
    return f"flatten(list_transform({cut}, lambda x: [{made}]))"


#: Keys of a token and of a term that are one edit, or two, apart: where letters are left out of both, keys say where.
_ask1 = f"list_concat(['8:' || w || ':'], {_keys(9, _one)}, {_keys(1, _one)})"
_own1 = f"list_concat(['9:' || w || ':'], {_keys(8, _one)}, {_keys(1, _one)})"
_pair = "(x.i - {}) || ',' || (x.j - {})"
_ask2 = f"list_concat({_ask1}, {_keys(9, _two)}, {_keys(2, _two, _pair.format(0, 0))}, {_keys(3, _two, 'x.i', 'x.j - 1')}, {_keys(4, _one, 'x.i')})"
_own2 = (
    f"list_concat({_own1}, {_keys(8, _two)}, {_keys(2, _two, *(_pair.format(i, j) for i in (0, 1) for j in (0, 1)))}, "
    f"{_keys(3, _one, 'x.i', 'x.i - 1')}, {_keys(4, _two, 'x.i', 'x.i - 1', 'x.j - 1', 'x.j - 2')})"
)
_crossed = (
    "len(list_filter(range(1, length(x)), lambda i: len(list_filter([i - 1, i, i + 1], lambda j: j >= 1 AND "
    "substr(x, i, 1) = substr(y, j + 1, 1) AND substr(x, i + 1, 1) = substr(y, j, 1) AND "
    "levenshtein(left(x, i - 1), left(y, j - 1)) + levenshtein(substr(x, i + 2), substr(y, j + 2)) <= 1)) > 0)) > 0"
)
#: DuckDB counts edits of bytes, so letters beyond a to z take the place of one byte that no token holds.
_letters = "\u00e0\u00e1\u00e2\u00e3\u00e4\u00e5\u00e6\u00e7\u00e8\u00e9\u00ea\u00eb\u00ec\u00ed\u00ee\u00ef\u00f0\u00f1\u00f2\u00f3\u00f4\u00f5\u00f6\u00f8\u00f9\u00fa\u00fb\u00fc\u00fd\u00fe\u00ff\u00df\u0153"
_bytes = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456"
_plain = f"translate({{}}, '{_letters}', '{_bytes}')"


def _met(n: str, asked: str, token_keys: str, term_keys: str) -> str:
    return (
        f"met{n} AS (SELECT DISTINCT a.w AS token, d.w AS term, freq FROM (SELECT w, unnest({token_keys}) AS key FROM {asked}) a "
        f"JOIN (SELECT w, freq, unnest({term_keys}) AS key FROM known) d USING (key)),\n"
        f" near{n} AS MATERIALIZED (SELECT *, damerau_levenshtein(x, y) AS n FROM (SELECT *, {_plain.format('token')} AS x, {_plain.format('term')} AS y FROM met{n}))"
    )


#: Edits where a swap counts one; what is inserted into a swap is left out, which the function would count as two edits.
SPELL = rf"""WITH t AS (SELECT unnest(regexp_split_to_array(text, '[ \n]+')) AS token FROM documents),
 c AS MATERIALIZED (SELECT token, count(*) AS freq FROM t WHERE regexp_full_match(token, '\p{{L}}+') AND lower(token) = token AND upper(token) <> token AND length(token) > 3 GROUP BY token),
 known AS MATERIALIZED (SELECT token AS w, freq FROM c WHERE freq >= 5), asked AS MATERIALIZED (SELECT token AS w FROM c WHERE freq < 5),
 {_met('1', 'asked', _ask1, _own1)},
 best1 AS MATERIALIZED (SELECT token, term, row_number() OVER (PARTITION BY token ORDER BY freq DESC, term) AS k FROM near1 WHERE n = 1 QUALIFY k = 1),
 rest AS MATERIALIZED (SELECT w FROM asked WHERE w NOT IN (SELECT token FROM best1)),
 {_met('2', 'rest', _ask2, _own2)},
 best2 AS (SELECT token, term, row_number() OVER (PARTITION BY token ORDER BY freq DESC, term) AS k FROM near2
  WHERE n = 2 AND (abs(length(x) - length(y)) <> 1 OR levenshtein(x, y) < 3 OR {_crossed}) QUALIFY k = 1),
 r AS (SELECT token, term FROM best1 UNION ALL SELECT token, term FROM best2)
 SELECT c.token, coalesce(term, c.token) AS repaired FROM c LEFT JOIN r USING (token)"""

ORACLE_SQL = {
    "ext_dispatch": f"""WITH n AS (SELECT doc_id, 'doc_' || doc_id || CASE WHEN e = '' THEN '' ELSE '.' || e END AS filename FROM (SELECT doc_id, [{_list}][doc_id % 16 + 1] AS e FROM documents)), s AS (SELECT *, lower(regexp_extract(filename, '(\\.[^./]+)$', 1)) AS suffix FROM n)
SELECT *, suffix IN ('.pdf','.doc','.docx','.ppt','.pptx','.jpg','.jpeg','.png','.webp','.bmp','.tiff','.tif','.gif') AS allowed, CASE WHEN suffix IN ('.pdf','.doc','.ppt') THEN 'pdf' WHEN suffix = '.docx' THEN 'docx' WHEN suffix = '.pptx' THEN 'pptx' ELSE 'image' END AS input_type FROM s""",
    "digital_gate": f"WITH {TURNS} SELECT conv_id, count(*) FILTER (WHERE length(t) >= 200) AS good, count(*) AS pages, good > 0 AS digital FROM turns GROUP BY conv_id",
    "page_limit": f"WITH {TURNS} SELECT conv_id, page_index, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY page_index) AS INTEGER) AS n, CAST(length(t) AS INTEGER) AS chars FROM turns QUALIFY n <= 5",
    "doc_text": f"WITH {TURNS} SELECT conv_id, {breaks(strip('string_agg(t, chr(10) || chr(10) ORDER BY page_index)'))} AS doc_text FROM turns GROUP BY conv_id",
    "linebreak_norm": f"SELECT doc_id, {breaks('replace(text, chr(10), [chr(10), chr(13) || chr(10), chr(13), chr(9) || chr(10), repeat(chr(10), 4)][doc_id % 5 + 1])')} AS t FROM documents",
    "clean_text": f"SELECT doc_id, {clean('text')} AS t FROM documents",
    "letter_digit_split": r"SELECT page_id, replace(replace(regexp_replace(regexp_replace(html, '([a-zA-Z])([0-9])', '\1 \2', 'g'), '([0-9])([a-zA-Z])', '\1 \2', 'g'), 'Firewall', 'View all'), 'Viewall', 'View all') AS t FROM pages",
    "email_first": "SELECT * FROM (SELECT doc_id, " + first(clean("text"), r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b") + " AS email FROM documents) WHERE email IS NOT NULL",
    "alnum_first": "SELECT * FROM (SELECT doc_id, " + first(clean("text"), r"\b[A-Za-z0-9][A-Za-z0-9\-\/]{5,}\b") + " AS id FROM documents) WHERE id IS NOT NULL",
    "field_validate": rf"""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN lpad((c_custkey * 7 % 1000000)::VARCHAR, 6, '0') ELSE right(lpad(c_custkey::VARCHAR, 6, '0'), 6) END AS pincode,
 CASE WHEN c_custkey % 3 = 0 THEN 'x ' || lpad((c_custkey * 7 % 1000000)::VARCHAR, 6, '0') || ' y' ELSE 'none' END AS pin_alias, 'OA-' || lpad(c_custkey::VARCHAR, 5, '0') || '/B' AS policy_no,
 'ABCDE' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') || 'F' AS pan, 'HDFC0' || lpad(c_custkey::VARCHAR, 6, '0') AS ifsc, 'user' || c_custkey || '@mail.example.com' AS email,
 CASE WHEN c_custkey % 4 IN (0, 1) THEN '9' || lpad(c_custkey::VARCHAR, 9, '0') ELSE {MOBILE} END AS mobile FROM customer""",
    "fields_untyped": """SELECT click_id, '"user' || click_id || '@mail.example.com"' AS email, CASE WHEN click_id % 2 = 0 THEN '"ABCDE1234F"' ELSE click_id::VARCHAR END AS pan,
 CASE click_id % 3 WHEN 0 THEN '["9876543210"]' WHEN 1 THEN '"9876543210"' ELSE 'null' END AS mobile, CASE WHEN click_id % 5 = 0 THEN '"560001"' ELSE '7' END AS pincode,
 CASE WHEN click_id % 5 = 0 THEN '"at 560001"' ELSE '560001' END AS pin_alias, json_extract(props, '$.k')::VARCHAR AS k, json_extract(props, '$.device')::VARCHAR AS device,
 json_extract(props, '$.tags')::VARCHAR AS tags FROM clicks WHERE props LIKE '{%}' AND json_valid(props)""",
    "line_group": f"WITH RECURSIVE {WORDS}, {FOLD} SELECT * FROM grouped",
    "line_agg": f"WITH RECURSIVE {LINES} SELECT * FROM line_rows",
    "page_text": f"WITH RECURSIVE {LINES} SELECT page_id, {strip('string_agg(line_text, chr(10) ORDER BY line_no)')} AS page_text, count(*) AS n_lines FROM line_rows GROUP BY page_id",
    "nested_pages": f"WITH RECURSIVE {LINES} SELECT page_id, count(*) AS n_lines, arg_min(line_text, line_no) AS first_line, max(bx2) AS right_edge FROM line_rows GROUP BY page_id",
    "word_stats": f"WITH {STATS} SELECT * FROM stats",
    "route": f"WITH {ROUTES} SELECT page_id, handwritten, engine_used, edge FROM routes",
    "final_words": f"WITH {ROUTES} SELECT page_id, count(*) AS n, CAST(sum(CASE WHEN engine_used LIKE 'paddle%' THEN ca ELSE cb END) AS BIGINT) AS sum_conf, max(x2) AS right_edge FROM words JOIN routes USING (page_id) GROUP BY page_id",
    "engine_first_preset_last": f"WITH {ROUTES}, p AS (SELECT *, page_id // 4 AS doc, CASE page_id % 3 WHEN 0 THEN 'clean_doc' WHEN 1 THEN 'photo' ELSE 'low_light' END AS preset FROM routes) SELECT doc, arg_min(engine_used, page_id) AS engine_used, arg_max(preset, page_id) AS preset_used, count(*) AS pages FROM p GROUP BY doc",
    "gutter": f"WITH {GUTTER} SELECT * FROM geometry",
    "gutter_window": f"WITH {GUTTER} SELECT * FROM geometry",
    "zone_class": f"WITH {GUTTER} SELECT page_id, seq, zone FROM zoned",
    "zone_rows": f"WITH RECURSIVE {ZONES} SELECT * FROM zrows",
    "tagged_text": f"WITH RECURSIVE {ZONES}, b AS (SELECT page_id, zone, '<' || zone || '>' || chr(10) || string_agg('  ' || row_text, chr(10) ORDER BY row_no) AS block FROM zrows GROUP BY page_id, zone) SELECT page_id, chr(10) || '<PAGE 1>' || chr(10) || string_agg(block, chr(10) ORDER BY CASE zone WHEN 'HEADER' THEN 0 WHEN 'SIDEBAR' THEN 1 WHEN 'BODY' THEN 2 ELSE 3 END) AS tagged FROM b GROUP BY page_id",
    "tile_edge": f"WITH {TILES}, {PIXELS}, {EDGE} SELECT vec_id, round(e, 6) AS edge FROM edges",
    "tile_preset": f"WITH {TILES}, {PIXELS}, c AS (SELECT vec_id, CAST(CASE label % 3 WHEN 0 THEN v WHEN 1 THEN v // 2 ELSE CASE WHEN v > 127 THEN 255 ELSE 30 END END AS BIGINT) AS v FROM pixels), m AS (SELECT vec_id, round(sum(v) / 64.0::DOUBLE, 6) AS mean, round(sqrt(CAST(64 * sum(v * v) - sum(v) * sum(v) AS DOUBLE)) / 64.0::DOUBLE, 6) AS sd FROM c GROUP BY vec_id) SELECT *, CASE WHEN mean < 110 THEN 'low_light' WHEN sd > 75 THEN 'photo' ELSE 'clean_doc' END AS preset FROM m",
    "tile_median": f"WITH {TILES}, {PIXELS} " + _tile.format(_near.format("list_sort(list(b.v))[5]")),
    "tile_sharpen": f"WITH {TILES}, {PIXELS} " + _tile.format(_near.format("least(255, greatest(0, 5 * a.v - CAST(sum(CASE WHEN abs(dx) + abs(dy) = 1 THEN b.v ELSE 0 END) AS INTEGER)))")),
    "dims_scale": f"WITH {WORDS}, s AS (SELECT page_id, max(x2) + page_id % 1500 AS w, max(y2) + page_id % 700 AS h FROM words GROUP BY page_id), q AS (SELECT *, CASE WHEN greatest(w, h) > 1600 THEN 1600::DOUBLE / greatest(w, h) ELSE 1 END AS r FROM s) SELECT page_id, CAST(trunc(w * r) AS INTEGER) AS new_w, CAST(trunc(h * r) AS INTEGER) AS new_h FROM q",
    "poly_bbox": f"WITH {WORDS} SELECT page_id, seq, x1 AS bx1, y1 AS by1, x2 AS bx2, y2 AS by2 FROM words",
    "ocr_row_norm": f"WITH {WORDS} SELECT page_id, seq, text, x1, y1, CASE WHEN seq % 11 = 0 OR seq % 13 = 0 THEN 0 ELSE round(ca / 100.0::DOUBLE, 6) END AS conf, x2, y2 FROM words WHERE seq % 17 <> 0",
    "slide_merge": f"WITH s AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN '' ELSE coalesce(text, '') END AS slide, CASE WHEN turn % 2 = 0 THEN upper(role) END AS ocr FROM conversations) SELECT conv_id, turn, CASE WHEN ocr IS NULL THEN slide WHEN slide = '' THEN ocr ELSE {strip('slide || chr(10) || ocr')} END AS t FROM s",
    "docx_union": "SELECT conv_id, 0 AS page_index, CAST(length(text) AS INTEGER) AS chars FROM conversations WHERE turn = 0 UNION ALL SELECT conv_id, page_index, chars FROM (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS page_index, CAST(length(text) AS INTEGER) AS chars FROM conversations WHERE turn > 0) WHERE page_index <= 5",
    "spell_fix": SPELL,
    "digital_text": f"WITH {TURNS} SELECT conv_id, coalesce(string_agg(t, chr(10) || chr(10) ORDER BY page_index) FILTER (WHERE t <> ''), '') AS full_text FROM turns GROUP BY conv_id HAVING count(*) FILTER (WHERE length(t) >= 200) > 0",
    "dark_pixels": f"WITH {TILES} SELECT vec_id, CAST(len(list_filter(px, lambda v: v < 128)) AS INTEGER) AS n_dark, n_dark >= 32 AS enough FROM tiles",
    "tile_gray": f"WITH {TILES}, {PIXELS}, g AS (SELECT vec_id, CAST(2989 * px[k + 1] + 5870 * px[(k + 1) % 64 + 1] + 1140 * px[(k + 2) % 64 + 1] AS BIGINT) AS v FROM tiles, (SELECT unnest(range(64)) AS k)) SELECT vec_id, CAST(sum(v) AS DOUBLE) / 640000.0::DOUBLE AS mean_luma, CAST(max(v) AS DOUBLE) / 10000.0::DOUBLE AS max_luma FROM g GROUP BY vec_id",
    "engine_forced": f"WITH {ROUTES} SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'paddleocr(forced)' WHEN 1 THEN 'tesseract(forced)' ELSE engine_used END AS engine_used FROM routes",
    "page_debug": f"WITH RECURSIVE {ROUTES}, {FOLD}, c AS (SELECT page_id, count(DISTINCT line_no) AS lines_count FROM grouped GROUP BY page_id) SELECT page_id, engine_used, n AS words_count, lines_count, CASE WHEN engine_used LIKE 'paddle%' THEN score_a ELSE score_b END AS score FROM routes JOIN c USING (page_id)",
    "single_char": f"WITH {WORDS}, r AS (SELECT page_id, CAST(seq // 3 AS INTEGER) AS cell, seq, CASE WHEN seq % 17 = 0 THEN ' ' ELSE text END AS t, CASE WHEN seq % 11 <> 0 AND seq % 13 <> 0 THEN ca END AS c FROM words) SELECT page_id, cell, left({strip("string_agg(t, '' ORDER BY seq)")}, 1) AS char, round(coalesce(sum(c) / count(c)::DOUBLE, 0) / 100, 6) AS conf FROM r GROUP BY page_id, cell",
    "flatten_words": f"""WITH RECURSIVE {WORDS}, {FOLD}, g AS (SELECT page_id, line_no, x1, y1, x2, y2, text, seq, CAST(row_number() OVER (PARTITION BY page_id, line_no ORDER BY x1, y1, seq) - 1 AS INTEGER) AS word_no FROM words JOIN grouped USING (page_id, seq)),
 u AS (SELECT page_id, line_no, word_no, text, x1 || ',' || y1 || ',' || x2 || ',' || y2 AS bbox FROM g WHERE line_no % 2 = 0 UNION ALL
 SELECT page_id, line_no, 0, string_agg(text, ' ' ORDER BY x1, y1, seq), min(x1) || ',' || min(y1) || ',' || max(x2) || ',' || max(y2) FROM g WHERE line_no % 2 = 1 GROUP BY page_id, line_no)
 SELECT page_id, CAST(line_no AS INTEGER) AS line_no, word_no, text, bbox, CASE WHEN page_id % 3 = 0 THEN 1920 ELSE 1600 END AS w_px, CASE WHEN page_id % 3 = 1 THEN 1080 ELSE 1200 END AS h_px FROM u""",
    "decision_rows": f"""WITH {WORDS}, v(k, n, chars, avg_a, height_cv, conf_cv, edge, printed_engine, avg_b, ratio_b, score_a, score_b) AS (VALUES """
    + ", ".join(f"({k}, {r})" for k, r in enumerate(x for x in DECISIONS.split("\n") if x)) + """),
 p AS (SELECT page_id, count(*) AS own FROM words GROUP BY page_id), t AS (SELECT p.page_id, v.* REPLACE (CASE WHEN own < 5 THEN own ELSE n END AS n) FROM p JOIN v ON p.page_id % 33 = v.k),
 h AS (SELECT *, n > 0 AND NOT (chars >= 100 AND avg_a >= 0.78) AND NOT (chars >= 150 AND avg_a >= 0.72) AND ((n >= 8 AND height_cv > 0.35 AND avg_a < 0.7)
  OR (n >= 10 AND conf_cv > 0.45 AND avg_a < 0.68) OR (chars >= 30 AND avg_a < 0.72 AND edge >= 22) OR (chars >= 15 AND avg_a < 0.6 AND edge >= 25)) AS handwritten FROM t)
 SELECT page_id, CAST(k AS INTEGER) AS k, handwritten, CASE WHEN handwritten THEN 'paddleocr(handwritten)' WHEN lower(trim(printed_engine)) = 'paddle' THEN 'paddleocr(printed)'
  WHEN avg_b < 0.2 THEN 'paddleocr(conf_low_fallback)' WHEN ratio_b < 0.4 AND avg_b < 0.45 THEN 'paddleocr(conf_weak_fallback)'
  WHEN (score_b < 0.25 AND score_a - score_b > 0.2) THEN 'paddleocr(score_fallback)' WHEN score_b >= 0.85 * score_a AND avg_b >= 0.45 THEN 'tesseract(printed)'
  WHEN score_a - score_b > 0.25 THEN 'paddleocr(score_fallback)' ELSE 'tesseract(printed)' END AS engine_used FROM h""",
    "fallback_body": f"""SELECT doc_id AS doc, '<BODY>' || array_to_string(list_transform(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: {strip('x')} <> ''),
 lambda x: chr(10) || '  ' || replace(replace({strip(r"regexp_replace(regexp_replace(x, '([a-zA-Z])([0-9])', '\1 \2', 'g'), '([0-9])([a-zA-Z])', '\1 \2', 'g')")}, 'Firewall', 'View all'), 'Viewall', 'View all')), '') AS body FROM documents""",
    "best_preset": """WITH t AS (SELECT doc_id, place, ['clean_doc', 'photo', 'low_light'][place + 1] AS preset, CAST((doc_id * (place * 3 + 7) + place) % 5 AS DOUBLE) / 4 AS score
  FROM documents, (SELECT unnest(range(3)) AS place))
 SELECT doc_id, preset, score FROM t QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, place) = 1""",
    "extractor_items": """SELECT c_custkey, CAST(item AS INTEGER) AS item, 'w' || c_custkey AS text, CAST(0.5 AS DOUBLE) AS conf, 1 AS bx1, 2 AS by1, 3 AS bx2, 4 AS by2
 FROM customer JOIN (VALUES (0, 0), (2, 0), (2, 1), (5, 6), (6, 3)) v(k, item) ON c_custkey % 8 = k""",
    "ocr_columnar": f"WITH {WORDS} SELECT page_id, seq, text, x1, y1, CASE WHEN seq % 11 = 0 THEN 0 ELSE round(ca / 100.0::DOUBLE, 6) END AS conf, x2, y2 FROM words WHERE seq % 17 <> 0",
}
ORACLE_SQL |= raster_sql(f"{TILES}, {PIXELS}")
