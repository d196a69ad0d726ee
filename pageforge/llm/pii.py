"""Personal data with DataFrame functions only: expressions propose, checks confirm, context adjusts.

Expressions propose spans, checks confirm them (number ranges, Luhn, mod-97), and each span has a score, which words
just before it adjust. The base kinds (email, ip, card, phone) stay whatever their score; the further kinds iban and
ssn need a score of MIN_SCORE. Positions are counted in code points, from the lengths of what stands between matches:
`split` gives the gaps, `regexp_extract_all` the matches of the same expression.

Time is in proportion to a text's length, however many spans it has: places are counted from match to match.
Expressions are written so that no text makes them slow: runs are taken whole (possessive), a match starts only where
its run starts or where the previous match ended, and a kind is tried only on texts with a character that it needs.

Defined results: null text is empty; empty text has no spans; overlapping spans of different kinds are all reported,
and are redacted as one; rows that repeat are each treated alone; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageforge.functions.folds import before

MIN_SCORE, CONTEXT = 0.5, 48
#: Characters of the pieces from which a redacted text is put together.
PIECE = 4096
LABEL = "[A-Za-z0-9-]++"
EMAIL = rf"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@{LABEL}(?:\.{LABEL})++"
IP = r"[0-9](?<![0-9]{2})[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++"
#: A whole run of digits with single separators, of 13 to 19 digits.
CARD = r"[0-9](?<![0-9]{2})(?<![0-9][ -][0-9])(?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SSN = r"[0-9](?<![0-9-][0-9])[0-9]{2}-[0-9]{2}-[0-9]{4}(?![0-9-])"

#: Letters and digits of an IBAN, by country.
IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 "
    "EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 "
    "IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 "
    "NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 "
    "SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30 "
    "AO25 BF28 BJ28 CF27 CG27 CI28 CM27 CV25 DZ26 GA27 GQ27 GW25 IR26 KM27 MA28 MG27 ML28 MZ25 NE28 SN28 TD27 TG28"
)


def _iban() -> str:
    """Per length: its countries, and exactly so many letters and digits with single blanks."""
    by: dict[int, list[str]] = {}
    for x in IBAN_LENGTHS.split():
        by.setdefault(int(x[2:]), []).append(x[:2])
    kinds = "|".join(f"(?:{'|'.join(c)})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in sorted(by.items()))
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{kinds})(?![A-Za-z0-9])"


IBAN = _iban()

_digits = "regexp_replace(m, '[^0-9]', '')"
_luhn = (
    "aggregate(sequence(1, length(d)), 0, (s, i) -> s + CASE WHEN i % 2 = 1 THEN int(substr(d, -i, 1)) "
    "WHEN int(substr(d, -i, 1)) >= 5 THEN 2 * int(substr(d, -i, 1)) - 9 ELSE 2 * int(substr(d, -i, 1)) END) % 10 = 0"
)
_mod97 = (
    "aggregate(sequence(1, length(d)), 0, (s, i) -> CASE WHEN substr(d, i, 1) <= '9' "
    "THEN (s * 10 + ascii(substr(d, i, 1)) - 48) % 97 ELSE (s * 100 + ascii(substr(d, i, 1)) - 55) % 97 END) = 1"
)


def _with(d: str, check: str) -> str:
    """check, where d stands for an expression that is worked out once."""
    return f"element_at(transform(array({d}), d -> {check}), 1)"


_parts = "forall(split(m, '[.]'), p -> length(ltrim('0', p)) <= 3 AND coalesce(try_cast(nullif(ltrim('0', p), '') AS int), 0) <= 255)"
_turned = "concat(substr(replace(m, ' ', ''), 5), substr(replace(m, ' ', ''), 1, 4))"
_area = "substr(m, 1, 3) NOT IN ('000', '666') AND substr(m, 1, 1) <> '9' AND substr(m, 5, 2) <> '00' AND substr(m, 8, 4) <> '0000'"

#: kind: (expression, what its texts must hold, check of a match m, score, words before it that count, what they add).
KINDS = {
    "email": (EMAIL, "instr(t, '@') > 0", "true", 0.9, "(?:e-?)?mail|mailto|contact|write|reach", 0.1),
    "ip": (IP, "instr(t, '.') > 0", _parts, 0.6, "ip|host|server|address|client", 0.3),
    "card": (CARD, "true", _with(_digits, _luhn), 0.8, "card|visa|credit|debit|payment|account", 0.2),
    "phone": (PHONE, "instr(t, '+') > 0", f"length({_digits}) BETWEEN 9 AND 15", 0.6, "phone|tel|telephone|call|mobile|fax", 0.3),
    "iban": (IBAN, "true", _with(_turned, _mod97), 0.6, "iban|bank|account|transfer|konto", 0.3),
    "ssn": (SSN, "instr(t, '-') > 0", _area, 0.3, "ssns?|social|security|taxpayer", 0.4),
}
BASE = ("email", "ip", "card", "phone")


def _quoted(pattern: str) -> str:
    return pattern.replace("\\", "\\\\")


def _spans(kind: str, m: str, g: str) -> str:
    """Spans of a kind from its matches m and the gaps g before, between and after them. The text before a match is what
    the last gap and, where that is short, earlier matches hold."""
    place = before(f"size({m})", f"length(get({g}, w - 1)) + length(get({m}, w - 1))", "{a} + {x}")
    # a match has three characters or more
    earlier = f"array_join(flatten(transform(sequence(greatest(0, k - {CONTEXT // 3}), k - 1), j -> array(get({g}, j), get({m}, j)))), '')"
    near = f"right(concat(IF(k = 0 OR length(get({g}, k)) >= {CONTEXT}, '', {earlier}), get({g}, k)), {CONTEXT})"
    _, _, check, score, words, plus = KINDS[kind]
    points = f"{score}D + IF(lower({near}) RLIKE '\\\\b(?:{words})\\\\b', {plus}D, 0D)"
    start = f"p + length(get({g}, k))"
    span = f"transform({place}, (p, k) -> struct('{kind}' AS kind, {start} AS start, {start} + length(get({m}, k)) AS end, {points} AS score, get({m}, k) AS m))"
    keep = f"coalesce(element_at(transform(array(x.m), m -> {check}), 1), false)" + ("" if kind in BASE else f" AND x.score >= {MIN_SCORE}")
    return f"transform(filter({span}, x -> {keep}), x -> struct(x.kind AS kind, x.start AS start, x.end AS end, x.score AS score))"


def with_spans(docs: DataFrame) -> DataFrame:
    """(own, pii): the row's own columns as a struct, and for each kind in order, then by start, (kind, start, end,
    score) with ends exclusive."""
    found = docs.select(F.struct("*").alias("own")).withColumn("t", F.coalesce(F.col("own").getField("text"), F.lit("")))
    none = "CAST(array() AS array<struct<kind:string,start:int,end:int,score:double>>)"
    for kind, (pattern, needs, *_) in KINDS.items():
        m, g, s = f"_m_{kind}", f"_g_{kind}", f"_s_{kind}"
        found = found.withColumn(m, F.expr(f"CASE WHEN {needs} THEN regexp_extract_all(t, '{_quoted(pattern)}', 0) ELSE array() END"))
        found = found.withColumn(g, F.expr(f"CASE WHEN size({m}) > 0 THEN split(t, '{_quoted(pattern)}', -1) ELSE array() END"))
        found = found.withColumn(s, F.expr(f"CASE WHEN size({m}) > 0 THEN {_spans(kind, m, g)} ELSE {none} END"))
    return found.select("own", F.concat(*[F.col(f"_s_{k}") for k in KINDS]).alias("pii"))


def listed(spans: str) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.expr(f"array_join(transform({spans}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')")


def _between(start: str, end: str) -> str:
    """The text from start to end, from its pieces _c of PIECE characters: cutting at a place of a string takes time in
    proportion to the place, which is small here."""
    first, last = f"CAST({start} div {PIECE} AS int)", f"CAST({end} div {PIECE} AS int)"
    return (
        f"IF({first} = {last}, substr(coalesce(get(_c, {first}), ''), {start} % {PIECE} + 1, {end} - {start}), "
        f"concat(substr(get(_c, {first}), {start} % {PIECE} + 1), array_join(slice(_c, {first} + 2, {last} - {first} - 1), ''), "
        f"substr(coalesce(get(_c, {last}), ''), 1, {end} % {PIECE})))"
    )


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span replaced by its kind in angle brackets; overlapping spans become one, named by the first.
    n_chars, where there is one, follows the new text; null text stays null."""
    own = lambda name: F.col("own").getField(name)
    found = with_spans(docs).withColumn("_t", own("text")).withColumn(
        "_p", F.expr("array_sort(transform(pii, x -> struct(x.start AS start, -x.end AS back, x.kind AS kind, x.end AS end)))")
    )
    # a span that starts behind the ends of all before it is shown; what lies between goes before it
    reached = before("size(_p)", "get(_p, w - 1).end", "greatest({a}, {x})")
    shown = f"transform({reached}, (e, k) -> IF(get(_p, k).start >= e, named_struct('f', e, 's', get(_p, k).start, 'kind', get(_p, k).kind), NULL))"
    some = "size(_p) > 0"
    found = found.withColumn("_c", F.expr(f"CASE WHEN {some} THEN regexp_extract_all(_t, '(?s).{{1,{PIECE}}}', 0) END"))
    found = found.withColumn("_s", F.expr(f"CASE WHEN {some} THEN filter({shown}, x -> x IS NOT NULL) END"))
    found = found.withColumn("_e", F.expr("array_max(transform(_p, x -> x.end))")).withColumn("_n", F.length("_t"))
    parts = f"transform(_s, x -> concat({_between('x.f', 'x.s')}, '<', upper(x.kind), '>'))"
    found = found.withColumn("_new", F.expr(f"CASE WHEN {some} THEN concat(array_join({parts}, ''), {_between('_e', '_n')}) ELSE _t END"))
    new = {"text": F.col("_new")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.expr(some), F.length("_new").cast(docs.schema["n_chars"].dataType)).otherwise(own("n_chars"))
    return found.select([new.get(c, own(c)).alias(c) for c in docs.columns])
