"""Validation of identifier fields in a map of strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageforge.functions.text import clean, strip

#: Patterns and the keys that they apply to.
PIN = r"\b\d{6}\b"
ALNUM_ID = r"\b[A-Za-z0-9][A-Za-z0-9\-\/]{5,}\b"
PAN = r"(?i)\b[A-Z]{5}\d{4}[A-Z]\b"
IFSC = r"(?i)\b[A-Z]{4}0[A-Z0-9]{6}\b"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PHONE = r"(?:\+91[\s-]?)?(?:0[\s-]?)?\b\d{10}\b"
PIN_KEYS = ("Pincode", "Pin", "PIN", "Pin Code", "PIN Code")
ID_KEYS = ("Policy No", "Policy Number", "Certificate No", "SL No/Certificate No", "Company/TPA ID No", "TPA ID")
PHONE_KEYS = ("Mobile", "Phone", "Contact", "Mobile No", "Phone No")


def first_match(text: Column, pattern: str) -> Column:
    """The first whole match, or null."""
    return F.regexp_substr(text, F.lit(pattern))


def ocr_fixes(text: Column) -> Column:
    """Stripped; a zero that stands for a letter O beside a single letter is turned."""
    return F.regexp_replace(F.regexp_replace(strip(text), r"\b0([A-Za-z])", "O$1"), r"\b([A-Za-z])0\b", "$1O")


def no_blanks(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit(""))


def last_ten_digits(text: Column) -> Column:
    return F.right(F.regexp_replace(text, r"\D", ""), F.lit(10))


def valid(key: str, value: Column) -> Column:
    """The value of one field after cleaning and validation; a value that does not match stays cleaned."""
    if key in ID_KEYS:
        return once(clean(value), lambda v: F.coalesce(_first(no_blanks(ocr_fixes(v)), ALNUM_ID), v))
    if key in ("PAN", "IFSC"):
        return once(clean(value), lambda v: F.coalesce(_first(F.upper(no_blanks(v)), PAN if key == "PAN" else IFSC), v))
    if key == "Email":
        return once(clean(value), lambda v: F.coalesce(_first(v, EMAIL), v))
    if key in PHONE_KEYS:
        return once(clean(value), lambda v: F.coalesce(last_ten_digits(_first(no_blanks(v), PHONE)), v))
    return clean(value)


def _first(text: Column, pattern: str) -> Column:
    """first_match() of a short text inside of a lambda, where regexp_substr would search it twice."""
    return F.get(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lit(0))


def validate(fields: Column) -> Column:
    """A map of field values, validated; each pincode alias that matches overwrites Pincode, the last one wins."""
    def one(k: Column, v: Column) -> Column:
        found = clean(v)
        for keys in (ID_KEYS, ("PAN",), ("IFSC",), ("Email",), PHONE_KEYS):
            found = F.when(k.isin(*keys), valid(keys[0], v)).otherwise(found)
        return found

    keyed = F.transform_values(fields, one)
    pins = F.coalesce(*[_first(clean(F.try_element_at(fields, F.lit(k))), PIN) for k in reversed(PIN_KEYS)])

    def with_pin(pin: Column) -> Column:
        mended = F.map_concat(F.map_filter(keyed, lambda k, v: k != "Pincode"), F.create_map(F.lit("Pincode"), pin))
        return F.when(pin.isNotNull(), mended).otherwise(keyed)

    return once(pins, with_pin)


def once(value: Column, body) -> Column:
    """body of a value that is worked out once and used often."""
    return F.transform(F.array(value), body)[0]


def validate_untyped(fields: Column) -> Column:
    """A map of variants from a variant object: strings as validate() has them; numbers, lists, objects and others as they
    are, but for a Pincode that a string alias gives."""
    is_text = lambda v: F.schema_of_variant(v) == "STRING"

    def with_texts(values: Column, found: Column) -> Column:
        others = F.map_filter(values, lambda k, v: ~F.map_contains_key(found, k))  # all texts are found
        return F.map_concat(others, F.transform_values(found, lambda k, v: v.cast("variant")))

    def mended(values: Column) -> Column:
        texts = F.transform_values(F.map_filter(values, lambda k, v: is_text(v)), lambda k, v: v.cast("string"))
        return once(texts, lambda t: once(validate(t), lambda found: with_texts(values, found)))

    return once(fields.cast("map<string,variant>"), mended)
