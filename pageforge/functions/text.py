"""Text normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that is stripped, as a Java character class.
WS = r"[\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
WS_NOT_LF = r"[\x09\x0b-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, rf"^{WS}+|{WS}+\z", "")


def strip_sql(text: str) -> str:
    """strip() as SQL."""
    pattern = rf"^{WS}+|{WS}+\z".replace("\\", "\\\\")
    return f"regexp_replace({text}, '{pattern}', '')"


def normalize_linebreaks(text: Column) -> Column:
    """One kind of line end, no white space before it, at most one empty line; stripped."""
    t = F.regexp_replace(text, r"\r\n?", "\n")
    t = F.regexp_replace(t, rf"{WS_NOT_LF}+\n", "\n")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def clean(text: Column) -> Column:
    """ASCII text with single blanks."""
    return F.trim(F.regexp_replace(text, r"[^\x00-\x08\x0e-\x1b\x21-\x7f]+", " "))  # white space and all beyond ASCII


def split_letters_digits(text: Column) -> Column:
    """A blank between a letter and a digit, one pass in each direction."""
    return F.regexp_replace(F.regexp_replace(text, "([a-zA-Z])([0-9])", "$1 $2"), "([0-9])([a-zA-Z])", "$1 $2")


def brand_fix(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("Firewall"), F.lit("View all")), F.lit("Viewall"), F.lit("View all"))


def suffix(name: Column) -> Column:
    """The lower-cased file extension with its dot; empty without one."""
    return F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1))
