"""Cleaning, formatting and checking of address text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = ["number_prefix", "number_digits", "number_suffix"]
STREET = ["street_predirectional", "street_premodifier", "street_pretype", "street_name", "street_posttype", "street_postdirectional"]
PLACE = ["place_name", "place_state", "place_zipcode"]
FLAT = [*NUMBER, *STREET, *PLACE]


def clean_text(c: Column) -> Column:
    """Letters, digits, ``#``, ``-`` and single spaces; all else is deleted, not replaced."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}# -]", ""), " +", " "))


def _joined(sep: str, columns: list[Column]) -> Column:
    return F.concat_ws(sep, *(F.nullif(c, F.lit("")) for c in columns))


def format_number(prefix: Column, digits: Column, suffix: Column) -> Column:
    return F.trim(F.regexp_replace(_joined("", [prefix, digits, suffix]), " +", " "))


def format_parts(*columns: Column) -> Column:
    """Parts by single spaces, without those that are NULL or empty."""
    return F.trim(F.regexp_replace(_joined(" ", list(columns)), " +", " "))


def format_address(prefix: str = "") -> Column:
    """Text of the twelve flat columns, each with ``prefix`` before its name."""
    c = [F.col(prefix + n) for n in FLAT]
    return format_parts(format_number(*c[:3]), *c[3:])


def is_na(columns: list[str]) -> Column:
    """A record is missing if any of its fields is NULL."""
    out = F.lit(False)
    for n in columns:
        out = out | F.col(n).isNull()
    return out


def to_int(c: Column) -> Column:
    """Integer within text, cut towards zero; NULL if there is none."""
    return F.regexp_replace(c, "[^0-9.-]", "").try_cast("double").try_cast("int")


def norm(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"^[ \t\r\n]+|[ \t\r\n]+$", ""))


def repair_digits(c: Column) -> Column:
    """Digits only; a number above 999999 keeps its first six characters."""
    d = F.regexp_replace(c, r"[^0-9]", "")
    return F.when(d.try_cast("double") > 999999, F.substring(d, 1, 6)).otherwise(d)


def valid_zip(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9]{5}$") & ~c.rlike("^000"), F.lit(False))


def repair_zip(c: Column) -> Column:
    """Longer than five: the first five; NULL if that is no ZIP; ``""`` stays."""
    cut = F.when(F.length(c) > 5, F.substring(c, 1, 5)).otherwise(c)
    return F.when(valid_zip(cut) | (cut == ""), cut)


def valid_digits(c: Column) -> Column:
    return c.isNull() | (c == "") | (c.rlike("^[0-9]+$") & (c.try_cast("double") <= 999999))


def normalize_county(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[.']", ""), " +", " "))


# Names of county equivalents.
COUNTY_SUFFIXES = ("County", "Parish", "City and Borough", "Census Area", "Planning Region", "Borough", "Municipality", "Municipio", "city")


def strip_county_suffix(c: Column) -> Column:
    return F.regexp_replace(c, f" ({'|'.join(COUNTY_SUFFIXES)})$", "")
