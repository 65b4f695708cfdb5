"""Ordinal street names, Soundex and phonetic street keys."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordinal words.
_UNITS = ["first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth", "eleventh", "twelfth", "thirteenth", "fourteenth", "fifteenth", "sixteenth", "seventeenth", "eighteenth", "nineteenth"]
_TENS = ["twent", "thirt", "fort", "fift", "sixt", "sevent", "eight", "ninet"]


def word_ordinals() -> dict[str, int]:
    """FIRST to NINETY NINTH."""
    out = {w.upper(): i for i, w in enumerate(_UNITS, 1)}
    for tens, stem in enumerate(_TENS, 2):
        out[f"{stem}ieth".upper()] = 10 * tens
        out |= {f"{stem}y {u}".upper(): 10 * tens + i for i, u in enumerate(_UNITS[:9], 1)}
    return out


def is_ordinal(c: Column) -> Column:
    return F.coalesce(c.rlike("(?i)^[0-9]+(st|nd|rd|th)$"), F.lit(False))


def ordinal_number(c: Column) -> Column:
    return F.when(is_ordinal(c), F.regexp_extract(c, "^[0-9]+", 0).try_cast("int"))


def _ordinal_words(c: Column) -> Column:
    """The words of a text in capitals; digits and marks are dropped."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.replace(F.upper(c), F.lit("-"), F.lit(" ")), "[^A-Z ]", ""), " +", " "))


def _by_word(c: Column, values: Mapping[str, int | str]) -> Column:
    """The value of the ordinal words of a text. One lookup in a constant table,
    so that the expression stays small enough to be compiled."""
    return F.try_element_at(F.create_map(*(F.lit(v) for kv in values.items() for v in kv)), _ordinal_words(c))


def parse_word_ordinal(c: Column) -> Column:
    """The number that ordinal words stand for, 1 to 99; digits and marks are dropped first."""
    return _by_word(c, word_ordinals())


def ordinal_text(n: int) -> str:
    return f"{n}{'TH' if n % 100 in (11, 12, 13) else {1: 'ST', 2: 'ND', 3: 'RD'}.get(n % 10, 'TH')}".upper()


def canonical_ordinal(n: Column) -> Column:
    end = F.when((n % 100).between(11, 13), "TH").when(n % 10 == 1, "ST").when(n % 10 == 2, "ND").when(n % 10 == 3, "RD").otherwise("TH")
    return F.when(n.isNotNull(), F.concat(n.cast("string"), end))


def map_ordinal(c: Column) -> Column:
    """Numeric ordinals in capitals, ordinal words as numbers, all else unchanged."""
    return F.when(is_ordinal(F.trim(c)), F.upper(F.trim(c))).otherwise(F.coalesce(_by_word(c, {w: ordinal_text(n) for w, n in word_ordinals().items()}), c))


def soundex(c: Column) -> Column:
    """Four-character Soundex of the letters; ``0000`` for none, NULL for NULL."""
    letters = F.regexp_replace(F.upper(c), "[^A-Z]", "")
    return F.when(letters == "", "0000").otherwise(F.soundex(letters))


def street_key(c: Column) -> Column:
    """``#`` and four digits for an ordinal, else Soundex."""
    number = F.regexp_extract(F.trim(c), "(?i)^([0-9]+)(st|nd|rd|th)$", 1).try_cast("int")
    written = F.when(number.isNotNull(), F.format_string("#%04d", number))
    return F.coalesce(written, _by_word(c, {w: f"#{n:04d}" for w, n in word_ordinals().items()}), soundex(c))


def is_ordinal_key(c: Column) -> Column:
    return F.coalesce(c.rlike("^#[0-9]{4}$"), F.lit(False))


def ordinal_neighbors(key: Column) -> Column:
    """Keys that differ by moving the digits within the padding, or by one digit
    in place (a leading digit never becomes 0); an empty array for other keys."""
    digits = F.substring(key, 2, 4)
    sig = F.regexp_replace(digits, "^0+", "")
    k = F.length(sig)
    shifts = F.transform(F.sequence(F.lit(0), 4 - k), lambda i: F.concat(F.lit("#"), F.repeat(F.lit("0"), i), sig, F.repeat(F.lit("0"), 4 - k - i)))
    swaps = F.flatten(F.transform(F.sequence(F.lit(1), k), lambda p: F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.struct(p.alias("p"), d.alias("d")))))
    kept = F.filter(swaps, lambda s: ~((s["p"] == 1) & (s["d"] == 0)))
    changed = F.transform(kept, lambda s: F.concat(F.lit("#"), F.repeat(F.lit("0"), 4 - k), F.substring(sig, F.lit(1), s["p"] - 1), s["d"].cast("string"), F.substring(sig, s["p"] + 1, F.lit(4))))
    found = F.filter(F.array_distinct(F.concat(shifts, changed)), lambda v: v != key)
    return F.when(key.rlike("^#[0-9]{4}$") & (sig != ""), found).otherwise(F.array().cast("array<string>"))
