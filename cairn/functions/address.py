"""Address records built from parts: structs of number, street and place, and
flat tables brought to the twelve columns, with validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.dicts import map_direction, map_post_type, map_pre_type, map_state
from cairn.functions.phonetic import map_ordinal
from cairn.functions.text import FLAT, NUMBER, PLACE, STREET, valid_digits, valid_zip

Part = Column | str | None


def _column(v: Part) -> Column:
    """A column as it is; any other value as a constant for all rows."""
    return v if isinstance(v, Column) else F.lit(v).cast("string")


def address_number(prefix: Part = None, digits: Part = None, suffix: Part = None, strict: bool = True) -> Column:
    """``struct<prefix, digits, suffix>``. Digits are NULL, ``""`` or a number up to
    999999; others raise an error, or become NULL without ``strict``."""
    d = _column(digits)
    digits = F.when(valid_digits(d), d).otherwise(F.raise_error(F.lit("digits must be a whole number from 0 to 999999")).cast("string") if strict else F.lit(None).cast("string"))
    return F.struct(_column(prefix).alias("prefix"), digits.alias("digits"), _column(suffix).alias("suffix"))


def mapped_street(parts: dict[str, Column], map_posttype: bool = True, map_directional: bool = True, map_pretype: bool = True, map_ordinals: bool = True) -> dict[str, Column]:
    """The parts of a street (names as in ``STREET``) in canonical form, as far as the flags say."""
    out = dict(parts)
    for wanted, f, names in ((map_directional, map_direction, (STREET[0], STREET[5])), (map_pretype, map_pre_type, (STREET[2],)), (map_ordinals, map_ordinal, (STREET[3],)), (map_posttype, map_post_type, (STREET[4],))):
        for n in names if wanted else ():
            out[n] = f(out[n])
    return out


def address_street(predirectional: Part = None, premodifier: Part = None, pretype: Part = None, name: Part = None, posttype: Part = None, postdirectional: Part = None, **maps: bool) -> Column:
    """``struct`` of the six street parts; flags as in ``mapped_street``."""
    parts = mapped_street(dict(zip(STREET, map(_column, (predirectional, premodifier, pretype, name, posttype, postdirectional)))), **maps)
    return F.struct(*(c.alias(n.removeprefix("street_")) for n, c in parts.items()))


def address_place(name: Part = None, state: Part = None, zipcode: Part = None, map_states: bool = True, strict: bool = True) -> Column:
    """``struct<name, state, zipcode>``. A ZIP is NULL, ``""`` or five digits that
    do not begin with 000; others raise an error, or become NULL without ``strict``."""
    s, z = _column(state), _column(zipcode)
    good = z.isNull() | (z == "") | valid_zip(z)
    code = F.when(good, z).otherwise(F.raise_error(F.lit("a ZIP must have five digits and not begin with 000")).cast("string") if strict else F.lit(None).cast("string"))
    return F.struct(_column(name).alias("name"), (map_state(s) if map_states else s).alias("state"), code.alias("zipcode"))


def address(number: Column, street: Column, place: Column) -> Column:
    """``struct<number, street, place>``."""
    return F.struct(number.alias("number"), street.alias("street"), place.alias("place"))


def flatten(c: str) -> list[Column]:
    """The twelve flat columns of an address struct."""
    return [F.col(f"{c}.{n.replace('_', '.', 1)}").alias(n) for n in FLAT]


def as_address(df: DataFrame, map_states: bool = True, strict: bool = True, **maps: bool) -> DataFrame:
    """``df`` with the twelve flat columns: those that it has, as text, harmonised
    and checked; those that it lacks are ``""``. Other columns stay as they are.
    Flags as in ``mapped_street``; here ordinals too are mapped unless told otherwise."""
    has = {n: F.col(f"`{n}`").cast("string") if n in df.columns else F.lit("") for n in FLAT}
    number = address_number(*(has[n] for n in NUMBER), strict=strict)
    street = mapped_street({n: has[n] for n in STREET}, **maps)
    place = address_place(*(has[n] for n in PLACE), map_states=map_states, strict=strict)
    made = {n: number[n.removeprefix("number_")] for n in NUMBER} | street | {n: place[n.removeprefix("place_")] for n in PLACE}
    return df.withColumns({n: made[n] for n in FLAT})
