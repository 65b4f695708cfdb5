"""Tokens of an address text with their labels, by rules.

From the right: ZIP, state; from the left: number with prefix and suffix,
direction, pre-modifier, pre-type, name up to the last type word, direction,
unit; what is left is the place. Post boxes, corners of two streets, recipients
and buildings before the number, landmarks and texts that are no address are
told first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cairn.functions.dicts import dictionary, map_direction, map_post_type, map_pre_type, map_state
from cairn.functions.phonetic import map_ordinal
from cairn.functions.text import FLAT, clean_text, repair_digits, repair_zip

# The labels that address records use.
FIELDS = {
    "number_prefix": "AddressNumberPrefix", "number_digits": "AddressNumber", "number_suffix": "AddressNumberSuffix", "street_predirectional": "StreetNamePreDirectional",
    "street_premodifier": "StreetNamePreModifier", "street_pretype": "StreetNamePreType", "street_name": "StreetName", "street_posttype": "StreetNamePostType",
    "street_postdirectional": "StreetNamePostDirectional", "place_name": "PlaceName", "place_state": "StateName", "place_zipcode": "ZipCode",
}
_TYPES, _WAYS, _STATES = dictionary("post_type"), dictionary("direction"), dictionary("state")
# All labels.
LABELS = (
    "AddressNumberPrefix", "AddressNumberSuffix", "AddressNumber", "BuildingName", "CornerOf", "IntersectionSeparator", "LandmarkName", "NotAddress", "OccupancyIdentifier", "OccupancyType", "PlaceName", "Recipient", "StateName",
    "StreetNamePostDirectional", "StreetNamePostType", "StreetNamePreDirectional", "StreetNamePreModifier", "StreetNamePreType", "StreetName", "SubaddressIdentifier", "SubaddressType", "USPSBoxGroupID", "USPSBoxGroupType", "USPSBoxID", "USPSBoxType", "ZipCode",
)
_UNITS = {"apt", "apartment", "unit", "suite", "ste", "rm", "room", "fl", "floor", "lot", "bldg", "building", "tower", "wing", "trlr", "#"}
# The types that most streets have.
_USUAL = {"St", "Ave", "Rd", "Dr", "Ln", "Ct", "Blvd", "Way", "Pl", "Cir", "Ter", "Pkwy", "Hwy", "Trl", "Aly", "Sq", "Loop", "Pike", "Expy", "Fwy", "Tpke", "Cres", "Run", "Walk"}
_NO_END = {"la", "is", "al", "park", "lake", "mount", "fort", "mt", "ft"}
_PARTS = {"bldg", "building", "tower", "wing"}  # units that are parts of the site
_BOX = re.compile(r"(?:(rr|hc|rural route|highway contract)\s+(\d\S*)\s+)?((?:p\s*o\s+|post office\s+)?box)\s+(\S*\d\S*|[a-z])(?=\s|$)", re.I)
_SEPARATORS = {"and", "at", "&", "@", "x"}
_BUILDINGS = {"building", "bldg", "tower", "towers", "hall", "house", "complex", "apartments", "center", "centre", "arena", "terminal"}
_LANDMARKS = {"park", "hospital", "airport", "school", "university", "college", "church", "library", "museum", "cemetery", "stadium", "zoo", "shelter", "courthouse", "mall"}
_NOWHERE = {"unknown", "none", "na", "n a", "not available", "no address", "homeless", "transient", "null", "tbd", "not known"}
_PRE = ("state route", "state rte", "county road", "county rd", "us highway", "us hwy", "us route", "state highway", "state hwy", "co rd", "st rte", "route", "highway", "us", "sr", "cr")
_MODIFIERS = {"old", "new"}
TAGS = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("token", T.StringType())]))


def tag(text: str | None) -> list[tuple[str, str]] | None:
    """(label, token) of a cleaned text; NULL for NULL."""
    if text is None:
        return None
    t = re.sub(r"#", " # ", text).split()
    low = [w.lower() for w in t]
    if " ".join(low) in _NOWHERE:
        return [("NotAddress", w) for w in t]
    if m := _BOX.search(" ".join(t)):
        return _around_box(t, m)
    if low[:2] == ["corner", "of"] and len(t) > 2:
        return [("CornerOf", t[0]), ("CornerOf", t[1]), *_crossing(t[2:], low[2:])]
    number = next((i for i, w in enumerate(t) if w[0].isdigit()), len(t))
    if number and (rest := _crossing(t, low, True)):
        return rest
    first = _lead(t, low, number)
    return [*((label, w) for label, w in zip(first, t)), *_tag_street(t[len(first) :])]


def _around_box(t: list[str], m: re.Match) -> list[tuple[str, str]]:
    """A post box, with what stands before it as an address or recipient and the place behind it."""
    text = " ".join(t)
    before, after = text[: m.start()].split(), text[m.end() :].split()
    head = _tag_street(before) if any(w[0].isdigit() for w in before) else [("Recipient", w) for w in before]
    group = [("USPSBoxGroupType", w) for w in m[1].split()] + [("USPSBoxGroupID", m[2])] if m[1] else []
    return [*head, *group, *(("USPSBoxType", w) for w in m[3].split()), ("USPSBoxID", m[4]), *_tag_street(after)]


def _crossing(t: list[str], low: list[str], both: bool = False) -> list[tuple[str, str]]:
    """Two streets and what separates them; with ``both`` only if each has a type."""
    at = next((i for i in range(1, len(t) - 1) if low[i] in _SEPARATORS), None)
    if at is None:
        return [] if both else _tag_street(t)
    typed = lambda words: any(w in _TYPES for w in words[1:])
    if both and not (typed(low[:at]) and typed(low[at + 1 :])):
        return []
    # a number makes the rules look for a street; it is taken out again
    one = [("StreetName" if label == "PlaceName" else label, w) for label, w in _tag_street(["1", *t[:at]])[1:]]
    two = _tag_street(["1", *t[at + 1 :]])[1:]
    if two and two[0][0] == "PlaceName":
        two[0] = ("StreetName", two[0][1])
    return [*one, ("IntersectionSeparator", t[at]), *two]


def _lead(t: list[str], low: list[str], number: int) -> list[str]:
    """Labels of the words before the house number, or of a landmark without one."""
    words = low[:number]
    zip_only = number == len(t) - 1 and re.fullmatch(r"\d{5}(-\d{4})?", t[number]) is not None
    if number == len(t) or zip_only:
        mark = next((i for i, w in enumerate(words) if w in _LANDMARKS), None)
        if mark and not any(w in _TYPES and w not in _LANDMARKS for w in words[: mark + 1]):
            return ["LandmarkName"] * (mark + 1)
        return []
    if number < 2 and words[:1] not in (["attn"], ["attention"]) or words[-1:] == ["#"] and number < 2:
        return []
    # a street may begin with a direction and a type before its number
    if any(" ".join(words[k:]) in _PRE for k in range(len(words))) or any(w in _TYPES and w not in _BUILDINGS for w in words):
        return []
    hash_ = 1 if words[-1] == "#" else 0
    return ["BuildingName" if any(w in _BUILDINGS for w in words) else "Recipient"] * (number - hash_)


def _tag_street(t: list[str]) -> list[tuple[str, str]]:
    """A street address with its place, or a part of one."""
    low = [w.lower() for w in t]
    lab: list[str | None] = [None] * len(t)
    end = len(t)
    if end > 1 and re.fullmatch(r"\d{4,5}(-\d{4})?|\d{5}\w|\d{4}[A-Za-z]", t[end - 1]) and end > 2:
        lab[end - 1] = "ZipCode"
        end -= 1
    for n in (3, 2, 1):
        if end - n > 0 and (" ".join(low[end - n : end]) in _STATES or n == 1 and lab[-1] == "ZipCode" and re.fullmatch("[A-Z]{2}", t[end - 1]) and low[end - 1] not in _WAYS and low[end - 1] not in _TYPES):
            for i in range(end - n, end):
                lab[i] = "StateName"
            end -= n
            break
    i = 0
    if i < end and not low[i][0].isdigit() and i + 1 < end and (len(t[i]) == 1 and t[i + 1][0].isdigit()):
        lab[i] = "AddressNumberPrefix"
        i += 1
    if i < end and re.match(r"\d", t[i]) and not re.fullmatch(r"\d+(st|nd|rd|th)", low[i]):
        lab[i] = "AddressNumber"
        i += 1
        if i + 1 < end and (re.fullmatch("[A-Za-z]", t[i]) and low[i] not in ("n", "s", "e", "w") or t[i] == "1/2"):
            lab[i] = "AddressNumberSuffix"
            i += 1
    if i + 1 < end and low[i] in _WAYS and low[i + 1] not in _UNITS and not (low[i + 1] in _TYPES and i + 2 >= end):
        lab[i] = "StreetNamePreDirectional"
        i += 1
    if i + 2 < end and low[i] in _MODIFIERS:
        lab[i] = "StreetNamePreModifier"
        i += 1
    for p in _PRE:
        n = len(p.split())
        if " ".join(low[i : i + n]) == p and i + n < end and re.match(r"\d", t[i + n]):
            for k in range(i, i + n):
                lab[k] = "StreetNamePreType"
            lab[i + n] = "StreetName"
            i += n + 1
            break
    # the last type word before the unit ends the street
    unit = next((k for k in range(i, end) if low[k] in _UNITS and k > i), end)
    # a usual type goes before one that also stands in names of places; of those the first that follows a name
    strong = [k for k in range(i + 1, unit) if _TYPES.get(low[k]) in _USUAL]
    weak = [k for k in range(i + 1, unit) if low[k] in _TYPES and low[k] not in _NO_END]
    last = (strong or weak or [None])[0]
    while last is not None and last + 1 < unit and last + 1 in strong:
        last += 1
    named = any(v == "StreetName" for v in lab)
    if last is not None and not (named and last > i):
        for k in range(i, last):
            lab[k] = "StreetName"
        lab[last] = "StreetNamePostType"
        i = last + 1
    elif named and i < end and low[i] in _TYPES:
        lab[i] = "StreetNamePostType"
        i += 1
    elif not named and unit < end:
        for k in range(i, unit):
            lab[k] = "StreetName"
        i = unit
    elif not named and i < end and ("StreetNamePreDirectional" in lab or "AddressNumber" in lab):
        lab[i] = "StreetName"
        i += 1
    if i < end and low[i] in _WAYS and lab[i - 1] in ("StreetNamePostType", "StreetName"):
        lab[i] = "StreetNamePostDirectional"
        i += 1
    while i < end and low[i] in _UNITS:
        kind = "Subaddress" if low[i] in _PARTS else "Occupancy"
        lab[i] = "OccupancyIdentifier" if t[i] == "#" else kind + "Type"
        i += 1
        if i < end and (t[i] == "#" or re.match(r"\d|[A-Za-z]$|[A-Za-z]?\d", t[i])):
            lab[i] = kind + "Identifier"
            i += 1
            if i < end and t[i - 1] == "#":
                lab[i] = kind + "Identifier"
                i += 1
    for k in range(end):
        if lab[k] is None:
            lab[k] = "PlaceName"
    return [(x or "PlaceName", w) for x, w in zip(lab, t)]


@F.pandas_udf(TAGS)
def _tags(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        memo: dict = {}
        out = []
        for v in s:
            v = v if isinstance(v, str) else None
            if v not in memo:
                got = tag(v)
                memo[v] = None if got is None else [{"label": a, "token": b} for a, b in got]
            out.append(memo[v])
        yield pd.Series(out, dtype=object)


def tag_address(c: Column, clean: bool = True) -> Column:
    """Labelled tokens of a text column."""
    return _tags(clean_text(c) if clean else c)


def _collect(tags: Column, label: str, sep: str) -> Column:
    return F.array_join(F.array_distinct(F.transform(F.filter(tags, lambda t: t["label"] == label), lambda t: t["token"])), sep)


def addresses_from_tags(df: DataFrame, tags: str, ordinals: bool = True, maps: bool = True) -> DataFrame:
    """The twelve flat columns of labelled tokens: collected, repaired and, with
    ``maps``, harmonised. NULL tags give twelve NULLs, no tokens twelve empty strings."""
    raw = {f: _collect(F.col(tags), label, "" if f.startswith("number_") or f in ("place_state", "place_zipcode") else " ") for f, label in FIELDS.items()}
    fixed = raw | {"number_digits": repair_digits(raw["number_digits"]), "place_zipcode": repair_zip(raw["place_zipcode"])}
    if maps:
        fixed |= {"place_state": map_state(raw["place_state"]), "street_predirectional": map_direction(raw["street_predirectional"]), "street_postdirectional": map_direction(raw["street_postdirectional"]), "street_posttype": map_post_type(raw["street_posttype"]), "street_pretype": map_pre_type(raw["street_pretype"])}
    if ordinals and maps:
        fixed["street_name"] = map_ordinal(raw["street_name"])
    return df.withColumns({f: F.when(F.col(tags).isNotNull(), fixed[f]) for f in FLAT})


def parse_addresses(df: DataFrame, column: str, ordinals: bool = True) -> DataFrame:
    """``df`` with the twelve flat columns of its text column. Texts are tagged
    once for each distinct value."""
    texts = df.select(F.col(column).alias("__text")).where("__text is not null").distinct()
    parsed = addresses_from_tags(texts.withColumn("__tags", tag_address(F.col("__text"))), "__tags", ordinals).drop("__tags")
    return df.join(parsed.hint("merge"), df[column] == parsed["__text"], "left").drop("__text")


def explain_tags(df: DataFrame, column: str) -> DataFrame:
    """One row for each token: ``text, position, token, label, field, note``. A
    text without tokens has one row that says so."""
    fields = F.create_map(*(F.lit(v) for kv in {b: a for a, b in FIELDS.items()}.items() for v in kv))
    out = df.select(F.col(column).alias("text")).where("text is not null").distinct().select("text", F.posexplode_outer(tag_address(F.col("text"))).alias("position", "t"))
    field = F.try_element_at(fields, F.col("t.label"))
    note = F.when(F.col("t.label").isNull(), "no tokens").when(field.isNull(), "not part of the address record").when(F.count("*").over(Window.partitionBy("text", "t.label")) > 1, "joined with the other tokens of its label").otherwise("taken over")
    return out.select("text", "position", "t.token", "t.label", field.alias("field"), note.alias("note"))
