"""Address records that denote one location, though written differently.

The streets of a reference list are indexed by the deletion neighbourhood of
their names, inside the ZIP and inside the other ZIPs of the same place. Each
distinct way of writing a street is parsed into components, its candidates come
out of that index by equality joins, and the assignment of components with the
least cost decides. House number, its prefix and its suffix (the unit of a
house) are hard: records that differ in one of them never denote one location.

Costs only rank readings. A written part that the street lacks costs more than
a missing one, so a record without a part goes to the street without it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.dicts import POST_TYPES, dictionary, entries
from cairn.session import materialize, require

STREET = ["street_predirectional", "street_premodifier", "street_pretype", "street_name", "street_posttype", "street_postdirectional"]

# Short and long forms of words inside names and of pre-types.
NAME_WORDS = {"lk": "lake", "ft": "fort", "mt": "mount", "mnt": "mount", "st": "saint", "ste": "saint", "upr": "upper", "up": "upper", "lwr": "lower", "cpr": "copper", "coppr": "copper", "cdr": "cedar", "stn": "stone", "spgs": "springs", "spg": "springs", "hts": "heights", "jct": "junction", "lndg": "landing", "fls": "falls", "n": "north", "s": "south", "e": "east", "w": "west"}
PRE_TYPE_WORDS = {"state route": "sr", "st rte": "sr", "state rte": "sr", "state rt": "sr", "st rt": "sr", "sr": "sr", "county road": "cr", "co rd": "cr", "county rd": "cr", "co road": "cr", "cr": "cr", "us highway": "us", "us hwy": "us", "us": "us", "state highway": "sh", "st hwy": "sh", "county highway": "ch", "co hwy": "ch"}
ORDINAL_UNITS = ["first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth", "eleventh", "twelfth", "thirteenth", "fourteenth", "fifteenth", "sixteenth", "seventeenth", "eighteenth", "nineteenth"]
ORDINAL_TENS = ["twentieth", "thirtieth", "fortieth", "fiftieth", "sixtieth", "seventieth", "eightieth", "ninetieth"]
CARDINAL_TENS = ["twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]


def _suffix(n: int) -> str:
    return f"{n}{'th' if n % 100 in (11, 12, 13) else {1: 'st', 2: 'nd', 3: 'rd'}.get(n % 10, 'th')}"


def ordinal_words() -> dict[str, str]:
    out = {w: _suffix(i) for i, w in enumerate(ORDINAL_UNITS, 1)}
    for i, (tens, cardinal) in enumerate(zip(ORDINAL_TENS, CARDINAL_TENS), 2):
        out[tens] = _suffix(10 * i)
        out |= {f"{cardinal} {u}": _suffix(10 * i + j) for j, u in enumerate(ORDINAL_UNITS[:9], 1)}
    return out


def clean_zip(c: Column) -> Column:
    """Five digits of a ZIP: ZIP+4 cut, a lost leading zero put back; else the
    trimmed text (``""`` for NULL)."""
    z = F.regexp_replace(F.coalesce(c, F.lit("")), r"\s", "")
    return F.when(z.rlike(r"^[0-9]{5}(-?[0-9]{4})?$"), F.substring(z, 1, 5)).when(z.rlike(r"^[0-9]{4}$"), F.concat(F.lit("0"), z)).otherwise(z)


_TYPES = {k: v.lower() for k, v in entries(POST_TYPES).items()}


def typed_spellings(types: dict[str, str]) -> dict[str, str]:
    """Short forms as people type them, for types by their full names: with vowels
    after the first letter left out, ``oo`` as ``u``, and, of names of three letters,
    with the last doubled or an e behind. Forms of two types, or known ones, are none."""
    full = {k: v for k, v in types.items() if len(k) <= 9 and all(len(k) >= len(o) for o, w in types.items() if w == v)}
    out: dict[str, set[str]] = {}
    for name, v in full.items():
        forms = {name[:1]}
        for c in name[1:]:
            forms = {f + c for f in forms} | (forms if c in "aeiou" else set())
        forms.add(name.replace("oo", "u"))
        if len(name) == 3:
            forms |= {name + name[-1], name + "e"}
        for f in forms:
            if len(f) >= 3:
                out.setdefault(f, set()).add(v)
    return {f: min(v) for f, v in out.items() if len(v) == 1 and f not in types}


_TYPED = typed_spellings(_TYPES)
_FULL = {v: k for k, v in reversed(_TYPES.items()) if k != v}
_WAYS = {k.replace(".", "").replace("-", " "): v.lower() for k, v in dictionary("direction").items()}
_ORDINALS = ordinal_words()
_PRE = re.compile(rf"({'|'.join(sorted(PRE_TYPE_WORDS, key=len, reverse=True))}) (?=[0-9])")
_MARKS, _OTHER = re.compile(r"[.'’]"), re.compile(r"[\W_]+")
LAST_WORD = 5  # letters from which the last word of a name is a key of its own
LONG_TYPE = 5  # letters from which a street type may have two slips
LONG_NAME = 8  # letters from which a name may have two slips
_MARK = "\x01"  # between the place and the street parts as written
_COMPONENTS = ("pd", "pm", "pt", "name", "po", "sd")


def _plain(s: str | None) -> str:
    """Lower case, without dots and apostrophes, other marks as one space."""
    return _OTHER.sub(" ", _MARKS.sub("", (s or "").lower())).strip()


def _deletions(s: str) -> list[str]:
    """The text and all texts with one character deleted."""
    return list(dict.fromkeys([s, *(s[:i] + s[i + 1 :] for i in range(len(s)))])) if len(s) > 1 else [s]


_NEAR_TYPES: dict[str, str] = {}
for _w in _TYPES:
    if len(_w) >= 3:
        for _k in _deletions(_w):
            _NEAR_TYPES.setdefault(_k, _w)


def _near_type(word: str) -> bool:
    return len(word) >= 2 and any(k in _NEAR_TYPES for k in _deletions(word))


def _name(tokens: list[str]) -> str:
    """Words of a name in their long form; the last word, the name proper, stays."""
    text = " ".join([*(NAME_WORDS.get(w, w) for w in tokens[:-1]), *tokens[-1:]])
    return _ORDINALS.get(text, text)


def parse_street(parts: list[str | None]) -> tuple[str, str, str, str, str, str]:
    """Components (canonical, lower case, ``""`` where absent) of the six street
    fields. The parts stand in their usual order, so a part in a wrong field is
    found; a type that no list knows, but in its own field, is kept behind ``?``."""
    t = _plain(" ".join(p for p in parts if p)).split(" ")
    pd_ = pm = pt = po = sd = ""
    if len(t) >= 2 and t[0] in _WAYS:
        pd_, t = _WAYS[t[0]], t[1:]
        if len(t) >= 2 and t[0] in ("east", "west") and pd_ in ("n", "s") and not parts[0]:
            pd_, t = pd_ + t[0][0], t[1:]
    if len(t) >= 2 and t[-1] in _WAYS:
        sd, t = _WAYS[t[-1]], t[:-1]
    if len(t) >= 2 and t[0] == "old":
        pm, t = "old", t[1:]
    if m := _PRE.match(" ".join(t)):
        pt, t = PRE_TYPE_WORDS[m[1]], t[len(m[1].split(" ")) :]
    if len(t) >= 2:
        own = _plain(parts[4]).rsplit(" ", 1)[-1]
        if t[-1] in _TYPES:
            po, t = _TYPES[t[-1]], t[:-1]
        elif t[-1] in _TYPED:
            po, t = _TYPED[t[-1]], t[:-1]
        elif own and t[-1] == own:
            po, t = "?" + own, t[:-1]
    return pd_, pm, pt, _name(t), po, sd


def readings(parsed: tuple[str, str, str, str, str, str]) -> list[tuple[str, str, str, str, str, str]]:
    """The parse itself and others that allow for a misspelt type or direction
    within the name, or for a lost space."""
    pd_, pm, pt, name, po, sd = parsed
    out = [parsed]
    t = name.split(" ")
    if not po and len(t) >= 2 and (_near_type(t[-1]) or len(t[-1]) <= 2):
        out.append((pd_, pm, pt, _name(t[:-1]), "?" + t[-1], sd))
    if sd and not po:
        out.append((pd_, pm, pt, name, "??" + sd, ""))
    if not pd_ and not sd and len(t) >= 2 and len(t[0]) >= 3:
        for w in ("north", "south", "east", "west", "northeast", "northwest", "southeast", "southwest"):
            if set(_deletions(t[0])) & set(_deletions(w)):
                out.append((_WAYS[w], pm, pt, _name(t[1:]), po, sd))
    if not po:
        for n in range(2, min(max(map(len, _TYPES)) + 2, len(name) - 3)):
            head, tail = name[:-n].rstrip(), name[-n:].lstrip()
            if tail in _TYPES and len(head) >= 4:
                out.append((pd_, pm, pt, head, _TYPES[tail], sd))
            elif len(tail) >= 4 and len(head) >= 4 and _near_type(tail):
                out.append((pd_, pm, pt, head, "?" + tail, sd))
    if not pd_ and not sd:
        for w in ("north", "south", "east", "west", "northeast", "northwest", "southeast", "southwest", "n", "s", "e", "w", "ne", "nw", "se", "sw"):
            if name.startswith(w) and len(name) >= len(w) + 4 and name[len(w)] != " ":
                out.append((_WAYS[w], pm, pt, name[len(w) :], po, sd))
    return list(dict.fromkeys(out))


def name_keys(name: str) -> list[str]:
    """Keys of the index: the deletions of the name without spaces and of its last word."""
    keys, last = _deletions(name.replace(" ", "")), name.rsplit(" ", 1)[-1]
    return list(dict.fromkeys(keys + _deletions(last))) if last != name and len(last) >= LAST_WORD else keys


def _parsed(df: DataFrame, extra: str) -> DataFrame:
    """Replaces the street fields by components; ``extra`` are the columns kept, with types."""
    keep = [c.split()[0] for c in extra.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parsed = [parse_street(list(p)) for p in zip(*(b[c] for c in STREET))]
            yield pd.concat([b[keep].reset_index(drop=True), pd.DataFrame(parsed, columns=list(_COMPONENTS), dtype=object)], axis=1)

    return df.mapInPandas(run, f"{extra}, {', '.join(f'{c} string' for c in _COMPONENTS)}")


def street_list(ranges: DataFrame) -> DataFrame:
    """One row for each street of the reference list: ``zip``, components,
    lowest and highest number."""
    distinct = ranges.where("zip is not null").groupBy("zip", *STREET).agg(F.min(F.least("fromhn", "tohn")).alias("low"), F.max(F.greatest("fromhn", "tohn")).alias("high"))
    parsed = _parsed(distinct, "zip string, low int, high int").where("name <> ''")
    return parsed.groupBy("zip", *_COMPONENTS).agg(F.min("low").alias("low"), F.max("high").alias("high"))


def _place_word(text: str | None) -> str:
    """Letters and digits of a place name, usual short words written out."""
    return "".join(_PLACES.get(w, w) for w in _plain(text).split())


def _slips(a: str, b: str, most: int) -> int:
    """Alignment distance (an exchange of neighbours counts one), ``most`` if it is that or more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) >= most:
        return most
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            row.append(v)
        before, last = last, row
    return min(last[-1], most)


def _name_cost(a: str, b: str) -> float:
    """0 for equal names, about 1 for one slip of the pen, 2 for two (long names
    only), 9 beyond. A letter doubled or exchanged with its neighbour is the
    likelier slip. A lost space is one slip at most."""
    if a == b:
        return 0.0
    s, t = a.replace(" ", ""), b.replace(" ", "")
    d = _slips(s, t, 3)
    if d == 0:
        return 0.1
    if d == 1:
        likely = len(s) == len(t) and sorted(s) == sorted(t) or _DOUBLED.sub(r"\1", s) == _DOUBLED.sub(r"\1", t)
        return 0.95 if likely else 1.0
    return 2.0 if d == 2 and min(len(s), len(t)) >= LONG_NAME else 9.0


SLOTS = ("pd", "pm", "pt", "po", "sd")  # the components other than the name
LACKING = {"pd": 1.0, "pm": 0.7, "pt": 1.0, "po": 1.0, "sd": 1.0}  # a part of the street that is not written
SURPLUS = {"pd": 3.0, "pm": 2.0, "pt": 5.0, "po": 3.0, "sd": 3.0}  # a written part that the street lacks
TURNED = 0.5  # a direction at the other end
_NEVER = 99.0


def _surplus(slot: str, word: str, street: dict[str, str]) -> float:
    if slot == "po" and word.startswith("?"):
        return _NEVER if word.startswith("??") else 2.0
    if slot in ("pd", "sd") and (street["pd"] or street["sd"]):
        return 5.0
    return SURPLUS[slot]


def _part_cost(slot: str, word: str, other: str, part: str) -> float:
    """Cost of reading a written component as a component of the street."""
    if slot != other:
        return TURNED if {slot, other} == {"pd", "sd"} and word == part else _NEVER
    if word == part:
        return 0.0
    if slot == "po":
        if word.startswith("??"):
            return 1.6
        if word.startswith("?"):
            w, full = word[1:], _FULL.get(part, part)
            return 0.4 if (_slips(w, full, 3) <= 2 if len(w) >= LONG_TYPE else _slips(w, full, 2) <= 1 or _slips(w, part, 2) <= 1) else 2.0
        return 2.5
    return {"pm": 2.0, "pt": 5.0}.get(slot, _NEVER)


def assign(costs: list[list[float]], surplus: list[float], lacking: list[float]) -> float:
    """Least cost of assigning rows to columns, at most one to each; rows and
    columns left alone cost ``surplus`` and ``lacking``. Exact, by dynamic
    programming over sets of columns."""
    best = {0: 0.0}
    for i, row in enumerate(costs):
        after: dict[int, float] = {}
        for used, c in best.items():
            after[used] = min(after.get(used, math.inf), c + surplus[i])
            for j, v in enumerate(row):
                if not used >> j & 1:
                    after[used | 1 << j] = min(after.get(used | 1 << j, math.inf), c + v)
        best = after
    return min(c + sum(v for j, v in enumerate(lacking) if not used >> j & 1) for used, c in best.items())


@lru_cache(maxsize=200_000)
def _assigned(written: tuple[str, ...], street: tuple[str, ...]) -> float:
    have = [(s, w) for s, w in zip(SLOTS, written) if w]
    want = [(s, w) for s, w in zip(SLOTS, street) if w]
    parts = dict(zip(SLOTS, street))
    return assign([[_part_cost(s, w, t, v) for t, v in want] for s, w in have], [_surplus(s, w, parts) for s, w in have], [LACKING[t] for t, _ in want])


def component_cost(p: tuple, r: tuple) -> float:
    """Cost of reading a parse ``p`` as the street ``r``, names aside: the least
    of all assignments of written components to components of the street."""
    return _assigned(p[:3] + p[4:], r[:3] + r[4:])


class StreetIndex:
    """Deletion-neighbourhood index over the streets of one block."""

    def __init__(self, streets: pd.DataFrame):
        self.rows = list(zip(*(streets[c] for c in _COMPONENTS)))
        self.ids, self.low, self.high = (streets[c].tolist() for c in ("street_id", "low", "high"))
        self.keys: dict[str, list[int]] = {}
        for i, r in enumerate(self.rows):
            for k in name_keys(r[3]):
                self.keys.setdefault(k, []).append(i)
        self.exact: dict[str, list[int]] = {}
        for i, r in enumerate(self.rows):
            self.exact.setdefault(r[3], []).append(i)
        self.memo: dict[tuple, list[tuple[float, int]]] = {}

    def candidates(self, parsed: tuple, slips: bool) -> list[tuple[float, int]]:
        """(cost, position) of the streets that the parse may mean; with
        ``slips`` also those with a misspelt name, type or direction."""
        at = (parsed, slips)
        if at not in self.memo:
            if not slips:
                found = [(component_cost(parsed, self.rows[i]), i) for i in self.exact.get(parsed[3], ())]
            else:
                best: dict[int, float] = {}
                for p in readings(parsed):
                    for i in {i for k in name_keys(p[3]) for i in self.keys.get(k, ())}:
                        c = component_cost(p, self.rows[i]) + _name_cost(p[3], self.rows[i][3])
                        if c < best.get(i, 9.0):
                            best[i] = c
                found = [(c, i) for i, c in best.items() if c <= LIMIT]
            self.memo[at] = found
        return self.memo[at]

    def off(self, number: int, i: int) -> float:
        """What a number outside the ranges of a street costs."""
        low, high = self.low[i], self.high[i]
        return 0.0 if low is not None and low == low and low <= number <= high else MARGIN


def _digits(number: str) -> int:
    d = number.split("|")[1]
    return int(d) if d.isdigit() and len(d) < 10 else -1


def _joined(parsed: tuple) -> str:
    """Components in one text; ``""`` without a name."""
    return "|".join(parsed) if parsed[3] else ""


def _unlisted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of ZIPs without streets: parsed only."""
    for b in batches:
        code, written = pd.factorize(b["written"])
        split = [w.split(_MARK) for w in written]
        parsed = np.array([_joined(parse_street(w[1:])) for w in split], dtype=object)
        place = np.array([w[0] for w in split], dtype=object)
        yield pd.DataFrame({"x_id": b["x_id"], "number": b["number"], "zip": b["zip"], "street_id": pd.array([None] * len(b), dtype="Int64"), "place_name": place[code], "parsed": parsed[code]})


def _own_block(rows: pd.DataFrame, streets: pd.DataFrame) -> pd.DataFrame:
    """First pass, inside the ZIP as written: takes only what is plain.

    Rows written alike are read once; only where the number has a say between
    streets are they looked at one by one."""
    index = StreetIndex(streets)
    town = streets["r_place"].iloc[0] if len(streets) else None
    places: dict[str, bool] = {}
    code, written = pd.factorize(rows["written"])
    numbers = rows["number"].tolist()
    by_code = np.argsort(code, kind="stable")
    cuts = np.searchsorted(code[by_code], np.arange(len(written) + 1))
    chosen = np.full(len(rows), -1, dtype=np.int64)
    parsed_of, place_of = np.empty(len(written), dtype=object), np.empty(len(written), dtype=object)
    for k, w in enumerate(written):
        place, *parts = w.split(_MARK)
        parsed = parse_street(parts)
        parsed_of[k], place_of[k] = _joined(parsed), place
        if place not in places:
            word = _place_word(place)
            places[place] = not word or not town or _slips(word, town, 4) <= 3
        if not parsed[3] or not places[place]:
            continue
        at = by_code[cuts[k] : cuts[k + 1]]
        exact = index.candidates(parsed, False)
        if len(exact) == 1 and exact[0][0] <= 1.0:
            chosen[at] = index.ids[exact[0][1]]  # whatever the number
            continue
        if not exact and not index.candidates(parsed, True):
            continue
        for i in at:
            digits = _digits(numbers[i])
            for slips in (False, True):
                ranked = sorted((c + index.off(digits, j), j) for c, j in index.candidates(parsed, slips))
                if ranked and ranked[0][0] <= (1.0 + MARGIN if not slips else 1.4) and (len(ranked) == 1 or ranked[1][0] > ranked[0][0]):
                    chosen[i] = index.ids[ranked[0][1]]
                    break
                if ranked and not slips and ranked[0][0] <= 1.0:
                    break  # tied between streets of just this name
    known = chosen >= 0
    # a block may have streets and no rows: texts must be objects even then
    return pd.DataFrame({"x_id": rows["x_id"].to_numpy(), "number": rows["number"].to_numpy(dtype=object), "zip": rows["zip"].to_numpy(dtype=object), "street_id": pd.array(chosen, dtype="Int64"), "place_name": np.where(known, "", place_of[code]), "parsed": np.where(known, "", parsed_of[code])}).assign(street_id=lambda d: d["street_id"].where(known))


def _any_block(rows: pd.DataFrame, streets: pd.DataFrame) -> pd.DataFrame:
    """Second pass, in one block of several: the best reading and the runner-up's cost."""
    index, out = StreetIndex(streets), []
    town = streets["r_place"].iloc[0] if len(streets) else None
    block = streets["zip"].iloc[0] if len(streets) else ""
    for x, number, z, place, parsed in zip(rows["x_id"], rows["number"], rows["zip"], rows["place"], rows["parsed"]):
        at = 0.0 if z == block else 0.3 if not z else 0.4 if _slips(z, block, 3) <= 2 else 0.8
        away = 0.0 if place == town else 0.2 if not place or not town else 0.1 if _slips(place, town, 4) <= 3 else 1.0
        far = 3.0 if at >= 0.8 and away >= 1.0 else 0.0
        digits = _digits(number)
        ranked = sorted((c + index.off(digits, i) + at + away + far, index.ids[i]) for c, i in index.candidates(tuple(parsed.split("|")), True))
        ranked = [r for r in ranked if r[0] <= LIMIT + MARGIN]
        if ranked:
            tied = len(ranked) > 1 and ranked[1][0] <= ranked[0][0]
            out.append((x, number, z, place, parsed, round(ranked[0][0], 6), None if tied else ranked[0][1]))
    return pd.DataFrame(out, columns=["x_id", "number", "zip", "place", "parsed", "cost", "street_id"])


MARGIN = 0.8  # what a number outside the ranges of a street costs
LIMIT = 3.6
GROUP_ROWS = 40_000  # rows that one task looks up at a time


def resolve(records: DataFrame, ranges: DataFrame) -> DataFrame:
    """``x_id, street, number``: records of one place agree in the last two.

    ``records`` has ``x_id``, the number parts, the street parts, ``place_name``
    and ``place_zipcode``; ``ranges`` is the list of streets (``zip``, street
    parts, ``fromhn``, ``tohn``). Records without a house number or a street
    name have no location and do not come out. A street that the list does not settle counts
    as a street of its own, in its normalised writing. NULL and ``""`` mean the
    same here, repeated records come out once for each different location, an
    empty table gives an empty result, and extra columns are ignored.

    Rows of one ZIP are looked up together, a busy ZIP in several groups, each
    with its own copy of the ZIP's streets.
    """
    require(records, "x_id", "number_prefix", "number_digits", "number_suffix", *STREET, "place_name", "place_zipcode")
    require(ranges, "zip", "fromhn", "tohn", *STREET)
    kind = dict(records.dtypes)["x_id"]
    given = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in (*STREET, "place_name")]
    mark = lambda c: F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), r"[^\p{L}\p{N}]+", "")
    number = F.concat_ws("|", mark("number_prefix"), F.regexp_replace(mark("number_digits"), "^0+(?=.)", ""), mark("number_suffix"))
    written = F.concat_ws(_MARK, "place_name", *STREET).alias("written")
    base = records.where("x_id is not null and trim(number_digits) <> ''").select("x_id", number.alias("number"), clean_zip(F.col("place_zipcode")).alias("zip"), *given)

    # the usual place of each listed ZIP, and how many groups it needs
    plain_place = F.regexp_replace(F.lower("place_name"), r"[^\p{L}\p{N}]+", " ")
    seen = base.groupBy("zip", plain_place.alias("written")).agg(F.count(F.lit(1)).alias("n"))
    seen = materialize(seen, "places")
    listed = street_list(ranges)
    usual = seen.groupBy("zip").agg(F.max(F.when(F.trim("written") != "", F.struct("n", "written"))).alias("m"), F.sum("n").alias("n"))
    usual = usual.select(F.col("zip"), _place_expr(F.coalesce("m.written", F.lit(""))).alias("r_place"), F.ceil(F.col("n") / F.lit(GROUP_ROWS)).cast("int").alias("groups"))
    streets = listed.join(usual, "zip", "left").withColumn("groups", F.coalesce("groups", F.lit(1))).withColumn("street_id", F.monotonically_increasing_id())
    streets = materialize(streets, "streets")
    zips = streets.groupBy("zip").agg(F.first("groups").alias("groups"), F.first("r_place").alias("r_place"))

    # first pass: inside the ZIP as written; where that is not listed there is nothing to look up
    own = base.join(zips.select("zip", "groups"), "zip").withColumn("part", F.pmod(F.xxhash64("x_id"), "groups").cast("int"))
    copies = streets.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    form = f"x_id {kind}, number string, zip string, street_id long, place_name string, parsed string"
    at = copies.groupBy("zip", "part")
    listed_rows = own.select("x_id", "number", "zip", written, "part").groupBy("zip", "part").cogroup(at).applyInPandas(_own_block, form)
    others = base.join(zips.select("zip"), "zip", "left_anti").select("x_id", "number", "zip", written).mapInPandas(_unlisted, form)
    looked = materialize(listed_rows.unionByName(others), "looked")

    # second pass: what was not plain, in its ZIP, the ZIPs of its place, and else in ZIPs one slip away
    hard = looked.where("street_id is null and parsed <> ''").select("x_id", "number", "zip", _place_expr(F.col("place_name")).alias("place"), "parsed").distinct()
    hard = materialize(hard, "hard")
    ways = _blocks(hard.select("zip", "place").distinct(), zips.select("zip", "r_place"))
    blocked = hard.join(materialize(ways, "ways"), ["zip", "place"])
    sizes = blocked.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / F.lit(GROUP_ROWS)).cast("int").alias("groups"))
    sizes = materialize(sizes, "sizes")
    spread = blocked.join(sizes, "block").withColumn("part", F.pmod(F.xxhash64("x_id"), "groups").cast("int")).drop("groups")
    copies = streets.drop("groups").withColumnRenamed("zip", "block").join(sizes, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).withColumn("zip", F.col("block"))
    form = f"x_id {kind}, number string, zip string, place string, parsed string, cost double, street_id long"
    read = spread.groupBy("block", "part").cogroup(copies.groupBy("block", "part")).applyInPandas(_any_block, form)
    whole = ["x_id", "number", "zip", "place", "parsed"]
    tied = F.struct("cost", F.coalesce("street_id", F.lit(-1)).alias("street_id"))
    best = read.groupBy(*whole).agg(F.min(tied).alias("m"), F.max(F.struct(-F.col("cost"), F.coalesce("street_id", F.lit(-1)).alias("street_id"))).alias("w"))
    best = best.select(*whole, F.when((F.col("m.street_id") >= 0) & (F.col("m.street_id") == F.col("w.street_id")), F.col("m.street_id")).alias("street_id"))
    late = hard.join(best, whole, "left")
    text = F.concat_ws("|", "zip", F.when(F.col("zip") == "", F.col("place")).otherwise(""), "parsed")
    settled = looked.where("street_id is not null").select("x_id", F.col("street_id").cast("string").alias("street"), "number")
    return settled.unionByName(late.select("x_id", F.coalesce(F.col("street_id").cast("string"), text).alias("street"), "number"))


_PLACES = {"ft": "fort", "mt": "mount", "st": "saint", "n": "north", "s": "south", "spgs": "springs", "hts": "heights", "jct": "junction", "lndg": "landing"}
_DOUBLED = re.compile(r"(.)\1")


def _place_expr(c: Column) -> Column:
    """``_place_word`` as an expression."""
    out = F.concat(F.lit(" "), F.regexp_replace(F.regexp_replace(F.lower(c), r"[.'’]", ""), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    for short, long in _PLACES.items():
        out = F.replace(out, F.lit(f" {short} "), F.lit(f" {long} "))
    return F.replace(out, F.lit(" "), F.lit(""))


def _neighbours(c: str) -> Column:
    """The text of a column and all texts with one character deleted."""
    return F.expr(f"CASE WHEN length({c}) < 2 THEN array({c}) ELSE array_distinct(concat(array({c}), transform(sequence(1, length({c})), i -> concat(substr({c}, 1, i - 1), substr({c}, i + 1))))) END")


def _blocks(written: DataFrame, zips: DataFrame) -> DataFrame:
    """``zip, place, block``: the ZIPs in which to look for a ZIP and a place as
    written: the ZIP if it is listed, those of the place, up to a slip, and
    without either the listed ZIPs one slip away."""
    listed = written.join(zips.select("zip"), "zip", "left_semi").withColumn("block", F.col("zip"))
    known = zips.where("r_place <> ''").select(F.col("zip").alias("block"), F.explode(_neighbours("r_place")).alias("k"))
    local = written.where("place <> ''").select("zip", "place", F.explode(_neighbours("place")).alias("k")).join(known, "k").drop("k")
    found = listed.select("zip", "place", "block").unionByName(local.select("zip", "place", "block")).distinct()
    lost = written.where("zip <> ''").join(found.select("zip", "place").distinct(), ["zip", "place"], "left_anti")
    slips = zips.select(F.col("zip").alias("block"), F.explode(_neighbours("zip")).alias("k"))
    near = lost.select("zip", "place", F.explode(_neighbours("zip")).alias("k")).join(slips, "k").select("zip", "place", "block")
    return found.unionByName(near.distinct())


def locations(records: DataFrame, ranges: DataFrame) -> DataFrame:
    """``x_id, location``: the class of each record with a location, as a hash of
    its street and number; one row for each location of a record."""
    return resolve(records, ranges).select("x_id", F.xxhash64("street", "number").alias("location")).distinct()


def same_location(records: DataFrame, ranges: DataFrame) -> DataFrame:
    """All pairs ``x_id_a < x_id_b`` of records that denote the same location.

    The pairs within a location all come out, since the result is defined so;
    see ``resolve`` for one row for each record instead."""
    located = resolve(records, ranges).repartition("street", "number").dropDuplicates(["street", "number", "x_id"])
    a, b = located.withColumnRenamed("x_id", "x_id_a"), located.withColumnRenamed("x_id", "x_id_b")
    return a.join(b, ["street", "number"]).where("x_id_a < x_id_b").select("x_id_a", "x_id_b").distinct()
