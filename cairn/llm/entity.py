"""Matching of two lists of addressed places that share no key.

Candidates share a MinHash band of the street name's letter pairs and an area (two
values with the first three digits of the ZIP, with the coarse cell of the map
or with a MinHash value of the town, one with the ZIP), each taken together with house number,
suffix and unit, so that no block spans the whole country; or the parcel, whole
with the unit or its end with the digits of the number in any order; or those
digits and the place on the map. The unit must agree in any case; a number with a
slip needs a witness (``slip_witnessed``) and yields to the same number. Partial
and noisy attributes are compared for each candidate pair, and a boosted
classifier, trained on weak labels from a bounded sample of pairs, gives a
calibrated probability.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.address import parse_street
from cairn.llm.boost import Boosted
from cairn.session import materialize, require

HASHES = 12  # six bands of two values
_SEEDS = np.random.default_rng(11).integers(1, 2**61 - 1, size=(2, HASHES), dtype=np.int64) | 1
_UNIT = re.compile(r"[\s,]*(?:\b(?:apt|apartment|unit|suite|ste|room|rm|fl|floor|lot)\b[\s.#]*|#\s*)([a-z0-9-]{1,6})\s*$", re.I)
_NUMBER = re.compile(r"(\d+)\s*-?\s*([a-z]?)", re.I)
#: A normalised side: number and unit; street components, ZIP and town, each by tabs; place as packed microdegrees.
_SIDE = "side_id string, number string, street string, area string, parcel string, at long"

SLIP_METRES = 15.0  # within which a place speaks for a number with its digits in another order
_CELL = 0.001
AREA_CELL = 0.1  # degrees of the coarse cells, about 10 km
AREA_REACH = 0.01  # degrees by which two places of one address may lie apart and still share a coarse cell
PARCEL_END = 6  # digits of a parcel number that tell it apart within a number

FEATURES = ["name_same", "name_slip", "name_jaccard", "type", "direction", "pre_type", "zip", "city", "parcel", "log_metres", "listed"]


def minhashes(names: list[str]) -> np.ndarray:
    """MinHash values of the letter pairs of each text; zeros for an empty text."""
    out = np.zeros((len(names), HASHES), dtype=np.uint64)
    code = _Memo(lambda g: int.from_bytes(g.encode()[:7], "big"))
    codes, rows, starts = [], [], []
    for i, name in enumerate(names):
        s = name.replace(" ", "")
        grams = {s[j : j + 2] for j in range(len(s) - 1)} or ({s} if s else set())
        if grams:
            rows.append(i)
            starts.append(len(codes))
            codes += [code[g] for g in grams]
    if rows:
        every = np.array(codes, dtype=np.uint64)[:, None]
        mixed = (every * _SEEDS[0].astype(np.uint64) + _SEEDS[1].astype(np.uint64)) ^ ((every * _SEEDS[1].astype(np.uint64)) >> np.uint64(29))
        mixed = (mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(8)
        out[rows] = np.minimum.reduceat(mixed, starts, axis=0)
    return out


def minhash(name: str) -> list[int]:
    """MinHash values of the letter pairs of a text; none for an empty text."""
    return minhashes([name])[0].tolist() if name.replace(" ", "") else []


def _zip(z: str | None) -> str:
    z = re.sub(r"\s", "", z or "")
    if re.fullmatch(r"\d{5}(-?\d{4})?", z):
        return z[:5]
    return "0" + z if re.fullmatch(r"\d{4}", z) else z


_CITY = {"ft": "fort", "mt": "mount", "st": "saint", "n": "north", "s": "south", "jct": "junction", "hts": "heights", "spgs": "springs", "lndg": "landing"}


def _city(c: str | None) -> str:
    return "".join(_CITY.get(w, w) for w in re.sub(r"[\W_]+", " ", (c or "").lower()).split())


def _parcel(p: str) -> str:
    return re.sub(r"\D", "", p)


class _Memo(dict):
    """Results of a function by argument; few enough to keep, else forgotten."""

    def __init__(self, f):
        self.f = f

    def __missing__(self, k):
        if len(self) > 200_000:
            self.clear()
        self[k] = v = self.f(k)
        return v


def _text(v) -> str:
    return v if isinstance(v, str) else ""


def _packed(lat: pd.Series, lon: pd.Series) -> pd.Series:
    """Latitude and longitude in one number; NULL where missing or zero."""
    lat, lon = lat.to_numpy(dtype=float), lon.to_numpy(dtype=float)
    known = np.isfinite(lat) & np.isfinite(lon) & ~((lat == 0) & (lon == 0))
    y, x = (np.round(np.where(known, v, 0) * 1e6).astype(np.int64) for v in (lat, lon))
    return pd.Series(((y + (1 << 30)) << 32) | (x + (1 << 30))).astype("Int64").where(known)


def _unpacked(at: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    v = at.fillna(0).to_numpy(dtype=np.int64)
    known = v != 0
    lat, lon = ((v >> 32) - (1 << 30)) / 1e6, ((v & 0xFFFFFFFF) - (1 << 30)) / 1e6
    return np.where(known, lat, math.nan), np.where(known, lon, math.nan)


def _sites(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    street = _Memo(lambda line: "\t".join(parse_street(["", "", "", line, "", ""])))
    city, code = _Memo(_city), _Memo(_zip)
    for b in batches:
        rows = []
        for sid, house, line, town, z, parcel in zip(b["id"], b["house_no"], b["street_line"], b["city"], b["zip"], b["parcel_ref"]):
            line = _text(line)
            unit = _UNIT.search(line)
            m = _NUMBER.search(_text(house))
            number = f"{int(m[1])}{m[2].lower()}|{unit[1].lower() if unit else ''}" if m else ""
            rows.append((sid, number, street[line[: unit.start()] if unit else line], f"{code[_text(z)]}\t{city[_text(town)]}", _parcel(parcel) if parcel else ""))
        yield pd.DataFrame(rows, columns=["side_id", "number", "street", "area", "parcel"]).assign(at=_packed(b["lat"], b["lon"]).to_numpy(dtype=object))


def _points(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    fields = ["st_predir", "st_premod", "st_pretyp", "st_name", "st_postyp", "st_posdir"]
    street = _Memo(lambda parts: "\t".join(parse_street(list(parts))))
    city, code = _Memo(_city), _Memo(_zip)
    unit = _Memo(lambda s: m[1].lower() if (m := _UNIT.search(s)) else s.strip().lower())
    suffix = _Memo(lambda s: re.sub(r"[^a-z]", "", s.lower()))
    for b in batches:
        rows = []
        for uid, num, suf, sub, town, z, parcel, *parts in zip(b["id"], b["add_number"], b["addnum_suf"], b["subaddress"], b["post_city"], b["zip_code"], b["parcel_id"], *(b[f] for f in fields)):
            number = "" if num is None or num != num else f"{int(num)}{suffix[suf] if suf else ''}|{unit[sub] if sub else ''}"
            rows.append((uid, number, street[tuple(parts)], f"{code[_text(z)]}\t{city[_text(town)]}", _parcel(parcel) if parcel else ""))
        yield pd.DataFrame(rows, columns=["side_id", "number", "street", "area", "parcel"]).assign(at=_packed(b["latitude"], b["longitude"]).to_numpy(dtype=object))


def _hashed(values: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(values, dtype=object), categorize=False)


def _distinct(values: pd.Series) -> tuple[np.ndarray, list[str]]:
    """The position of each value among the distinct ones, and these."""
    at, distinct = pd.factorize(values)
    return at, list(distinct)


class _Signatures(dict):
    """MinHash values by text, of all texts asked for at once."""

    def of(self, texts: list[str]) -> np.ndarray:
        if len(self) > 200_000:
            self.clear()
        new = [t for t in texts if t not in self]
        self.update(zip(new, minhashes(new)))
        return np.stack([self[t] for t in texts])


def _cells(lat: np.ndarray, lon: np.ndarray, side: float, reach: float | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, column, where new) of the cells of places; with ``reach`` (degrees of
    latitude; of longitude more, the nearer to a pole) of all cells within it."""
    at = np.isfinite(lat)
    north = np.where(at, reach or 0.0, 0.0)
    east = north / np.maximum(np.cos(np.radians(np.where(at, lat, 0.0))), 0.01)
    seen: list[tuple[np.ndarray, np.ndarray]] = []
    for dy, dx in ((-1, -1), (-1, 1), (1, -1), (1, 1)) if reach else ((0, 0),):
        y, x = (np.floor(np.where(at, v + d, 0.0) / side).astype(np.int64) for v, d in ((lat, dy * north), (lon, dx * east)))
        yield y, x, at & ~np.any([(y == v) & (x == w) for v, w in seen] or [np.zeros(len(lat), dtype=bool)], axis=0)
        seen.append((y, x))


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Block keys of a normalised side, each a hash of two things or more.

    The first are free of slips in the name, the last of slips in the number.
    ``usual`` is the town that the ZIP usually goes with, for a missing one. A column ``around`` asks for the places within reach, not the own one only.
    """
    bands = _Signatures()
    loosened = _Memo(_digits)
    odd = np.uint64(0x9E3779B97F4A7C15)
    mix = lambda u, v: ((u * odd) ^ (v + odd)) * np.uint64(0xBF58476D1CE4E5B9)
    known = lambda texts: np.array([t != "" for t in texts], dtype=bool)
    for b in batches:
        if not len(b):
            continue
        # streets, areas and numbers repeat: what is worked out is worked out for each once
        at, streets = _distinct(b["street"])
        names = [s.split("\t")[3] for s in streets]
        sig, named = bands.of(names)[at], known(names)[at]
        at, areas = _distinct(b["area"] + "\t" + b["usual"].fillna(""))
        zips, cities, usual = zip(*(s.split("\t") for s in areas))
        regions, towns = [z[:3] if len(z) == 5 else "" for z in zips], [c or t for c, t in zip(cities, usual)]
        zip_key, zip_known, region_key, region_known, spelt, town_known = (v[at] for v in (_hashed(zips), known(zips), _hashed(regions), known(regions), bands.of(towns), known(towns)))
        at, numbers = _distinct(b["number"])
        base, units, loose = (_hashed(v)[at] for v in (numbers, [n.split("|")[1] for n in numbers], [loosened[n] for n in numbers]))
        rid, parcel = b["rid"].to_numpy(), list(b["parcel"])
        pair = lambda j: sig[:, j] * odd ^ sig[:, j + 1] + np.uint64(j)
        lat, lon = _unpacked(b["at"])
        parts = [(named & region_known, region_key ^ pair(j)) for j in (2, 4)]
        for y, x, new in _cells(lat, lon, AREA_CELL, AREA_REACH if "around" in b else None):
            parts += [(named & new, mix(y.view(np.uint64), x.view(np.uint64)) ^ pair(j)) for j in (6, 8, 10)]
        parts += [(named & zip_known, zip_key ^ sig[:, j] + np.uint64(j)) for j in (0, 11)]
        parts += [(named & town_known, mix(spelt[:, j], pair(2 * j))) for j in (0, 1, 2)]
        parts = [(ok, mix(base, v)) for ok, v in parts]
        told = np.array([len(p) >= PARCEL_END for p in parcel], dtype=bool)
        parts.append((told, mix(loose, _hashed([p[-PARCEL_END:] for p in parcel]))))
        parts.append((told, mix(units, _hashed(parcel))))
        for y, x, new in _cells(lat, lon, _CELL, SLIP_METRES / 111_000 if "around" in b else None):
            parts.append((new, mix(loose, mix(y.view(np.uint64), x.view(np.uint64)))))
        yield pd.DataFrame({"key": np.concatenate([k[ok].view(np.int64) for ok, k in parts]), "rid": np.concatenate([rid[ok] for ok, _ in parts])})


def _digits(number: str) -> str:
    """A normalised number with its digits in order of size, suffix and unit as they are."""
    house, _, unit = number.partition("|")
    return "".join(sorted(c for c in house if c.isdigit())) + house.lstrip("0123456789") + "|" + unit


def number_slip(a: str, b: str) -> float:
    """1 same number, 0.5 its digits in another order, 0 another slip, -1 another
    number. Other slips are one edit, or digits in another order where one side
    lacks the suffix. Units must agree."""
    if a == b:
        return 1.0
    (x, _, u), (y, _, v) = a.partition("|"), b.partition("|")
    if u != v:
        return -1.0
    if _digits(a) == _digits(b):
        return 0.5
    bare = x.isdigit() != y.isdigit() and sorted(filter(str.isdigit, x)) == sorted(filter(str.isdigit, y))
    return 0.0 if bare or _one_slip(x, y) else -1.0


def slip_witnessed(slip: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether a pair may stand with this agreement of numbers.

    Neighbours' numbers are one digit apart, so most slips need the same whole
    parcel; digits in another order also go with the end of the parcel, or a
    place too near for a neighbour.
    """
    parcel, metres = x[:, FEATURES.index("parcel")], x[:, FEATURES.index("log_metres")]
    return (slip == 1) | ((slip >= 0) & (parcel == 2)) | ((slip == 0.5) & ((parcel >= 1) | (metres <= math.log10(SLIP_METRES + 1))))


def _osa(a: str, b: str, most: int = 3) -> int:
    """Alignment distance, ``most`` if it is that or more."""
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


def _one_slip(a: str, b: str) -> bool:
    """Whether the alignment distance is below two."""
    if a == b:
        return True
    n, m = len(a), len(b)
    if abs(n - m) > 1:
        return False
    i, most = 0, min(n, m)
    while i < most and a[i] == b[i]:
        i += 1
    if n != m:
        return a[i + 1 :] == b[i:] if n > m else a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


def _agree(a: str, b: str) -> float:
    """1 equal, 0 one slip apart, -1 different, NaN if either is missing."""
    if not a or not b:
        return math.nan
    return 1.0 if a == b else 0.0 if _one_slip(a, b) else -1.0


def _streets(pair: tuple[str, str]) -> tuple:
    x, y = pair
    ad, _, at, an, ao, as_ = x.split("\t")
    bd, _, bt, bn, bo, bs = y.split("\t")
    s, t = an.replace(" ", ""), bn.replace(" ", "")
    g, h = {s[i : i + 2] for i in range(len(s) - 1)}, {t[i : i + 2] for i in range(len(t) - 1)}
    kind = 2.0 if ao == bo else 1.0 if not ao else 0.5 if ao.startswith("?") else 0.2 if not bo else -1.0
    way = 2.0 if (ad, as_) == (bd, bs) else 1.5 if (ad, as_) == (bs, bd) else 1.0 if not ad and not as_ else 0.2 if not bd and not bs else -1.0
    return float(an == bn), float(min(_osa(s, t), 3)), len(g & h) / max(1, len(g | h)), kind, way, 1.0 if at == bt else 0.0 if not at else -1.0


def _areas(pair: tuple[str, str]) -> tuple:
    (az, ac), (bz, bc) = (v.split("\t") for v in pair)
    return _agree(az, bz), _agree(ac, bc)


def compare(b: pd.DataFrame, streets: _Memo | None = None, areas: _Memo | None = None) -> np.ndarray:
    """Features of candidate pairs, columns ``a_*`` and ``b_*`` of both sides. The
    memos keep what is found for pairs of streets and of areas over several calls."""
    streets, areas = _Memo(_streets) if streets is None else streets, _Memo(_areas) if areas is None else areas

    def parcels(x: str, y: str) -> float:
        if not x or not y:
            return math.nan
        return 2.0 if x == y else 1.0 if len(x) >= 6 and len(x) < len(y) and y.endswith(x) else 0.0 if _one_slip(x, y) else -1.0

    out = np.full((len(b), len(FEATURES)), math.nan)
    if len(b):
        out[:, :6] = [streets[v] for v in zip(b["a_street"], b["b_street"])]
        out[:, 6:8] = [areas[v] for v in zip(b["a_area"], b["b_area"])]
        out[:, 8] = [parcels(x, y) for x, y in zip(b["a_parcel"], b["b_parcel"])]
    lat1, lon1 = (np.radians(v) for v in _unpacked(b["a_at"]))
    lat2, lon2 = (np.radians(v) for v in _unpacked(b["b_at"]))
    with np.errstate(invalid="ignore"):
        metres = 6_371_008.8 * np.hypot(lat2 - lat1, (lon2 - lon1) * np.cos(lat1))
        out[:, 9] = np.round(np.log10(metres + 1.0), 2)
    out[:, 10] = b["a_listed"].to_numpy(dtype=float)
    return out


def weak_labels(x: np.ndarray) -> np.ndarray:
    """1 for pairs that surely agree, 0 for pairs that surely do not, NaN between.

    Number, suffix and unit agree in every pair but for witnessed slips. Of the independent witnesses
    (street, ZIP or town, parcel, place on the map) several must speak alike.
    """
    f = dict(zip(FEATURES, x.T))
    street = (f["name_slip"] <= 1) & (f["type"] > 0) & (f["direction"] > 0) & (f["pre_type"] >= 0)
    whole = (f["name_same"] == 1) & (f["type"] == 2) & (f["direction"] == 2) & (f["pre_type"] == 1)
    near, far = f["log_metres"] <= 2.2, f["log_metres"] > 3.3
    parcel, other = f["parcel"] >= 1, f["parcel"] == -1
    area, away = (f["zip"] == 1) | (f["city"] == 1), (f["zip"] == -1) & (f["city"] == -1)
    # a street written as another street of the area is called is that street
    foreign = ((f["listed"] >= 1) & (f["name_same"] == 0)) | ((f["listed"] == 2) & ~((f["name_same"] == 1) & (f["type"] == 2) & (f["direction"] >= 1.5)))
    yes = ~foreign & ((street & (parcel | near) & ~away & ~far) | (whole & area & ~far & ~(f["zip"] == -1) & ~(f["city"] == -1)))
    no = (foreign & ~(parcel & near)) | (far & ~parcel) | (other & ~near & ~whole) | (f["type"] == -1) | (f["direction"] == -1) | (f["name_slip"] >= 3) | (away & ~parcel & ~near)
    return np.where(yes & ~no, 1.0, np.where(no & ~yes, 0.0, math.nan))


def known_pairs(n: int = 4_000, seed: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """Invented comparisons with labels, for what no data are needed: those of all
    kinds whose witnesses speak plainly."""
    r = np.random.default_rng(seed)
    x = np.full((n, len(FEATURES)), math.nan)
    same = r.random(n) < 0.5
    x[:, 0] = same
    x[:, 1] = np.where(same, 0, r.integers(0, 4, n))
    x[:, 2] = np.where(same, 1.0, np.clip(1 - 0.3 * x[:, 1] + r.normal(0, 0.1, n), 0, 0.95))
    for j, values in {3: (2, 2, 1, 0.5, 0.2, -1), 4: (2, 2, 1.5, 1, 0.2, -1), 5: (1, 1, 0, -1), 6: (1, 1, 0, -1, math.nan), 7: (1, 1, 0, -1, math.nan), 8: (2, 1, 0, -1, -1, math.nan), 10: (2, 1, 0)}.items():
        x[:, j] = r.choice(values, n)
    x[:, 9] = np.where(r.random(n) < 0.3, math.nan, np.round(r.uniform(0, 5, n), 2))
    y = weak_labels(x)
    known = ~np.isnan(y)
    return x[known], y[known]


def fit_pairs(seen: np.ndarray) -> Boosted:
    """A classifier of comparisons (rows of ``FEATURES`` and the agreement of numbers), by their weak labels and,
    with little weight, by ``known_pairs``, so that it is fitted even where no pair of the data speaks plainly."""
    y = weak_labels(seen) if len(seen) else np.zeros(0)
    known = ~np.isnan(y)
    x, t = seen[known].reshape(-1, len(FEATURES) + 1), y[known]
    more, labels = known_pairs()
    more = np.column_stack([more, np.ones(len(more))])
    every, target = np.concatenate([x, more]), np.concatenate([t, labels])
    weight = np.concatenate([np.ones(len(t)), np.full(len(labels), KNOWN_WEIGHT / len(labels))])
    # pairs are also learnt with a witness hidden, so that each of them weighs on its own
    hidden = [every]
    for j in (6, 7, 8, 9):
        h = every.copy()
        h[:, j] = math.nan
        hidden.append(h)
    k = len(hidden)
    return Boosted(rounds=50, depth=4).fit(np.concatenate(hidden), np.tile(target, k), np.tile(weight, k), groups=np.tile(np.arange(len(target)), k))


KNOWN_WEIGHT = 200.0  # of the invented comparisons, in pairs of the data


def _listed(a: DataFrame, b: DataFrame) -> DataFrame:
    """Adds ``listed``: 2 if the other list has the street as written in the
    same ZIP (without one: in the same town), 1 if it has its name, else 0."""
    name = F.element_at(F.split("street", "\t"), 4)
    parts = F.split("area", "\t")
    areas = b.select(F.explode(F.array(F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))).alias("where"), "street").where("where <> ''").distinct().withColumn("name", name).where("name <> ''")
    names = areas.select("where", "name").distinct().withColumn("has_name", F.lit(1))
    return (
        a.withColumn("name", name)
        .withColumn("where", F.when(F.get(parts, F.lit(0)) != "", F.get(parts, F.lit(0))).otherwise(F.get(parts, F.lit(1))))
        .join(areas.select("where", "street", F.lit(1).alias("has_street")), ["where", "street"], "left")
        .join(names, ["where", "name"], "left")
        .withColumn("listed", (F.coalesce("has_street", F.lit(0)) + F.coalesce("has_name", F.lit(0))).cast("double"))
        .select(*a.columns, "listed")
    )


def match_entities(sites: DataFrame, points: DataFrame, threshold: float = 0.5, sample_pairs: int = 40_000) -> DataFrame:
    """``site_id, uuid, confidence``: for each site its point of the other list.

    The classifier is fitted on at most about ``sample_pairs`` candidate pairs;
    all pairs are judged. A site gets the most probable point if its probability
    reaches ``threshold`` (ties: the highest uuid), else no row. Points of the same
    house number with suffix and unit go first; a number with a slip counts only
    where parcel or place bear it out (``slip_witnessed``). Without a number a
    site has no match.
    NULL, empty and zero values count as missing. Repeated deliveries change
    nothing: the pair's best comparison counts. Empty tables give an empty
    result; extra columns are ignored.
    """
    require(sites, "site_id", "house_no", "street_line", "city", "zip", "lat", "lon", "parcel_ref")
    require(points, "uuid", "add_number", "addnum_suf", "st_predir", "st_premod", "st_pretyp", "st_name", "st_postyp", "st_posdir", "subaddress", "post_city", "zip_code", "latitude", "longitude", "parcel_id")
    left = sites.where("site_id is not null").select(F.col("site_id").cast("string").alias("id"), "house_no", "street_line", "city", "zip", "lat", "lon", "parcel_ref").dropDuplicates()
    right = points.where("uuid is not null").select(F.col("uuid").alias("id"), "add_number", "addnum_suf", "st_predir", "st_premod", "st_pretyp", "st_name", "st_postyp", "st_posdir", "subaddress", "post_city", "zip_code", "latitude", "longitude", "parcel_id")
    # a NULL would turn the packed places of a batch into floats, too coarse for them
    numbered = lambda d: d.where("number <> ''").fillna(0, ["at"]).withColumn("rid", F.monotonically_increasing_id())
    b = materialize(numbered(right.mapInPandas(_points, _SIDE)), "points")
    a = materialize(_listed(numbered(left.mapInPandas(_sites, _SIDE)), b), "sites")
    key = "key long, rid long"
    # one row for each ZIP of five digits, so never more than 100,000
    code, town = F.split("area", "\t")[0], F.split("area", "\t")[1]
    usual = b.select(code.alias("code"), town.alias("town")).where("code rlike '^[0-9]{5}$' and town <> ''").groupBy("code", "town").agg(F.count(F.lit(1)).alias("n")).groupBy("code").agg(F.max(F.struct("n", "town"))["town"].alias("usual"))
    usual = F.broadcast(materialize(usual, "towns"))
    placed = lambda side: side.withColumn("code", code).join(usual, "code", "left").drop("code")
    pairs = placed(a).withColumn("around", F.lit(True)).mapInPandas(_keys, key).withColumnRenamed("rid", "a_rid").join(placed(b).mapInPandas(_keys, key).withColumnRenamed("rid", "b_rid"), "key").select("a_rid", "b_rid").distinct()
    shown = lambda side, s: side.select(*(F.col(c).alias(f"{s}_{c}" if c != "side_id" else f"{s}_id") for c in side.columns))
    # keys are hashes: numbers are compared as written
    differ = F.col("a_number") != F.col("b_number")
    numbers = [F.when(differ, F.col(f"{s}_number")).alias(f"{s}_number") for s in "ab"]
    columns = ["a_id", "b_id", "a_listed", *numbers, *(f"{s}_{c}" for c in ("street", "area", "parcel", "at") for s in "ab")]
    full = pairs.join(shown(a, "a"), "a_rid").join(shown(b, "b"), "b_rid").select(*columns)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        streets, areas = _Memo(_streets), _Memo(_areas)
        for p in batches:
            slip = np.array([number_slip(u, v) if isinstance(u, str) else 1.0 for u, v in zip(p["a_number"], p["b_number"])])
            p, slip = p[slip >= 0].reset_index(drop=True), slip[slip >= 0]
            x = compare(p, streets, areas)
            ok = slip_witnessed(slip, x)
            yield pd.concat([p[["a_id", "b_id"]], pd.DataFrame(x, columns=FEATURES).assign(number=slip)], axis=1)[ok]

    known_by = [*FEATURES, "number"]
    judged = materialize(full.mapInPandas(features, "a_id string, b_id string, " + ", ".join(f"{f} double" for f in known_by)), "features")
    n = judged.count()
    seen = judged.sample(min(1.0, sample_pairs / max(n, 1)), seed=5).select(*known_by).toPandas().to_numpy(dtype=float).reshape(-1, len(known_by))
    model = fit_pairs(seen)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield pd.DataFrame({"a_id": p["a_id"], "b_id": p["b_id"], "same": p["number"] == 1, "confidence": model.predict(p[known_by].to_numpy(dtype=float))})

    scored = judged.mapInPandas(judge, "a_id string, b_id string, same boolean, confidence double").where(F.col("confidence") >= threshold)
    best = scored.groupBy("a_id").agg(F.max(F.struct("same", "confidence", "b_id")).alias("best"))
    return best.select(F.col("a_id").cast("long").alias("site_id"), F.col("best.b_id").alias("uuid"), "best.confidence")
