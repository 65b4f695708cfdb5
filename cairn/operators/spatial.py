"""Points near points, and points in regions.

A bounded sample of the points shapes a quadtree whose leaves hold about equally
many of them. Every reference point lies in one leaf; a query is repeated into
each leaf that its search box touches. In a leaf an R-tree is bulk-loaded over
one side and probed with the other, and the candidates are refined exactly. A
pair is reported only by the leaf that holds its reference point, the indexed
point itself, so no pair comes out twice. Both sides are then counted by leaf,
over all rows: a leaf with more than its share, as the sample is bounded or its
points coincide, is dealt to several groups, of points and of queries alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.session import require

EARTH_M = 6_371_008.8
_DEPTH = 20  # 2^20 cells along an axis: about 38 m of longitude


def parse_point(column: str):
    """``struct<lon, lat>`` of a WKT point; NULL for NULL, empty or other text.

    Accepts any letter case and spacing, an SRID prefix, and Z or M values.
    """
    number = r"([-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)"
    pattern = rf"(?i)^\s*(?:SRID\s*=\s*[0-9]+\s*;)?\s*POINT\s*(?:ZM|Z|M)?\s*\(\s*{number}\s+{number}(?:\s+[-+.0-9eE]+)*\s*\)\s*$"
    lon, lat = (F.expr(f"try_cast(nullif(regexp_extract(`{column}`, r'{pattern}', {i}), '') as double)") for i in (1, 2))
    return F.when(lon.isNotNull() & lat.isNotNull(), F.struct(lon.alias("lon"), lat.alias("lat")))


def great_circle(lat1, lon1, lat2, lon2):
    """Metres on the sphere (numpy, haversine)."""
    a, b = np.radians(lat1), np.radians(lat2)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.minimum(1.0, np.sqrt(h)))


class Quadtree:
    """Leaves as sorted Z-order starts; built from a sample of points."""

    def __init__(self, lon: np.ndarray, lat: np.ndarray, capacity: int):
        codes = np.sort(self.code(*self.cell(lon, lat)))
        starts: list[int] = []
        stack = [(0, 0, 0, len(codes))]
        while stack:
            level, prefix, a, b = stack.pop()
            width = 1 << 2 * (_DEPTH - level)
            if b - a <= capacity or level == _DEPTH:
                starts.append(prefix)
                continue
            edges = [prefix + i * (width >> 2) for i in range(5)]
            at = [a, *(a + np.searchsorted(codes[a:b], e) for e in edges[1:4]), b]
            stack += [(level + 1, edges[i], int(at[i]), int(at[i + 1])) for i in (3, 2, 1, 0)]
        self.starts = np.sort(np.array(starts, dtype=np.int64))
        #: Groups to which the points and the queries of a leaf are dealt.
        self.salts = np.ones(len(starts), dtype=np.int64)
        self.parts = np.ones(len(starts), dtype=np.int64)
        self._index: RTree | None = None

    @staticmethod
    def cell(lon, lat):
        n = 1 << _DEPTH
        f = lambda v, low, span: np.clip(np.floor((np.asarray(v, dtype=float) - low) / span * n), 0, n - 1).astype(np.int64)
        return f(lon, -180.0, 360.0), f(lat, -90.0, 180.0)

    @staticmethod
    def code(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), dtype=np.int64)
        for i in range(_DEPTH):
            out |= ((x >> i) & 1) << (2 * i) | ((y >> i) & 1) << (2 * i + 1)
        return out

    def leaf(self, lon, lat) -> np.ndarray:
        return np.searchsorted(self.starts, self.code(*self.cell(lon, lat)), side="right") - 1

    def bounds(self) -> tuple[np.ndarray, ...]:
        """Cell ranges x0, y0, x1, y1 (inclusive) of the leaves."""
        ends = np.append(self.starts[1:], 1 << 2 * _DEPTH)
        side = np.round(np.sqrt((ends - self.starts).astype(float))).astype(np.int64)
        x = np.zeros_like(side)
        y = np.zeros_like(side)
        for i in range(_DEPTH):
            x |= ((self.starts >> (2 * i)) & 1) << i
            y |= ((self.starts >> (2 * i + 1)) & 1) << i
        return x, y, x + side - 1, y + side - 1

    def touched(self, west, south, east, north) -> tuple[np.ndarray, np.ndarray]:
        """(box, leaf) for every leaf that a box touches; the leaves are found
        through an R-tree over their own bounds."""
        if self._index is None:
            self._index = RTree(*self.bounds())
        x0, y0 = self.cell(west, south)
        x1, y1 = self.cell(east, north)
        return self._index.probe(x0, y0, x1, y1)


class RTree:
    """Sort-tile-recursive bulk-loaded R-tree over boxes, probed in batches."""

    def __init__(self, x0, y0, x1, y1, fanout: int = 16):
        x0, y0, x1, y1 = (np.asarray(v) for v in (x0, y0, x1, y1))
        n = len(x0)
        self.fanout = fanout
        slabs = max(1, math.ceil(math.sqrt(n / fanout)))
        by_x = np.argsort(x0, kind="stable")
        slab = np.empty(n, dtype=np.int64)
        slab[by_x] = np.arange(n) * slabs // max(n, 1)
        self.order = np.lexsort((y0, slab))
        level = [v[self.order] for v in (x0, y0, x1, y1)]
        self.levels = [level]
        while len(level[0]) > fanout:
            cuts = np.arange(0, len(level[0]), fanout)
            level = [np.minimum.reduceat(level[0], cuts), np.minimum.reduceat(level[1], cuts), np.maximum.reduceat(level[2], cuts), np.maximum.reduceat(level[3], cuts)]
            self.levels.append(level)

    def probe(self, x0, y0, x1, y1) -> tuple[np.ndarray, np.ndarray]:
        """(query, item) for all boxes that touch."""
        n = len(self.levels[0][0])
        if n == 0 or len(x0) == 0:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        top = len(self.levels[-1][0])
        q, node = np.repeat(np.arange(len(x0)), top), np.tile(np.arange(top), len(x0))
        for depth in range(len(self.levels) - 1, -1, -1):
            a, b, c, d = self.levels[depth]
            hit = (a[node] <= x1[q]) & (c[node] >= x0[q]) & (b[node] <= y1[q]) & (d[node] >= y0[q])
            q, node = q[hit], node[hit]
            if depth:
                q, node = np.repeat(q, self.fanout), (node[:, None] * self.fanout + np.arange(self.fanout)).ravel()
                inside = node < len(self.levels[depth - 1][0])
                q, node = q[inside], node[inside]
        return q, self.order[node]


def sample_quadtree(points: DataFrame, sample_rows: int = 200_000, leaf_rows: int = 20_000) -> Quadtree:
    """A quadtree of ``points`` (``lon, lat``) with about ``leaf_rows`` rows in
    a leaf. At most about ``sample_rows`` sampled points come to the driver; they
    only decide where the space is cut, not what is found."""
    n = points.count()
    fraction = min(1.0, sample_rows / max(n, 1))
    seen = (points if fraction == 1.0 else points.sample(fraction, seed=7)).select("lon", "lat").toPandas()
    return Quadtree(seen["lon"].to_numpy(), seen["lat"].to_numpy(), max(1, math.ceil(leaf_rows * fraction)))


def count_leaves(points: DataFrame, tree: Quadtree) -> np.ndarray:
    """Rows of ``points`` (``lon, lat``) in each leaf; as many numbers come to
    the driver as there are leaves, which the sample bounds."""
    shared = points.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            leaf, n = np.unique(shared.value.leaf(b["lon"].to_numpy(), b["lat"].to_numpy()), return_counts=True)
            yield pd.DataFrame({"leaf": leaf, "n": n})

    out = np.zeros(len(tree.starts), dtype=np.int64)
    seen = points.select("lon", "lat").mapInPandas(run, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).toPandas()
    out[seen["leaf"].to_numpy()] = seen["n"].to_numpy()
    return out


def _shares(counts: np.ndarray, leaf_rows: int) -> np.ndarray:
    return np.maximum(1, -(-counts // (2 * leaf_rows)))


def _hash(ids: pd.Series) -> np.ndarray:
    return pd.util.hash_array(ids.to_numpy(dtype=object)).astype(np.uint64)


def _dealt(leaf: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, copy) for every row, ``copies`` times."""
    row = np.repeat(np.arange(len(leaf)), copies)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)


def _reach(lat: np.ndarray, metres: float) -> tuple[np.ndarray, np.ndarray]:
    """Degrees of longitude and latitude that surely hold ``metres``."""
    d = math.degrees(metres / EARTH_M) * (1 + 1e-9) + 1e-12
    edge = np.minimum(np.abs(lat) + d, 90.0)
    s = math.sin(metres / (2 * EARTH_M)) / np.maximum(np.cos(np.radians(edge)), 1e-12)
    return np.where(s >= 1, 360.0, np.degrees(2 * np.arcsin(np.minimum(s, 1.0))) * (1 + 1e-9) + 1e-12), np.full(len(lat), d)


def _unwrapped(i, w, s, e, n):
    """Boxes across the date line appear on both sides of it."""
    left, right = w < -180.0, e > 180.0
    return (np.concatenate([i, i[left], i[right]]), np.concatenate([np.where(left, -180.0, w), w[left] + 360.0, np.full(right.sum(), -180.0)]), np.concatenate([s, s[left], s[right]]),
            np.concatenate([np.where(right, 180.0, e), np.full(left.sum(), 180.0), e[right] - 360.0]), np.concatenate([n, n[left], n[right]]))


def near_points(queries: DataFrame, points: DataFrame, metres: float, sample_rows: int = 200_000, leaf_rows: int = 20_000) -> DataFrame:
    """``query_id, point_id``: every pair at most ``metres`` apart.

    Both sides have ``id`` (string), ``lon`` and ``lat`` in degrees. Rows with
    missing or impossible coordinates (NULL, NaN, |lon| > 180, |lat| > 90) match
    nothing. Rows repeated with equal id and place are taken once, and each pair
    of ids comes out once. The limit itself belongs to the result. Extra columns
    are ignored; an empty side gives an empty result.
    """
    for side in (queries, points):
        require(side, "id", "lon", "lat")
    usable = "id is not null and abs(lon) <= 180 and abs(lat) <= 90 and not isnan(lon) and not isnan(lat)"
    queries, points = (s.select("id", "lon", "lat").where(usable) for s in (queries, points))
    tree = sample_quadtree(points, sample_rows, leaf_rows)
    tree.salts, tree.parts = _shares(count_leaves(points, tree), leaf_rows), _shares(count_leaves(queries, tree), leaf_rows)
    spark = queries.sparkSession
    shared = spark.sparkContext.broadcast(tree)  # leaves: bounded by the sample, not by the data

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = shared.value
        for b in batches:
            leaf = t.leaf(b["lon"].to_numpy(), b["lat"].to_numpy())
            salt = (_hash(b["id"]) % t.salts[leaf].astype(np.uint64)).astype(np.int64)
            i, part = _dealt(leaf, t.parts[leaf])
            yield pd.DataFrame({"leaf": leaf[i], "salt": salt[i], "part": part, "id": b["id"].to_numpy()[i], "lon": b["lon"].to_numpy()[i], "lat": b["lat"].to_numpy()[i]})

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = shared.value
        for b in batches:
            lon, lat = b["lon"].to_numpy(), b["lat"].to_numpy()
            dx, dy = _reach(lat, metres)
            i, w, s, e, n = _unwrapped(np.arange(len(b)), lon - dx, lat - dy, lon + dx, lat + dy)
            q, leaf = t.touched(w, s, e, n)
            met = np.unique(np.stack([i[q], leaf]), axis=1)
            i, leaf = met[0], met[1]
            part = (_hash(b["id"])[i] % t.parts[leaf].astype(np.uint64)).astype(np.int64)
            k, salt = _dealt(leaf, t.salts[leaf])
            i = i[k]
            yield pd.DataFrame({"leaf": leaf[k], "salt": salt, "part": part[k], "id": b["id"].to_numpy()[i], "lon": lon[i], "lat": lat[i]})

    def probe(key, q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(p):
            p, q = p.drop_duplicates(["id", "lon", "lat"]), q.drop_duplicates(["id", "lon", "lat"])
            plon, plat = p["lon"].to_numpy(), p["lat"].to_numpy()
            index = RTree(plon, plat, plon, plat)
            for a in range(0, len(q), 50_000):  # bounds the candidates in memory
                part = q.iloc[a : a + 50_000]
                lon, lat = part["lon"].to_numpy(), part["lat"].to_numpy()
                dx, dy = _reach(lat, metres)
                i, w, s, e, n = _unwrapped(np.arange(len(part)), lon - dx, lat - dy, lon + dx, lat + dy)
                k, j = index.probe(w, s, e, n)
                k = i[k]
                ok = great_circle(lat[k], lon[k], plat[j], plon[j]) <= metres
                out.append(pd.DataFrame({"query_id": part["id"].to_numpy()[k[ok]], "point_id": p["id"].to_numpy()[j[ok]]}).drop_duplicates())
        return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype=str), "point_id": pd.Series(dtype=str)})

    form = "leaf long, salt long, part long, id string, lon double, lat double"
    left = queries.mapInPandas(spread, form).groupBy("leaf", "salt", "part")
    right = points.mapInPandas(place, form).groupBy("leaf", "salt", "part")
    return left.cogroup(right).applyInPandas(probe, "query_id string, point_id string").distinct()


def parse_polygons(wkt: str | None) -> list[list[np.ndarray]]:
    """Polygons of a POLYGON or MULTIPOLYGON text, each a list of rings (outer
    first) of shape (n, 2). Anything else gives an empty list."""
    import re

    text = re.sub(r"^\s*SRID\s*=\s*\d+\s*;", "", wkt or "", flags=re.I).strip()
    m = re.match(r"(MULTI)?POLYGON\s*(?:ZM|Z|M)?\s*(\(.*\))\s*$", text, flags=re.I | re.S)
    if not m:
        return []
    body = m[2] if m[1] else f"({m[2]})"
    out = []
    for polygon in re.findall(r"\(\s*(\([^()]*\)(?:\s*,\s*\([^()]*\))*)\s*\)", body):
        rings = [np.array([[float(v) for v in p.split()[:2]] for p in ring.split(",")]) for ring in re.findall(r"\(([^()]*)\)", polygon)]
        out.append([r for r in rings if len(r) >= 4])
    return [p for p in out if p]


def inside(rings: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Even-odd rule over all rings, so holes are outside. West and south edges
    belong to a ring, east and north edges do not."""
    odd = np.zeros(len(x), dtype=bool)
    for ring in rings:
        ax, ay, bx, by = ring[:-1, 0], ring[:-1, 1], ring[1:, 0], ring[1:, 1]
        for a, b, c, d in zip(ax, ay, bx, by):
            if b != d:
                odd ^= ((b > y) != (d > y)) & (x < (c - a) * (y - b) / (d - b) + a)
    return odd


def containing_region(points: DataFrame, regions: DataFrame, sample_rows: int = 200_000, leaf_rows: int = 20_000) -> DataFrame:
    """``point_id, region_id`` for every region that contains a point.

    ``points`` has ``id`` (string), ``lon``, ``lat``; ``regions`` has ``id``
    (string) and ``wkt`` (polygon or multipolygon, holes allowed). A point on a
    shared edge belongs to one side (west and south edges are inside). Points
    without place, and regions with NULL, empty or other WKT, match nothing;
    repeated rows and extra columns change nothing.
    """
    require(points, "id", "lon", "lat")
    require(regions, "id", "wkt")
    points = points.select("id", "lon", "lat").where("id is not null and abs(lon) <= 180 and abs(lat) <= 90 and not isnan(lon) and not isnan(lat)")
    tree = sample_quadtree(points, sample_rows, leaf_rows)
    tree.salts = _shares(count_leaves(points, tree), leaf_rows)
    shared = points.sparkSession.sparkContext.broadcast(tree)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = shared.value
        for b in batches:
            leaf = t.leaf(b["lon"].to_numpy(), b["lat"].to_numpy())
            salt = (_hash(b["id"]) % t.salts[leaf].astype(np.uint64)).astype(np.int64)
            yield pd.DataFrame({"leaf": leaf, "salt": salt, "id": b["id"], "lon": b["lon"], "lat": b["lat"]})

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = shared.value
        for b in batches:
            for rid, wkt in zip(b["id"], b["wkt"]):
                boxes = [(r[0][:, 0].min(), r[0][:, 1].min(), r[0][:, 0].max(), r[0][:, 1].max()) for r in parse_polygons(wkt)]
                if not boxes:
                    continue
                w, s, e, n = (np.array(v) for v in zip(*boxes))
                leaves = np.unique(t.touched(w, s, e, n)[1])
                k, salt = _dealt(leaves, t.salts[leaves])
                yield pd.DataFrame({"leaf": leaves[k], "salt": salt, "id": rid, "wkt": wkt})

    def probe(key, p: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"point_id": pd.Series(dtype=str), "region_id": pd.Series(dtype=str)})]
        if len(p) and len(r):
            r = r.drop_duplicates(["id", "wkt"])
            parts = [(rid, rings) for rid, wkt in zip(r["id"], r["wkt"]) for rings in parse_polygons(wkt)]
            box = np.array([[q[0][:, 0].min(), q[0][:, 1].min(), q[0][:, 0].max(), q[0][:, 1].max()] for _, q in parts])
            index = RTree(*box.T)
            x, y = p["lon"].to_numpy(), p["lat"].to_numpy()
            k, j = index.probe(x, y, x, y)
            order = np.argsort(j, kind="stable")
            k, j = k[order], j[order]
            for part in np.unique(j):
                i = k[np.searchsorted(j, part) : np.searchsorted(j, part, side="right")]
                ok = inside(parts[part][1], x[i], y[i])
                out.append(pd.DataFrame({"point_id": p["id"].to_numpy()[i[ok]], "region_id": parts[part][0]}))
        return pd.concat(out)

    left = points.mapInPandas(place, "leaf long, salt long, id string, lon double, lat double").groupBy("leaf", "salt")
    right = regions.select("id", "wkt").where("id is not null").mapInPandas(spread, "leaf long, salt long, id string, wkt string").groupBy("leaf", "salt")
    return left.cogroup(right).applyInPandas(probe, "point_id string, region_id string").distinct()
