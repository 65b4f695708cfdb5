"""Points and lines on the sphere, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS_M = 6_371_010.0


def parse_line(wkt: Column) -> Column:
    """``array<struct<lon, lat>>`` of a WKT LINESTRING; NULL for anything else."""
    body = F.nullif(F.regexp_extract(wkt, r"(?i)^\s*(?:SRID\s*=\s*[0-9]+\s*;)?\s*LINESTRING\s*(?:ZM|Z|M)?\s*\(([^()]*)\)\s*$", 1), F.lit(""))
    pair = lambda p: F.split(F.trim(p), r"\s+")
    return F.transform(F.split(body, ","), lambda p: F.struct(pair(p)[0].try_cast("double").alias("lon"), pair(p)[1].try_cast("double").alias("lat")))


def degrees_apart(a: Column, b: Column) -> Column:
    """Central angle of two points (struct lon, lat) in radians."""
    h = F.pow(F.sin((F.radians(b["lat"]) - F.radians(a["lat"])) / 2), 2) + F.cos(F.radians(a["lat"])) * F.cos(F.radians(b["lat"])) * F.pow(F.sin((F.radians(b["lon"]) - F.radians(a["lon"])) / 2), 2)
    return 2 * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Initial great-circle bearing in degrees from north, 0 to 360; NULL for equal points."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    deg = F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)))
    return F.when((lon1 == lon2) & (lat1 == lat2), F.lit(None).cast("double")).otherwise(F.pmod(deg + 360.0, F.lit(360.0)))


def normalize_longitude(c: Column) -> Column:
    return F.pmod(c + 540.0, F.lit(360.0)) - 180.0


def direct_point(lon: Column, lat: Column, bearing_deg: Column, metres: Column) -> Column:
    """Struct lon, lat of the point at a bearing and distance."""
    d, b, a = metres / F.lit(RADIUS_M), F.radians(bearing_deg), F.radians(lat)
    lat2 = F.asin(F.sin(a) * F.cos(d) + F.cos(a) * F.sin(d) * F.cos(b))
    lon2 = F.radians(lon) + F.atan2(F.sin(b) * F.sin(d) * F.cos(a), F.cos(d) - F.sin(a) * F.sin(lat2))
    return F.struct(normalize_longitude(F.degrees(lon2)).alias("lon"), F.degrees(lat2).alias("lat"))


def range_fraction(n: Column, start: Column, end: Column) -> Column:
    """Place of a number along its range, 0 to 1; 0.5 if the ends are equal."""
    f = (n - start).cast("double") / F.nullif(end - start, F.lit(0)).cast("double")
    return F.when(n.isNull() | start.isNull() | end.isNull(), F.lit(None).cast("double")).when(start == end, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), f)))


def along(line: Column, fraction: Column) -> Column:
    """``struct<lon, lat, bearing>`` at a fraction of the length of a polyline.

    The segment that holds the fraction is found by summed angles, and the point
    within it by spherical interpolation. A line without length gives its first
    point and no bearing; NULL lines or fractions give NULL.
    """
    ends = F.transform(F.sequence(F.lit(1), F.size(line) - 1), lambda i: F.struct(F.get(line, i - 1).alias("a"), F.get(line, i).alias("b"), degrees_apart(F.get(line, i - 1), F.get(line, i)).alias("d")))
    zero = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<struct<a:struct<lon:double,lat:double>,b:struct<lon:double,lat:double>,d:double,from:double>>").alias("out"))
    summed = F.aggregate(ends, zero, lambda s, e: F.struct((s["sum"] + e["d"]).alias("sum"), F.array_append(s["out"], F.struct(e["a"].alias("a"), e["b"].alias("b"), e["d"].alias("d"), s["sum"].alias("from"))).alias("out")))

    def place(s: Column) -> Column:
        want = fraction * s["sum"]
        last = F.element_at(F.filter(s["out"], lambda e: (e["from"] <= want) & (e["d"] > 0)), -1)

        def within(e: Column) -> Column:
            t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (want - e["from"]) / e["d"]))
            k1, k2 = F.sin((1 - t) * e["d"]) / F.sin(e["d"]), F.sin(t * e["d"]) / F.sin(e["d"])
            xyz = lambda p: (F.cos(F.radians(p["lat"])) * F.cos(F.radians(p["lon"])), F.cos(F.radians(p["lat"])) * F.sin(F.radians(p["lon"])), F.sin(F.radians(p["lat"])))
            (x1, y1, z1), (x2, y2, z2) = xyz(e["a"]), xyz(e["b"])
            x, y, z = k1 * x1 + k2 * x2, k1 * y1 + k2 * y2, k1 * z1 + k2 * z2
            return F.struct(F.degrees(F.atan2(y, x)).alias("lon"), F.degrees(F.atan2(z, F.sqrt(x * x + y * y))).alias("lat"), bearing(e["a"]["lon"], e["a"]["lat"], e["b"]["lon"], e["b"]["lat"]).alias("bearing"))

        first = F.get(line, F.lit(0))
        still = F.struct(first["lon"].alias("lon"), first["lat"].alias("lat"), F.lit(None).cast("double").alias("bearing"))
        return F.when(last.isNull(), still).otherwise(F.element_at(F.transform(F.array(last), within), 1))

    found = F.element_at(F.transform(F.array(summed), place), 1)
    return F.when(line.isNotNull() & (F.size(line) >= 2) & fraction.isNotNull(), found)


def offset_point(lon: Column, lat: Column, bearing_deg: Column, side: Column, metres: Column) -> Column:
    """The point moved to the left (``L``) or right (``R``) of its line."""
    turn = F.when(side == "L", bearing_deg - 90.0).when(side == "R", bearing_deg + 90.0)
    stay = F.struct(lon.alias("lon"), lat.alias("lat"))
    return F.when(turn.isNull() | (metres == 0) | metres.isNull(), stay).otherwise(direct_point(lon, lat, turn, metres))
