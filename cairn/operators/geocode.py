"""Geocoding along street ranges: street, then range, then a point beside the line."""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.geo import along, offset_point, parse_line, range_fraction
from cairn.functions.text import FLAT, STREET, format_address, format_parts, to_int, valid_zip
from cairn.functions.zips import VARIANTS, zip_candidates
from cairn.operators.diagnose import problem_examples
from cairn.operators.match import match_streets
from cairn.session import materialize, require, shuffled, staged
from cairn.sources.ranges import missing_message, needed_counties

STAGES = ("none", "street_variant", "street", "range_variant", "range")


def pick_ranges(wanted: DataFrame, ranges: DataFrame) -> DataFrame:
    """For ``wanted`` (``id, zip, street, n``) the best range of equal ZIP and
    street text that holds the number with right parity: the narrowest, then
    nearest to the middle, then the lowest ``ord``. Ranges with a missing end
    hold nothing."""
    lo, hi = F.least("fromhn", "tohn"), F.greatest("fromhn", "tohn")
    fits = (F.col("fromhn").isNotNull() & F.col("tohn").isNotNull() & F.col("n").between(lo, hi)) & (F.col("parity").isNull() | (F.col("parity") == "B") | (F.col("parity") == F.when(F.col("n") % 2 == 0, "E").otherwise("O")))
    found = wanted.join(shuffled(ranges), ["zip", "street"]).where(fits)
    middle = (F.col("fromhn") + F.col("tohn")) / 2
    rank = F.struct(F.abs(F.col("fromhn") - F.col("tohn")).alias("width"), F.abs(F.col("n") - middle).alias("off"), F.col("ord").alias("ord"))
    return found.groupBy("id").agg(F.min(F.struct(rank.alias("rank"), "n", "fromhn", "tohn", "side", "offset_flag", "geometry_wkt")).alias("r")).select("id", "r.n", "r.fromhn", "r.tohn", "r.side", "r.offset_flag", "r.geometry_wkt")


def place_in_range(picked: DataFrame, offset: float = 10.0) -> DataFrame:
    """Adds ``lon`` and ``lat``: the number's place along its line, ``offset``
    metres to its side, unless the range is flagged as already offset."""
    f = range_fraction(F.col("n"), F.col("fromhn"), F.col("tohn"))
    at = picked.withColumn("p", along(parse_line(F.col("geometry_wkt")), f))
    metres = F.when(F.col("offset_flag") == "Y", 0.0).otherwise(float(offset))
    return at.withColumn("q", offset_point(F.col("p.lon"), F.col("p.lat"), F.col("p.bearing"), F.col("side"), metres)).withColumns({"lon": F.col("q.lon"), "lat": F.col("q.lat")}).drop("p", "q")


def geocode(x: DataFrame, ranges: DataFrame, x_id: str = "x_id", ord_col: str = "taf_id", phonetic: float = 1, fuzzy: float = 2, types: str = "exact", directions: str = "exact", variants: Sequence[str] | None = VARIANTS, offset: float = 10.0, catalog: DataFrame | None = None, installed: DataFrame | None = None, strict_coverage: bool = False) -> DataFrame:
    """One row for each row of ``x``: ``x_id, matched_zipcode``, six
    ``matched_street_*`` columns, ``matched_geography`` (WKT point), ``geocode_stage``.

    Addresses are looked up once for each formatted text. Streets are sought in
    the ZIP itself, and for what is left in its variants, by variant rank, then
    ZIP. Rows without a usable ZIP find nothing. With a ``catalog`` of what there
    is and the manifest of what is ``installed``, missing counties are warned
    of, or refused with ``strict_coverage`` (see ``check_coverage``).
    """
    if catalog is not None and installed is not None:
        check_coverage(x, "place_zipcode", catalog, installed, variants, strict_coverage)
    if not (math.isfinite(offset) and offset >= 0):
        raise ValueError("offset must be finite and not negative")
    require(x, x_id, *FLAT)
    require(ranges, ord_col, "zip", "fromhn", "tohn", "side", "parity", "offset_flag", "geometry_wkt", *STREET)
    spark = x.sparkSession
    addresses = staged(spark, lambda: x.select(F.col(x_id).alias("x_id"), format_address().alias("text"), "place_zipcode", *STREET, "number_digits"), "addresses")
    distinct = addresses.where(valid_zip(F.col("place_zipcode"))).groupBy("text").agg(F.min(F.struct("place_zipcode", *STREET, "number_digits")).alias("a")).select("text", "a.*")
    distinct = staged(spark, lambda d=distinct: d, "texts")
    street = format_parts(*(F.col(c) for c in STREET)).alias("street")
    refs = ranges.where("zip is not null").select(F.col(ord_col).alias("ord"), "zip", "fromhn", "tohn", "side", "parity", "offset_flag", "geometry_wkt", *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in STREET)).withColumn("street", street)
    ystreets = staged(spark, lambda: refs.groupBy("zip", *STREET).agg(F.min("ord").alias("ord")), "streets")
    options = {"phonetic": phonetic, "fuzzy": fuzzy, "types": types, "directions": directions}

    own = distinct.withColumnRenamed("place_zipcode", "zip")
    found = staged(spark, lambda: match_streets(own, ystreets, "text", "ord", ["zip"], **options).join(shuffled(own.select(F.col("text").alias("x_id"), "zip")), "x_id").select(F.col("x_id").alias("text"), "zip", F.col("y_ord").alias("ord")), "found")

    def among_variants() -> DataFrame:
        left = distinct.join(shuffled(found), "text", "left_anti")
        ways = zip_candidates(left, "place_zipcode", variants).where("source_zip_variant_rank > 0").groupBy("source_zip", "zip").agg(F.min("source_zip_variant_rank").alias("rank"))
        there = ways.join(ystreets.select("zip").distinct(), "zip", "left_semi")
        tried = left.join(there, left["place_zipcode"] == there["source_zip"]).withColumn("key", F.concat_ws("\r", "text", "zip"))
        tried = materialize(tried, "tried")
        late = match_streets(tried, ystreets, "key", "ord", ["zip"], **options).withColumnRenamed("x_id", "key").join(shuffled(tried.select("key", "text", "zip", "rank")), "key")
        return late.groupBy("text").agg(F.min(F.struct("rank", "zip", F.col("y_ord").alias("ord"))).alias("b")).select("text", "b.zip", "b.ord")

    if variants:
        found = found.unionByName(staged(spark, among_variants, "late"))
    streets = found.join(shuffled(ystreets.select("ord", "zip", *(F.col(c).alias(f"matched_{c}") for c in STREET))), ["ord", "zip"]).drop("ord")
    streets = streets.withColumn("street", format_parts(*(F.col(f"matched_{c}") for c in STREET)))
    numbered = streets.join(shuffled(distinct.select("text", "number_digits")), "text")
    wanted = numbered.select(F.col("text").alias("id"), "zip", "street", to_int(F.col("number_digits")).alias("n")).where("n is not null")
    points = staged(spark, lambda: place_in_range(pick_ranges(wanted, refs), offset).select(F.col("id").alias("text"), "lon", "lat"), "points")
    out = addresses.select("x_id", "text", "place_zipcode").join(shuffled(streets.withColumnRenamed("zip", "matched_zipcode").drop("street")), "text", "left").join(shuffled(points), "text", "left")
    wkt = F.when(F.col("lon").isNotNull(), F.format_string("POINT (%.7f %.7f)", "lon", "lat"))
    matched = [f"matched_{c}" for c in STREET]
    out = out.withColumn("matched_geography", wkt)
    return out.select("x_id", "matched_zipcode", *matched, "matched_geography", geocode_stage(F.col("place_zipcode"), F.col("matched_zipcode"), format_parts(*(F.col(m) for m in matched)), F.col("matched_geography")).alias("geocode_stage"))


def geocode_stage(zip_: Column, matched_zip: Column, matched_street: Column, geography: Column) -> Column:
    """none, street_variant, street, range_variant or range."""
    street = (F.coalesce(matched_zip, F.lit("")) != "") & (F.coalesce(matched_street, F.lit("")) != "")
    exact = street & F.coalesce((zip_ != "") & (zip_ == matched_zip), F.lit(False))
    return F.when(~street, "none").when(geography.isNotNull(), F.when(exact, "range").otherwise("range_variant")).otherwise(F.when(exact, "street").otherwise("street_variant"))


def stage_rank(stage: Column) -> Column:
    return F.array_position(F.array(*(F.lit(s) for s in STAGES)), stage).cast("int") - 1


def uncovered_zips(x: DataFrame, zip_col: str, ranges: DataFrame) -> DataFrame:
    """Usable ZIPs of ``x`` for which no range is installed."""
    return x.where(valid_zip(F.col(zip_col))).select(F.col(zip_col).alias("zip")).distinct().join(ranges.select("zip").distinct(), "zip", "left_anti")


def check_coverage(x: DataFrame, zip_col: str, catalog: DataFrame, installed: DataFrame, variants: Sequence[str] | None = VARIANTS, strict: bool = False) -> DataFrame:
    """Rows of ``needed_counties`` of the ZIPs of ``x`` whose county is in the
    ``catalog``, but not ``installed`` (a manifest). If there are any, they are
    told by a warning, or by ``RuntimeError`` if ``strict``."""
    needed = needed_counties(x, zip_col, catalog, variants)
    missing = needed.join(installed.select("county_fips").distinct(), "county_fips", "left_anti").select(*needed.columns)
    message = missing_message(missing)
    if message and strict:
        raise RuntimeError(message + " Addresses there, such as: " + problem_examples(x.where(F.col(zip_col).isin([r[0] for r in missing.select("source_zip").distinct().limit(5).collect()])).select(F.col(zip_col).alias("zip")), "zip"))
    if message:
        warnings.warn(message, stacklevel=2)
    return missing
