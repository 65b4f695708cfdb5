"""Street ranges: from raw features to an installed, partitioned data set.

An installation is a folder of ranges, partitioned by the ZIP's first three and
last two digits and the county, and a manifest beside it: the ZIPs of each
installed county. A catalog has the same columns for counties that could be
installed."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions.dicts import map_direction, map_post_type, map_pre_type
from cairn.functions.phonetic import map_ordinal
from cairn.functions.tagger import addresses_from_tags, tag_address
from cairn.functions.text import STREET
from cairn.functions.zips import VARIANTS, zip_candidates
from cairn.session import delete, materialize, require

#: Feature classes that are streets.
ROAD_CLASSES = ("S1100", "S1200", "S1400", "S1630", "S1640")

RANGE_SCHEMA = T.StructType([T.StructField(n, t) for n, t in [("linearid", T.StringType()), ("fullname", T.StringType()), ("side", T.StringType()), ("zip", T.StringType()), ("fromhn", T.IntegerType()), ("tohn", T.IntegerType()), ("parity", T.StringType()), ("offset_flag", T.StringType()), ("geometry_wkt", T.StringType()), *((c, T.StringType()) for c in STREET), ("street_tag_parsed", T.BooleanType()), ("county_fips", T.StringType()), ("zip3", T.StringType()), ("zip2", T.StringType())]])


def unpivot_sides(features: DataFrame) -> DataFrame:
    """One row for each side of a feature with left and right columns; sides with
    any missing value are left out, house numbers become integers."""
    require(features, "linearid", "fullname", "zipl", "zipr", "lfromhn", "ltohn", "rfromhn", "rtohn", "parityl", "parityr", "offsetl", "offsetr", "geometry_wkt")
    one = "linearid, fullname, '{s}' as side, zip{t} as zip, {t}fromhn as fromhn, {t}tohn as tohn, parity{t} as parity, offset{t} as offset_flag, geometry_wkt"
    sides = [features.selectExpr(*one.format(s=s, t=t).split(", ")) for s, t in (("L", "l"), ("R", "r"))]
    both = sides[0].unionByName(sides[1]).withColumns({c: F.col(c).cast("string").try_cast("int") for c in ("fromhn", "tohn")})
    return both.dropna("any")


def feature_names(names: DataFrame) -> DataFrame:
    """Primary names of road classes: ``linearid``, ``fullname`` and the six street
    parts, NULL as ``""``, without repetition."""
    require(names, "linearid", "fullname", "mtfcc", "paflag", "prequalabr", "prediabrv" if "prediabrv" in names.columns else "predirabrv", "pretypabrv", "name", "suftypabrv", "sufdirabrv")
    kept = names.where(F.col("mtfcc").isin(*ROAD_CLASSES) & F.col("fullname").isNotNull() & (F.col("paflag") == "P"))
    part = lambda c, out: F.coalesce(F.col(c), F.lit("")).alias(out)
    pre = "prediabrv" if "prediabrv" in names.columns else "predirabrv"
    return kept.select("linearid", "fullname", part(pre, STREET[0]), part("prequalabr", STREET[1]), part("pretypabrv", STREET[2]), part("name", STREET[3]), part("suftypabrv", STREET[4]), part("sufdirabrv", STREET[5])).distinct()


def parse_full_names(df: DataFrame, column: str) -> DataFrame:
    """``column`` and the six street parts of its distinct values, read by the
    tagger; what has no street name in it is the name itself."""
    names = df.select(column).where(F.col(column).isNotNull()).distinct()
    tagged = addresses_from_tags(names.withColumn("__tags", tag_address(F.concat(F.lit("1 "), F.col(column)))), "__tags", maps=False)
    named = F.coalesce(F.col("street_name"), F.lit("")) != ""
    return tagged.select(column, *(F.when(named, F.coalesce(F.col(c), F.lit(""))).otherwise(F.col(column) if c == "street_name" else F.lit("")).alias(c) for c in STREET))


def link_names(sides: DataFrame, names: DataFrame, county_fips: str) -> DataFrame:
    """Range sides with the street parts of their feature (the first by text). A
    side without one has the parts that its whole name is parsed into, and
    ``street_tag_parsed``."""
    first = names.groupBy("linearid").agg(F.min(F.struct(*STREET)).alias("s"))
    joined = sides.join(first, "linearid", "left")
    read = parse_full_names(joined.where("s is null"), "fullname").select(F.col("fullname").alias("__full"), F.struct(*STREET).alias("__p"))
    joined = joined.join(read, F.col("s").isNull() & (F.col("fullname") == F.col("__full")), "left").withColumn("street_tag_parsed", F.col("s").isNull())
    joined = joined.select(*sides.columns, *(F.coalesce(F.col(f"s.{c}"), F.col(f"__p.{c}"), F.lit("")).alias(c) for c in STREET), "street_tag_parsed")
    return joined.withColumns({"county_fips": F.lit(county_fips), "zip3": F.substring("zip", 1, 3), "zip2": F.substring("zip", 4, 2)})


def harmonise_streets(df: DataFrame) -> DataFrame:
    """The six street columns in canonical form."""
    return df.withColumns({"street_predirectional": map_direction(F.col("street_predirectional")), "street_postdirectional": map_direction(F.col("street_postdirectional")), "street_pretype": map_pre_type(F.col("street_pretype")), "street_posttype": map_post_type(F.col("street_posttype")), "street_name": map_ordinal(F.col("street_name"))})


_PARTS = ["zip3", "zip2", "county_fips"]


def install_ranges(ranges: DataFrame, path: str) -> None:
    """Writes ranges by ZIP and county and brings the manifest up to date.

    All counties of ``ranges`` are replaced: partitions that they had before and
    have no longer are deleted. A busy partition is written by several tasks.
    """
    spark = ranges.sparkSession
    ranges = ranges.select(*RANGE_SCHEMA.fieldNames())
    ranges.hint("rebalance", *_PARTS).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*_PARTS).parquet(path)
    # one row for each ZIP of each county; the country has some ten thousand
    now = {tuple(r) for r in ranges.select(*_PARTS).distinct().toLocalIterator()}
    for county in {r[2] for r in now}:
        for stale in installed_partitions(spark, path, county) - {r for r in now if r[2] == county}:
            delete(spark, f"{path}/zip3={stale[0]}/zip2={stale[1]}/county_fips={stale[2]}")
    fresh = manifest(ranges).withColumn("installed_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"))
    old = read_manifest(spark, path).join(fresh.select("county_fips").distinct(), "county_fips", "left_anti")
    write_small(old.select(*MANIFEST_SCHEMA.fieldNames()).unionByName(fresh), manifest_path(path))


def installed_partitions(spark: SparkSession, path: str, county_fips: str) -> set[tuple[str, str, str]]:
    """(zip3, zip2, county) of the partitions of a county."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/zip3=*/zip2=*/county_fips={county_fips}")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    return {tuple(re.findall(r"=([^/]*)", str(f.getPath()))[-3:]) for f in found}


def install_county(features: DataFrame, names: DataFrame, county_fips: str, path: str) -> DataFrame:
    """The whole way of a county: sides, names, parsed fallback, ranges, manifest.
    Returns the county's rows of the manifest."""
    install_ranges(link_names(unpivot_sides(features), feature_names(names), county_fips), path)
    return read_manifest(features.sparkSession, path).where(F.col("county_fips") == county_fips)


CATALOG_SCHEMA = T.StructType([T.StructField(n, t) for n, t in [("county_fips", T.StringType()), ("zip", T.StringType()), ("zip3", T.StringType()), ("zip2", T.StringType()), ("n_ranges", T.LongType())]])
MANIFEST_SCHEMA = T.StructType([*CATALOG_SCHEMA.fields, T.StructField("installed_at", T.StringType())])


def manifest_path(path: str) -> str:
    return path.rstrip("/") + "_manifest"


def write_small(df: DataFrame, path: str) -> None:
    """Writes a small table beside ``path`` and puts it in its place by renaming,
    so that a reader finds the old or the new one; ``df`` may read the old."""
    spark = df.sparkSession
    at = f"{path}.{uuid.uuid4().hex}"
    df.coalesce(1).write.parquet(at)
    delete(spark, path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    if not hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration()).rename(hadoop(at), hadoop(path)):
        raise RuntimeError(f"{at} could not be renamed to {path}")


def _read_small(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The ZIPs of the installed counties; an empty table before the first installation."""
    return _read_small(spark, manifest_path(path), MANIFEST_SCHEMA)


def catalog_rows(df: DataFrame) -> DataFrame:
    """The distinct rows of a catalog or manifest, by ZIP and county."""
    return df.select(*CATALOG_SCHEMA.fieldNames()).distinct().orderBy("zip", "county_fips")


def write_catalog(df: DataFrame, path: str) -> None:
    write_small(catalog_rows(df), path)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return _read_small(spark, path, CATALOG_SCHEMA)


def ensure_counties(zips: DataFrame, zip_col: str, catalog: DataFrame, path: str, install: Callable[[str], object], variants: Sequence[str] | None = VARIANTS) -> DataFrame:
    """Installs what is missing for the ZIPs: ``install`` is called with the code
    of each county in the catalog that has one of them, or a variant, and is not
    installed. Returns what was missing, as ``needed_counties``; if a county is
    missing still, ``RuntimeError`` with ``missing_message``."""
    spark = zips.sparkSession
    needed = needed_counties(zips, zip_col, catalog, variants)
    absent = lambda: needed.join(read_manifest(spark, path).select("county_fips").distinct(), "county_fips", "left_anti").select(*needed.columns)
    before = materialize(absent(), "missing")
    for r in before.select("county_fips").distinct().orderBy("county_fips").collect():  # counties: a few thousand at most
        install(r["county_fips"])
    message = missing_message(absent())
    if message:
        raise RuntimeError(message)
    return before


def missing_message(missing: DataFrame, shown: int = 5) -> str:
    """A sentence on counties that are not installed, with the ZIPs that ask for
    them; ``""`` if there are none."""
    counties = [r[0] for r in missing.select("county_fips").distinct().orderBy("county_fips").collect()]
    if not counties:
        return ""
    asked = F.concat("zip", F.lit(" ("), "source_zip_variant", F.lit(" from "), "source_zip", F.lit(")"))
    zips = missing.select(asked.alias("z")).distinct().orderBy("z")
    n = zips.count()
    some = lambda items, size: ", ".join(items[:shown]) + (f", ... and {size - shown} more" if size > shown else "")
    return f"{len(counties)} counties are not installed: {some(counties, len(counties))}. Affected ZIPs: {some([r['z'] for r in zips.limit(shown).collect()], n)}."


def read_ranges(spark: SparkSession, path: str, zips: Sequence[str] | None = None, mapped: bool = False) -> DataFrame:
    """The installed ranges; with ``zips`` only the partitions of these, with
    ``mapped`` the street parts in canonical form."""
    df = spark.read.schema(RANGE_SCHEMA).option("basePath", path).parquet(path)
    if zips is not None:
        prune = F.lit(False)
        for z in dict.fromkeys(zips):
            prune = prune | ((F.col("zip3") == z[:3]) & (F.col("zip2") == z[3:]))
        df = df.where(prune)
    return harmonise_streets(df) if mapped else df


def manifest(ranges: DataFrame) -> DataFrame:
    """``county_fips, zip, zip3, zip2, n_ranges``."""
    return ranges.where("zip is not null").groupBy("county_fips", "zip", "zip3", "zip2").agg(F.count(F.lit(1)).alias("n_ranges"))


def needed_counties(zips: DataFrame, zip_col: str, catalog: DataFrame, variants: Sequence[str] | None = VARIANTS) -> DataFrame:
    """Catalog rows of the ZIPs and their variants, with where each came from."""
    wanted = zip_candidates(zips, zip_col, variants)
    return wanted.join(catalog.select("county_fips", "zip", "zip3", "zip2", "n_ranges"), "zip").select("county_fips", "zip", "zip3", "zip2", "n_ranges", "source_zip", "source_zip_variant").distinct()


def missing_counties(needed: DataFrame, installed: DataFrame) -> DataFrame:
    return needed.select("county_fips").distinct().join(installed.select("county_fips").distinct(), "county_fips", "left_anti")


def street_type_counts(ranges: DataFrame, top: int = 10) -> DataFrame:
    """The street names found in most ZIPs: ``street_name, street_posttype, n_zips, n_ranges``."""
    counts = ranges.groupBy("street_name", "street_posttype").agg(F.count_distinct("zip").alias("n_zips"), F.count(F.lit(1)).alias("n_ranges"))
    return counts.orderBy(F.desc("n_zips"), F.desc("n_ranges"), "street_name", "street_posttype").limit(top)
