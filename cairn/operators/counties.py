"""County names to FIPS codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.dicts import map_state
from cairn.functions.text import normalize_county, strip_county_suffix
from cairn.session import require


def county_reference(adjacency: DataFrame) -> DataFrame:
    """``county_full, state, county_fips`` of the counties of the census bureau's
    county adjacency file (``name``, such as ``Hamilton County, OH``, and ``geoid``)."""
    require(adjacency, "name", "geoid")
    parts = F.split("name", ", (?=[A-Z]{2}$)")
    return adjacency.where("name is not null and geoid is not null").select(parts[0].alias("county_full"), F.get(parts, F.lit(1)).alias("state"), F.lpad("geoid", 5, "0").alias("county_fips")).distinct()


def read_county_adjacency(spark: SparkSession, path: str) -> DataFrame:
    """``county_reference`` of the published text file (columns by ``|``)."""
    raw = spark.read.csv(path, sep="|", header=True)
    return county_reference(raw.toDF(*(c.strip().lower().replace("county ", "") for c in raw.columns)))


def lookup_counties(asked: DataFrame, reference: DataFrame) -> DataFrame:
    """``asked`` (``county, state``) with ``county_fips``, ``county_full``,
    ``status`` (ok, ambiguous, not_found or unknown_state) and ``choices``, the
    full names that an ambiguous one may mean.

    A five-digit code stands for itself; else the full name decides, then the
    short one without the word for the kind of county, within the state. The
    reference is the list of counties (``county_full, state, county_fips``).
    """
    require(asked, "county", "state")
    require(reference, "county_full", "state", "county_fips")
    ref = reference.select(F.col("state").alias("r_state"), normalize_county(F.col("county_full")).alias("full"), normalize_county(strip_county_suffix(F.col("county_full"))).alias("short"), F.struct(F.col("county_fips").alias("fips"), "county_full").alias("r"))
    full = ref.groupBy("r_state", "full").agg(F.min("r").alias("f"), F.count_distinct("r").alias("nf")).withColumnsRenamed({"r_state": "fs", "full": "fn"})
    short = ref.groupBy("r_state", "short").agg(F.min("r").alias("s"), F.sort_array(F.collect_set("r.county_full")).alias("names"), F.count_distinct("r").alias("ns")).withColumnsRenamed({"r_state": "ss", "short": "sn"})
    codes = ref.groupBy(F.col("r.fips").alias("code")).agg(F.min("r").alias("c"))
    q = asked.withColumns({"__n": normalize_county(F.col("county")), "__s": map_state(F.col("state"))})
    q = q.join(full, (F.col("__s") == F.col("fs")) & (F.col("__n") == F.col("fn")), "left").join(short, (F.col("__s") == F.col("ss")) & (F.col("__n") == F.col("sn")), "left").join(codes, F.col("county") == F.col("code"), "left")
    is_code = F.coalesce(F.col("county").rlike("^[0-9]{5}$"), F.lit(False))
    hit = F.when(is_code, F.col("c")).when(F.col("nf") == 1, F.col("f")).when(F.col("ns") == 1, F.col("s"))
    unsure = ~is_code & hit.isNull() & (F.col("ns") > 1)
    status = F.when(hit.isNotNull(), "ok").when(unsure, "ambiguous").when(~is_code & (F.coalesce("__s", F.lit("")) == ""), "unknown_state").otherwise("not_found")
    return q.select(*asked.columns, hit["fips"].alias("county_fips"), hit["county_full"].alias("county_full"), status.alias("status"), F.when(unsure, F.col("names")).alias("choices"))
