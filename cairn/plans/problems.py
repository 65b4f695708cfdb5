"""Queries of the general data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.compact import compact_taf, duplicate_ids
from cairn.operators.heavy_keys import heavy_keys, per_key
from cairn.operators.spatial import containing_region, near_points, parse_point
from cairn.sources.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_keys(table(spark, d, "x"), "place_zipcode", 0.04).select("place_zipcode")


def p2_zip_results(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "x").withColumn("late", (F.col("received_at") > F.col("entered_at") + F.expr("interval 30 days")).cast("long"))
    return per_key(x, "place_zipcode", {"first_entered": ("min", "entered_at"), "last_received": ("max", "received_at"), "n_late": ("sum", "late"), "n_named": ("count", "place_name")}, {"n_records": "x_id"})


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return duplicate_ids(spark, table(spark, d, "taf"), table(spark, d, "taf_file"))


def p5_manifest(spark: SparkSession, d: str) -> DataFrame:
    return compact_taf(spark, table(spark, d, "taf"), table(spark, d, "taf_file"))[0].select("out_group", "n_rows", "n_bytes")


def _geocoded(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "geocode").select(F.col("geocode_id").cast("string").alias("id"), parse_point("matched_geography").alias("p"))
    return g.where("p is not null").select("id", "p.lon", "p.lat")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    points = _geocoded(spark, d)
    nad = table(spark, d, "nad").select(F.col("uuid").alias("id"), F.col("longitude").alias("lon"), F.col("latitude").alias("lat"))
    tract = table(spark, d, "tract").select(F.col("tract_id").cast("string").alias("id"), F.col("tract_wkt").alias("wkt"))
    near = near_points(points, nad, 30.0).select(F.col("query_id").cast("long").alias("geocode_id"), F.lit("near").alias("kind"), F.col("point_id").alias("other_id"))
    region = containing_region(points, tract).select(F.col("point_id").cast("long").alias("geocode_id"), F.lit("region").alias("kind"), F.col("region_id").alias("other_id"))
    return near.unionByName(region)


def p5_totals(spark: SparkSession, d: str) -> DataFrame:
    """What the consolidated files hold in all."""
    return p5_manifest(spark, d).agg(F.sum("n_rows").alias("n_rows"))


QUERIES = {f.__name__: f for f in (p2_found, p2_zip_results, p5_found, p5_manifest, p5_totals, p6_found)}

SQL = {
    "p2_found": "SELECT place_zipcode FROM x WHERE place_zipcode <> '' GROUP BY place_zipcode HAVING count(*) > 0.04 * (SELECT count(*) FROM x)",
    "p2_zip_results": """SELECT place_zipcode, count(*) AS n_rows, min(entered_at) AS first_entered, max(received_at) AS last_received,
        CAST(sum(CAST(received_at > entered_at + INTERVAL 30 DAY AS BIGINT)) AS BIGINT) AS n_late, count(place_name) AS n_named, count(DISTINCT x_id) AS n_records FROM x GROUP BY place_zipcode""",
    "p5_found": """SELECT taf_id FROM (SELECT taf_id, min(taf_id) OVER (PARTITION BY linearid, fullname, side, zip, fromhn, tohn, parity, offset_flag, geometry_wkt, street_predirectional, street_premodifier,
        street_pretype, street_name, street_posttype, street_postdirectional, street_tag_parsed, county_fips, zip3, zip2) AS first_id FROM taf) t WHERE taf_id > first_id""",
    "p5_totals": """SELECT count(*) AS n_rows FROM (SELECT DISTINCT linearid, fullname, side, zip, fromhn, tohn, parity, offset_flag, geometry_wkt, street_predirectional, street_premodifier,
        street_pretype, street_name, street_posttype, street_postdirectional, street_tag_parsed, county_fips, zip3, zip2 FROM taf) t""",
    "p6_found": r"""WITH g AS (SELECT DISTINCT geocode_id, CAST(regexp_extract(lower(matched_geography), 'point\s*(?:zm|z|m)?\s*\(\s*([-+.0-9e]+)\s+([-+.0-9e]+)', 1) AS DOUBLE) AS lon, CAST(regexp_extract(lower(matched_geography), 'point\s*(?:zm|z|m)?\s*\(\s*([-+.0-9e]+)\s+([-+.0-9e]+)', 2) AS DOUBLE) AS lat
        FROM geocode WHERE regexp_matches(lower(matched_geography), 'point\s*(?:zm|z|m)?\s*\(\s*[-+.0-9e]+\s+[-+.0-9e]+')), n AS (SELECT DISTINCT uuid, longitude AS lon, latitude AS lat FROM nad WHERE abs(longitude) <= 180 AND abs(latitude) <= 90),
      cells AS (SELECT *, CAST(floor(lat / 0.001) AS BIGINT) + i AS cell FROM g, range(-1, 2) t(i)), near AS (SELECT DISTINCT geocode_id, uuid FROM cells g JOIN n ON CAST(floor(n.lat / 0.001) AS BIGINT) = g.cell AND 2 * 6371008.8 * asin(least(1, sqrt(pow(sin(radians(n.lat - g.lat) / 2), 2) + cos(radians(g.lat)) * cos(radians(n.lat)) * pow(sin(radians(n.lon - g.lon) / 2), 2)))) <= 30),
      rings AS (SELECT tract_id, row_number() OVER () AS ring, string_split(r, ',') AS p FROM (SELECT tract_id, unnest(regexp_extract_all(tract_wkt, '\(([^()]+)\)', 1)) AS r FROM tract) q), corners AS (SELECT tract_id, ring, i, string_split(trim(p[i]), ' ') AS a, string_split(trim(p[i + 1]), ' ') AS b FROM (SELECT *, unnest(range(1, len(p))) AS i FROM rings) q),
      edges AS (SELECT tract_id, CAST(a[1] AS DOUBLE) AS x1, CAST(a[2] AS DOUBLE) AS y1, CAST(b[1] AS DOUBLE) AS x2, CAST(b[2] AS DOUBLE) AS y2 FROM corners),
      region AS (SELECT geocode_id, tract_id FROM g JOIN edges ON y1 <> y2 AND (y2 > lat) <> (y1 > lat) AND lon < (x1 - x2) * (lat - y2) / (y1 - y2) + x2 GROUP BY geocode_id, lon, lat, tract_id HAVING count(*) % 2 = 1)
      SELECT geocode_id, 'near' AS kind, uuid AS other_id FROM near UNION ALL SELECT DISTINCT geocode_id, 'region', CAST(tract_id AS VARCHAR) FROM region""",
}
