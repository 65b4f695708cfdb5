"""Queries of the address operators over the tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import address, cells, dicts, geo, phonetic, tagger, text, zips
from cairn import cli
from cairn.operators import counties, diagnose, fuzzy, geocode, match
from cairn.plans import match_sql
from cairn.operators.spatial import parse_point
from cairn.session import shared_path
from cairn.sources import points, ranges
from cairn.sources.tables import table

STREET = text.STREET
_S = ", ".join(STREET)

# ---------------------------------------------------------------- text and words


def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.clean_text(F.col("text")).alias("cleaned"))


def format_address(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "x").select("x_id", text.format_address().alias("address"))


def unique_by_text(spark: SparkSession, d: str) -> DataFrame:
    return match.unique_addresses(table(spark, d, "x"), "x_id").select("x_id", text.format_address().alias("address"))


def missing_records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "x").groupBy("source", text.is_na(text.FLAT).alias("missing")).agg(F.count(F.lit(1)).alias("n"))


def digit_repair(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sites").select("house_no").distinct().select("house_no", text.repair_digits(F.col("house_no")).alias("digits"), text.valid_digits(F.col("house_no")).alias("valid"))


def zip_repair(spark: SparkSession, d: str) -> DataFrame:
    z = F.col("place_zipcode")
    return table(spark, d, "x").select("place_zipcode").distinct().select("place_zipcode", text.repair_zip(z).alias("repaired"), text.valid_zip(z).alias("valid"))


def house_number_int(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sites").select("house_no").distinct().select("house_no", text.to_int(F.col("house_no")).alias("n"))


def street_type_map(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("street_posttype")
    return table(spark, d, "x").groupBy("street_posttype").agg(F.count(F.lit(1)).alias("n")).select("street_posttype", dicts.map_post_type(c).alias("mapped"), "n")


def direction_map(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("street_predirectional")
    return table(spark, d, "x").groupBy("street_predirectional").agg(F.count(F.lit(1)).alias("n")).select("street_predirectional", dicts.map_direction(c).alias("mapped"), "n")


def pre_type_map(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("street_pretype")
    return table(spark, d, "x").groupBy("street_pretype").agg(F.count(F.lit(1)).alias("n")).select("street_pretype", dicts.map_pre_type(c).alias("mapped"), "n")


def state_map(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_name", dicts.map_state(F.col("n_name")).alias("mapped")).unionByName(table(spark, d, "x").select(F.col("place_state").alias("n_name")).distinct().select("n_name", dicts.map_state(F.col("n_name")).alias("mapped")))


def unmapped_types(spark: SparkSession, d: str) -> DataFrame:
    return diagnose.unmapped_words(table(spark, d, "intake"), "posttype", "post_type")


def ordinal_map(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "x").select("street_name").distinct().select("street_name", phonetic.map_ordinal(F.col("street_name")).alias("mapped"))


def soundex_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "x").select("street_name").distinct().select("street_name", phonetic.soundex(F.col("street_name")).alias("key"))


def street_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "x").select("street_name").distinct().select("street_name", phonetic.street_key(F.col("street_name")).alias("key"))


def ordinal_neighbors(spark: SparkSession, d: str) -> DataFrame:
    keys = spark.range(1, 10_000).select(F.format_string("#%04d", "id").alias("key"))
    return keys.select("key", F.explode(phonetic.ordinal_neighbors(F.col("key"))).alias("neighbor"))


def zip_variants(spark: SparkSession, d: str) -> DataFrame:
    return zips.zip_candidates(table(spark, d, "x"), "place_zipcode").select("source_zip", "source_zip_variant", "zip")


def zip_choice(spark: SparkSession, d: str) -> DataFrame:
    return zips.choose_zips(table(spark, d, "x"), "place_zipcode", table(spark, d, "nad"), "zip_code")


#: Some counties with their codes, as the census bureau lists them.
COUNTIES = [("Hamilton County", "OH", "39061"), ("Butler County", "OH", "39017"), ("Orleans Parish", "LA", "22071"), ("St. Louis County", "MO", "29189"), ("St. Louis city", "MO", "29510"), ("Baltimore County", "MD", "24005"), ("Baltimore city", "MD", "24510"), ("Fairfax County", "VA", "51059"), ("Juneau City and Borough", "AK", "02110"), ("Kenton County", "KY", "21117")]
ASKED = [("Hamilton", "OH"), ("hamilton  county", "OH"), ("39061", None), ("Orleans", "LA"), ("St. Louis", "MO"), ("St Louis City", "MO"), ("Baltimore", "MD"), ("Fairfax", "VA"), ("Juneau", "AK"), ("Nowhere", "OH"), ("99999", "OH"), (None, "KY")]


def county_lookup(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "nad").select("county", "state").distinct().unionByName(spark.createDataFrame(ASKED, "county string, state string")).distinct()
    return counties.lookup_counties(asked, spark.createDataFrame(COUNTIES, "county_full string, state string, county_fips string")).drop("choices")


def flat_coerce(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "x").select("x_id", "number_digits", "street_predirectional", "street_name", "street_posttype", "place_zipcode")
    return address.as_address(x, strict=False)


# ---------------------------------------------------------------- fuzzy matching


def fuzzy_match_names(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "intake").select("name").where("name is not null").distinct()
    y = table(spark, d, "canon").where("field = 'name'").select("canon_id", F.col("canonical").alias("name"))
    return fuzzy.fuzzy_match(x.withColumn("entry", F.col("name")), y, "entry", "canon_id", "name", 1).select(F.col("x_id").alias("entry"), F.col("y_id").alias("canon_id"), "dist")


def fuzzy_field(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "x").select("place_zipcode").where("place_zipcode <> ''").distinct()
    y = table(spark, d, "taf").select("zip").distinct().select(F.col("zip").alias("id"), F.col("zip").alias("place_zipcode"))
    return fuzzy.fuzzy_match(x.withColumn("given", F.col("place_zipcode")), y, "given", "id", "place_zipcode", 1).select(F.col("x_id").alias("given"), F.col("y_id").alias("zip"), "dist")


def _x_streets(spark: SparkSession, d: str) -> DataFrame:
    x = ranges.harmonise_streets(table(spark, d, "x").select("place_zipcode", *STREET).na.fill("", STREET).distinct())
    return x.where("place_zipcode is not null").groupBy(F.col("place_zipcode").alias("zip"), *STREET).agg(F.lit(1).alias("one")).drop("one").withColumn("key", F.concat_ws("|", "zip", *STREET))


def _taf_streets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "taf").where("zip is not null").select("taf_id", "zip", *(phonetic.map_ordinal(F.col(c)).alias(c) if c == "street_name" else c for c in STREET)).groupBy("zip", *STREET).agg(F.min("taf_id").alias("taf_id"))


#: Types, directions, edits, phonetic distance of the registered street matches.
STREET_MATCHES = {
    "street_match_exact": ("exact", "exact", 0, 0), "street_match_swap": ("swap", "swap", 0, 0), "street_match_ignore": ("ignore", "ignore", 0, 0), "street_match_compatible": ("compatible", "exact", 0, 0),
    "street_match_fuzzy": ("exact", "exact", 1, 0), "street_match_phonetic": ("exact", "swap", 0, 2), "street_match_ordinal": ("ignore", "swap", 1, 1),
}


def _street_query(types: str, directions: str, fuzz: float, phon: float):
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = match.match_streets(_x_streets(spark, d), _taf_streets(spark, d), "key", "taf_id", ["zip"], phon, fuzz, types, directions)
        return out.select(F.col("x_id").alias("street"), F.col("y_ord").alias("taf_id"), "how")

    return run


def number_match(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "x").select(F.col("place_zipcode").alias("zip"), *text.NUMBER).na.fill("", text.NUMBER).where("zip is not null").distinct().withColumn("key", F.concat_ws("|", "zip", *text.NUMBER))
    y = table(spark, d, "nad").where("zip_code is not null").select(F.col("zip_code").alias("zip"), F.lit("").alias("number_prefix"), F.col("add_number").cast("string").alias("number_digits"), F.coalesce("addnum_suf", F.lit("")).alias("number_suffix"), "uuid")
    out = match.match_numbers(x, y, "key", "uuid", ["zip"], 1)
    return out.select(F.col("x_id").alias("number"), F.col("y_ord").alias("uuid"), "how")


def _x_addresses(spark: SparkSession, d: str) -> DataFrame:
    return ranges.harmonise_streets(table(spark, d, "x").groupBy("x_id").agg(F.min(F.struct(*text.FLAT)).alias("a")).select("x_id", "a.*").na.fill("", text.FLAT))


def _nad_addresses(spark: SparkSession, d: str) -> DataFrame:
    return points.read_points(table(spark, d, "nad")).where("place_zipcode <> ''").withColumn("y_ord", F.col("uuid"))


def staged_match(spark: SparkSession, d: str) -> DataFrame:
    return match.match_addresses(_x_addresses(spark, d), _nad_addresses(spark, d)).withColumn("stage", match.match_stage()).select("x_id", "stage", "street_name", "place_zipcode", F.col("y_ord").alias("uuid"))


def match_stage_counts(spark: SparkSession, d: str) -> DataFrame:
    return staged_match(spark, d).groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


def left_join_expand(spark: SparkSession, d: str) -> DataFrame:
    y = _nad_addresses(spark, d)
    out = match.address_left_join(_x_addresses(spark, d), y, "x_id", "y_ord")
    return out.groupBy("x_id").agg(F.count("uuid").alias("n_found"))


def fuzzy_left_join(spark: SparkSession, d: str) -> DataFrame:
    out = fuzzy.fuzzy_left_join(_x_addresses(spark, d), _nad_addresses(spark, d), "x_id", "uuid")
    return out.select("x_id", F.col("y_id").alias("uuid"))


def fuzzy_multi_field(spark: SparkSession, d: str) -> DataFrame:
    out = fuzzy.fuzzy_match_address(_x_addresses(spark, d), _nad_addresses(spark, d), "x_id", "uuid")
    return out.select("x_id", F.col("y_id").alias("uuid"))


def index_summary(spark: SparkSession, d: str) -> DataFrame:
    return match.AddressIndex(_nad_addresses(spark, d), "y_ord").summary()


def explain_match(spark: SparkSession, d: str) -> DataFrame:
    return diagnose.explain_match(_x_addresses(spark, d), _nad_addresses(spark, d))


def stage_table(spark: SparkSession, d: str) -> DataFrame:
    return diagnose.stage_table(_x_addresses(spark, d), _nad_addresses(spark, d))


# ---------------------------------------------------------------- sources


def address_points(spark: SparkSession, d: str) -> DataFrame:
    return points.read_points(table(spark, d, "nad")).groupBy(*text.FLAT, "uuid").agg(F.max("date_update").alias("date_update"), F.count(F.lit(1)).alias("n"))


def _features(spark: SparkSession, d: str) -> DataFrame:
    """Features with a left and a right side, put together from the ranges."""
    t = table(spark, d, "taf")
    side = lambda s, c: t.where(f"side = '{s}'").groupBy("linearid", "geometry_wkt").agg(F.min(F.struct("taf_id", "fullname", "zip", "fromhn", "tohn", "parity", "offset_flag")).alias(c))
    j = side("L", "l").join(side("R", "r"), ["linearid", "geometry_wkt"], "full")
    return j.select("linearid", F.coalesce("l.fullname", "r.fullname").alias("fullname"), F.col("l.zip").alias("zipl"), F.col("r.zip").alias("zipr"), F.col("l.fromhn").alias("lfromhn"), F.col("l.tohn").alias("ltohn"), F.col("r.fromhn").alias("rfromhn"), F.col("r.tohn").alias("rtohn"), F.col("l.parity").alias("parityl"), F.col("r.parity").alias("parityr"), F.col("l.offset_flag").alias("offsetl"), F.col("r.offset_flag").alias("offsetr"), "geometry_wkt")


def side_unpivot(spark: SparkSession, d: str) -> DataFrame:
    return ranges.unpivot_sides(_features(spark, d))


def feature_name_filter(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "taf")
    # taf holds roads by their primary names only; the filter itself is tested on rows of other kinds
    names = t.select("linearid", "fullname", F.lit("S1400").alias("mtfcc"), F.lit("P").alias("paflag"), F.nullif("street_predirectional", F.lit("")).alias("predirabrv"), F.col("street_premodifier").alias("prequalabr"), F.col("street_pretype").alias("pretypabrv"), F.col("street_name").alias("name"), F.col("street_posttype").alias("suftypabrv"), F.col("street_postdirectional").alias("sufdirabrv"))
    return ranges.feature_names(names)


def range_install(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "ranges")
    ranges.install_ranges(table(spark, d, "taf").drop("taf_id", "file_id"), path)
    return ranges.read_ranges(spark, path)


def range_zip(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "ranges")
    ranges.install_ranges(table(spark, d, "taf").drop("taf_id", "file_id"), path)
    return ranges.read_ranges(spark, path, ["39960", "05816"]).select("linearid", "zip", "side", "fromhn", "tohn")


def county_install(spark: SparkSession, d: str) -> DataFrame:
    """Every county from its features and names to installed ranges, and all of them once more."""
    path = shared_path(spark, "ranges")
    f = _features(spark, d).withColumns({c: F.col(c).cast("string") for c in ("lfromhn", "ltohn", "rfromhn", "rtohn")})
    t = table(spark, d, "taf").where("not street_tag_parsed")
    names = t.select("linearid", "fullname", F.lit("S1400").alias("mtfcc"), F.lit("P").alias("paflag"), F.col("street_predirectional").alias("predirabrv"), F.col("street_premodifier").alias("prequalabr"), F.col("street_pretype").alias("pretypabrv"), F.col("street_name").alias("name"), F.col("street_posttype").alias("suftypabrv"), F.col("street_postdirectional").alias("sufdirabrv"))
    for _ in range(2):
        ranges.install_county(f, names, "39000", path)
    return ranges.read_ranges(spark, path).where("not street_tag_parsed").drop("street_tag_parsed", "fullname")


def catalog_rows(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "catalog")
    ranges.write_catalog(ranges.manifest(table(spark, d, "taf")), path)
    return ranges.catalog_rows(ranges.read_catalog(spark, path))


def manifest_counts(spark: SparkSession, d: str) -> DataFrame:
    return ranges.manifest(table(spark, d, "taf"))


def needed_counties(spark: SparkSession, d: str) -> DataFrame:
    return ranges.needed_counties(table(spark, d, "x"), "place_zipcode", ranges.manifest(table(spark, d, "taf")))


def missing_counties(spark: SparkSession, d: str) -> DataFrame:
    catalog = ranges.manifest(table(spark, d, "taf"))
    needed = ranges.needed_counties(table(spark, d, "x"), "place_zipcode", catalog)
    return ranges.missing_counties(needed, catalog.where("n_ranges > 40"))


def top_streets(spark: SparkSession, d: str) -> DataFrame:
    return ranges.street_type_counts(table(spark, d, "taf"))


# ---------------------------------------------------------------- geocoding


def _numbered(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nad").where("add_number is not null and length(zip_code) = 5").select("uuid", "zip_code", "add_number", text.format_parts(dicts.map_direction(F.col("st_predir")), F.col("st_premod"), F.col("st_pretyp"), F.col("st_name"), dicts.map_post_type(F.col("st_postyp")), dicts.map_direction(F.col("st_posdir"))).alias("street")).distinct()


def range_pick(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "taf").select(F.col("taf_id").alias("ord"), "zip", text.format_parts(*(F.col(c) for c in STREET)).alias("street"), "fromhn", "tohn", "side", "parity", "offset_flag", "geometry_wkt")
    return geocode.pick_ranges(_numbered(spark, d).select(F.col("uuid").alias("id"), F.col("zip_code").alias("zip"), "street", F.col("add_number").alias("n")), t).select(F.col("id").alias("uuid"), "fromhn", "tohn", "side", "offset_flag", "geometry_wkt")


def range_fractions(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "taf")
    f = geo.range_fraction(F.expr("(fromhn + tohn) div 2 + 1"), F.col("fromhn"), F.col("tohn"))
    return t.select("taf_id", F.round(f, 6).alias("fraction"))


def line_bearing(spark: SparkSession, d: str) -> DataFrame:
    line = geo.parse_line(F.col("geometry_wkt"))
    t = table(spark, d, "taf").select("taf_id", F.get(line, F.lit(0)).alias("a"), F.get(line, F.lit(1)).alias("b"))
    return t.select("taf_id", F.round(geo.bearing(F.col("a.lon"), F.col("a.lat"), F.col("b.lon"), F.col("b.lat")), 4).alias("bearing"))


def offset_points(spark: SparkSession, d: str) -> DataFrame:
    """The first point of each line, 10 m to the side of its first piece."""
    line = geo.parse_line(F.col("geometry_wkt"))
    t = table(spark, d, "taf").select("taf_id", "side", F.get(line, F.lit(0)).alias("a"), F.get(line, F.lit(1)).alias("b"))
    turn = geo.bearing(F.col("a.lon"), F.col("a.lat"), F.col("b.lon"), F.col("b.lat"))
    p = geo.offset_point(F.col("a.lon"), F.col("a.lat"), turn, F.col("side"), F.lit(10.0))
    return t.withColumn("p", p).select("taf_id", F.round("p.lon", 6).alias("lon"), F.round("p.lat", 6).alias("lat"))


def interpolate(spark: SparkSession, d: str) -> DataFrame:
    """The point at three tenths of each line, and the direction there."""
    t = table(spark, d, "taf").select("taf_id", geo.along(geo.parse_line(F.col("geometry_wkt")), F.lit(0.3)).alias("p"))
    return t.select("taf_id", F.round("p.lon", 6).alias("lon"), F.round("p.lat", 6).alias("lat"), F.round("p.bearing", 3).alias("bearing"))


def geocode_points(spark: SparkSession, d: str) -> DataFrame:
    g = geocode.geocode(_x_addresses(spark, d), ranges.harmonise_streets(table(spark, d, "taf"))).withColumn("p", parse_point("matched_geography"))
    return g.select("x_id", "geocode_stage", "matched_zipcode", text.format_parts(*(F.col(f"matched_{c}") for c in STREET)).alias("matched_street"), F.col("p.lon").alias("lon"), F.col("p.lat").alias("lat"))


def geocode_stage(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "geocode").join(table(spark, d, "x").groupBy("x_id").agg(F.min("place_zipcode").alias("zip")), "x_id", "left")
    stage = geocode.geocode_stage(F.col("zip"), F.col("matched_zipcode"), F.col("matched_street"), F.when(~F.col("matched_geography").rlike("(?i)empty"), F.col("matched_geography")))
    return g.groupBy(stage.alias("stage")).agg(F.count(F.lit(1)).alias("n"), F.first(geocode.stage_rank(stage)).alias("rank"))


def geocode_table(spark: SparkSession, d: str) -> DataFrame:
    """The texts of addresses, as the command line geocodes them."""
    return cli.geocode_table(table(spark, d, "geocode").select("addr").where("addr is not null").distinct(), table(spark, d, "taf"), "addr")


def uncovered_zips(spark: SparkSession, d: str) -> DataFrame:
    return geocode.uncovered_zips(table(spark, d, "x"), "place_zipcode", table(spark, d, "taf"))


def point_cells(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nad").select("uuid", "latitude", "longitude").distinct().select("uuid", cells.cell(F.col("longitude"), F.col("latitude")).alias("cell"))


# ---------------------------------------------------------------- tagging


def tag_tokens(spark: SparkSession, d: str) -> DataFrame:
    return tagger.explain_tags(table(spark, d, "geocode"), "addr")


def parse_text(spark: SparkSession, d: str) -> DataFrame:
    return tagger.parse_addresses(table(spark, d, "geocode").select("geocode_id", "addr").distinct(), "addr")


def dedup_restore(spark: SparkSession, d: str) -> DataFrame:
    """Every address with the number of records that share its text."""
    x = table(spark, d, "x").select("x_id", text.format_address().alias("address"))
    return x.join(x.groupBy("address").agg(F.count_distinct("x_id").alias("n_records")), "address").distinct()


QUERIES = {
    f.__name__: f
    for f in (clean_text, format_address, unique_by_text, missing_records, digit_repair, zip_repair, house_number_int, street_type_map, direction_map, pre_type_map, state_map, unmapped_types, ordinal_map, soundex_key, street_key, ordinal_neighbors, zip_variants, zip_choice, county_lookup, flat_coerce, fuzzy_match_names, fuzzy_field, number_match, staged_match, match_stage_counts, left_join_expand, fuzzy_left_join, fuzzy_multi_field, index_summary, explain_match, stage_table, address_points, side_unpivot, feature_name_filter, range_install, range_zip, county_install, catalog_rows, manifest_counts, needed_counties, missing_counties, top_streets, range_pick, range_fractions, line_bearing, offset_points, interpolate, geocode_points, geocode_stage, geocode_table, uncovered_zips, point_cells, tag_tokens, parse_text, dedup_restore)
} | {name: _street_query(*how) for name, how in STREET_MATCHES.items()}

# ---------------------------------------------------------------- SQL

_TRIM = r"regexp_replace({c}, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')"


def _trimmed(c: str) -> str:
    return _TRIM.format(c=c)


def _mapped(c: str, kind: str) -> str:
    """A word through a dictionary, as a scalar expression over a map."""
    words = dicts.dictionary(kind)
    q = lambda s: "'" + s.replace("'", "''") + "'"
    pairs = ", ".join(f"{q(k)}: {q(v)}" for k, v in words.items())
    return f"coalesce(MAP {{{pairs}}}[lower({_trimmed(c)})], {_trimmed(c)})"


def _parts(*columns: str) -> str:
    return "trim(regexp_replace(concat_ws(' ', " + ", ".join(f"nullif({c}, '')" for c in columns) + "), ' +', ' ', 'g'))"


_NUMBER_TEXT = "trim(regexp_replace(concat_ws('', nullif(number_prefix, ''), nullif(number_digits, ''), nullif(number_suffix, '')), ' +', ' ', 'g'))"
_ADDRESS = "trim(regexp_replace(concat_ws(' ', nullif(" + _NUMBER_TEXT + ", ''), " + ", ".join(f"nullif({c}, '')" for c in [*STREET, *text.PLACE]) + "), ' +', ' ', 'g'))"
_VALID = "(coalesce({c}, '') <> '' AND regexp_full_match({c}, '[0-9]{{5}}') AND {c} NOT LIKE '000%')"


def _valid(c: str) -> str:
    return _VALID.format(c=c)


_ORDINAL_WORDS = ", ".join(f"('{w}', {n})" for w, n in phonetic.word_ordinals().items())
_END = "CASE WHEN n % 100 BETWEEN 11 AND 13 THEN 'TH' WHEN n % 10 = 1 THEN 'ST' WHEN n % 10 = 2 THEN 'ND' WHEN n % 10 = 3 THEN 'RD' ELSE 'TH' END"


def _ordinals(source: str, c: str) -> str:
    """Names of ``source`` with their mapped form."""
    return f"""WITH words(w, n) AS (VALUES {_ORDINAL_WORDS}), names AS (SELECT DISTINCT {c} AS street_name FROM {source}),
      plain AS (SELECT street_name, trim(regexp_replace(regexp_replace(replace(upper(street_name), '-', ' '), '[^A-Z ]', '', 'g'), ' +', ' ', 'g')) AS w FROM names),
      mapped AS (SELECT street_name, CASE WHEN regexp_full_match(lower(trim(street_name)), '[0-9]+(st|nd|rd|th)') THEN upper(trim(street_name)) WHEN n IS NOT NULL THEN n || {_END} ELSE street_name END AS mapped FROM plain LEFT JOIN words USING (w))"""


_soundex = match_sql.soundex


_VARIANTS = f"""WITH z AS (SELECT DISTINCT place_zipcode AS s FROM x WHERE {_valid("place_zipcode")}),
  raw AS (SELECT s, 'exact' AS v, s AS zip FROM z
    UNION ALL SELECT s, 'minus1', lpad(CAST(CAST(s AS INT) - 1 AS VARCHAR), 5, '0') FROM z
    UNION ALL SELECT s, 'plus1', CASE WHEN s = '99999' THEN '100000' ELSE lpad(CAST(CAST(s AS INT) + 1 AS VARCHAR), 5, '0') END FROM z
    UNION ALL SELECT s, 'sub5', substr(s, 1, 4) || d FROM z, range(10) t(d)
    UNION ALL SELECT s, 'sub4', substr(s, 1, 3) || d || substr(s, 5, 1) FROM z, range(10) t(d)
    UNION ALL SELECT s, 'swap', substr(s, 1, 1) || substr(s, 3, 1) || substr(s, 2, 1) || substr(s, 4, 2) FROM z),
  variants AS (SELECT s AS source_zip, v AS source_zip_variant, zip FROM raw WHERE {_valid("zip")} AND (v = 'exact' OR zip <> s))"""

_X_STREETS = f"""xs AS (SELECT DISTINCT place_zipcode AS zip, {_mapped("coalesce(street_predirectional, '')", "direction")} AS street_predirectional, coalesce(street_premodifier, '') AS street_premodifier, {_mapped("coalesce(street_pretype, '')", "pre_type")} AS street_pretype,
    mo.mapped AS street_name, {_mapped("coalesce(street_posttype, '')", "post_type")} AS street_posttype, {_mapped("coalesce(street_postdirectional, '')", "direction")} AS street_postdirectional FROM x JOIN mapped mo ON mo.street_name = coalesce(x.street_name, '') WHERE place_zipcode IS NOT NULL),
  xk AS (SELECT *, concat_ws('|', zip, {_S}) AS street FROM xs WHERE street_name <> ''),
  ts AS (SELECT zip, {", ".join("mo.mapped AS street_name" if c == "street_name" else c for c in STREET)}, taf_id AS y_ord FROM taf JOIN mapped mo ON mo.street_name = taf.street_name WHERE zip IS NOT NULL)"""
_PLAIN_NAMES = _ordinals("(SELECT coalesce(street_name, '') AS n0 FROM x UNION SELECT street_name FROM taf)", "n0")


def _street_sql(types: str, directions: str, fuzz: float, phon: float) -> str:
    same = " AND ".join(f"xk.{c} = f.{c}" for c in ("zip", *STREET))
    return f"{_PLAIN_NAMES}, {_X_STREETS}, {match_sql.NEIGHBORS}, {match_sql.streets('xk', 'ts', types, directions, phon, fuzz)} SELECT street, y_ord AS taf_id, how FROM xk JOIN s_found f ON {same}"


_FLAT_X = ", ".join(f"coalesce({c}, '') AS {c}" for c in text.FLAT)
_POINTS = f"""pts AS (SELECT coalesce(addnum_pre, '') AS number_prefix, coalesce(CAST(add_number AS VARCHAR), '') AS number_digits, coalesce(addnum_suf, '') AS number_suffix, {_mapped("coalesce(st_predir, '')", "direction")} AS street_predirectional, coalesce(st_premod, '') AS street_premodifier,
    {_mapped("coalesce(st_pretyp, '')", "pre_type")} AS street_pretype, mp.mapped AS street_name, {_mapped("coalesce(st_postyp, '')", "post_type")} AS street_posttype, {_mapped("coalesce(st_posdir, '')", "direction")} AS street_postdirectional,
    coalesce(post_city, '') AS place_name, coalesce(state, '') AS place_state, coalesce(zip_code, '') AS place_zipcode, uuid, CAST(dateupdate AS DATE) AS date_update FROM nad JOIN mapped mp ON mp.street_name = coalesce(st_name, '') WHERE zip_code IS NULL OR length(zip_code) = 5)"""
_NAD_NAMES = _ordinals("(SELECT coalesce(st_name, '') AS n0 FROM nad UNION SELECT coalesce(street_name, '') FROM x)", "n0")
_X_ADDRESSES = f"""first AS (SELECT x_id, min(ROW({", ".join(text.FLAT)})) AS a FROM x GROUP BY x_id)"""

SQL = {
    "clean_text": r"SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[^\p{L}\p{N}# -]', '', 'g'), ' +', ' ', 'g')) AS cleaned FROM documents",
    "format_address": f"SELECT x_id, {_ADDRESS} AS address FROM x",
    "unique_by_text": f"SELECT min(x_id) AS x_id, address FROM (SELECT x_id, {_ADDRESS} AS address FROM x) t GROUP BY address",
    "missing_records": f"SELECT source, ({' OR '.join(f'{c} IS NULL' for c in text.FLAT)}) AS missing, count(*) AS n FROM x GROUP BY ALL",
    "digit_repair": "WITH h AS (SELECT DISTINCT house_no, regexp_replace(house_no, '[^0-9]', '', 'g') AS d FROM sites) SELECT house_no, CASE WHEN TRY_CAST(d AS DOUBLE) > 999999 THEN substr(d, 1, 6) ELSE d END AS digits, (house_no IS NULL OR house_no = '' OR (regexp_full_match(house_no, '[0-9]+') AND TRY_CAST(house_no AS DOUBLE) <= 999999)) AS valid FROM h",
    "zip_repair": f"WITH z AS (SELECT DISTINCT place_zipcode, CASE WHEN length(place_zipcode) > 5 THEN substr(place_zipcode, 1, 5) ELSE place_zipcode END AS c FROM x) SELECT place_zipcode, CASE WHEN {_valid('c')} OR c = '' THEN c END AS repaired, {_valid('place_zipcode')} AS valid FROM z",
    "house_number_int": "SELECT DISTINCT house_no, CAST(trunc(TRY_CAST(regexp_replace(house_no, '[^0-9.-]', '', 'g') AS DOUBLE)) AS INT) AS n FROM sites",
    "street_type_map": f"SELECT street_posttype, {_mapped('street_posttype', 'post_type')} AS mapped, count(*) AS n FROM x GROUP BY street_posttype",
    "direction_map": f"SELECT street_predirectional, {_mapped('street_predirectional', 'direction')} AS mapped, count(*) AS n FROM x GROUP BY street_predirectional",
    "pre_type_map": f"SELECT street_pretype, {_mapped('street_pretype', 'pre_type')} AS mapped, count(*) AS n FROM x GROUP BY street_pretype",
    "state_map": f"WITH words(w, s) AS (VALUES {dicts.values_sql(dicts.dictionary('state'))}), v AS (SELECT n_name FROM nation UNION ALL SELECT DISTINCT place_state FROM x) SELECT n_name, CASE WHEN trim(n_name) = '' THEN '' ELSE s END AS mapped FROM v LEFT JOIN words ON lower(trim(n_name)) = w",
    "unmapped_types": f"WITH words(w, s) AS (VALUES {dicts.values_sql(dicts.dictionary('post_type'))}), v AS (SELECT {_trimmed('posttype')} AS word FROM intake) SELECT word, count(*) AS n FROM v WHERE word <> '' AND lower(word) NOT IN (SELECT w FROM words) GROUP BY word",
    "ordinal_map": f"{_ordinals('x', 'street_name')} SELECT street_name, mapped FROM mapped",
    "soundex_key": f"WITH n AS (SELECT DISTINCT street_name FROM x) SELECT street_name, {_soundex('street_name')} AS key FROM n",
    "street_key": f"{_ordinals('x', 'street_name')} SELECT street_name, CASE WHEN regexp_full_match(lower(mapped), '[0-9]+(st|nd|rd|th)') THEN '#' || lpad(CAST(CAST(regexp_extract(mapped, '^[0-9]+') AS INT) AS VARCHAR), 4, '0') ELSE {_soundex('mapped')} END AS key FROM mapped",
    "ordinal_neighbors": """WITH k AS (SELECT CAST(i AS VARCHAR) AS sig, '#' || lpad(CAST(i AS VARCHAR), 4, '0') AS key FROM range(1, 10000) t(i)),
      shifted AS (SELECT key, '#' || rpad(lpad(sig, CAST(length(sig) + p AS INT), '0'), 4, '0') AS neighbor FROM k, range(4) t(p) WHERE length(sig) + p <= 4),
      changed AS (SELECT key, '#' || lpad(substr(sig, 1, CAST(p - 1 AS INT)) || d || substr(sig, CAST(p + 1 AS INT)), 4, '0') AS neighbor FROM k, range(1, 5) t(p), range(10) u(d) WHERE p <= length(sig) AND NOT (p = 1 AND d = 0))
      SELECT DISTINCT key, neighbor FROM (SELECT * FROM shifted UNION ALL SELECT * FROM changed) q WHERE neighbor <> key""",
    "zip_variants": f"{_VARIANTS} SELECT DISTINCT source_zip, source_zip_variant, zip FROM variants",
    "zip_choice": f"""{_VARIANTS}, y AS (SELECT DISTINCT zip_code AS zip FROM nad WHERE {_valid('zip_code')}),
      d AS (SELECT DISTINCT source_zip, zip FROM variants JOIN y USING (zip)),
      r AS (SELECT source_zip, zip, row_number() OVER (PARTITION BY source_zip ORDER BY CASE WHEN zip = source_zip THEN 0 ELSE 1 END, abs(CAST(source_zip AS INT) - CAST(zip AS INT)), damerau_levenshtein(source_zip, zip), CAST(zip AS INT)) AS k FROM d) SELECT source_zip, zip FROM r WHERE k = 1""",
    "fuzzy_match_names": """WITH p AS (SELECT i.name AS entry, c.canon_id, damerau_levenshtein(translate(lower(i.name), 'é', '~'), lower(c.canonical)) AS dist FROM (SELECT DISTINCT name FROM intake WHERE name IS NOT NULL) i JOIN canon c ON c.field = 'name' AND abs(length(i.name) - length(c.canonical)) <= 1)
      SELECT entry, canon_id, CAST(dist AS INT) AS dist FROM (SELECT *, min(dist) OVER (PARTITION BY entry) AS m FROM p WHERE dist <= 1) q WHERE dist = m""",
    "fuzzy_field": """WITH p AS (SELECT g.place_zipcode AS given, t.zip, damerau_levenshtein(lower(g.place_zipcode), t.zip) AS dist FROM (SELECT DISTINCT place_zipcode FROM x WHERE place_zipcode <> '') g JOIN (SELECT DISTINCT zip FROM taf WHERE zip IS NOT NULL) t ON abs(length(place_zipcode) - length(zip)) <= 1)
      SELECT given, zip, CAST(dist AS INT) AS dist FROM (SELECT *, min(dist) OVER (PARTITION BY given) AS m FROM p WHERE dist <= 1) q WHERE dist = m""",
    "number_match": f"""WITH xs AS (SELECT DISTINCT place_zipcode AS zip, coalesce(number_prefix, '') AS number_prefix, coalesce(number_digits, '') AS number_digits, coalesce(number_suffix, '') AS number_suffix FROM x WHERE place_zipcode IS NOT NULL),
      xn AS (SELECT *, zip || '|' || number_prefix || '|' || number_digits || '|' || number_suffix AS number, lower({_NUMBER_TEXT}) AS t, CAST(number_digits AS INT) AS n FROM xs WHERE number_digits <> ''),
      ya AS (SELECT zip_code AS zip, lower(CAST(add_number AS VARCHAR) || coalesce(addnum_suf, '')) AS t, add_number AS n, uuid FROM nad WHERE zip_code IS NOT NULL AND add_number IS NOT NULL),
      ys AS (SELECT zip, t, min(uuid) AS uuid, arg_min(n, uuid) AS n FROM ya GROUP BY zip, t),
      hits AS (SELECT number, uuid, 0 AS gap, 0 AS dist, 'exact' AS how FROM xn JOIN ys USING (zip, t) UNION ALL SELECT number, uuid, abs(xn.n - ys.n), 1, 'fuzzy' FROM xn JOIN ys ON xn.zip = ys.zip AND xn.t <> ys.t AND abs(length(xn.t) - length(ys.t)) <= 1 AND damerau_levenshtein(xn.t, ys.t) = 1),
      r AS (SELECT *, row_number() OVER (PARTITION BY number ORDER BY CASE how WHEN 'exact' THEN 0 ELSE 1 END, gap, dist, uuid) AS k FROM hits) SELECT number, uuid, how FROM r WHERE k = 1""",
    "index_summary": f"""{_NAD_NAMES}, {_POINTS} SELECT place_zipcode, count(DISTINCT {_ADDRESS}) AS n_addresses, count(DISTINCT ({_S})) AS n_streets FROM pts WHERE place_zipcode <> '' GROUP BY place_zipcode""",
    "address_points": f"""{_NAD_NAMES}, {_POINTS} SELECT {", ".join(text.FLAT)}, uuid, max(date_update) AS date_update, count(*) AS n FROM pts GROUP BY {", ".join(text.FLAT)}, uuid""",
    "side_unpivot": """WITH s AS (SELECT linearid, geometry_wkt, side, min(ROW(taf_id, fullname, zip, fromhn, tohn, parity, offset_flag)) AS r FROM taf GROUP BY ALL), p AS (SELECT linearid, geometry_wkt, side, r[1] AS taf_id, r[2] AS fullname, r[3] AS zip, r[4] AS fromhn, r[5] AS tohn, r[6] AS parity, r[7] AS offset_flag FROM s),
      f AS (SELECT linearid, geometry_wkt, coalesce(max(fullname) FILTER (side = 'L'), max(fullname) FILTER (side = 'R')) AS fullname FROM p GROUP BY ALL)
      SELECT p.linearid, f.fullname, side, zip, fromhn, tohn, parity, offset_flag, p.geometry_wkt FROM p JOIN f ON p.linearid IS NOT DISTINCT FROM f.linearid AND p.geometry_wkt IS NOT DISTINCT FROM f.geometry_wkt WHERE p.linearid IS NOT NULL AND f.fullname IS NOT NULL AND zip IS NOT NULL AND fromhn IS NOT NULL AND tohn IS NOT NULL AND parity IS NOT NULL AND offset_flag IS NOT NULL AND p.geometry_wkt IS NOT NULL""",
    "feature_name_filter": """SELECT DISTINCT linearid, fullname, coalesce(street_predirectional, '') AS street_predirectional, coalesce(street_premodifier, '') AS street_premodifier, coalesce(street_pretype, '') AS street_pretype, coalesce(street_name, '') AS street_name, coalesce(street_posttype, '') AS street_posttype, coalesce(street_postdirectional, '') AS street_postdirectional FROM taf WHERE fullname IS NOT NULL""",
    "range_install": f"SELECT linearid, fullname, side, zip, fromhn, tohn, parity, offset_flag, geometry_wkt, {_S}, street_tag_parsed, county_fips, zip3, zip2 FROM taf",
    "range_zip": "SELECT linearid, zip, side, fromhn, tohn FROM taf WHERE (zip3 = '399' AND zip2 = '60') OR (zip3 = '058' AND zip2 = '16')",
    "manifest_counts": "SELECT county_fips, zip, zip3, zip2, count(*) AS n_ranges FROM taf WHERE zip IS NOT NULL GROUP BY ALL",
    "needed_counties": f"{_VARIANTS}, m AS (SELECT county_fips, zip, zip3, zip2, count(*) AS n_ranges FROM taf WHERE zip IS NOT NULL GROUP BY ALL) SELECT DISTINCT county_fips, m.zip, zip3, zip2, n_ranges, source_zip, source_zip_variant FROM variants JOIN m ON variants.zip = m.zip",
    "missing_counties": f"{_VARIANTS}, m AS (SELECT county_fips, zip, zip3, zip2, count(*) AS n_ranges FROM taf WHERE zip IS NOT NULL GROUP BY ALL) SELECT DISTINCT county_fips FROM variants JOIN m ON variants.zip = m.zip WHERE county_fips NOT IN (SELECT county_fips FROM m WHERE n_ranges > 40)",
    "top_streets": "SELECT street_name, street_posttype, count(DISTINCT zip) AS n_zips, count(*) AS n_ranges FROM taf GROUP BY ALL ORDER BY n_zips DESC, n_ranges DESC, street_name, street_posttype LIMIT 10",
    "range_pick": f"""WITH w AS (SELECT DISTINCT uuid, zip_code AS zip, add_number AS n, {_parts(_mapped("st_predir", "direction"), "st_premod", "st_pretyp", "st_name", _mapped("st_postyp", "post_type"), _mapped("st_posdir", "direction"))} AS street FROM nad WHERE add_number IS NOT NULL AND length(zip_code) = 5),
      t AS (SELECT *, {_parts(*STREET)} AS street FROM taf),
      c AS (SELECT w.uuid, t.*, row_number() OVER (PARTITION BY uuid ORDER BY abs(fromhn - tohn), abs(n - (fromhn + tohn) / 2.0), taf_id) AS k FROM w JOIN t USING (zip, street) WHERE n BETWEEN least(fromhn, tohn) AND greatest(fromhn, tohn) AND fromhn IS NOT NULL AND tohn IS NOT NULL AND (parity IS NULL OR parity = 'B' OR parity = CASE WHEN n % 2 = 0 THEN 'E' ELSE 'O' END))
      SELECT uuid, fromhn, tohn, side, offset_flag, geometry_wkt FROM c WHERE k = 1""",
    "range_fractions": "SELECT taf_id, round(CASE WHEN fromhn = tohn THEN 0.5 ELSE greatest(0, least(1, ((fromhn + tohn) // 2 + 1 - fromhn) / CAST(tohn - fromhn AS DOUBLE))) END, 6) AS fraction FROM taf WHERE fromhn IS NOT NULL AND tohn IS NOT NULL UNION ALL SELECT taf_id, NULL FROM taf WHERE fromhn IS NULL OR tohn IS NULL",
    "geocode_stage": """WITH z AS (SELECT x_id, min(place_zipcode) AS zip FROM x GROUP BY x_id), g AS (SELECT coalesce(matched_zipcode, '') <> '' AND coalesce(matched_street, '') <> '' AS street, coalesce(zip <> '' AND zip = matched_zipcode, false) AS same, matched_geography IS NOT NULL AND NOT regexp_matches(lower(matched_geography), 'empty') AS placed FROM geocode LEFT JOIN z USING (x_id)),
      s AS (SELECT CASE WHEN NOT street THEN 'none' WHEN placed AND same THEN 'range' WHEN placed THEN 'range_variant' WHEN same THEN 'street' ELSE 'street_variant' END AS stage FROM g)
      SELECT stage, count(*) AS n, CAST(CASE stage WHEN 'none' THEN 0 WHEN 'street_variant' THEN 1 WHEN 'street' THEN 2 WHEN 'range_variant' THEN 3 ELSE 4 END AS INT) AS rank FROM s GROUP BY stage""",
    "uncovered_zips": f"SELECT DISTINCT place_zipcode AS zip FROM x WHERE {_valid('place_zipcode')} AND place_zipcode NOT IN (SELECT zip FROM taf WHERE zip IS NOT NULL)",
    "dedup_restore": f"WITH a AS (SELECT x_id, {_ADDRESS} AS address FROM x), c AS (SELECT address, count(DISTINCT x_id) AS n_records FROM a GROUP BY address) SELECT DISTINCT x_id, address, n_records FROM a JOIN c USING (address)",
    "line_bearing": r"""WITH p AS (SELECT taf_id, string_split(regexp_extract(geometry_wkt, '\(([^()]*)\)', 1), ',') AS v FROM taf), q AS (SELECT taf_id, CAST(string_split(trim(v[1]), ' ')[1] AS DOUBLE) AS x1, CAST(string_split(trim(v[1]), ' ')[2] AS DOUBLE) AS y1, CAST(string_split(trim(v[2]), ' ')[1] AS DOUBLE) AS x2, CAST(string_split(trim(v[2]), ' ')[2] AS DOUBLE) AS y2 FROM p)
      SELECT taf_id, CASE WHEN x1 = x2 AND y1 = y2 THEN NULL ELSE round(fmod(degrees(atan2(sin(radians(x2 - x1)) * cos(radians(y2)), cos(radians(y1)) * sin(radians(y2)) - sin(radians(y1)) * cos(radians(y2)) * cos(radians(x2 - x1)))) + 360, 360), 4) END AS bearing FROM q""",
}
SQL |= {name: _street_sql(*how) for name, how in STREET_MATCHES.items()}

# addresses of x with NULL as empty, the first delivery of each; those of nad, one row for each text
_MATCH_SIDES = f"""{_NAD_NAMES}, {_POINTS}, xd AS (SELECT x_id, a.* FROM (SELECT x_id, min({{{", ".join(f"'{c}': {c}" for c in text.FLAT)}}}) AS a FROM x GROUP BY x_id) q),
  xa AS (SELECT x_id, {", ".join({"street_predirectional": _mapped("coalesce(street_predirectional, '')", "direction"), "street_postdirectional": _mapped("coalesce(street_postdirectional, '')", "direction"), "street_pretype": _mapped("coalesce(street_pretype, '')", "pre_type"), "street_posttype": _mapped("coalesce(street_posttype, '')", "post_type"), "street_name": "mo.mapped"}.get(c, f"coalesce(xd.{c}, '')") + f" AS {c}" for c in text.FLAT)} FROM xd JOIN mapped mo ON mo.street_name = coalesce(xd.street_name, '')),
  ya AS (SELECT uuid AS y_ord, {", ".join(text.FLAT)} FROM pts WHERE place_zipcode <> ''), yu AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY {_ADDRESS} ORDER BY y_ord) AS k FROM ya) q WHERE k = 1)"""
_CHOICES = f"""zc AS (SELECT DISTINCT place_zipcode AS s FROM xa WHERE {_valid("place_zipcode")}),
  zraw AS (SELECT s, s AS zip FROM zc UNION ALL SELECT s, lpad(CAST(CAST(s AS INT) - 1 AS VARCHAR), 5, '0') FROM zc UNION ALL SELECT s, CASE WHEN s = '99999' THEN '100000' ELSE lpad(CAST(CAST(s AS INT) + 1 AS VARCHAR), 5, '0') END FROM zc
    UNION ALL SELECT s, substr(s, 1, 4) || d FROM zc, range(10) t(d) UNION ALL SELECT s, substr(s, 1, 3) || d || substr(s, 5, 1) FROM zc, range(10) t(d) UNION ALL SELECT s, substr(s, 1, 1) || substr(s, 3, 1) || substr(s, 2, 1) || substr(s, 4, 2) FROM zc),
  choices AS (SELECT source_zip, zip FROM (SELECT s AS source_zip, zip, row_number() OVER (PARTITION BY s ORDER BY CASE WHEN zip = s THEN 0 ELSE 1 END, abs(CAST(s AS INT) - CAST(zip AS INT)), damerau_levenshtein(s, zip), CAST(zip AS INT)) AS k FROM (SELECT DISTINCT s, zip FROM zraw WHERE {_valid("zip")} AND zip IN (SELECT place_zipcode FROM yu)) q) w WHERE k = 1)"""
_MATCHED = f"{_MATCH_SIDES}, {_CHOICES}, {match_sql.staged('xa', 'yu', 'choices')}"
_EQUAL = " AND ".join(f"m.{c} = y.{c}" for c in text.FLAT)


def _fuzzy_sql(same: list[str], by: list[str]) -> str:
    """Pairs of ``xa`` and ``ya`` with equal fields (case does not count) and among the names, within ``by``, the nearest up to one edit."""
    keys = "".join(f"{c}, " for c in by)
    on = " AND ".join([*(f"a.{c} = b.{c}" for c in by), "abs(length(a.v) - length(b.v)) <= 1"])
    low = ", ".join(f"lower({c}) AS {c}" for c in same)
    return f"""{_MATCH_SIDES}, fx AS (SELECT x_id, {keys}lower(street_name) AS v, {low} FROM xa), fy AS (SELECT y_ord, {keys}lower(street_name) AS v, {low} FROM ya),
      near AS (SELECT * FROM (SELECT *, min(d) OVER (PARTITION BY {keys}xv) AS least FROM (SELECT {"".join(f"a.{c}, " for c in by)}a.v AS xv, b.v AS yv, damerau_levenshtein(a.v, b.v) AS d FROM (SELECT DISTINCT {keys}v FROM fx) a JOIN (SELECT DISTINCT {keys}v FROM fy) b ON {on}) q WHERE d <= 1) w WHERE d = least),
      pairs AS (SELECT DISTINCT fx.x_id, fy.y_ord AS uuid FROM fx JOIN near n ON n.xv = fx.v{"".join(f" AND n.{c} = fx.{c}" for c in by)} JOIN fy ON fy.v = n.yv{"".join(f" AND fy.{c} = n.{c}" for c in by)} AND {" AND ".join(f"fx.{c} = fy.{c}" for c in same)})"""


_OTHERS = [c for c in (*text.NUMBER, *STREET) if c != "street_name"]
SQL |= {
    "staged_match": f"{_MATCHED} SELECT x_id, {match_sql.STAGE} AS stage, street_name, place_zipcode, y_ord AS uuid FROM m",
    "match_stage_counts": f"{_MATCHED} SELECT {match_sql.STAGE} AS stage, count(*) AS n FROM m GROUP BY stage",
    "left_join_expand": f"{_MATCHED} SELECT m.x_id, count(y.y_ord) AS n_found FROM m LEFT JOIN ya y ON m.y_ord IS NOT NULL AND {_EQUAL} GROUP BY m.x_id",
    "fuzzy_left_join": f"{_fuzzy_sql(_OTHERS, ['place_zipcode'])} SELECT xa.x_id, p.uuid FROM xa LEFT JOIN pairs p ON p.x_id = xa.x_id",
    "fuzzy_multi_field": f"{_fuzzy_sql([*_OTHERS, *text.PLACE], [])} SELECT x_id, uuid FROM pairs",
}

_COUNTY_NAME = "trim(regexp_replace(regexp_replace(lower(trim({c})), '[.'']', '', 'g'), '[ ]+', ' ', 'g'))"
_rows = lambda rows: ", ".join("(" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in r) + ")" for r in rows)
_LOOKUP = f"""WITH ref(county_full, state, county_fips) AS (VALUES {_rows(COUNTIES)}), r AS (SELECT *, {_COUNTY_NAME.format(c="county_full")} AS fn, {_COUNTY_NAME.format(c="regexp_replace(county_full, ' (County|Parish|City and Borough|Census Area|Planning Region|Borough|Municipality|Municipio|city)$', '')")} AS sn FROM ref),
  asked AS (SELECT county, state, {_COUNTY_NAME.format(c="county")} AS n FROM (SELECT county, state FROM nad UNION SELECT * FROM (VALUES {_rows(ASKED)}) v(county, state)) q),
  hits AS (SELECT a.county, a.state, count(r.county_fips) FILTER (r.state = a.state AND fn = n) AS nf, max(county_fips) FILTER (r.state = a.state AND fn = n) AS f, count(*) FILTER (r.state = a.state AND sn = n) AS ns, max(county_fips) FILTER (r.state = a.state AND sn = n) AS s, max(county_fips) FILTER (county_fips = county) AS c, coalesce(regexp_full_match(county, '[0-9]{{5}}'), false) AS code FROM asked a LEFT JOIN r ON true GROUP BY ALL),
  best AS (SELECT *, CASE WHEN code THEN c WHEN nf = 1 THEN f WHEN ns = 1 THEN s END AS county_fips FROM hits)
  SELECT b.county, b.state, b.county_fips, ref.county_full, CASE WHEN b.county_fips IS NOT NULL THEN 'ok' WHEN NOT code AND ns > 1 THEN 'ambiguous' WHEN NOT code AND coalesce(b.state, '') = '' THEN 'unknown_state' ELSE 'not_found' END AS status FROM best b LEFT JOIN ref ON ref.county_fips = b.county_fips"""


def along_sql(source: str, p: str = "l") -> str:
    """CTEs up to ``{p}_at`` (``id, lon, lat, bearing``) for a relation of ``id, wkt, f``: the point at a part of a line."""
    hav = "2 * asin(least(1, sqrt(pow(sin((radians(by_) - radians(ay)) / 2), 2) + cos(radians(ay)) * cos(radians(by_)) * pow(sin((radians(bx) - radians(ax)) / 2), 2))))"
    xyz = lambda x, y: (f"cos(radians({y})) * cos(radians({x}))", f"cos(radians({y})) * sin(radians({x}))", f"sin(radians({y}))")
    mix = [f"(sin((1 - t) * d) / sin(d) * ({a}) + sin(t * d) / sin(d) * ({b}))" for a, b in zip(xyz("ax", "ay"), xyz("bx", "by_"))]
    turn = "fmod(degrees(atan2(sin(radians(bx - ax)) * cos(radians(by_)), cos(radians(ay)) * sin(radians(by_)) - sin(radians(ay)) * cos(radians(by_)) * cos(radians(bx - ax)))) + 360, 360)"
    return f"""{p}_v AS (SELECT id, f, string_split(regexp_extract(wkt, '[(]([^()]*)[)]', 1), ',') AS v FROM {source}), {p}_e AS (SELECT id, f, i, string_split(trim(v[i]), ' ') AS a, string_split(trim(v[i + 1]), ' ') AS b FROM (SELECT *, unnest(range(1, len(v))) AS i FROM {p}_v) q),
      {p}_c AS (SELECT id, f, i, CAST(a[1] AS DOUBLE) AS ax, CAST(a[2] AS DOUBLE) AS ay, CAST(b[1] AS DOUBLE) AS bx, CAST(b[2] AS DOUBLE) AS by_ FROM {p}_e), {p}_d AS (SELECT *, {hav} AS d FROM {p}_c), {p}_s AS (SELECT *, coalesce(sum(d) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, sum(d) OVER (PARTITION BY id) AS total FROM {p}_d),
      {p}_t AS (SELECT *, greatest(0, least(1, (f * total - start) / d)) AS t FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i DESC) AS k FROM {p}_s WHERE start <= f * total AND d > 0) q WHERE k = 1),
      {p}_p AS (SELECT id, {mix[0]} AS x, {mix[1]} AS y, {mix[2]} AS z, {turn} AS bearing FROM {p}_t),
      {p}_at AS (SELECT id, degrees(atan2(y, x)) AS lon, degrees(atan2(z, sqrt(x * x + y * y))) AS lat, bearing FROM {p}_p UNION ALL SELECT id, ax, ay, NULL FROM {p}_s s WHERE i = 1 AND f IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {p}_t t WHERE t.id = s.id))"""


def offset_sql(lon: str, lat: str, bearing: str, side: str, metres: str) -> tuple[str, str]:
    """Longitude and latitude of a point moved to the side."""
    turn = f"radians(CASE {side} WHEN 'L' THEN {bearing} - 90 WHEN 'R' THEN {bearing} + 90 END)"
    d, a = f"({metres} / {geo.RADIUS_M})", f"radians({lat})"
    y = f"asin(sin({a}) * cos({d}) + cos({a}) * sin({d}) * cos({turn}))"
    x = f"radians({lon}) + atan2(sin({turn}) * sin({d}) * cos({a}), cos({d}) - sin({a}) * sin({y}))"
    stay = f"{turn} IS NULL OR {metres} = 0"
    return f"CASE WHEN {stay} THEN {lon} ELSE fmod(degrees({x}) + 540, 360) - 180 END", f"CASE WHEN {stay} THEN {lat} ELSE degrees({y}) END"


_ENDS = r"""e AS (SELECT taf_id, side, CAST(string_split(trim(v[1]), ' ')[1] AS DOUBLE) AS x1, CAST(string_split(trim(v[1]), ' ')[2] AS DOUBLE) AS y1, CAST(string_split(trim(v[2]), ' ')[1] AS DOUBLE) AS x2, CAST(string_split(trim(v[2]), ' ')[2] AS DOUBLE) AS y2 FROM (SELECT taf_id, side, string_split(regexp_extract(geometry_wkt, '[(]([^()]*)[)]', 1), ',') AS v FROM taf) q),
  w AS (SELECT *, CASE WHEN x1 = x2 AND y1 = y2 THEN NULL ELSE fmod(degrees(atan2(sin(radians(x2 - x1)) * cos(radians(y2)), cos(radians(y1)) * sin(radians(y2)) - sin(radians(y1)) * cos(radians(y2)) * cos(radians(x2 - x1)))) + 360, 360) END AS turn FROM e)"""
_LON, _LAT = offset_sql("x1", "y1", "turn", "side", "10.0")
_G_LON, _G_LAT = offset_sql("a.lon", "a.lat", "a.bearing", "r.side", "CASE WHEN r.offset_flag = 'Y' THEN 0.0 ELSE 10.0 END")
_TAF_MAPPED = ", ".join({"street_predirectional": _mapped("coalesce(street_predirectional, '')", "direction"), "street_postdirectional": _mapped("coalesce(street_postdirectional, '')", "direction"), "street_pretype": _mapped("coalesce(street_pretype, '')", "pre_type"), "street_posttype": _mapped("coalesce(street_posttype, '')", "post_type"), "street_name": "mo.mapped"}.get(c, f"coalesce({c}, '')") + f" AS {c}" for c in STREET)
_ALL_NAMES = _ordinals("(SELECT coalesce(street_name, '') AS n0 FROM x UNION SELECT coalesce(street_name, '') FROM taf UNION SELECT coalesce(st_name, '') FROM nad)", "n0")
_SAME_STREET = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in STREET)
_RAW_ZIPS = """SELECT s, 1 AS rank, lpad(CAST(CAST(s AS INT) - 1 AS VARCHAR), 5, '0') AS zip FROM gz UNION ALL SELECT s, 2, CASE WHEN s = '99999' THEN '100000' ELSE lpad(CAST(CAST(s AS INT) + 1 AS VARCHAR), 5, '0') END FROM gz
    UNION ALL SELECT s, 3, substr(s, 1, 4) || d FROM gz, range(10) t(d) UNION ALL SELECT s, 4, substr(s, 1, 3) || d || substr(s, 5, 1) FROM gz, range(10) t(d) UNION ALL SELECT s, 5, substr(s, 1, 1) || substr(s, 3, 1) || substr(s, 2, 1) || substr(s, 4, 2) FROM gz"""
_GEOCODE = f"""{_MATCH_SIDES.replace(_NAD_NAMES, _ALL_NAMES)}, tr AS (SELECT taf_id, zip, fromhn, tohn, side, parity, offset_flag, geometry_wkt, {_TAF_MAPPED} FROM taf JOIN mapped mo ON mo.street_name = coalesce(taf.street_name, '') WHERE zip IS NOT NULL),
  gt AS (SELECT x_id, {_ADDRESS} AS text, * EXCLUDE (x_id) FROM xa), gd AS (SELECT text, a.* FROM (SELECT text, min({{{", ".join(f"'{c}': {c}" for c in ("place_zipcode", *STREET, "number_digits"))}}}) AS a FROM gt WHERE {_valid("place_zipcode")} GROUP BY text) q),
  gx AS (SELECT place_zipcode AS zip, {_S} FROM gd), gy AS (SELECT zip, {_S}, taf_id AS y_ord FROM tr), {match_sql.NEIGHBORS}, {match_sql.streets("gx", "gy", fuzzy=2)},
  own AS (SELECT gd.text, f.zip, f.y_ord FROM gd JOIN s_found f ON f.zip = gd.place_zipcode AND {_SAME_STREET("f", "gd")}), gl AS (SELECT * FROM gd WHERE text NOT IN (SELECT text FROM own)),
  gz AS (SELECT DISTINCT place_zipcode AS s FROM gl), ways AS (SELECT s, zip, min(rank) AS rank FROM ({_RAW_ZIPS}) q WHERE {_valid("zip")} AND zip <> s AND zip IN (SELECT zip FROM tr) GROUP BY s, zip),
  tried AS (SELECT gl.text, ways.rank, ways.zip, {", ".join("gl." + c for c in STREET)} FROM gl JOIN ways ON ways.s = gl.place_zipcode), {match_sql.streets("tried", "gy", fuzzy=2, p="v")},
  late AS (SELECT text, zip, y_ord FROM (SELECT t.text, f.zip, f.y_ord, row_number() OVER (PARTITION BY t.text ORDER BY t.rank, f.zip, f.y_ord) AS k FROM tried t JOIN v_found f ON f.zip = t.zip AND {_SAME_STREET("f", "t")}) q WHERE k = 1),
  found AS (SELECT f.text, f.zip, {", ".join("tr." + c for c in STREET)}, {_parts(*("tr." + c for c in STREET))} AS street FROM (SELECT * FROM own UNION ALL SELECT * FROM late) f JOIN tr ON tr.taf_id = f.y_ord AND tr.zip = f.zip GROUP BY ALL),
  wanted AS (SELECT f.text, f.zip, f.street, CAST(trunc(TRY_CAST(regexp_replace(gd.number_digits, '[^0-9.-]', '', 'g') AS DOUBLE)) AS INT) AS n FROM found f JOIN gd USING (text)),
  picked AS (SELECT * FROM (SELECT w.text AS id, w.n, r.fromhn, r.tohn, r.side, r.offset_flag, r.geometry_wkt AS wkt, row_number() OVER (PARTITION BY w.text ORDER BY abs(fromhn - tohn), abs(n - (fromhn + tohn) / 2.0), taf_id) AS k FROM wanted w JOIN (SELECT *, {_parts(*STREET)} AS street FROM tr) r ON r.zip = w.zip AND r.street = w.street
    WHERE n BETWEEN least(fromhn, tohn) AND greatest(fromhn, tohn) AND fromhn IS NOT NULL AND tohn IS NOT NULL AND (parity IS NULL OR parity = 'B' OR parity = CASE WHEN n % 2 = 0 THEN 'E' ELSE 'O' END)) q WHERE k = 1),
  lines AS (SELECT id, wkt, CASE WHEN fromhn = tohn THEN 0.5 ELSE greatest(0, least(1, (n - fromhn) / CAST(tohn - fromhn AS DOUBLE))) END AS f FROM picked), {along_sql("lines")},
  placed AS (SELECT a.id, round({_G_LON}, 7) AS lon, round({_G_LAT}, 7) AS lat FROM l_at a JOIN picked r ON r.id = a.id)
  SELECT gt.x_id, CASE WHEN f.text IS NULL OR f.street = '' THEN 'none' WHEN p.lon IS NOT NULL AND gt.place_zipcode = f.zip THEN 'range' WHEN p.lon IS NOT NULL THEN 'range_variant' WHEN gt.place_zipcode = f.zip THEN 'street' ELSE 'street_variant' END AS geocode_stage, f.zip AS matched_zipcode, coalesce(f.street, '') AS matched_street, p.lon, p.lat
  FROM gt LEFT JOIN found f ON f.text = gt.text LEFT JOIN placed p ON p.id = gt.text"""
_STREET_TEXT, _NUMBER_OF = (lambda t: _parts(*(f"{t}.{c}" for c in STREET))), (lambda t: "trim(regexp_replace(concat_ws('', " + ", ".join(f"nullif({t}.{c}, '')" for c in text.NUMBER) + "), ' +', ' ', 'g'))")
_WHOLE = lambda t: "trim(regexp_replace(concat_ws(' ', nullif(" + _NUMBER_OF(t) + ", ''), " + ", ".join(f"nullif({t}.{c}, '')" for c in [*STREET, *text.PLACE]) + "), ' +', ' ', 'g'))"
_STAGES = f"""{_MATCHED}, zp AS (SELECT place_zipcode AS zip, count(*) AS za, count(DISTINCT ({_S})) AS zs FROM yu GROUP BY place_zipcode), sp AS (SELECT place_zipcode AS zip, {_S}, count(*) AS sa, count(DISTINCT number_digits) AS sn FROM yu GROUP BY ALL),
  ms AS (SELECT *, {match_sql.STAGE} AS stage FROM m), d AS (SELECT m.*, zp.za, zp.zs, sp.sa, sp.sn FROM ms m LEFT JOIN zp ON zp.zip = m.place_zipcode LEFT JOIN sp ON sp.zip = m.place_zipcode AND {_SAME_STREET("sp", "m")})"""
_STEP = "CASE d.stage WHEN 'none' THEN 1 WHEN 'zip' THEN 2 WHEN 'street' THEN 3 ELSE 4 END"


def _status(need: int, same: str, other: str) -> str:
    return f"CASE WHEN {_STEP} < {need - 1} THEN 'skipped' WHEN {_STEP} < {need} THEN 'no match' WHEN {same} THEN 'exact' ELSE '{other}' END"


SQL |= {
    "county_lookup": _LOOKUP,
    "flat_coerce": f"{_ordinals('x', 'street_name')} SELECT x_id, '' AS number_prefix, CASE WHEN number_digits IS NULL OR number_digits = '' OR (regexp_full_match(number_digits, '[0-9]+') AND TRY_CAST(number_digits AS DOUBLE) <= 999999) THEN number_digits END AS number_digits, '' AS number_suffix, {_mapped('street_predirectional', 'direction')} AS street_predirectional, '' AS street_premodifier, '' AS street_pretype, mo.mapped AS street_name, {_mapped('street_posttype', 'post_type')} AS street_posttype, '' AS street_postdirectional, '' AS place_name, '' AS place_state, CASE WHEN place_zipcode IS NULL OR place_zipcode = '' OR {_valid('place_zipcode')} THEN place_zipcode END AS place_zipcode FROM x LEFT JOIN mapped mo ON mo.street_name IS NOT DISTINCT FROM x.street_name",
    "catalog_rows": "SELECT county_fips, zip, zip3, zip2, count(*) AS n_ranges FROM taf WHERE zip IS NOT NULL GROUP BY ALL",
    "offset_points": f"WITH {_ENDS} SELECT taf_id, round({_LON}, 6) AS lon, round({_LAT}, 6) AS lat FROM w",
    "interpolate": f"WITH src AS (SELECT taf_id AS id, geometry_wkt AS wkt, 0.3 AS f FROM taf), {along_sql('src')} SELECT taf.taf_id, round(lon, 6) AS lon, round(lat, 6) AS lat, round(bearing, 3) AS bearing FROM taf LEFT JOIN l_at ON l_at.id = taf.taf_id",
    "geocode_points": _GEOCODE,
    "explain_match": f"{_STAGES} SELECT x_id, stage, za AS zip_addresses, zs AS zip_streets, sn AS street_numbers FROM d",
    "stage_table": f"""{_STAGES} SELECT d.x_id, 1 AS position, 'zip' AS stage, {_status(2, "g.place_zipcode = d.place_zipcode", "variant")} AS status, g.place_zipcode AS input, coalesce(d.place_zipcode, '') AS matched, CAST(coalesce(za, 0) AS VARCHAR) AS candidates FROM d JOIN xa g USING (x_id)
      UNION ALL SELECT d.x_id, 2, 'street', {_status(3, f"{_STREET_TEXT('g')} = {_STREET_TEXT('d')}", "fuzzy_or_phonetic")}, {_STREET_TEXT("g")}, {_STREET_TEXT("d")}, CASE WHEN d.stage = 'none' THEN '0' ELSE coalesce(zs, 0) || ' streets / ' || coalesce(za, 0) || ' addresses' END FROM d JOIN xa g USING (x_id)
      UNION ALL SELECT d.x_id, 3, 'number', {_status(4, f"{_NUMBER_OF('g')} = {_NUMBER_OF('d')}", "fuzzy")}, {_NUMBER_OF("g")}, {_NUMBER_OF("d")}, CASE WHEN {_STEP} < 3 THEN '0' ELSE CAST(coalesce(sa, 0) AS VARCHAR) END FROM d JOIN xa g USING (x_id)
      UNION ALL SELECT d.x_id, 4, 'final', d.stage, {_WHOLE("g")}, {_WHOLE("d")}, CASE d.stage WHEN 'number' THEN '1 best match' WHEN 'street' THEN 'street-only result' WHEN 'zip' THEN 'zip-only result' ELSE 'no result' END FROM d JOIN xa g USING (x_id)""",
}
SQL["county_install"] = f"""WITH su AS ({SQL["side_unpivot"]}), nm AS (SELECT linearid, min({{{", ".join(f"'{c}': coalesce({c}, '')" for c in STREET)}}}) AS n FROM taf WHERE NOT street_tag_parsed AND fullname IS NOT NULL GROUP BY linearid)
  SELECT su.* EXCLUDE (fullname), n.*, '39000' AS county_fips, substr(zip, 1, 3) AS zip3, substr(zip, 4, 2) AS zip2 FROM su JOIN nm USING (linearid)"""
