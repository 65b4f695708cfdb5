import pytest
from pyspark.sql import functions as F

from cairn.functions import address, dicts, text
from cairn.functions.text import FLAT, STREET
from cairn.operators import counties
from cairn.sources import points, ranges

FEATURES = "linearid string, fullname string, zipl string, zipr string, lfromhn string, ltohn string, rfromhn string, rtohn string, parityl string, parityr string, offsetl string, offsetr string, geometry_wkt string"
NAMES = "linearid string, fullname string, mtfcc string, paflag string, predirabrv string, prequalabr string, pretypabrv string, name string, suftypabrv string, sufdirabrv string"
LINE = "LINESTRING (0 0, 0.01 0)"


def features(spark, *rows):
    return spark.createDataFrame([(i, n, zl, zr, "1", "99", "2", "98", "O", "E", "N", "N", LINE) for i, n, zl, zr in rows], FEATURES)


def names(spark, *rows):
    return spark.createDataFrame([(i, n, kind, flag, None, None, None, name, typ, None) for i, n, kind, flag, name, typ in rows], NAMES)


def test_a_county_from_features_to_ranges(spark, tmp_path):
    path = str(tmp_path / "ranges")
    streets = names(spark, ("a", "Main St", "S1400", "P", "Main", "St"), ("a", "Old Main St", "S1400", "A", "Old Main", "St"), ("b", "Creek", "H3010", "P", "Creek", None))
    first = ranges.install_county(features(spark, ("a", "Main St", "11111", "11112"), ("b", "N Oak Avenue", "11111", None)), streets, "39001", path)
    assert {tuple(r)[:5] for r in first.collect()} == {("39001", "11111", "111", "11", 2), ("39001", "11112", "111", "12", 1)}
    got = {(r["linearid"], r["side"]): r for r in ranges.read_ranges(spark, path).collect()}
    assert set(got) == {("a", "L"), ("a", "R"), ("b", "L")}
    # "b" has no name of a road: its whole name is parsed
    assert [got["b", "L"][c] for c in STREET] == ["N", "", "", "Oak", "Avenue", ""] and got["b", "L"]["street_tag_parsed"] and not got["a", "L"]["street_tag_parsed"]
    assert [r["street_posttype"] for r in ranges.read_ranges(spark, path, ["11111"], mapped=True).where("linearid = 'b'").collect()] == ["Ave"]
    ranges.install_county(features(spark, ("c", "Elm St", "22222", "22222")), streets, "39003", path)
    # the first county again, now without 11112
    ranges.install_county(features(spark, ("a", "Main St", "11111", "11111")), streets, "39001", path)
    assert {(r["county_fips"], r["zip"], r["n_ranges"]) for r in ranges.read_manifest(spark, path).collect()} == {("39001", "11111", 2), ("39003", "22222", 2)}
    assert {(r["county_fips"], r["zip"]) for r in ranges.read_ranges(spark, path).collect()} == {("39001", "11111"), ("39003", "22222")}
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"


def test_catalog_and_missing_counties(spark, tmp_path):
    path, at = str(tmp_path / "ranges"), str(tmp_path / "catalog")
    assert ranges.read_catalog(spark, at).count() == 0 and ranges.read_manifest(spark, path).count() == 0
    rows = [("39003", "22222", "222", "22", 2), ("39001", "11111", "111", "11", 2), ("39001", "11111", "111", "11", 2)]
    ranges.write_catalog(spark.createDataFrame(rows, ranges.CATALOG_SCHEMA), at)
    ranges.write_catalog(ranges.read_catalog(spark, at), at)
    catalog = ranges.read_catalog(spark, at)
    assert [tuple(r) for r in ranges.catalog_rows(catalog).collect()] == [rows[1], rows[0]]
    zips = spark.createDataFrame([("11112",), ("33333",), ("x",), (None,)], "z string")
    asked = []

    def install(county):
        asked.append(county)
        ranges.install_county(features(spark, ("a", "Main St", "11111", "11111")), names(spark), county, path)

    missing = ranges.ensure_counties(zips, "z", catalog, path, install)
    assert asked == ["39001"] and {(r["county_fips"], r["zip"], r["source_zip"], r["source_zip_variant"]) for r in missing.collect()} == {("39001", "11111", "11112", "minus1"), ("39001", "11111", "11112", "sub5")}
    assert ranges.ensure_counties(zips, "z", catalog, path, install).count() == 0 and asked == ["39001"]
    with pytest.raises(RuntimeError, match=r"1 counties are not installed: 39003. Affected ZIPs: 22222 \(exact from 22222\)"):
        ranges.ensure_counties(spark.createDataFrame([("22222",)], "z string"), "z", catalog, path, lambda county: None)


def test_feature_names_filter(spark):
    rows = names(spark, ("a", "Main St", "S1400", "P", "Main", "St"), ("a", "Main St", "S1400", "P", "Main", "St"), ("b", "Rail", "R1011", "P", "Rail", None), ("c", None, "S1400", "P", "x", None), ("d", "Alias", "S1400", "A", "Alias", None), ("e", "Lane", "S1640", "P", None, "Ln"))
    assert {(r["linearid"], r["street_name"]) for r in ranges.feature_names(rows).collect()} == {("a", "Main"), ("e", "")} and ranges.feature_names(rows).count() == 2


def test_points_by_state_and_county(spark):
    raw = "addnum_pre string, add_number int, addnum_suf string, st_predir string, st_premod string, st_pretyp string, st_name string, st_postyp string, st_posdir string, subaddress string, county string, post_city string, state string, zip_code string, uuid string, latitude double, longitude double, parcel_id string, dateupdate timestamp, natgrid string, placement string, addrclass string, addr_type string"
    row = lambda u, county, state, z: (None, 5, None, None, None, None, "Fifth", "Street", None, None, county, "Town", state, z, u, 39.0, -84.0, None, None, None, None, None, None)
    df = spark.createDataFrame([row("a", "Hamilton", "OH", "45220"), row("b", "Butler", "OH", "45011"), row("c", "Hamilton", "IN", None), row("d", "Hamilton", "OH", "4522")], raw)
    assert {r["uuid"] for r in points.read_points(df).collect()} == {"a", "b", "c"}
    assert [(r["uuid"], r["street_name"], r["street_posttype"]) for r in points.read_points(df, "Hamilton", "OH").collect()] == [("a", "5TH", "St")]


def test_flat_tables_become_addresses(spark):
    df = spark.createDataFrame([(1, 10, "fifth", "AVENUE", "ohio", "45220", "kept"), (2, None, "Main", "foofy", "", "", None), (3, 7, "x", "Avenue Circle", "Nowhere", None, "")], "id int, number_digits int, street_name string, street_posttype string, place_state string, place_zipcode string, note string")
    got = {r["id"]: r for r in address.as_address(df).collect()}
    assert [got[1][c] for c in FLAT] == ["", "10", "", "", "", "", "5TH", "Ave", "", "", "OH", "45220"] and got[1]["note"] == "kept"
    assert got[2]["number_digits"] is None and got[2]["street_posttype"] == "foofy" and got[2]["place_state"] == "" and got[3]["street_posttype"] == "Avenue Circle" and got[3]["place_state"] is None and got[3]["place_zipcode"] is None
    plain = address.as_address(df, map_states=False, map_posttype=False, map_ordinals=False).where("id = 1").first()
    assert (plain["street_name"], plain["street_posttype"], plain["place_state"]) == ("fifth", "AVENUE", "ohio")
    bad = spark.createDataFrame([("12a", "1234"), ("1000000", "00012"), ("", "")], "number_digits string, place_zipcode string")
    assert [(r["number_digits"], r["place_zipcode"]) for r in address.as_address(bad, strict=False).collect()] == [(None, None), (None, None), ("", "")]
    with pytest.raises(Exception, match="digits must be"):
        address.as_address(bad).collect()
    assert address.as_address(df.limit(0)).count() == 0


def test_constructors(spark):
    made = address.address(address.address_number(digits="10"), address.address_street(name=F.col("n"), posttype="lane", predirectional="North", map_ordinals=False), address.address_place(zipcode="45220", state="Ohio"))
    r = spark.createDataFrame([("Fifth",), ("Oak",)], "n string").select(made.alias("a")).select(*address.flatten("a")).collect()
    assert [x["street_name"] for x in r] == ["Fifth", "Oak"] and r[0]["street_predirectional"] == "N" and r[0]["street_posttype"] == "Ln" and r[0]["place_state"] == "OH" and r[0]["number_prefix"] is None
    with pytest.raises(Exception, match="five digits"):
        spark.range(1).select(address.address_place(zipcode="00012")).collect()


#: Postal abbreviations and names of the national schema, as published.
TYPES = {"Avenue": "Ave", "avnue": "Ave", "Blvrd": "Blvd", "lane": "Ln", "la": "Ln", "bl": "Blvd", "st": "St", "Riv ": "Riv", "woods": "Woods", "knls": "Knls", "ledge": "Ledge", "end": "End", "close": "Close", "cutoff": "Cutoff", "acres": "Acres", "taxiway": "Taxiway", "access road": "Access Road", "overlook": "Overlook", "esplanade": "Esplanade", "county road": "County Road", "bureau of indian affairs highway": "Bureau of Indian Affairs Highway", "street passway": "Street Passway", "way terrace": "Way Terrace", "dam": "Dam", "prairie": "Prairie", "passage": "Psge", "coves": "Cvs", "burgs": "Bgs", "cliffs": "Clfs", "commons": "Cmns", "crossroads": "Xrds", "islands": "Iss", "isles": "Isle", "mountains": "Mnts", "falls": "Fls", "fall": "Fall", "junctions": "Jcts", "springs": "Spgs", "valleys": "Vlys", "Woop": "Woop", "two words": "two words", "": ""}


def test_street_types(spark):
    got = spark.createDataFrame(list(TYPES.items()), "t string, want string").select("t", "want", dicts.map_post_type(F.col("t")).alias("got")).collect()
    assert [r["t"] for r in got if r["got"] != r["want"]] == []
    # no spelling stands for two types
    spelt: dict[str, set] = {}
    for line in dicts.POST_TYPES.strip().splitlines():
        head, _, rest = line.partition(":")
        for f in rest.split(","):
            if f.strip():
                spelt.setdefault(f.strip().lower(), set()).add(head)
    assert [f for f, h in spelt.items() if len(h) > 1] == []


def test_counties(spark):
    raw = spark.createDataFrame([("Hamilton County, OH", "39061"), ("Hamilton County, OH", "39061"), ("Orleans Parish, LA", "22071"), ("St. Louis County, MO", "29189"), ("St. Louis city, MO", "29510"), ("Juneau City and Borough, AK", "2110"), (None, "1")], "name string, geoid string")
    ref = counties.county_reference(raw)
    asked = spark.createDataFrame([("Hamilton", "OH"), ("hamilton county", "Ohio"), ("39061", None), ("Orleans", "LA"), ("St. Louis", "MO"), ("St Louis City", "MO"), ("Juneau", "Alaska"), ("Not A County", "OH"), ("99999", "OH"), ("Hamilton", "Atlantis"), (None, "OH")], "county string, state string")
    got = {(r["county"], r["state"]): (r["county_fips"], r["status"]) for r in counties.lookup_counties(asked, ref).collect()}
    assert got == {("Hamilton", "OH"): ("39061", "ok"), ("hamilton county", "Ohio"): ("39061", "ok"), ("39061", None): ("39061", "ok"), ("Orleans", "LA"): ("22071", "ok"), ("St. Louis", "MO"): (None, "ambiguous"), ("St Louis City", "MO"): ("29510", "ok"), ("Juneau", "Alaska"): ("02110", "ok"), ("Not A County", "OH"): (None, "not_found"), ("99999", "OH"): (None, "not_found"), ("Hamilton", "Atlantis"): (None, "unknown_state"), (None, "OH"): (None, "not_found")}
    assert counties.lookup_counties(asked, ref).where("status = 'ambiguous'").first()["choices"] == ["St. Louis County", "St. Louis city"]
    assert text.COUNTY_SUFFIXES[-1] == "city"
