import random

from pyspark.sql import functions as F

from cairn.functions import cells, dicts, distance, geo, phonetic, tagger, text, zips


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").withColumn("out", f(F.col("v"))).orderBy("i").collect()
    return [r["out"] for r in rows]


def test_clean(spark):
    assert column(spark, ['33\\33 B"urnet Ave; Ci!ncinn&*ati OH 45219', "33_33 Burnet Ave. ", None], text.clean_text) == ["3333 Burnet Ave Cincinnati OH 45219", "3333 Burnet Ave", None]


def test_dictionaries(spark):
    assert column(spark, ["st", "lane", "Avnue", "Blvrd", "woods", "bl", "la", " foofy ", "", None], dicts.map_post_type) == ["St", "Ln", "Ave", "Blvd", "Woods", "Blvd", "Ln", "foofy", "", None]
    assert column(spark, ["North", "N.E.", "south west", "North-East ", "Nope"], dicts.map_direction) == ["N", "NE", "SW", "NE", "Nope"]
    assert column(spark, ["US", " U.S. Hwy ", "Nope"], dicts.map_pre_type) == ["US Hwy", "US Hwy", "Nope"]
    assert column(spark, ["oh", "  new york ", "NewYork", "foo", "", None], dicts.map_state) == ["OH", "NY", "NY", None, "", None]


def test_no_spelling_has_two_meanings():
    for kind in ("post_type", "pre_type", "direction", "state"):
        words = dicts.dictionary(kind)
        assert all(words[v.lower()] == v for v in words.values())


def test_phonetic(spark):
    assert column(spark, ["MEADOWLARK", "7TH", "5th", "FIFTH", "BURNET", "TWENTY FIRST", "main"], phonetic.street_key) == ["M346", "#0007", "#0005", "#0005", "B653", "#0021", "M500"]
    assert column(spark, ["Robert", "Rubin", "Ashcraft", "Tymczak", "Pfister", "A", "", " ", None], phonetic.soundex) == ["R163", "R150", "A261", "T522", "P236", "A000", "0000", "0000", None]
    assert column(spark, ["fifth", "7th", "main", "twenty first", "", " ", None], phonetic.map_ordinal) == ["5TH", "7TH", "main", "21ST", "", " ", None]
    near = column(spark, ["#0007"], phonetic.ordinal_neighbors)[0]
    assert {"#0070", "#0700", "#7000", "#0008", "#0009"} <= set(near) and not {"#0077", "#0017", "#0007"} & set(near)


def test_zip_variants(spark):
    got = column(spark, ["45220", "", None], zips.zip_variants)
    assert got[0] == ["45219", *(f"4522{i}" for i in range(1, 10)), "45200", "45210", *(f"452{i}0" for i in range(3, 10)), "42520"]
    assert got[1:] == [[""], None]
    assert column(spark, ["00100"], lambda c: zips.zip_variants(c, ["minus1"])) == [[]]


def test_zip_choice(spark):
    x = spark.createDataFrame([(z,) for z in ["45222", "45219", "45220", "", None]], "z string")
    y = spark.createDataFrame([(z,) for z in ["42522", "45200", "45219", "45221", "45223", "45321", ""]], "z string")
    assert {tuple(r) for r in zips.choose_zips(x, "z", y, "z").collect()} == {("45222", "45221"), ("45219", "45219"), ("45220", "45221")}


def osa(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_distance(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randint(0, 6)))
    pairs = [(word(), word()) for _ in range(400)] + [("", ""), (None, "a")]
    rows = spark.createDataFrame(pairs, "a string, b string").withColumns({"d": distance.osa("a", "b"), **{f"d{k}": distance.osa_up_to("a", "b", k) for k in range(4)}}).collect()
    for x in rows:
        if x["a"] is None:
            assert x["d"] is None
        else:
            assert x["d"] == osa(x["a"], x["b"]) and all(x[f"d{k}"] == (x["d"] if x["d"] <= k else None) for k in range(4))


def test_geometry(spark):
    line = spark.createDataFrame([("LINESTRING (0 0, 0.01 0)",)], "w string")
    at = line.withColumn("p", geo.along(geo.parse_line(F.col("w")), F.lit(0.25))).select("p.*").first()
    assert abs(at["lon"] - 0.0025) < 1e-9 and abs(at["lat"]) < 1e-12 and abs(at["bearing"] - 90) < 1e-9
    moved = line.withColumn("q", geo.offset_point(F.lit(0.0), F.lit(0.0), F.lit(90.0), F.lit("L"), F.lit(10.0))).select("q.*").first()
    assert moved["lat"] > 0 and abs(moved["lat"] - 10 / geo.RADIUS_M * 57.29577951308232) < 1e-9


def test_cells_decode():
    import numpy as np

    r = np.random.default_rng(1)
    lon, lat = r.uniform(-180, 180, 500), r.uniform(-89, 89, 500)
    back = cells.cell_center(cells.cell_ids(lon, lat))
    assert np.abs(back[1] - lat).max() < 1e-6 and np.abs((back[0] - lon) * np.cos(np.radians(lat))).max() < 1e-6


def test_tagger():
    labels = dict(tagger.tag("200 W 14th Street Cincinnati OH 45222"))
    assert [a for a, _ in tagger.tag("200 W 14th Street Cincinnati OH 45222")] == ["AddressNumber", "StreetNamePreDirectional", "StreetName", "StreetNamePostType", "PlaceName", "StateName", "ZipCode"] and labels["StreetName"] == "14th"
    assert [a for a, _ in tagger.tag("111 State Route 32 Cincinnati OH 45912")][1:4] == ["StreetNamePreType", "StreetNamePreType", "StreetName"]
    assert [a for a, _ in tagger.tag("290 Ludlow Avenue Apt #2 Cincinnati OH 45220")][3:6] == ["OccupancyType", "OccupancyIdentifier", "OccupancyIdentifier"]
    assert tagger.tag(None) is None and tagger.tag("") == []


#: Texts with their labels in short: the first letters of each word of a label.
LABELLED = {
    "PO Box 123 Cincinnati OH 45220": "UBT UBT UBI PN SN ZC", "RR 2 Box 14 Loveland OH 45140": "UBGT UBGI UBT UBI PN SN ZC", "12 Oak St PO Box 9 Dayton OH 45402": "AN SN SNPT UBT UBT UBI PN SN ZC",
    "Attn Ann Lee 290 Ludlow Avenue Cincinnati OH 45220": "R R R AN SN SNPT PN SN ZC", "Carew Tower 441 Vine St Cincinnati OH 45202": "BN BN AN SN SNPT PN SN ZC", "Eden Park Cincinnati OH": "LN LN PN SN",
    "corner of Main and Vine Cincinnati OH": "CO CO SN IS SN PN SN", "Main St and Vine St Cincinnati OH 45220": "SN SNPT IS SN SNPT PN SN ZC", "unknown": "NA", "10 Oak St Building 4 Dayton OH": "AN SN SNPT ST SI PN SN",
    "A 123 Main St E Cincinnati OH 45220": "ANP AN SN SNPT SNPD PN SN ZC", "200 W Old US 50 Ave Cincinnati OH 45220": "AN SNPD SNPM SNPT SN SNPT PN SN ZC", "111 State Route 32": "AN SNPT SNPT SN", "45220": "AN", "#": "OI",
}


def test_labels():
    import re

    short = lambda label: "".join(re.findall("[A-Z]", label.replace("USPS", "U").replace("ID", "I")))
    for text, want in LABELLED.items():
        got = tagger.tag(text)
        assert " ".join(short(a) for a, _ in got) == want, text
        assert {a for a, _ in got} <= set(tagger.LABELS) and len(tagger.LABELS) == 26


def test_explained_tags(spark):
    df = spark.createDataFrame([("12 Oak Hollow St Apt 3",), ("",), (None,)], "t string")
    got = [(r["text"], r["token"], r["field"], r["note"]) for r in tagger.explain_tags(df, "t").orderBy("text", "position").collect()]
    assert got[0] == ("", None, None, "no tokens") and ("12 Oak Hollow St Apt 3", "Oak", "street_name", "joined with the other tokens of its label") in got and got[-1][2:] == (None, "not part of the address record") and len(got) == 7


def test_parse(spark):
    df = spark.createDataFrame([("200 W 14th Street Cincinnati OH 45222",), (None,), ("1234 Main St Cincinnati Cincinnati OH 45229",)], "t string")
    rows = {r["t"]: r for r in tagger.parse_addresses(df, "t").collect()}
    r = rows["200 W 14th Street Cincinnati OH 45222"]
    assert (r["street_predirectional"], r["street_name"], r["street_posttype"], r["place_zipcode"]) == ("W", "14TH", "St", "45222")
    assert rows[None]["street_name"] is None and rows["1234 Main St Cincinnati Cincinnati OH 45229"]["place_name"] == "Cincinnati"
