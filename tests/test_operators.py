import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.functions.text import FLAT
from cairn.operators import counties, fuzzy, geocode, match, spatial
from cairn.operators.compact import assign_files, compact, longest_first, read_compacted
from cairn.operators.heavy_keys import heavy_keys, per_key
from cairn.operators.spatial import Quadtree, RTree, containing_region, great_circle, inside, near_points, parse_point, parse_polygons


def addresses(spark, rows, key="x_id"):
    """rows: (id, digits, name, type, zip)"""
    out = [(i, "", d, "", "", "", "", n, t, "", "Town", "OH", z) for i, d, n, t, z in rows]
    return spark.createDataFrame(out, f"{key} int, " + ", ".join(f"{c} string" for c in FLAT))


def test_heavy_keys(spark):
    df = spark.createDataFrame([("a", 1)] * 7 + [("b", 2)] * 2 + [(None, 3), ("", 4)], "k string, v int")
    assert [r["k"] for r in heavy_keys(df, "k", 0.5).collect()] == ["a"]
    got = {r["k"]: (r["n_rows"], r["s"], r["d"]) for r in per_key(df, "k", {"s": ("sum", "v")}, {"d": "v"}).collect()}
    assert got == {"a": (7, 7, 1), "b": (2, 4, 1), None: (1, 3, 1), "": (1, 4, 1)}
    assert heavy_keys(df.limit(0), "k", 0.1).count() == 0
    with pytest.raises(ValueError):
        per_key(df, "k", {"k": ("sum", "v")})


def test_longest_first():
    groups = longest_first([7, 6, 5, 4, 3], 2)
    load = [sum(s for s, g in zip([7, 6, 5, 4, 3], groups) if g == k) for k in (0, 1)]
    assert sorted(load) == [11, 14] and longest_first([], 3) == []


def test_compact(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 5, "z", f"v{i % 7}", None if i % 2 else "x") for i in range(40)] + [(3, 3, "z", "v3", None)], "id int, file int, zone string, v string, w string")
    files = spark.createDataFrame([(i, 100 * i) for i in range(5)] + [(9, 0)], "file int, n_bytes int")
    out = str(tmp_path / "out")
    manifest = compact(rows, files, out, "id", "file", "zone", target_bytes=300)
    got = {(r["id"], r["v"], r["w"]) for r in read_compacted(spark, out).collect()}
    want = {}
    for r in rows.orderBy("id").collect():
        want.setdefault((r["zone"], r["v"], r["w"]), r["id"])
    assert {(i, k[1], k[2]) for k, i in want.items()} == got and manifest.agg(F.sum("n_rows")).first()[0] == len(got)
    (tmp_path / "out" / manifest.first()["path"]).unlink()
    with pytest.raises(RuntimeError):
        read_compacted(spark, out)


def test_compact_empty(spark, tmp_path):
    rows = spark.createDataFrame([], "id int, file int, zone string, v string")
    compact(rows, spark.createDataFrame([], "file int, n_bytes int"), str(tmp_path / "o"), "id", "file", "zone")
    assert read_compacted(spark, str(tmp_path / "o")) is None


def test_compact_with_columns_named_like_its_own(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "z", 5, "a"), (2, 1, "z", 5, "a"), (3, None, None, None, None), (4, 2, "y", 6, "b")], "id int, file_id int, zone string, out_group int, check string")
    out = str(tmp_path / "o")
    compact(rows, spark.createDataFrame([(1, None), (1, 50), (7, 3)], "file_id int, n_bytes int"), out, "id", "file_id", "zone")
    assert sorted(tuple(r) for r in read_compacted(spark, out).collect() if r["id"] != 3) == [(1, 1, "z", 5, "a"), (4, 2, "y", 6, "b")] and read_compacted(spark, out).count() == 3


def test_assign_splits_busy_shards(spark):
    files = spark.range(50).select(F.col("id").alias("file_id"), F.lit("a").alias("shard_key"), F.lit(10).alias("n_bytes"))
    got = assign_files(files, 100, shard_files=10)
    assert got.count() == 50 and got.groupBy("out_group").count().agg(F.max("count")).first()[0] <= 10


def test_rtree_against_brute_force():
    r = np.random.default_rng(3)
    x, y, qx, qy = r.random(700), r.random(700), r.random(50), r.random(50)
    q, i = RTree(x, y, x, y).probe(qx - 0.05, qy - 0.05, qx + 0.05, qy + 0.05)
    want = {(a, b) for a in range(50) for b in range(700) if abs(x[b] - qx[a]) <= 0.05 and abs(y[b] - qy[a]) <= 0.05}
    assert set(zip(q.tolist(), i.tolist())) == want


def test_quadtree_covers():
    r = np.random.default_rng(4)
    lon, lat = r.normal(-84, 1, 3000), r.normal(39, 1, 3000)
    t = Quadtree(lon, lat, 50)
    counts = np.bincount(t.leaf(lon, lat), minlength=len(t.starts))
    assert counts.max() <= 50
    same = Quadtree(np.full(500, 1.0), np.full(500, 2.0), 50)
    assert spatial._shares(np.bincount(same.leaf(np.full(500, 1.0), np.full(500, 2.0))), 50).max() == 5


def test_near_points(spark):
    r = np.random.default_rng(5)
    q = [(f"q{i}", float(a), float(b)) for i, (a, b) in enumerate(zip(r.normal(-84, 0.002, 60), r.normal(39, 0.002, 60)))] + [("date line", 179.99999, 0.0), ("none", None, 1.0), ("nan", float("nan"), 1.0)]
    p = [(f"p{i}", float(a), float(b)) for i, (a, b) in enumerate(zip(r.normal(-84, 0.002, 300), r.normal(39, 0.002, 300)))] + [("beyond", -179.99999, 0.0)]
    p += [("pile", -84.0, 39.0)] * 50
    form = "id string, lon double, lat double"
    got = {tuple(x) for x in near_points(spark.createDataFrame(q, form), spark.createDataFrame(p, form), 60.0, leaf_rows=20).collect()}
    want = {(a[0], b[0]) for a in q[:61] for b in p if great_circle(a[2], a[1], b[2], b[1]) <= 60.0}
    assert got == want and ("date line", "beyond") in got


def test_regions(spark):
    wkt = [("a", "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))"), ("b", "MULTIPOLYGON (((10 10, 12 10, 12 12, 10 12, 10 10)), ((4 0, 6 0, 6 4, 4 4, 4 0)))"), ("c", "POLYGON EMPTY"), ("d", None)]
    pts = [("in", 3.0, 3.0), ("hole", 1.5, 1.5), ("part", 11.0, 11.0), ("edge", 4.0, 2.0), ("out", 50.0, 50.0)]
    got = {tuple(x) for x in containing_region(spark.createDataFrame(pts, "id string, lon double, lat double"), spark.createDataFrame(wkt, "id string, wkt string"), leaf_rows=1).collect()}
    assert got == {("in", "a"), ("part", "b"), ("edge", "b")}
    assert inside(parse_polygons(wkt[0][1])[0], np.array([0.5]), np.array([0.5])).tolist() == [True]


def test_parse_point(spark):
    rows = spark.createDataFrame([(v,) for v in ["POINT (-84.5 39)", "point ( -84.5   39 )", "SRID=4326;POINT(-84.5 39)", "POINT Z (-84.5 39 0)", "POINT EMPTY", None, "x"]], "w string").select(parse_point("w").alias("p")).collect()
    assert [r["p"] and (r["p"]["lon"], r["p"]["lat"]) for r in rows] == [(-84.5, 39.0)] * 4 + [None] * 3


def test_staged_match(spark):
    x = addresses(spark, [(1, "10", "MAINE", "St", "45220"), (2, "99", "MAIN", "St", "45220"), (3, "10", "MAIN", "St", "45229"), (4, "10", "OAK", "St", "45220"), (5, "10", "MAIN", "St", "45103")])
    y = addresses(spark, [(1, "10", "MAIN", "St", "45220"), (2, "11", "MAIN", "St", "45220"), (3, "10", "ELM", "St", "45220"), (4, "10", "MAIN", "St", "45229")], "y_ord")
    got = match.match_addresses(x, y, zip_variants=None).withColumn("stage", match.match_stage())
    assert [(r["x_id"], r["stage"], r["y_ord"]) for r in got.orderBy("x_id").collect()] == [(1, "number", 1), (2, "street", None), (3, "number", 4), (4, "zip", None), (5, "none", None)]


def test_numbers(spark):
    x = addresses(spark, [(i, d, "A", "", "1") for i, d in enumerate(["1", "10", "228", "11", "22", "99897", None])])
    y = addresses(spark, [(i, d, "A", "", "1") for i, d in enumerate(["12", "11", "10", "22"])], "y_ord")
    got = {r["x_id"]: r["y_ord"] for r in match.match_numbers(x, y, "x_id", "y_ord").collect()}
    assert got == {0: 2, 1: 2, 2: 3, 3: 1, 4: 3}


def test_fuzzy_names(spark):
    y = ["adams", "pine", "pinye", "woolper"]
    x = spark.createDataFrame([(0, "Pinye"), (1, "Wolper"), (2, "zzz"), (3, None)], "i int, v string")
    got = {tuple(r) for r in fuzzy.fuzzy_match(x, spark.createDataFrame(list(enumerate(y)), "j int, v string"), "i", "j", "v", 1).collect()}
    assert got == {(0, 2, 0), (1, 3, 1)}


def test_geocode(spark):
    line = "LINESTRING (0 0, 0.01 0)"
    form = "taf_id int, zip string, fromhn int, tohn int, side string, parity string, offset_flag string, geometry_wkt string, street_predirectional string, street_premodifier string, street_pretype string, street_name string, street_posttype string, street_postdirectional string"
    taf = spark.createDataFrame([(1, "45220", 1, 99, "L", "O", "N", line, "", "", "", "MAIN", "St", ""), (2, "45220", 2, 100, "R", "E", "N", line, "", "", "", "MAIN", "St", ""), (3, "42520", None, 9, "L", "O", "N", line, "", "", "", "ELM", "St", "")], form)
    x = addresses(spark, [(1, "1", "MAIN", "St", "45220"), (2, "2", "MAIN", "St", "45220"), (3, "5", "ELM", "St", "45220"), (4, "5", "OAK", "St", "45220"), (5, "5", "OAK", "St", None)])
    got = {r["x_id"]: r for r in geocode.geocode(x, taf).collect()}
    assert [got[i]["geocode_stage"] for i in range(1, 6)] == ["range", "range", "street_variant", "none", "none"]
    lat = [float(got[i]["matched_geography"].split()[2].rstrip(")")) for i in (1, 2)]
    assert lat[0] > 0 > lat[1] and got[3]["matched_geography"] is None


def test_geocoding_gathers_no_growing_table_on_the_driver(spark, monkeypatch):
    from cairn import cli, session

    spark.createDataFrame([(1, "45220", 1, 99, "L", "O", "N", "LINESTRING(-84.5 39.1, -84.4 39.1)", "", "", "", "Main", "St", "")], "taf_id int, zip string, fromhn int, tohn int, side string, parity string, offset_flag string, geometry_wkt string, " + ", ".join(f"{c} string" for c in match.STREET)).createOrReplaceTempView("few_ranges")
    plans, write = [], session.materialize

    def planned(df, kind="stage"):
        plans.append((kind, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, kind)

    for module in (session, geocode, match):
        monkeypatch.setattr(module, "materialize", planned)
    out = cli.geocode_table(spark.createDataFrame([("1 Main St Town OH 45220",), ("3 Mian St Town OH 45221",)], "addr string"), spark.table("few_ranges"), "addr")
    plans.append(("result", out._jdf.queryExecution().executedPlan().toString()))
    # the ZIPs and their variants are few
    assert {k for k, p in plans if "BroadcastHashJoin" in p} <= {"tried", "pairs"} and {"addresses", "names", "found", "late", "points", "result"} <= {k for k, _ in plans}
    assert sorted(r["addr_geocode_stage"] for r in out.collect()) == ["range", "range_variant"]


def test_geocode_keeps_no_inner_stages(spark):
    """What the driver holds at the end: few stages and a short plan (F1, F2)."""
    from cairn import session

    line = "LINESTRING (0 0, 0.01 0)"
    form = "taf_id int, zip string, fromhn int, tohn int, side string, parity string, offset_flag string, geometry_wkt string, street_predirectional string, street_premodifier string, street_pretype string, street_name string, street_posttype string, street_postdirectional string"
    taf = spark.createDataFrame([(1, "45220", 1, 99, "L", "O", "N", line, "", "", "", "MAIN", "St", "")], form)
    before = set(session._stages)
    out = geocode.geocode(addresses(spark, [(1, "1", "MIAN", "St", "45220"), (2, "3", "MAIN", "St", "45221")]), taf)
    assert sorted(p.rsplit("/", 1)[1].split("-")[0] for p in set(session._stages) - before) == ["addresses", "found", "late", "points", "streets", "texts"]
    assert "LINESTRING" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r["x_id"]: r["geocode_stage"] for r in out.collect()} == {1: "range", 2: "range_variant"}


def test_close_pairs_in_blocks(spark, monkeypatch):
    rows = [(b, w) for b in ("1", "2") for w in ("main", "mian", "maine", "oak", "mn", "")] + [("2", "moan"), ("2", "naim"), (None, "main")]
    xs, ys = spark.createDataFrame([*rows, ("3", "main")], "b string, xv string"), spark.createDataFrame(rows, "b string, yv string")
    got = []
    for size in (0, 7, 1000):
        monkeypatch.setattr(fuzzy, "WHOLE_BLOCK", size, raising=True)
        got.append(sorted(tuple(r) for r in fuzzy.close_pairs(xs, ys, 2, ["b"]).select("b", "xv", "yv", "dist").collect()))
    assert got[0] == got[1] == got[2] and ("1", "main", "mian", 1) in got[0] and not any(r[0] in (None, "3") for r in got[0])


def test_counties(spark):
    ref = spark.createDataFrame([("Hamilton County", "OH", "39061"), ("St. Louis County", "MO", "29189"), ("St. Louis city", "MO", "29510"), ("Orleans Parish", "LA", "22071")], "county_full string, state string, county_fips string")
    asked = spark.createDataFrame([("Hamilton", "Ohio"), ("orleans", "LA"), ("39061", "OH"), ("Nowhere", "OH")], "county string, state string")
    assert {r["county"]: r["county_fips"] for r in counties.lookup_counties(asked, ref).collect()} == {"Hamilton": "39061", "orleans": "22071", "39061": "39061", "Nowhere": None}


def test_close_pairs_for_any_limit(spark):
    import random

    from tests.test_functions import osa

    r = random.Random(4)
    word = lambda n: "".join(r.choice("abcd") for _ in range(n))
    x, y = [sorted({word(r.randint(0, 11)) for _ in range(60)}) for _ in range(2)]
    xs, ys = (spark.createDataFrame([(w,) for w in s], f"{c} string") for s, c in ((x, "xv"), (y, "yv")))
    for k in (1, 2, 3, 4):
        got = {(p["xv"], p["yv"]): p["dist"] for p in fuzzy.close_pairs(xs, ys, k).collect()}
        assert got == {(a, b): osa(a, b) for a in x for b in y if osa(a, b) <= k}


def test_one_edit_behind_ten_thousand_characters(spark):
    a = "".join(chr(97 + i * i % 23) for i in range(10_050))
    x, y = spark.createDataFrame([(a + "xyz",)], "xv string"), spark.createDataFrame([(a + "xz",)], "yv string")
    assert [r["dist"] for r in fuzzy.close_pairs(x, y, 1).collect()] == [1]


def test_crowded_leaves_are_dealt_to_groups(spark):
    # most points, and most queries, stand at one place; the sample knows 20 of them
    r = np.random.default_rng(6)
    lon, lat = r.normal(-84, 0.02, 900), r.normal(39, 0.02, 900)
    lon[:300], lat[:300] = -84.0, 39.0
    points = spark.createDataFrame([(str(i), float(x), float(y)) for i, (x, y) in enumerate(zip(lon, lat))], "id string, lon double, lat double")
    queries = points.where("cast(id as int) % 3 = 0").unionByName(points.where("id = '1'"))
    got = {tuple(x) for x in near_points(queries, points, 120.0, sample_rows=20, leaf_rows=15).collect()}
    ids = [i for i in range(900) if i % 3 == 0 or i == 1]
    want = {(str(i), str(j)) for i in ids for j in np.flatnonzero(great_circle(lat[i], lon[i], lat, lon) <= 120.0)}
    assert got == want


def test_compact_spreads_rows_without_a_file_and_joins_small_keys(spark, tmp_path):
    rows = spark.createDataFrame([(i, None if i < 60 else i % 8, f"z{i % 4}", f"v{i}") for i in range(100)] + [(100, 3, "z1", "v5"), (200, None, "z0", "v9"), (99, 3, "z3", "v99")], "id int, file int, zone string, v string")
    files = spark.createDataFrame([(i, 200) for i in range(8)], "file int, n_bytes int")
    manifest = compact(rows, files, str(tmp_path / "a"), "id", "file", "zone", ignore=["zone"], target_bytes=2000)
    got = read_compacted(spark, str(tmp_path / "a"))
    assert sorted(r["id"] for r in got.collect()) == list(range(100))
    # 6,000 bytes without file make three groups, 1,600 of four small keys one
    assert manifest.count() == 4
    one = compact(rows, files, str(tmp_path / "b"), "id", "file", "zone")
    assert one.agg(F.sum("n_rows")).first()[0] == 101 and one.count() == 2


def test_compact_finds_damaged_files(spark, tmp_path):
    import pyarrow.parquet as pq

    from cairn.operators import compact as module

    rows = spark.createDataFrame([(i, 0, "z", f"v{i}") for i in range(20)], "id int, file int, zone string, v string")
    out = tmp_path / "o"
    manifest = compact(rows, spark.createDataFrame([(0, 10)], "file int, n_bytes int"), str(out), "id", "file", "zone")
    path = out / manifest.first()["path"]
    pq.write_table(pq.read_table(path).slice(0, 19), path)
    content = F.unhex(F.md5(F.to_json(F.struct("zone", "v"), {"ignoreNullFields": "false"})))
    with pytest.raises(RuntimeError):
        module._read_back(spark.read.schema(rows.schema), "file://" + str(out), manifest, content)


def test_no_stages_in_a_local_folder_of_a_cluster():
    from types import SimpleNamespace

    from cairn.session import shared_dir

    conf = SimpleNamespace(get=lambda *a: None)
    with pytest.raises(RuntimeError):
        shared_dir(SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, master="spark://host:7077"), conf=conf))


def test_left_join_with_prefixes_and_a_prepared_index(spark):
    x = addresses(spark, [(1, "10", "Main", "St", "11111"), (2, "99", "Main", "St", "11111"), (3, "1", "Elm", "St", "22222")]).withColumn("note", F.lit("x"))
    y = addresses(spark, [(1, "10", "Main", "St", "11111"), (2, "10", "Main", "St", "11111"), (3, "12", "Main", "St", "11111")], "y_ord").withColumn("note", F.col("y_ord"))
    index = match.AddressIndex(y, "y_ord")
    out = match.address_left_join(x, y, "x_id", "y_ord", prepared=index)
    assert "street_name" in out.columns and "street_name_y" in out.columns and "street_name_x" not in out.columns and {"note_x", "note_y"} <= set(out.columns)
    assert sorted((r["x_id"], r["note_y"]) for r in out.collect() if r["x_id"] != 2) == [(1, 1), (1, 2), (3, None)]
    named = y.select("y_ord", *(F.col(c).alias("ref_" + c) for c in FLAT))
    wide = match.address_left_join(x, named, "x_id", "y_ord", by=("", "ref_"))
    assert sorted((r["x_id"], r["ref_street_name_y"]) for r in wide.collect() if r["x_id"] != 2) == [(1, "Main"), (1, "Main"), (3, None)]
    with pytest.raises(ValueError):
        match.address_left_join(x, y.where("y_ord < 3"), "x_id", "y_ord", prepared=index)


def test_stage_table(spark):
    from cairn.operators.diagnose import problem_examples, stage_table

    x = addresses(spark, [(1, "10", "Main", "St", "11111"), (2, "11", "Mian", "St", "11112"), (3, "1", "Elm", "St", "11111"), (4, "1", "Elm", "St", "90909")])
    y = addresses(spark, [(1, "10", "Main", "St", "11111"), (2, "12", "Main", "St", "11111")], "y_ord")
    got = {(r["x_id"], r["stage"]): (r["status"], r["candidates"]) for r in stage_table(x, y).collect()}
    assert len(got) == 16
    assert [got[1, s][0] for s in ("zip", "street", "number", "final")] == ["exact", "exact", "exact", "number"]
    assert [got[2, s][0] for s in ("zip", "street", "number", "final")] == ["variant", "fuzzy_or_phonetic", "fuzzy", "number"] and got[2, "street"][1] == "1 streets / 2 addresses"
    assert [got[3, s] for s in ("street", "number", "final")] == [("no match", "1 streets / 2 addresses"), ("skipped", "0"), ("zip", "zip-only result")]
    assert [got[4, s][0] for s in ("zip", "street", "number", "final")] == ["no match", "skipped", "skipped", "none"]
    texts = spark.createDataFrame([("b" * 130,), ("a\nb",), (None,)], "t string")
    assert problem_examples(texts, "t", 2) == '"<NA>", "a b", ... and 1 more' and problem_examples(texts, "t").endswith('bbb..."') and problem_examples(texts.limit(0), "t") == ""


def test_phonetic_keys(spark):
    x = spark.createDataFrame([(1, "#0005"), (2, "M500"), (3, None), (4, "M600")], "i int, k string")
    y = spark.createDataFrame([(1, "#0050"), (2, "#0005"), (3, "M550"), (4, "M500"), (5, "#0006")], "j int, k string")
    pairs = lambda limit: {tuple(r) for r in fuzzy.match_phonetic_keys(x, y, "i", "j", "k", limit).collect()}
    assert pairs(1) == {(1, 1), (1, 5), (2, 4), (4, 4)} and pairs(0) == {(2, 4)}


def test_coverage(spark):
    x = addresses(spark, [(1, "10", "Main", "St", "11111"), (2, "10", "Main", "St", "77777")])
    catalog = spark.createDataFrame([("39001", "11111", "111", "11", 3), ("39003", "77777", "777", "77", 1)], "county_fips string, zip string, zip3 string, zip2 string, n_ranges int")
    installed = catalog.where("county_fips = '39001'")
    with pytest.warns(UserWarning, match="39003"):
        assert {r["county_fips"] for r in geocode.check_coverage(x, "place_zipcode", catalog, installed).collect()} == {"39003"}
    with pytest.raises(RuntimeError, match="77777"):
        geocode.geocode(x, None, catalog=catalog, installed=installed, strict_coverage=True)
    assert geocode.check_coverage(x, "place_zipcode", catalog, catalog, strict=True).count() == 0


def test_streamed_matching(spark, tmp_path):
    from cairn.streaming.addresses import match_stream

    x = addresses(spark, [(1, "10", "Main", "St", "11111"), (2, "10", "Elm", "St", "11111")])
    index = match.AddressIndex(addresses(spark, [(7, "10", "Main", "St", "11111")], "y_ord"), "y_ord")
    x.write.parquet(str(tmp_path / "in"))
    got = []
    query = match_stream(spark.readStream.schema(x.schema).parquet(str(tmp_path / "in")), index, lambda df, n: got.extend(df.select("x_id", "y_ord").collect()), str(tmp_path / "check"))
    query.awaitTermination(120)
    assert {tuple(r) for r in got} == {(1, 7), (2, None)}


def test_command_line(spark, tmp_path):
    from cairn import cli

    columns = "taf_id long, zip string, fromhn int, tohn int, side string, parity string, offset_flag string, geometry_wkt string, street_predirectional string, street_premodifier string, street_pretype string, street_name string, street_posttype string, street_postdirectional string"
    spark.createDataFrame([(1, "45220", 1, 99, "L", "B", "N", "LINESTRING (-84.5 39.1, -84.4 39.1)", "", "", "", "Main", "St", "")], columns).write.parquet(str(tmp_path / "ranges"))
    (tmp_path / "a.csv").write_text("id,address\n1,50 Main Street Cincinnati OH 45220\n2,nowhere\n")
    cli.main([str(tmp_path / "a.csv"), str(tmp_path / "ranges")])
    out = {r["id"]: r for r in spark.read.csv(cli.output_path(str(tmp_path / "a.csv")), header=True).collect()}
    assert out["1"]["addr_geocode_stage"] == "range" and out["1"]["addr_matched_street"] == "Main St" and abs(float(out["1"]["addr_longitude"]) + 84.45) < 1e-3 and out["2"]["addr_geocode_stage"] == "none"
    with pytest.raises(SystemExit):
        cli.main([str(tmp_path / "a.txt"), "x"])
