import datetime as dt
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import columns, geometry
from gridloom.operators import buildings, catalog, census, spatial, synpop
from gridloom.sources import readers, writers
from tests.test_timeseries import START, series

RING = "code string, cx double, cy double, rings array<array<struct<x:double,y:double>>>"


def square(x, y, r):
    return [[{"x": float(x + a * r), "y": float(y + b * r)} for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1))]]


def units(spark, *rows):
    return spark.createDataFrame([(c, float(x), float(y), square(x, y, r)) for c, x, y, r in rows], RING)


def test_geometry_functions(spark):
    hole = square(0, 0, 4) + square(0, 0, 1)
    df = spark.createDataFrame([(hole,), (square(3, 5, 2),), ([[{"x": 1.0, "y": 2.0}]],)], f"rings {geometry.RINGS}")
    inside = lambda x, y: geometry.contains(F.col("rings"), F.lit(float(x)), F.lit(float(y)))
    a, b, c = df.select(geometry.centroid(F.col("rings")).alias("c"), inside(0, 0).alias("o"), inside(2, 0).alias("i"), inside(4, 0).alias("e"), inside(9, 0).alias("f")).collect()
    assert (a.o, a.i, a.e, a.f) == (False, True, True, False)
    assert (b.c.x, b.c.y) == pytest.approx((3, 5)) and (c.c.x, c.c.y) == (1, 2)


def test_wkb(spark):
    ring = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 0.0)]
    polygon = struct.pack("<BII", 1, 3, 1) + struct.pack("<I", 4) + b"".join(struct.pack("<dd", *p) for p in ring)
    point_z = struct.pack(">BIddd", 0, 1001, 5.0, 6.0, 7.0)
    many = struct.pack("<BII", 1, 6, 2) + polygon * 2
    data = [(polygon.hex(),), (point_z.hex().upper(),), (many.hex(),), ("zz",), (None,)]
    got = [r.r for r in spark.createDataFrame(data, "g string").select(geometry.parse_wkb("g").alias("r")).collect()]
    assert [(p.x, p.y) for p in got[0][0]] == ring and (got[1][0][0].x, got[1][0][0].y) == (5, 6)
    assert len(got[2]) == 2 and got[3] is None and got[4] is None


def test_containing_unit_wins_over_a_nearer_centroid(spark):
    large = units(spark, ("H1A", 50, 0, 50), ("H1B", 91.6, 0, 0.1))
    points = spark.createDataFrame([("B1", 90.0, 0.0), ("B2", 200.0, 0.0), ("B3", None, None)], "building_id string, cx double, cy double")
    got = {r.building_id: r.fsa_code for r in spatial.assign_units(points, large, "fsa_code", 30.0).collect()}
    assert got == {"B1": "H1A", "B2": "H1B", "B3": None}
    old = points.withColumn("fsa_code", F.when(F.col("building_id") == "B1", "OLD"))
    assert {r.fsa_code for r in spatial.assign_units(old, large, "fsa_code", 30.0).collect()} == {"OLD", "H1B", None}
    assert {r.fsa_code for r in spatial.assign_units(old, large, "fsa_code", 30.0, overwrite=True).collect()} == {"H1A", "H1B", None}


def test_units_that_a_footprint_meets_are_candidates(spark):
    """B1 straddles a border, B2's centroid is in no unit, B3 meets none, B4 crosses a unit without a corner of either inside, B5 is a hole's."""
    large = units(spark, ("A", 50, 0, 50), ("B", 106, 0, 6), ("C", 200, 300, 20), ("D", 240, 300, 1))
    large = large.unionByName(spark.createDataFrame([("E", 500.0, 500.0, square(500, 500, 40) + square(500, 500, 30))], large.schema))
    bar = [[{"x": float(x), "y": float(y)} for x, y in ((170, 298), (231, 298), (231, 302), (170, 302))]]
    shapes = [("B1", 98.0, 0.0, square(98, 0, 3)), ("B2", 228.0, 300.0, square(228, 300, 9)), ("B3", 228.0, 300.0, square(228, 300, 1)), ("B4", 234.0, 300.0, bar), ("B5", 500.0, 500.0, square(500, 500, 5)), ("B6", 98.0, 0.0, None)]
    points = spark.createDataFrame(shapes, f"building_id string, cx double, cy double, rings {geometry.RINGS}")
    got = {(r.building_id, r.code) for r in spatial.candidates(points, large, 30.0).collect()}
    assert got == {("B1", "A"), ("B1", "B"), ("B2", "C"), ("B4", "C"), ("B6", "A")}
    got = {r.building_id: r.fsa_code for r in spatial.assign_units(points, large, "fsa_code", 30.0).collect()}
    assert got == {"B1": "B", "B2": "C", "B3": "D", "B4": "C", "B5": "E", "B6": "A"}


def test_nearest_units_by_distance_then_code(spark):
    large = units(spark, ("B", 1, 0, 1), ("A", -1, 0, 1), ("C", 5, 0, 1))
    small = spark.createDataFrame([("d1", 0.0, 0.0), ("d2", None, None)], "code string, cx double, cy double")
    assert {r.code: r.nearest for r in spatial.nearest_units(small, large, 2).collect()} == {"d1": ["A", "B"], "d2": []}
    assert spatial.nearest_units(small, large, None).where("code = 'd1'").first().nearest == ["A", "B", "C"]


def test_standard_columns(spark):
    df = spark.createDataFrame(
        [(" B1 ", "1990", None, "flat", "n/a", "3", 12.0, 2.0), ("B2", None, "x", None, None, None, None, 1.0)],
        "ID_UEV string, ANNEE_CONS string, LIBELLE_UT string, g_usag_pre string, ETAGE_HORS string, FloorNu_RawTax string, Z_Max double, Z_Min double",
    )
    a, b = buildings.standardize_buildings(df).orderBy("building_id").collect()
    assert (a.building_id, a.year_built, a.building_type, a.stories, a.height_m, a.volume) == ("B1", 1990, "flat", 3, 10.0, None)
    assert (b.year_built, b.building_type, b.height_m) == (None, "x", None)
    with pytest.raises(KeyError):
        buildings.standardize_buildings(df.drop("ID_UEV"))
    with pytest.raises(Exception, match="fraction"):
        buildings.standardize_buildings(df.withColumn("ANNEE_CONS", F.lit("1990.5"))).collect()


def test_duplicates_fill_each_other_in_row_order(spark):
    df = spark.createDataFrame([("B1", None, "a", 1), ("B1", 1990, "b", 2), (None, 1, None, 3), (None, 2, "z", 4)], "building_id string, year long, kind string, o int")
    got = {r.building_id: (r.year, r.kind) for r in buildings.collapse_buildings(df, order="o").collect()}
    assert got == {"B1": (1990, "a"), None: (1, "z")}


def test_sources_in_order_and_geometry_from_the_primary(spark):
    make = lambda rows: spark.createDataFrame(rows, "building_id string, year long, geometry string")
    out = buildings.combine_buildings(make([("B1", None, "inv"), ("B2", 1, "inv")]), make([("B1", 1990, "pri")]), make([("B1", 5, "sec"), ("B3", 7, "sec")]))
    assert {r.building_id: (r.year, r.geometry) for r in out.collect()} == {"B1": (1990, "pri"), "B2": (1, "inv"), "B3": (7, "sec")}


def test_hand_over_table(spark):
    known = ["building_id", "building_type", "building_category", "year_built", "stories", "height_m", "footprint_area", "total_floor_area", "volume", "num_dwellings", "fsa_code", "da_code"]
    row = ("B1", "flat", "c", 1990, 4, 12.0, 1.0, 2.0, 3.0, 1, "H1A", None, "1000", None, "old", None)
    schema = "building_id string, building_type string, building_category string, year_built long, stories long, height_m double, footprint_area double, total_floor_area double, volume double, num_dwellings long, fsa_code string, da_code string, CODE_UTILI string, extra string, alias_z string, alias_a string"
    b = buildings.attribute_maps(spark.createDataFrame([row], schema), known)
    assert b.first().aliases == {"z": "old"} and b.first().metadata == {"CODE_UTILI": "1000", "extra": None}
    r = buildings.hub_building_table(b, "montreal", alias_keys=["z", "a"]).first()
    assert (r.function, r.storey_height_m, r.fallback_unit_type, r.fallback_unit_code, r.hub_city_crs) == ("1000", 3.0, "fsa", "H1A", "EPSG:2950")
    assert json.loads(r.metadata_json) == {"CODE_UTILI": "1000", "extra": None} and r.provenance_json is None and (r.alias_z, r.alias_a) == ("old", None)
    assert buildings.hub_building_table(b, "m", with_load=b).first().energy_data_level == "building"


def test_sampling(spark):
    df = spark.range(100).withColumnRenamed("id", "building_id")
    a = [r[0] for r in buildings.sample_rows(df, "building_id", n=7).collect()]
    assert len(a) == 7 and a == [r[0] for r in buildings.sample_rows(df.repartition(9), "building_id", n=7).collect()]
    assert buildings.sample_rows(df, "building_id", fraction=0.001).count() == 1
    with pytest.raises(ValueError):
        buildings.sample_rows(df, "building_id", 0.5, 3)


def test_synthetic_population(spark):
    people = spark.createDataFrame([(" D1", 1), ("D1", 1), ("D1", -1), ("D2", None)], "area string, HID long")
    got = {r.da_code: (r.n_individuals_syn, r.n_households_syn) for r in synpop.summarize_synpop(people).collect()}
    assert got == {"D1": (3, 1), "D2": (1, 0)}
    small = spark.createDataFrame([("D2", True), ("D1", False)], "code string, has_geometry boolean")
    near = spark.createDataFrame([("D1", ["A"])], "code string, nearest array<string>")
    table = synpop.synpop_input(small, near, spark.createDataFrame([("D1", "40"), ("D2", "x")], "code string, population string"), "m")
    rows = {r.da_code: r for r in table.collect()}
    assert (rows["D1"].population_2021, rows["D1"].nearest_fsa_1, rows["D1"].nearest_fsa_2) == (40, "A", None)
    m = synpop.synpop_manifest(table, 3, 4).first()
    assert (m.n_das, m.n_das_with_census, m.n_das_with_geometry, m.population_2021_sum, m.da_codes) == (2, 2, 1, 40, ["D1", "D2"])
    assert synpop.merge_synpop(table, synpop.summarize_synpop(people)).count() == 2
    with pytest.raises(KeyError):
        synpop.merge_synpop(table, people)


@pytest.fixture(scope="module")
def town(spark):
    """20 areas; load follows feature f; the last four have no load."""
    facts, load = [], []
    for k in range(20):
        code = f"A{k:02d}"
        facts += [(code, "f", float(k)), (code, "noise", float(k * 7 % 11)), (code, "flat", 1.0), (code, census.POPULATION, 100.0 + (100 * (k == 17)))]
        if k < 16:
            load += [(code, START + dt.timedelta(days=31 * m, hours=h), (k + 1.0) * (h + 1)) for m in range(3) for h in range(3)]
    c = spark.createDataFrame(facts, "code string, feature string, value double")
    return spark.createDataFrame(load, "code string, ts timestamp_ntz, kwh double"), c, c.select("code").distinct()


def test_features_are_ranked(town):
    load, facts, _ = town
    got = census.select_features(facts, load).collect()
    assert got[0].feature == "f" and got[0].score == pytest.approx(1) and got[0].n_months == 3
    assert {r.feature for r in got} == {"f", "noise"}  # constant ones have too few values
    assert len(census.select_features(facts, load, max_features=1, method="pearson").collect()) == 1


def test_features_of_too_few_areas_are_an_error(town):
    load, facts, _ = town
    with pytest.raises(Exception, match="features need 5 areas"):
        census.select_features(facts, load.where("code < 'A04'")).collect()


def test_imputation_copies_the_nearest_donor(spark, town):
    load, facts, areas = town
    features = spark.createDataFrame([("f", 1.0)], "feature string, score double")
    more = areas.unionByName(spark.createDataFrame([("ZZ",)], "code string"))
    out, report = census.impute_by_census(load, facts, more, features)
    got = {r.code: r for r in report.collect()}
    assert {c: (r.donor, r.scale, r.status) for c, r in got.items()} == {
        "A16": ("A15", 1.0, "imputed"),
        "A17": ("A15", 2.0, "imputed"),
        "A18": ("A15", 1.0, "imputed"),
        "A19": ("A15", 1.0, "imputed"),
        "ZZ": (None, None, "missing_census"),
    }
    assert out.where("code = 'A17'").agg(F.sum("kwh")).first()[0] == 2 * load.where("code = 'A15'").agg(F.sum("kwh")).first()[0]
    assert out.where("code < 'A16'").exceptAll(load).count() == 0 and out.count() == load.count() + 36
    same, none = census.impute_by_census(load, facts, load.select("code"), features)
    assert none.count() == 0 and same.count() == load.count()


def test_distance_is_the_formula(spark):
    facts = spark.createDataFrame([("t", "a", 1.0), ("d1", "a", 2.0), ("d2", "a", 4.0), ("d1", "b", 1.0), ("d2", "b", 1.0), ("t", "b", 9.0), ("d1", "c", 5.0), ("d2", "c", 7.0)], "code string, feature string, value double")
    features = spark.createDataFrame([("a", 0.6), ("b", 0.3), ("c", 0.1)], "feature string, score double")
    pick = lambda *c: spark.createDataFrame([(x,) for x in c], "code string")
    got = {r.donor: r.distance for r in census.donor_distance(facts, features, pick("t"), pick("d1", "d2")).collect()}
    assert got == pytest.approx({"d1": 1.0, "d2": 3.0})  # b has no deviation, c is missing for t


@pytest.mark.parametrize("lacking", [0.0, 0.05, 0.5])
def test_donor_index_gives_the_nearest(lacking):
    """Against all pairs, with features missing on both sides and weights of zero; with few missing most pairs are left out."""
    rng = np.random.default_rng(12)
    centres = rng.normal(0, 4, (30, 4))
    z, own = (centres[rng.integers(0, 30, n)] + rng.normal(0, 0.2, (n, 4)) for n in (3000, 400))
    z[rng.random(z.shape) < lacking / 10], own[rng.random(own.shape) < lacking] = np.nan, np.nan
    z[:50] = z[50:100]  # ties
    own[0], w = np.nan, np.tile([0.5, 0.3, 0.2, 0.0], (400, 1))
    index = census.DonorIndex(z)
    best, found, pairs = index.nearest(own, w)
    share = np.where(np.isnan(own), 0, w)
    share = np.divide(share, share.sum(1, keepdims=True), out=np.zeros_like(share), where=share.sum(1, keepdims=True) > 0)
    far = np.round(index.distances(own, share, np.arange(len(z))), 9)
    assert np.isinf(found[0]) and np.array_equal(np.round(found[1:], 9), far.min(1)[1:])
    assert np.array_equal(best[np.isfinite(found)], far.argmin(1)[np.isfinite(found)])
    assert lacking > 0.1 or pairs < 0.25 * far.size


def test_features_are_judged_on_areas_in_the_census(spark, town):
    """Areas with load that the census lacks don't lower a feature's coverage; too few known areas are an error."""
    load, facts, _ = town
    known = facts.where("code <= 'A09'")
    got = {r.feature: r.score for r in census.select_features(known, load).collect()}
    assert got["f"] == pytest.approx(1)
    assert {r.feature for r in census.select_features(known, load, candidates=["noise"]).collect()} == {"noise"}
    with pytest.raises(Exception, match="features need 5 areas"):
        census.select_features(facts.where("code < 'A04'"), load).collect()


def test_cities_keep_their_weather(spark):
    """Load that follows its own city's weather exactly is explained by it; the census must name the population."""
    rows = [("A", "x", 1.0), ("B", "y", -2.0)]
    hours = spark.range(400).selectExpr("timestamp_ntz'2024-01-01' + make_dt_interval(0, id) as ts", "cast(id * 37 % 41 - 20 as double) as x", "cast(id * 11 % 29 - 9 as double) as y")
    weather = hours.selectExpr("'x' as city", "ts", "x as temperature").union(hours.selectExpr("'y' as city", "ts", "y as temperature"))
    areas = spark.createDataFrame([(city, "fsa", code, 0.0, 0.0) for code, city, _ in rows], "city string, unit string, code string, cx double, cy double")
    load = hours.selectExpr("'fsa' as unit", "'A' as code", "ts", "100 - 2 * least(x - 10, 0) as kwh").union(hours.selectExpr("'fsa'", "'B'", "ts", "100 - 3 * least(y - 8, 0)"))
    facts = spark.createDataFrame([("A", census.POPULATION, 2.0), ("B", census.POPULATION, 4.0)], "code string, feature string, value double")
    c = catalog.Catalog(areas, load, weather, facts)
    fits = {r.code: r for r in catalog.city_tables(c)[0].collect()}
    assert {k: (r.model, round(r.x1, 2), round(r.k1, 3), round(r.r2, 6)) for k, r in fits.items()} == {"A": ("2ch", 10.0, -1.0, 1.0), "B": ("2ch", 8.0, -0.75, 1.0)}
    with pytest.raises(ValueError, match="no feature"):
        catalog.city_tables(c, population="People")


def test_holdout(spark, town):
    load, facts, areas = town
    hourly, monthly = census.evaluate_holdout(load, facts, areas.where("code <> 'A03'"), ["A02", "A03"])
    got = {r.code: r for r in hourly.collect()}
    assert got["A02"].n_obs == 9 and got["A02"].mae > 0 and got["A02"].corr == pytest.approx(1)
    assert got["A03"].n_obs == 0 and got["A03"].rmse is None
    assert {r.code: r.n_obs for r in monthly.collect()}["A02"] == 3
    assert census.holdout_codes([f"c{k}" for k in range(30)]) == census.holdout_codes([f"c{k}" for k in range(29, -1, -1)])


def test_errors_of_pairs(spark):
    df = spark.createDataFrame([("a", 2.0, 3.0), ("a", 0.0, 1.0), ("a", None, 5.0), ("b", 1.0, None)], "k string, truth double, predicted double")
    a, b = census.error_metrics(df, ["k"]).orderBy("k").collect()
    assert (a.n_obs, a.mae, a.rmse, a.mbe, a.mape_pct, a["corr"]) == (2, 1, 1, 1, 50, pytest.approx(1))
    assert (b.n_obs, b.mae, b["corr"]) == (0, None, None)


def test_census_folders_and_aliases(spark, tmp_path):
    for name, head, body in (("one", "COL0 - GEO UID\nCOL1 - Population, 2021\n", '"COL0","COL1"\n" H1A ","100"\n'), ("two", "COL0 - GEO UID\nCOL1 - Population, 2021\nCOL2 - Income / Median\n", '"COL0","COL1","COL2"\n"H1A","7","5"\n"H1B","8","x"\n')):
        (tmp_path / name).mkdir()
        (tmp_path / name / "s.txt").write_text(head)
        (tmp_path / name / "s.csv").write_text(body)
    df = readers.read_census(spark, [str(tmp_path / "one"), str(tmp_path / "two")])
    got = {r.code: (r["Population, 2021"], r["Income / Median"]) for r in df.collect()}
    assert got == {"H1A": ("100", "5"), "H1B": (None, "x")}
    long = {(r.code, r.feature): r.value for r in readers.census_long(df).collect()}
    assert long["H1A", "Population, 2021"] == 100 and long["H1B", "Income / Median"] is None
    with pytest.raises(KeyError):
        readers.read_census(spark, [str(tmp_path / "one")], aliases=["X"])


def test_geojson_in_and_out(spark, tmp_path):
    feature = {"type": "Feature", "properties": {"CFSAUID": " H1A "}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [2, 0], [2, 2], [0, 0]]], [[[5, 5], [6, 5], [6, 6], [5, 5]]]]}}
    point = {"type": "Feature", "properties": {"CFSAUID": "H1B"}, "geometry": {"type": "Point", "coordinates": [3, 4]}}
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [feature, point]}))
    paths = {"m": str(tmp_path / "a.geojson"), "none": str(tmp_path / "b.geojson")}
    with pytest.raises(FileNotFoundError):
        readers.read_geometry(spark, paths)
    a, b = readers.read_geometry(spark, paths, strict=False).orderBy("code").collect()
    assert (a.city, a.code, len(a.rings)) == ("m", "H1A", 2) and (b.rings[0][0].x, b.rings[0][0].y) == (3, 4)
    df = spark.createDataFrame([("B1", square(0, 0, 1), None)], f"building_id string, rings {geometry.RINGS}, year long")
    writers.write_building_geojson(df, str(tmp_path / "out"), "EPSG:2950")
    out = json.loads(spark.read.text(str(tmp_path / "out")).first()[0])
    assert out["properties"] == {"building_id": "B1", "year": None, "crs": "EPSG:2950"} and out["geometry"]["coordinates"][0][0] == [-1, -1]
    for crs, target in ((None, None), ("EPSG:2950", "EPSG:9999"), ("EPSG:9999", "EPSG:4326")):
        with pytest.raises(ValueError):
            writers.write_building_geojson(df, str(tmp_path / "x"), crs, target)


def test_weather_is_coerced_and_its_column_found(spark, tmp_path):
    (tmp_path / "w.csv").write_text("date_time_local,Outdoor Temperature (C)\n2024-01-01 01:00:00,-5\nbad,1\n2024-01-01 00:00:00,x\n")
    got = readers.read_weather(spark, {"m": str(tmp_path / "w.csv")}).collect()
    assert [(r.city, r.ts, r.temperature) for r in got] == [("m", dt.datetime(2024, 1, 1, 1), -5)]


@pytest.mark.parametrize("form", ["parquet", "csv"])
def test_wide_files(spark, tmp_path, form):
    both = series(spark, [1, None], "a").unionByName(series(spark, [3, 4], "b.c"))
    path = str(tmp_path / form)
    writers.write_load_wide(both, path, form)
    got = {(r.code, r.ts): r.kwh for r in readers.read_load_wide(spark, path, form).collect()}
    assert got == {(r.code, r.ts): r.kwh for r in both.collect()}
    with pytest.raises(ValueError):
        readers.read_load_wide(spark, path, "xls")


def test_buildings_by_suffix(spark, tmp_path):
    (tmp_path / "b.csv").write_text("ID_UEV,ANNEE_CONS\nB1,1990\n")
    assert readers.read_buildings(spark, str(tmp_path / "b.csv")).first().year_built == 1990
    with pytest.raises(ValueError):
        readers.read_buildings(spark, "x.gpkg")


def test_shapefile_attributes(spark, tmp_path):
    fields, rows = [(b"ID_UEV", 6), (b"ANNEE_CONS", 6), (b"LIBELLE_UT", 8)], [("B1", "1990", "caf\u00e9"), ("B2", "", "x"), ("B3", "2001", "y")]
    head = struct.pack("<BBBBIHH20x", 3, 124, 1, 1, len(rows), 32 + 32 * len(fields) + 1, 1 + sum(w for _, w in fields))
    head += b"".join(struct.pack("<11sc4xB15x", n, b"C", w) for n, w in fields) + b"\r"
    body = b"".join((b"*" if k == 2 else b" ") + b"".join(v.encode().ljust(w) for v, (_, w) in zip(r, fields)) for k, r in enumerate(rows))
    (tmp_path / "b.dbf").write_bytes(head + body + b"\x1a")
    got = readers.read_buildings(spark, str(tmp_path / "b.shp")).orderBy("building_id").collect()
    assert [(r.building_id, r.year_built, r.building_type) for r in got] == [("B1", 1990, "caf\u00e9"), ("B2", None, "x")]


def test_projection_of_known_points(spark):
    """On the central meridian the northing is the meridian's length: 4984944.378 m to 45 degrees; east and west are symmetric."""
    from gridloom.functions.projection import to_geographic

    df = spark.createDataFrame([(304800.0, 0.9999 * 4984944.378), (304800.0 + 78_000, 5e6), (304800.0 - 78_000, 5e6)], "x double, y double")
    lon, lat = to_geographic(F.col("x"), F.col("y"), "EPSG:2950")
    (a, b), (c, d), (e, f) = [tuple(r) for r in df.select(lon, lat).collect()]
    assert (a, b) == (pytest.approx(-73.5, abs=1e-9), pytest.approx(45.0, abs=1e-8))
    assert d == pytest.approx(f) and c + 73.5 == pytest.approx(-73.5 - e) and 0.95 < c + 73.5 < 1.05


def test_outline_of_areas_with_a_hole(spark):
    """Eight squares around an empty one: a border outside and one inside."""
    squares = [(f"s{k}", 2.0 * (k % 3), 2.0 * (k // 3), 1) for k in range(9) if k != 4]
    areas = units(spark, *squares).withColumn("city", F.lit("m"))
    (r,) = spatial.outline(areas, ["city"]).collect()
    assert sorted(len(x) for x in r.rings) == [4, 12]
    held = spatial.outline(areas, ["city"]).select(*[geometry.contains(F.col("rings"), F.lit(x), F.lit(2.2)).alias(n) for n, x in (("i", 0.1), ("hole", 2.1), ("out", 9.0))]).first()
    assert (held.i, held.hole, held.out) == (True, False, False)


def test_catalog(spark, town):
    load, facts, _ = town
    rows = [("m", "fsa", "A00", 0.0, 0.0), ("l", "fsa", "A00", 9.0, 9.0), ("m", "fsa", "NOLOAD", 1.0, 0.0), ("m", "da", "D1", 0.2, 0.0), ("m", "fsa", "A01", 10.0, 0.0)]
    areas = spark.createDataFrame([(*r, square(r[3], r[4], 1)) for r in rows], "city string, unit string, " + RING)
    unit = load.withColumn("unit", F.lit("fsa"))
    weather = load.select("ts").distinct().select(F.explode(F.array(F.lit("m"), F.lit("l"))).alias("city"), "ts", F.hour("ts").cast("double").alias("temperature"))
    points = spark.createDataFrame([("B1", 9.5, 0.5)], "building_id string, cx double, cy double")
    c = catalog.build_catalog(areas, unit, weather, facts, points, 5.0)
    assert [r.code for r in c.codes().collect()] == ["A00", "A01"] and [r.code for r in c.codes("da").collect()] == ["D1"]
    assert c.area("A00").first().city == "l" and c.nearest.first().nearest == ["A01", "A00"]
    assert (c.buildings.first().fsa_code, c.buildings.first().da_code) == ("A01", "D1")
    with pytest.raises(KeyError):
        c.area("NOLOAD")
    with pytest.raises(ValueError):
        c.codes("city")
    assert [r.code for r in catalog.selected(load, "A00").select("code").distinct().collect()] == ["A00"]
    with pytest.raises(KeyError):
        catalog.selected(load, ["A00", "??"])
    fits, short = catalog.city_tables(c)
    assert fits.count() == 0 and {r.code for r in short.collect()} == {"A00", "A01"}


def test_rebuild(spark):
    rng = np.random.default_rng(0)
    rows, facts = [], []
    for k in range(12):
        facts += [(f"A{k:02d}", "f", float(k)), (f"A{k:02d}", census.POPULATION, 50.0)]
        if k < 10:
            rows += [(f"A{k:02d}", START + dt.timedelta(hours=h), float((k + 1) * (10 + np.sin(h / 24 * 6.283)) + rng.normal(0, 0.01))) for h in range(96)]
    load = spark.createDataFrame(rows, "code string, ts timestamp_ntz, kwh double")
    weather = load.select("ts").distinct().withColumn("temperature", (F.hour("ts") % 5).cast("double"))
    census_ = spark.createDataFrame(facts, "code string, feature string, value double")
    out, qc, report, imputed = catalog.rebuild(load, weather, census_, census_.select("code").distinct())
    assert {r.donor for r in imputed.collect()} == {"A09"} and qc.count() == report.count() == 10
    assert out.count() == 12 * 96 and out.where("kwh is null").count() == 0


def test_rebuild_over_a_clock_change(spark):
    """Four days around the autumn change: the repeated hour stays two rows, and neither is doubled."""
    rows, facts = [], []
    for k in range(8):
        facts += [(f"A{k}", "f", float(k)), (f"A{k}", census.POPULATION, 10.0)]
        for h in range(96 * (k < 6)):
            rows.append((f"A{k}", str(dt.datetime(2024, 11, 1, 4) + dt.timedelta(hours=h)), str(100.0 + k + h % 24)))
    load = readers.long_from_raw(spark.createDataFrame(rows, "CP3 string, DateIntervalUTC string, kWh string"))
    weather = spark.createDataFrame([(dt.datetime(2024, 11, 1) + dt.timedelta(hours=h), 5.0) for h in range(96)], "ts timestamp_ntz, temperature double")
    facts = spark.createDataFrame(facts, "code string, feature string, value double")
    features = spark.createDataFrame([("f", 1.0)], "feature string, score double")
    out, _, _, imputed = catalog.rebuild(load, weather, facts, facts.select("code").distinct(), treatment={"max_iter": 1}, imputation={"features": features}, zone="America/Toronto")
    got = out.groupBy("code", "ts").agg(F.count("kwh").alias("n"), F.max("kwh").alias("kwh")).collect()
    assert {r.ts for r in got if r.n == 2} == {dt.datetime(2024, 11, 3, 1)} and len(got) == 8 * 95
    assert max(r.kwh for r in got if r.code == "A0") < 200 and {r.donor for r in imputed.collect()} == {"A5"}


def test_columns(spark):
    df = spark.createDataFrame([("x", "3", 1)], "a string, `b` string, c int")
    assert columns.rename_first_present(df, "k", ["z", "a"]).columns[0] == "k" and columns.rename_first_present(df, "c", ["a"]) is df
    assert columns.pick_column(df, ["q", "b"]) == "b"
    with pytest.raises(KeyError):
        columns.pick_column(df, ["q"])
    r = df.select(columns.first_numeric(df, ["a", "b"]).alias("n"), columns.first_present(df, ["q"]).alias("p"), columns.number(F.lit("NaN")).alias("m")).first()
    assert (r.n, r.p, r.m) == (3.0, None, None)
    times = spark.createDataFrame([(dt.datetime(2024, 1, d, 23),) for d in (1, 2, 3)], "ts timestamp_ntz")
    assert times.where(columns.between_times("ts", "2024-01-01", "2024-01-02")).count() == 2
    assert times.where(columns.between_times("ts", "2024-01-01 23:00:00", "2024-01-02 22:00:00")).count() == 1


def test_dissolve_and_inspect(spark):
    two = units(spark, ("A", 0, 0, 1), ("A", 5, 0, 1), ("B", 9, 0, 1))
    got = {r.code: len(r.rings) for r in spatial.dissolve(two, ["code"]).collect()}
    assert got == {"A": 2, "B": 1}
    assert readers.inspect_tables({"two": two, "none": two.limit(0)}) == {"two": 3, "none": 0}
    c = spark.createDataFrame([("A", 1), ("A", 1), ("B", 2)], "code string, v int")
    assert readers.first_census_row(c).count() == 2


def test_one_shape_and_one_place_are_looked_up_once(spark, monkeypatch):
    """Copies of units and of points make no pairs of copies; the lowest code of a shape and every point's row stay."""
    seen, real = [], spatial.candidates

    def counted(points, units, *rest):
        seen.append((points.count(), units.count()))
        return real(points, units, *rest)

    monkeypatch.setattr(spatial, "candidates", counted)
    many = units(spark, *[(f"u{k:02d}", k % 2 * 10, 0, 3) for k in reversed(range(40))])
    rows = [(f"B{k}", *[(0.5, 1.0), (11.0, 1.0), (100.0, 0.0), (None, 1.0)][k % 4]) for k in range(80)]
    points = spark.createDataFrame(rows, "building_id string, cx double, cy double")
    got = {r.building_id: r.code for r in spatial.assign_units(points, many, "code", 5.0).collect()}
    assert got == {f"B{k}": ["u00", "u01", "u01", None][k % 4] for k in range(80)}
    shapes = points.withColumn("rings", F.when(F.col("building_id") != "B0", F.array(F.array(F.struct(F.col("cx").alias("x"), F.col("cy").alias("y"))))))
    again = {r.building_id: r.code for r in spatial.assign_units(shapes, many, "code", 5.0).collect()}
    assert again == got and seen == [(3, 2), (4, 2)]


def test_points_in_parts_meet_only_parts_near_them(spark):
    """Parts that overlap hold a point once; points aren't paired with every group."""
    from gridloom.plans import registry

    parts = units(spark, ("r", 0, 0, 3), ("r", 2, 0, 3), ("s", 2, 0, 3), ("t", 50, 50, 3))
    rows = [("a", 1.0, 0.0), ("b", 1.0, 0.0), ("c", -2.5, 0.0), ("d", 20.0, 0.0), ("e", None, 0.0)]
    points = spark.createDataFrame(rows, "building_id string, cx double, cy double")
    got = sorted((r.code, r.building_id) for r in spatial.points_in_parts(points, spatial.dissolve(parts, ["code"]), ["code"], 4.0).collect())
    assert got == [("r", "a"), ("r", "b"), ("r", "c"), ("s", "a"), ("s", "b")]
    plan = registry.QUERIES["dissolve"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "exists(parts" not in plan and "Join LeftOuter, exists" not in plan


def test_footprints_are_tested_once_for_a_place(spark, monkeypatch):
    """As registered, over parts repeated under other keys: as many footprints are looked up as before."""
    from gridloom.plans import fixtures, registry

    seen, candidates, table = [], spatial.candidates, fixtures.table
    monkeypatch.setattr(spatial, "candidates", lambda points, *rest: seen.append(points.count()) or candidates(points, *rest))
    found = registry.QUERIES["assign_footprints"](spark, "/root/testdata/sf0.001").count()
    far = 601 * 557 * 10  # both coordinates repeat
    more = lambda spark, d, name: table(spark, d, name).withColumn("p_partkey", F.explode(F.array(F.col("p_partkey"), F.col("p_partkey") + far))) if name == "part" else table(spark, d, name)
    monkeypatch.setattr(fixtures, "table", more)
    assert registry.QUERIES["assign_footprints"](spark, "/root/testdata/sf0.001").count() == 2 * found and seen[0] == seen[1]


def test_donors_of_several_blocks(spark, monkeypatch):
    """The nearest donor is the same in one block of donors and in many."""
    facts = spark.range(60).selectExpr("cast(id as string) as code", "'f' as feature", "cast(id * 17 % 61 as double) as value")
    features = spark.createDataFrame([("f", 1.0)], "feature string, score double")
    donors, targets = (facts.where(f"cast(code as int) % 5 {c} 0").select("code") for c in ("<>", "="))
    found = []
    for donors_at_once in (census.DONORS, 7):
        monkeypatch.setattr(census, "DONORS", donors_at_once)
        monkeypatch.setattr(census, "BLOCK", 5)
        found.append(sorted(map(tuple, census.nearest_donor(facts, features, targets, donors).collect())))
    assert found[0] == found[1] and len(found[0]) == 12
