"""Queries over sources and sinks: each writes its files from the driver tables to the shared folder and reads them back."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import functions as F

from gridloom.functions import columns, geometry, projection
from gridloom.operators import buildings, spatial, timeseries
from gridloom.operators.short_term import daily_metrics
from gridloom.plans import fixtures as fx
from gridloom.plans.fixtures import with_tables
from gridloom.plans.registry import DAILY, FILL, ROUNDED, query, rounded
from gridloom.sources import readers, writers
from gridloom.storage import fresh_path

ZONE = readers.ZONE


def _raw(spark, d):
    """Readings over three days around each clock change, hour by hour in UTC."""
    e = fx.table(spark, d, "events")
    base = F.when(F.col("event_id") % 2 == 0, F.lit("2024-11-02")).otherwise("2024-03-09").cast("timestamp_ntz")
    at = base + F.make_dt_interval(hours=(F.col("event_id") * 7 % 72).cast("int"))
    return e.select(F.concat(F.lit(" "), "event_type").alias("CP3"), at.cast("string").alias("DateIntervalUTC"), F.col("value").cast("string").alias("kWh"))


RAW = """raw AS (SELECT event_type AS code, CASE WHEN event_id % 2 = 0 THEN TIMESTAMP '2024-11-02' ELSE TIMESTAMP '2024-03-09' END + INTERVAL (event_id * 7 % 72) HOUR AS utc, value FROM events),
loc AS (SELECT code, utc, utc - INTERVAL (CASE WHEN utc < TIMESTAMP '2024-03-10 07:00:00' OR utc >= TIMESTAMP '2024-11-03 06:00:00' THEN 5 ELSE 4 END) HOUR AS ts, sum(value) AS kwh FROM raw GROUP BY ALL)"""


@query(f"WITH {RAW} SELECT code, ts, utc, round(kwh, 6) AS kwh FROM loc")
def long_from_raw_load(spark, d):
    return rounded(readers.long_from_raw(_raw(spark, d)))


@query(f"WITH {RAW} SELECT code, ts, utc, round(kwh, 6) AS kwh FROM loc")
def read_load(spark, d):
    path = fresh_path(spark, "raw")
    _raw(spark, d).write.parquet(path)
    return rounded(readers.read_load(spark, path))


@query(f"WITH {RAW}, p AS (SELECT code, ts, kwh, utc FROM loc), " + DAILY.format(source="p").replace("ORDER BY ts", "ORDER BY utc") + f" SELECT code, date::VARCHAR AS date, {ROUNDED} FROM daily")
def daily_metrics_of_clock_changes(spark, d):
    return rounded(daily_metrics(readers.long_from_raw(_raw(spark, d)), order="utc").drop("dtw_cluster_label"))


WEATHER = """w AS (SELECT b + INTERVAL (k) HOUR AS here, ((k * 5 + day(b)) % 17 - 3)::DOUBLE AS temperature FROM (SELECT unnest([TIMESTAMP '2024-03-09', TIMESTAMP '2024-11-02']) AS b), (SELECT unnest(range(72)) AS k)),
i AS (SELECT CASE WHEN here = TIMESTAMP '2024-03-10 02:00:00' THEN TIMESTAMP '2024-03-10 07:00:00' WHEN here < TIMESTAMP '2024-03-10 02:00:00' OR here > TIMESTAMP '2024-11-03 01:00:00' THEN here + INTERVAL 5 HOUR
  ELSE here + INTERVAL 4 HOUR END AS ts, temperature FROM w WHERE here <> TIMESTAMP '2024-11-03 01:00:00'),
j AS (SELECT loc.code, loc.utc AS ts, loc.kwh, t.temperature FROM loc LEFT JOIN (SELECT ts, avg(temperature) AS temperature FROM i GROUP BY ts) t ON t.ts = loc.utc)"""


@query(f"WITH {RAW}, {WEATHER}, " + FILL.format(source="j", x="temperature") + " SELECT code, ts, round(kwh, 6) AS kwh, round(y, 6) AS temperature FROM filled WHERE y IS NOT NULL")
def align_weather_of_zone(spark, d):
    """Weather in local time without zone: an hour that spring skips moves to its end, one that autumn repeats but that is there once is left out."""
    load = readers.long_from_raw(_raw(spark, d)).select("code", F.col("utc").alias("ts"), "kwh")
    k, base = F.col("id").cast("int") % 72, F.when(F.col("id") < 72, F.lit("2024-03-09")).otherwise("2024-11-02").cast("timestamp_ntz")
    weather = spark.range(144).select((base + F.make_dt_interval(hours=k)).alias("ts"), ((k * 5 + F.day(base)) % 17 - 3).cast("double").alias("temperature"))
    return rounded(timeseries.align_weather(load, weather, zone=ZONE).select("code", "ts", "kwh", "temperature"))


WIDE = "g AS (SELECT c.code, t.ts FROM (SELECT DISTINCT code FROM load_hourly) c, (SELECT DISTINCT ts FROM load_hourly) t) SELECT g.code, g.ts, round(l.kwh, 6) AS kwh FROM g LEFT JOIN load_hourly l ON l.code = g.code AND l.ts = g.ts"


@query(with_tables("load_hourly", WIDE))
def read_load_wide_csv(spark, d):
    path = fresh_path(spark, "wide")
    writers.write_load_wide(fx.load_hourly(spark, d), path, "csv")
    return rounded(readers.read_load_wide(spark, path, "csv"))


@query(with_tables("load_hourly", WIDE))
def read_load_fallback(spark, d):
    """A table without the raw columns is read as a wide one."""
    path = fresh_path(spark, "wide")
    writers.write_load_wide(fx.load_hourly(spark, d), path)
    return rounded(readers.read_load(spark, path))


@query(with_tables("weather_hourly", "SELECT c.city, ts, temperature + c.more AS temperature FROM weather_hourly, (VALUES ('a', 0.0::DOUBLE), ('b', 1.0::DOUBLE)) AS c(city, more) WHERE hour(ts) <> 3"))
def read_weather(spark, d):
    """Two cities; one names its temperature otherwise, and text that isn't a number or a time drops out."""
    w, paths = fx.weather_hourly(spark, d), {}
    for city, name, more in (("a", "temperature", 0.0), ("b", "Outdoor Temperature (C)", 1.0)):
        paths[city] = fresh_path(spark, f"weather-{city}")
        text = F.when(F.hour("ts") == 3, F.lit("x")).otherwise((F.col("temperature") + more).cast("string"))
        rows = w.select(F.col("ts").cast("string").alias("date_time_local"), text.alias(name))
        rows.unionByName(spark.createDataFrame([("bad", "1")], ["date_time_local", name])).write.option("header", True).csv(paths[city])
    return readers.read_weather(spark, paths)


def _census_folder(spark, rows, names):
    """A folder with a CSV of columns COL0, COL1, ... and a text that names them."""
    path = fresh_path(spark, "census")
    rows.toDF(*[f"COL{k}" for k in range(len(names))]).write.option("header", True).csv(path)
    lines = [("Characteristics",), *[(f"COL{k} - {n}",) for k, n in enumerate(names)]]
    spark.createDataFrame(lines, "value string").coalesce(1).write.mode("append").text(path)
    return path


CENSUS_FILES = """one AS (SELECT c_custkey::VARCHAR AS code, round(c_acctbal, 2) AS balance FROM customer WHERE c_custkey % 3 > 0), two AS (
  SELECT c_custkey::VARCHAR AS code, CASE WHEN c_custkey % 5 > 0 THEN c_nationkey::DOUBLE END AS nation FROM customer WHERE c_custkey % 2 = 0),
joined AS (SELECT coalesce(one.code, two.code) AS code, balance, nation FROM one FULL JOIN two ON one.code = two.code)
SELECT code, unnest(['Balance / Total', 'Nation']) AS feature, unnest([balance, nation]) AS value FROM joined"""


def _read_census(spark, d, name, aliases):
    c, k = fx.table(spark, d, "customer"), F.col("c_custkey")
    code = F.concat(F.lit(" "), k.cast("string"), F.lit(" "))
    one = c.where(k % 3 > 0).select(code, F.round("c_acctbal", 2))
    nation = F.when(k % 5 > 0, F.col("c_nationkey").cast("string")).otherwise("..")
    two = c.where(k % 2 == 0).select(code, nation, F.lit("9"))
    folders = [_census_folder(spark, one, [name, "Balance / Total"]), _census_folder(spark, two, [name, "Nation", "Balance / Total"])]
    return readers.census_long(readers.read_census(spark, folders, aliases))


@query(f"WITH {CENSUS_FILES}")
def read_census(spark, d):
    return _read_census(spark, d, "GEO UID", readers.FSA_ALIASES)


@query(f"WITH {CENSUS_FILES}")
def read_census_of_small_areas(spark, d):
    return _read_census(spark, d, "DAUID21", readers.DA_ALIASES)


@query("SELECT c_nationkey::VARCHAR AS code, min(c_custkey) AS place, arg_min(c_name, c_custkey) AS name, arg_min(c_mktsegment, c_custkey) AS segment FROM customer WHERE c_custkey % 4 > 0 GROUP BY c_nationkey")
def first_census_row(spark, d):
    c = fx.table(spark, d, "customer").where("c_custkey % 4 > 0").repartition(5)
    rows = c.select(F.col("c_nationkey").cast("string").alias("code"), F.col("c_custkey").alias("place"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return readers.first_census_row(rows, order="place")


def _geojson(spark, rows, properties, path):
    """One GeoJSON document of rows' rings and some of their columns."""
    corners = F.transform("rings", lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"])))
    shape = F.struct(F.lit("Polygon").alias("type"), corners.alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), shape.alias("geometry"))
    whole = rows.agg(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(feature).alias("features")).alias("c"))
    whole.select(F.to_json("c").alias("value")).coalesce(1).write.text(path)
    return path


def _read_areas(spark, d, name, aliases, strict):
    code = F.concat(F.lit(" "), "code", F.lit(" ")).alias(name)
    paths = {"m": _geojson(spark, fx.areas(spark, d), [code], fresh_path(spark, "areas"))}
    if not strict:
        paths["none"] = fresh_path(spark, "missing")
    found = spatial.with_centroid(readers.read_geometry(spark, paths, aliases, strict))
    return rounded(found.select("city", "code", "cx", "cy", F.size(F.col("rings")[0]).alias("corners")))


AREAS = with_tables("areas", "SELECT 'm' AS city, code, cx, cy, 4 AS corners FROM areas")


@query(AREAS)
def read_geometry(spark, d):
    return _read_areas(spark, d, "CFSAUID", readers.FSA_ALIASES, True)


@query(AREAS)
def read_geometry_of_small_areas(spark, d):
    """A city whose file is missing is left out."""
    return _read_areas(spark, d, "DAUID", readers.DA_ALIASES, False)


STANDARD = ("building_id", "building_type", "building_category", "year_built", "stories", "total_floor_area", "height_m")
BUILDINGS = with_tables("standard", "SELECT * EXCLUDE (p_partkey) REPLACE (year_built::DOUBLE AS year_built) FROM standard")


def _standard(df):
    return df.select(*STANDARD).withColumn("year_built", F.col("year_built").cast("double"))


@query(BUILDINGS)
def read_buildings_parquet(spark, d):
    path = fresh_path(spark, "buildings") + ".parquet"
    fx.raw_buildings(spark, d).write.parquet(path)
    return _standard(readers.read_buildings(spark, path))


@query(BUILDINGS)
def read_buildings_csv(spark, d):
    path = fresh_path(spark, "buildings") + ".csv"
    fx.raw_buildings(spark, d).write.option("header", True).csv(path)
    return _standard(readers.read_buildings(spark, path))


def _footprints(spark, d):
    """raw buildings with a square of 10 m each, in the plane of EPSG:2950."""
    k = F.substring(F.trim("ID_UEV"), 2, 20).cast("long")
    x, y = (290000 + k * 17 % 6010).cast("double"), (5030000 + k * 31 % 5570).cast("double")
    at = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    return fx.raw_buildings(spark, d).withColumn("rings", F.array(F.array(at(-5, -5), at(5, -5), at(5, 5), at(-5, 5))))


def _building_file(spark, d):
    raw = _footprints(spark, d)
    return _geojson(spark, raw, [c for c in raw.columns if c != "rings"], fresh_path(spark, "buildings") + ".geojson")


@query(BUILDINGS)
def read_buildings_geojson(spark, d):
    return _standard(readers.read_buildings(spark, _building_file(spark, d)))


@query(with_tables("standard", "SELECT building_id, building_type, height_m, (290000 + p_partkey * 17 % 6010)::DOUBLE AS cx, (5030000 + p_partkey * 31 % 5570)::DOUBLE AS cy FROM standard"))
def read_building_geometry(spark, d):
    found = spatial.with_centroid(readers.read_building_geometry(spark, _building_file(spark, d)))
    return rounded(found.select("building_id", "building_type", "height_m", "cx", "cy"), 3)


def _degrees_sql(x, y, system):
    """projection.to_geographic in SQL: longitude and latitude."""
    meridian, scale, east, north = projection.SYSTEMS[system]
    radius, inward, upward = projection.series()
    a, b = f"(({y} - {north!r}::DOUBLE) / {scale * radius!r}::DOUBLE)", f"(({x} - {east!r}::DOUBLE) / {scale * radius!r}::DOUBLE)"
    xi = " - ".join([a, *[f"{c!r}::DOUBLE * sin({2 * j} * {a}) * cosh({2 * j} * {b})" for j, c in enumerate(inward, 1)]])
    eta = " - ".join([b, *[f"{c!r}::DOUBLE * cos({2 * j} * {a}) * sinh({2 * j} * {b})" for j, c in enumerate(inward, 1)]])
    chi = f"asin(sin({xi}) / cosh({eta}))"
    lat = " + ".join([chi, *[f"{c!r}::DOUBLE * sin({2 * j} * {chi})" for j, c in enumerate(upward, 1)]])
    return f"{meridian!r}::DOUBLE + degrees(atan2(sinh({eta}), cos({xi})))", f"degrees({lat})"


_LON, _LAT = _degrees_sql("x", "y", "EPSG:2950")


@query(
    f"""WITH p AS (SELECT 'B' || p_partkey AS building_id, (290000 + p_partkey * 17 % 6010 - 5)::DOUBLE AS x, (5030000 + p_partkey * 31 % 5570 - 5)::DOUBLE AS y FROM part)
SELECT building_id, 'EPSG:4326' AS crs, round({_LON}, 8) AS lon, round({_LAT}, 8) AS lat FROM p"""
)
def building_geojson(spark, d):
    """The export as one document in degrees, read again."""
    path = fresh_path(spark, "export")
    standard = buildings.standardize_buildings(_footprints(spark, d)).select("building_id", "rings")
    writers.write_feature_collection(standard, path, "EPSG:2950")
    schema = "properties map<string,string>, geometry struct<coordinates:array<array<array<double>>>>"
    lines = spark.read.text(path).where("value like '%\"Feature\"%'")  # a feature is a line of a part of the document
    f = lines.select(F.from_json(F.regexp_replace("value", "^,", ""), schema).alias("f"))
    corner = F.col("f.geometry.coordinates")[0][0]
    props = F.col("f.properties")
    return rounded(f.select(props["building_id"].alias("building_id"), props["crs"].alias("crs"), corner[0].alias("lon"), corner[1].alias("lat")), 8)


@query(with_tables("areas", "SELECT code, cx, cy, n FROM areas, (SELECT unnest([1, 2]) AS n)"))
def parse_wkb(spark, d):
    """Areas as polygons in hexadecimal WKB, read back; n tells the byte order."""

    @F.pandas_udf("string")
    def packed(x: pd.Series, y: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for a, b, k in zip(x, y, n, strict=True):
            order = "<" if k == 1 else ">"
            corners = [v for dx, dy in ((-5, -5), (5, -5), (5, 5), (-5, 5)) for v in (a + dx, b + dy)]
            out.append((struct.pack("B", k == 1) + struct.pack(f"{order}III8d", 3, 1, 4, *corners)).hex())
        return pd.Series(out)

    shapes = fx.areas(spark, d).drop("rings").withColumn("n", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("wkb", packed("cx", "cy", "n"))
    found = shapes.select("code", "n", geometry.parse_wkb("wkb").alias("rings"))
    return rounded(spatial.with_centroid(found).select("code", "cx", "cy", "n"))


@query("SELECT n_name AS name, n_nationkey AS code FROM nation")
def rename_first_present(spark, d):
    n = columns.rename_first_present(fx.table(spark, d, "nation").drop("n_regionkey"), "name", ["nom", "n_name", "n_nationkey"])
    return rounded(n.withColumnRenamed(columns.pick_column(n, ["code", "n_nationkey"]), "code"))


@query(with_tables("load_hourly", "SELECT code, ts, CASE WHEN kwh - 100 >= 0 THEN round(kwh - 100, 6) END AS kwh FROM load_hourly"))
def clip_negatives(spark, d):
    return rounded(columns.clip_negatives(fx.load_hourly(spark, d).withColumn("kwh", F.col("kwh") - 100)))


@query("SELECT name, kind != 'missing' AS exists, kind, rows FROM (VALUES ('files', 'dir', 25), ('none', 'missing', 0)) AS t(name, kind, rows)")
def inspect_paths(spark, d):
    paths = {"files": fresh_path(spark, "seen"), "none": fresh_path(spark, "unseen")}
    fx.areas(spark, d).coalesce(1).write.parquet(paths["files"])
    n = readers.inspect_tables({"files": spark.read.parquet(paths["files"])})
    found = readers.inspect_paths(spark, paths).where("kind = 'missing' or n_bytes > 0")
    return found.select("name", "exists", "kind", F.when(F.col("name") == "files", n["files"]).otherwise(0).alias("rows"))
