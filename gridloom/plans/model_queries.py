"""Queries over models, catalogs and pipelines whose inputs are built so that SQL can state the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.config import Paths
from gridloom.functions.geometry import area
from gridloom.operators import anomalies, buildings, catalog, prism, quality, short_term, spatial, timeseries, weather_model
from gridloom.plans import file_queries as files
from gridloom.plans import fixtures as fx
from gridloom.plans.fixtures import with_tables
from gridloom.plans.registry import ASSIGNED, DAILY, FILL, IMPUTED, MEANS, NEAR, ORACLE, PROFILES, SCORED, _aligned, _residuals, query, rounded
from gridloom.sources import project
from gridloom.storage import fresh_path
from gridloom.streaming.daily import daily_peaks

NORMAL = """w AS (SELECT l.code, l.ts, l.kwh, h.temperature FROM {source} l JOIN weather_hourly h ON h.ts = l.ts),
f AS (SELECT code, CASE WHEN var_pop(temperature) > 0 THEN covar_pop(temperature, kwh) / var_pop(temperature) ELSE 0 END AS b, avg(temperature) AS m FROM w GROUP BY code),
normal AS (SELECT w.code, w.ts, w.kwh - f.b * (w.temperature - f.m) AS kwh FROM w JOIN f USING (code))"""


@query(ORACLE["heating_change_point"])
def prism_table_heating_only(spark, d):
    return rounded(prism.prism_table(fx.load_hourly(spark, d), fx.weather_hourly(spark, d), mode="heating_only"))


@query(with_tables("load_hourly", "SELECT DISTINCT code, 12.0::DOUBLE AS x1, 20.0::DOUBLE AS x2, (50 + length(code))::DOUBLE AS y1, -2.0::DOUBLE AS k1, 1.5::DOUBLE AS k2, 0.0::DOUBLE AS sse FROM load_hourly"))
def prism_fit_of_exact_segments(spark, d):
    """Load that is three segments exactly: the three-segment candidate must find its breaks, level and slopes."""
    t = F.col("temperature")
    y = 50 + F.length("code") - 2 * F.least(t - 12, F.lit(0.0)) + 1.5 * F.greatest(t - 20, F.lit(0.0))
    fits = prism.prism_fit(_aligned(spark, d).withColumn("kwh", y))
    c = F.col("candidates")["3sg"]
    parts = [F.round(c["p"][prism.PARAMETERS.index(p)], 3).alias(p) for p in ("x1", "x2", "y1", "k1", "k2")]
    return fits.select("code", *parts, F.abs(F.round(c["sse"], 3)).alias("sse"))


EXACT = "x AS (SELECT code, i, TIMESTAMP '2024-01-01' + INTERVAL (i) HOUR AS ts, 10 * length(code) + 0.5 * i AS trend, (i % 24 * 7 % 24 - 11.5)::DOUBLE AS seasonal FROM (SELECT DISTINCT code FROM load_hourly), (SELECT unnest(range(240)) AS i))"


def _exact(spark, d):
    """A line plus a daily pattern that sums to 0, which the decomposition must give back."""
    i = F.col("i")
    rows = fx.load_hourly(spark, d).select("code").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(239))))
    ts = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=i)
    return rows.select("code", ts.alias("ts"), (10 * F.length("code") + 0.5 * i + i % 24 * 7 % 24 - 11.5).alias("kwh"))


@query(with_tables("load_hourly", EXACT + " SELECT code, ts, round(trend, 4) AS trend, round(seasonal, 4) AS seasonal, 0.0::DOUBLE AS resid FROM x"))
def stl_of_exact_series(spark, d):
    out = anomalies.stl_decompose(_exact(spark, d), 24)
    return out.select("code", "ts", *[(F.round(c, 4) + 0.0).alias(c) for c in ("trend", "seasonal", "resid")])


@query(with_tables("load_hourly", "SELECT DISTINCT code, 'too_short' AS status, 30 AS n_points, 0 AS n_replaced FROM load_hourly"))
def treat_anomalies_of_short_series(spark, d):
    """Under two periods a series stays as it is and the report says so."""
    short = _exact(spark, d).where("ts < '2024-01-02 06:00:00'")
    treated, report = anomalies.treat_anomalies(short, 24)
    same = treated.exceptAll(short).limit(1)
    return rounded(report.join(same.select("code").distinct(), "code", "left_anti").select("code", "status", "n_points", "n_replaced"))


@query(
    with_tables(
        "load_hourly",
        SCORED
        + """, masked AS (SELECT code, ts, is_anomaly, CASE WHEN NOT is_anomaly THEN kwh END AS v FROM scored),
med AS (SELECT *, coalesce(v, quantile_cont(v, 0.5) OVER (PARTITION BY code ORDER BY ts ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING)) AS kwh FROM masked), """
        + FILL.format(source="med", x="kwh")
        + " SELECT code, ts, is_anomaly, round(y, 6) AS kwh FROM filled",
    )
)
def median_anomalies(spark, d):
    out = anomalies.replace_anomalies(anomalies.score_residuals(_residuals(spark, d), 2.5), "rolling_median", 24)
    return rounded(out.select("code", "ts", "is_anomaly", "kwh"))


@query(with_tables("load_hourly", SCORED + " SELECT code, ts, round(resid, 6) AS resid FROM scored WHERE is_anomaly AND anomaly_direction = 'high'"))
def high_anomalies(spark, d):
    scored = anomalies.score_residuals(_residuals(spark, d), 2.5)
    return rounded(anomalies.anomalies_of(scored, "high").select("code", "ts", "resid"))


def _some_people(spark, d):
    """Populations of users; some are missing or not positive."""
    people = fx.people(spark, d).where("code % 5 > 0")
    return people.select("code", F.when(F.col("code") % 5 == 1, 0.0).otherwise(F.col("population")).alias("population"))


@query(with_tables("load_user", "SELECT code, ts, CASE WHEN code % 5 > 1 THEN round(kwh, 6) END AS kwh FROM load_user"))
def expand_by_population(spark, d):
    """Per head and back: areas without a positive population come back null, not as an error."""
    people = _some_people(spark, d)
    heads = weather_model.per_capita(fx.load_user(spark, d), people, strict=False)
    return rounded(weather_model.expand_by_population(heads, people).select("code", "ts", "kwh"))


@query(
    with_tables(
        "load_user weather_hourly census",
        NORMAL.format(source="load_user")
        + ", "
        + IMPUTED.replace("held AS (SELECT * FROM load_user WHERE code % 10 <> 3)", "held AS (SELECT code, ts, kwh / (100 + code % 97) AS kwh FROM normal WHERE code % 10 <> 3)")
        + " SELECT code, ts, round(kwh * (100 + code % 97), 4) AS kwh FROM (SELECT code, ts, kwh FROM held UNION ALL SELECT code, ts, kwh FROM imputed)",
    )
)
def rebuild_after_treatment(spark, d):
    """The stages of the rebuild that follow the treatment of anomalies: weather, heads, imputation, expansion."""
    load, known = fx.load_user(spark, d), fx.census_long(spark, d)
    people = fx.people(spark, d)
    out, _ = catalog.complete(load.where("code % 10 <> 3"), fx.weather_hourly(spark, d), known, load.select("code").distinct(), people)
    return out.select("code", "ts", F.round("kwh", 4).alias("kwh"))


def _catalog(spark, d):
    """Areas of two cities that share codes, load of two in three, small areas without load, buildings."""
    both = fx.areas(spark, d).withColumn("unit", F.lit("fsa")).withColumn("city", F.explode(F.array(F.lit("x"), F.lit("a"))))
    number = F.col("code").cast("int")
    large = both.where((F.col("city") == "x") | (number % 2 == 0))
    at = lambda dx, dy: F.struct((F.col("cx") + dx).alias("x"), (F.col("cy") + dy).alias("y"))
    ring = F.array(F.array(at(-1, -1), at(1, -1), at(1, 1), at(-1, 1)))
    small = fx.small_areas(spark, d).select("code", ring.alias("rings"), "cx", "cy", F.lit("da").alias("unit"), F.lit("x").alias("city"))
    load = fx.areas(spark, d).where(number % 3 > 0).select(F.lit("fsa").alias("unit"), "code", F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"), F.lit(1.0).alias("kwh"))
    none = spark.createDataFrame([], "city string, ts timestamp_ntz, temperature double"), spark.createDataFrame([], "code string, feature string, value double")
    return catalog.build_catalog(large.unionByName(small), load, *none, fx.building_points(spark, d), 7.0)


CATALOG = "k AS (SELECT * FROM areas WHERE code::INT % 3 > 0)"


@query(with_tables("areas small_areas", CATALOG + " SELECT CASE WHEN code::INT % 2 = 0 THEN 'a' ELSE 'x' END AS city, 'fsa' AS unit, code FROM k UNION ALL SELECT 'x', 'da', code FROM small_areas"))
def catalog_areas(spark, d):
    return _catalog(spark, d).areas.select("city", "unit", "code")


@query(
    with_tables(
        "areas small_areas",
        CATALOG + f""", r AS (SELECT s.code, a.code AS unit, row_number() OVER (PARTITION BY s.code ORDER BY {NEAR}, a.code) AS k FROM small_areas s, k a)
SELECT code, string_agg(unit, ',' ORDER BY k) AS nearest FROM r WHERE k <= 3 GROUP BY code""",
    )
)
def catalog_nearest(spark, d):
    return _catalog(spark, d).nearest.withColumn("nearest", F.array_join("nearest", ","))


@query(
    with_tables(
        "areas small_areas points",
        CATALOG
        + ", l AS ("
        + ASSIGNED.replace("areas a", "k a")
        + "), s AS ("
        + ASSIGNED.replace("areas a", "small_areas a").replace("fsa_code", "da_code").replace("cx - 5", "cx - 1").replace("cx + 5", "cx + 1").replace("cy - 5", "cy - 1").replace("cy + 5", "cy + 1")
        + ") SELECT l.building_id, l.fsa_code, s.da_code FROM l JOIN s USING (building_id)",
    )
)
def catalog_buildings(spark, d):
    return _catalog(spark, d).buildings.select("building_id", "fsa_code", "da_code")


@query(with_tables("areas", "SELECT code FROM areas WHERE code::INT % 3 > 0"))
def catalog_codes(spark, d):
    return _catalog(spark, d).codes("fsa")


@query(with_tables("load_user", "SELECT code, ts, round(kwh, 6) AS kwh FROM load_user WHERE code IN (4, 7)"))
def selected(spark, d):
    return rounded(catalog.selected(fx.load_user(spark, d), [7, 4, 7]))


@query(
    with_tables(
        "areas points",
        """big AS (SELECT a.*, n.n_regionkey AS region FROM areas a JOIN nation n ON lpad(n.n_nationkey::VARCHAR, 2, '0') = a.code)
SELECT region, (SELECT count(*) FROM big b WHERE b.region = r.region) AS n_parts, count(DISTINCT p.building_id) AS n_points FROM (SELECT DISTINCT region FROM big) r
LEFT JOIN points p ON EXISTS (SELECT 1 FROM big b WHERE b.region = r.region AND p.cx BETWEEN b.cx - 7 AND b.cx + 7 AND p.cy BETWEEN b.cy - 7 AND b.cy + 7) GROUP BY region""",
    )
)
def dissolve(spark, d):
    """Regions of areas that overlap: a point that two of a region's areas hold is in it."""
    at = lambda dx, dy: F.struct((F.col("cx") + dx).alias("x"), (F.col("cy") + dy).alias("y"))
    region = fx.table(spark, d, "nation").select(F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("code"), F.col("n_regionkey").cast("long").alias("region"))
    big = fx.areas(spark, d).join(region, "code").withColumn("rings", F.array(F.array(at(-7, -7), at(7, -7), at(7, 7), at(-7, 7))))
    whole = spatial.dissolve(big, ["region"])
    n_parts = whole.select("region", F.size("parts").cast("long").alias("n_parts"))
    held = spatial.points_in_parts(fx.building_points(spark, d), whole, ["region"], 7.0)
    n_points = held.groupBy("region").agg(F.count(F.lit(1)).alias("n_points"))
    return n_parts.join(n_points, "region", "left").select("region", "n_parts", F.coalesce("n_points", F.lit(0)).alias("n_points"))


@query(
    with_tables(
        "areas",
        """r AS (SELECT a.*, n.n_regionkey AS region FROM areas a JOIN nation n ON lpad(n.n_nationkey::VARCHAR, 2, '0') = a.code),
t AS (SELECT a.region, count(*) AS n FROM r a JOIN r b ON a.region = b.region AND abs(a.cx - b.cx) + abs(a.cy - b.cy) = 10 GROUP BY a.region)
SELECT region, 100.0::DOUBLE * count(*) AS area, 4 * count(*) - coalesce(max(t.n), 0) AS n_edges FROM r LEFT JOIN t USING (region) GROUP BY region""",
    )
)
def outline(spark, d):
    """Regions of neighbouring squares: two that share an edge lose it."""
    region = fx.table(spark, d, "nation").select(F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("code"), F.col("n_regionkey").cast("long").alias("region"))
    border = spatial.outline(fx.areas(spark, d).join(region, "code"), ["region"])
    size = F.aggregate(F.transform("rings", lambda r: F.abs(area(F.array(r)))), F.lit(0.0), lambda s, x: s + x)
    edges = F.size(F.flatten("rings")).cast("long")
    return rounded(border.select("region", size.alias("area"), edges.alias("n_edges")))


@query(with_tables("load_hourly", "m AS (SELECT code, avg(kwh) AS x FROM load_hourly GROUP BY code) SELECT n.n_name AS code, round(m.x, 6) AS metric FROM (SELECT n_name FROM nation UNION ALL SELECT DISTINCT code FROM load_hourly) n LEFT JOIN m ON m.code = n.n_name"))
def area_map(spark, d):
    load = fx.load_hourly(spark, d)
    areas = fx.table(spark, d, "nation").select(F.col("n_name").alias("code")).unionByName(load.select("code").distinct())
    return rounded(timeseries.area_map(areas, load))


@query("SELECT 'B' || p_partkey AS code, p_size::DOUBLE AS x, p_retailprice AS y FROM part WHERE p_partkey % 4 > 0")
def scatter(spark, d):
    p, k = fx.table(spark, d, "part"), F.col("p_partkey")
    rows = p.select(F.concat(F.lit("B"), k.cast("string")).alias("code"), F.when(k % 4 > 0, F.col("p_size").cast("string")).otherwise("n/a").alias("s"), "p_retailprice")
    return timeseries.scatter(rows, "s", "p_retailprice")


@query("SELECT 10 AS n, 10 AS known")
def sample_rows(spark, d):
    part = fx.table(spark, d, "part")
    some = buildings.sample_rows(part, "p_partkey", n=10)
    same = buildings.sample_rows(part.repartition(7), "p_partkey", n=10)
    return some.select("p_partkey").distinct().join(same.select("p_partkey"), "p_partkey", "left").agg(F.count(F.lit(1)).alias("n"), F.count("p_partkey").alias("known"))


#: Daily profiles as lists, and time warping by anti-diagonals of the cost table: each from the two before it.
WARPED = """days AS (SELECT area AS code, date, list(y ORDER BY ts) AS p FROM filled GROUP BY 1, 2),
pairs AS (SELECT a.code, a.date, b.date AS other, a.p AS x, b.p AS y FROM days a JOIN days b ON b.code = a.code AND a.date < b.date),
warp(code, date, other, x, y, d, now, last) AS (
  SELECT code, date, other, x, y, 0, list_transform(range(1, 25), lambda r: CASE WHEN r = 1 THEN abs(x[1] - y[1]) ELSE 'inf'::DOUBLE END), list_transform(range(1, 25), lambda r: 'inf'::DOUBLE) FROM pairs
  UNION ALL SELECT code, date, other, x, y, d + 1, list_transform(range(1, 25), lambda r: CASE WHEN d + 2 - r BETWEEN 0 AND 23 THEN abs(x[r] - y[d + 3 - r]) + least(now[r], now[r - 1], last[r - 1]) ELSE 'inf'::DOUBLE END), now
  FROM warp WHERE d < 46),
far AS (SELECT code, date, other, now[24] AS distance FROM warp WHERE d = 46)"""
WARPED_DAYS = PROFILES + FILL.format(source="j", x="kwh") + ", " + WARPED


def _profiles(spark, d):
    return short_term.daily_profiles(fx.load_gappy(spark, d), normalize=False)


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query(recursive(with_tables("load_gappy", WARPED_DAYS + " SELECT code, date::VARCHAR AS date, other::VARCHAR AS other, round(distance, 6) AS distance FROM far")))
def dtw_distance(spark, d):
    """Time warping between all days of each area, in blocks of seven days."""
    return rounded(short_term.dtw_table(_profiles(spark, d), block=7).drop("i", "j"))


@query(
    recursive(
        with_tables(
            "load_gappy",
            WARPED_DAYS
            + """, f AS (SELECT code, date, other, distance FROM far UNION ALL SELECT code, other, date, distance FROM far), sizes AS (SELECT code, day(date) % 3 AS c, count(*) AS n FROM days GROUP BY 1, 2),
m AS (SELECT f.code, f.date, day(f.date) % 3 AS c, n.c AS o, sum(distance) AS far, max(n.n) AS n FROM f JOIN sizes n ON n.code = f.code AND n.c = day(f.other) % 3 GROUP BY ALL),
s AS (SELECT code, date, max(CASE WHEN o = c THEN far / (n - 1) END) AS inside, min(CASE WHEN o <> c THEN far / n END) AS outside FROM m GROUP BY 1, 2)
SELECT code, round(avg((outside - inside) / greatest(outside, inside)), 6) AS silhouette FROM s GROUP BY code""",
        )
    )
)
def silhouette(spark, d):
    """Of each area's days, labelled by the day of the month modulo 3."""
    one_way = short_term.dtw_table(_profiles(spark, d))
    labels = one_way.select("code", "i", "date").union(one_way.select("code", "j", "other")).distinct().select("code", "i", (F.dayofmonth("date") % 3).alias("c"))
    pairs = one_way.select("code", "i", "j", "distance").union(one_way.select("code", "j", "i", "distance"))
    return rounded(short_term.silhouettes(pairs, labels))


TWO = "SELECT code, d.date::DATE::VARCHAR AS date, day(d.date) % 2 = 1 AS with_first, 2 AS k, 1.0::DOUBLE AS silhouette FROM (SELECT DISTINCT code FROM load_hourly), (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-24', INTERVAL 1 DAY)) AS date) d"


@query(with_tables("load_hourly", TWO))
def cluster_profiles_of_two_shapes(spark, d):
    """Days of two shapes, told apart whatever the clusters are called."""
    days = fx.load_hourly(spark, d).select("code").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(23))))
    shape = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: (h * h * (1 + F.col("k") % 2) + h * F.col("k") / 100).cast("double"))
    profiles = days.select("code", F.date_add(F.lit("2024-01-01").cast("date"), F.col("k")).alias("date"), shape.alias("profile"))
    found = short_term.cluster_profiles(profiles, k_max=2)
    first = found.where("date = '2024-01-01'").select("code", F.col("cluster_label").alias("first"))
    same = (F.col("cluster_label") == F.col("first")).alias("with_first")
    return rounded(found.join(first, "code").select("code", "date", same, "k", F.round("silhouette", 1).alias("silhouette")))


@query(
    with_tables(
        "load_gappy",
        PROFILES + FILL.format(source="j", x="kwh") + " SELECT area AS code, date::VARCHAR AS date, 'h' || lpad(arg_max(ts, (y, -ts))::VARCHAR, 2, '0') AS cluster_label FROM filled GROUP BY 1, 2",
    )
)
def label_days(spark, d):
    """Days labelled by a user's function: the hour of the highest load."""
    profiles = short_term.daily_profiles(fx.load_gappy(spark, d), normalize=False)
    return rounded(short_term.label_days(profiles, lambda p: f"h{int(p.argmax()):02d}"))


@query(with_tables("load_hourly", "l AS (SELECT code, date_trunc('day', ts)::TIMESTAMP AS day, ts, kwh FROM load_hourly), e AS (SELECT max(day) AS last FROM l) SELECT code, day, round(max(kwh), 6) AS peak_load, round(max(kwh) FILTER (WHERE hour(ts) BETWEEN 6 AND 11), 6) AS am_peak, round(max(kwh) FILTER (WHERE hour(ts) BETWEEN 16 AND 21), 6) AS pm_peak, count(*) AS n FROM l, e WHERE day < last GROUP BY 1, 2"))
def stream_daily_peaks(spark, d):
    """The stream over files, to its end: the last day isn't final."""
    path, out, mark = (fresh_path(spark, f"stream-{x}") for x in ("in", "out", "mark"))
    load = fx.load_hourly(spark, d).select("code", F.col("ts").cast("timestamp").alias("ts"), "kwh")
    load.write.parquet(path)
    peaks = daily_peaks(spark.readStream.schema(load.schema).parquet(path))
    peaks.writeStream.outputMode("append").format("parquet").option("checkpointLocation", mark).trigger(availableNow=True).start(out).awaitTermination()
    found = spark.read.schema(peaks.schema).parquet(out)
    return rounded(found.withColumn("day", F.col("day").cast("timestamp_ntz")))


@query(with_tables("areas", "SELECT 'fsa' AS unit, code, cx, cy, 72 AS n_hours, 2 AS n_features FROM areas WHERE code::INT % 2 = 0"))
def load_project(spark, d):
    areas = fx.areas(spark, d)
    raw = areas.where(F.col("code").cast("int") % 2 == 0).withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(71))))
    at = F.lit("2024-11-02").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("h"))
    path, weather = fresh_path(spark, "load"), fresh_path(spark, "weather")
    raw.select(F.col("code").alias("CP3"), at.cast("string").alias("DateIntervalUTC"), F.lit(1.0).alias("kWh")).write.parquet(path)
    spark.createDataFrame([("2024-11-02 00:00:00", "1")], "date_time_local string, temperature string").write.option("header", True).csv(weather)
    shapes = files._geojson(spark, areas, [F.col("code").alias("CFSAUID")], fresh_path(spark, "areas"))
    facts = files._census_folder(spark, areas.select("code", F.lit("5"), F.lit("6")), ["GEO UID", "Income", "Population"])
    c = project.load_project(spark, Paths(path, {"m": weather}, {"m": shapes}, [facts]))
    n = c.load.groupBy("unit", "code").agg(F.count(F.lit(1)).alias("n_hours"))
    m = c.census.groupBy("code").agg(F.count("value").alias("n_features"))
    return rounded(c.areas.join(n, ["unit", "code"]).join(m, "code").select("unit", "code", "cx", "cy", "n_hours", "n_features"))
