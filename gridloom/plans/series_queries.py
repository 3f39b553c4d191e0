"""Queries over long series and large groups, segmented fits, and cities with weather of their own, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.operators import anomalies, catalog, census, prism, quality, ranges, spatial, timeseries
from gridloom.operators.census import POPULATION
from gridloom.plans import fixtures as fx
from gridloom.plans.fixtures import with_tables
from gridloom.plans.model_queries import CATALOG, _catalog
from gridloom.plans.prism_sql import FITS, PARTS, prism_sql
from gridloom.plans.registry import DAILY, ERRORS, FEATURES, FILL, IMPUTED, MEANS, NEAR, ROUNDED, _aligned, query, rounded
from gridloom.plans.stl_sql import stl_sql
from gridloom.storage import fresh_path
from gridloom.streaming.daily import daily_metrics_stream

# --- long series and large groups -------------------------------------------------------------------------------------

#: Hourly load of all areas as one series, some hours missing.
WHOLE = "whole AS (SELECT 'all' AS code, ts, CASE WHEN (hour(ts) * 7 + day(ts)) % 5 > 1 THEN sum(kwh) END AS kwh FROM load_hourly GROUP BY ts)"


def _whole(spark, d):
    total = fx.load_hourly(spark, d).groupBy("ts").agg(F.sum("kwh").alias("kwh"))
    some = F.when((F.hour("ts") * 7 + F.dayofmonth("ts")) % 5 > 1, F.col("kwh"))
    return total.select(F.lit("all").alias("code"), "ts", some.alias("kwh"))


@query(with_tables("load_hourly", WHOLE + ", " + FILL.format(source="whole", x="kwh") + " SELECT code, ts, round(y, 6) AS kwh FROM filled"))
def interpolate_long_series(spark, d):
    """One series in 12 ranges of time."""
    return rounded(timeseries.interpolate_both(_whole(spark, d), ranges=12))


@query(with_tables("load_hourly", WHOLE + ", " + FILL.format(source="whole", x="kwh") + " SELECT code, ts, round(CASE WHEN i - a <= 1 THEN ax END, 6) AS kwh FROM filled"))
def ffill_long_series(spark, d):
    return rounded(timeseries.ffill(_whole(spark, d), limit=1, ranges=5))


@query(
    """SELECT l_returnflag AS flag, round(quantile_cont(l_extendedprice, 0.02), 6) AS low, round(quantile_cont(l_extendedprice, 0.5), 6) AS mid,
  round(quantile_cont(l_extendedprice, 0.98), 6) AS high FROM lineitem GROUP BY l_returnflag"""
)
def quantiles(spark, d):
    """Exact quantiles of three groups that hold the whole table."""
    rows = fx.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_extendedprice")
    return rounded(ranges.quantiles(rows, "l_extendedprice", {"low": 0.02, "mid": 0.5, "high": 0.98}, ["flag"]))


@query("SELECT round(quantile_cont(quantity, 0.25), 6) AS q1, round(quantile_cont(quantity, 0.75), 6) AS q3 FROM sale_lines WHERE quantity IS NOT NULL")
def quantiles_of_repeated_values(spark, d):
    """Of a whole column whose values repeat, with nulls."""
    return rounded(ranges.quantiles(fx.table(spark, d, "sale_lines"), "quantity", {"q1": 0.25, "q3": 0.75}))


@query(
    with_tables(
        "load_gappy",
        """b AS (SELECT code, time_bucket(INTERVAL 5 HOUR, ts, (SELECT date_trunc('day', min(ts))::TIMESTAMP FROM load_gappy)) AS ts, avg(kwh) AS kwh FROM load_gappy WHERE hour(ts) % 12 > 5 GROUP BY 1, 2),
g AS (SELECT c.code, t.ts FROM (SELECT DISTINCT code FROM b) c, (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 5 HOUR)) AS ts FROM b) t)
SELECT g.code, g.ts, round(b.kwh, 6) AS kwh FROM g LEFT JOIN b ON b.code = g.code AND b.ts = g.ts""",
    )
)
def resample_hours(spark, d):
    """Means of bins of five hours, those without a row too."""
    return rounded(timeseries.resample(fx.load_gappy(spark, d).where("hour(ts) % 12 > 5"), "5 hours", "mean"))


@query(
    with_tables(
        "load_daily",
        """s AS (SELECT code, ts, kwh FROM load_daily WHERE code % 20 = 3 AND month(ts) <> 4), o AS (SELECT date_trunc('month', min(ts)) AS o FROM s),
b AS (SELECT code, (o + to_months((datediff('month', o, ts) // 2 * 2)::INT))::TIMESTAMP AS ts, sum(kwh) AS kwh FROM s, o GROUP BY 1, 2),
g AS (SELECT c.code, t.ts FROM (SELECT DISTINCT code FROM b) c, (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 2 MONTH)) AS ts FROM b) t)
SELECT g.code, g.ts, round(coalesce(b.kwh, 0), 3) AS kwh FROM g LEFT JOIN b ON b.code = g.code AND b.ts = g.ts""",
    )
)
def resample_months(spark, d):
    """Sums of bins of two months; an empty one is 0."""
    return rounded(timeseries.resample(fx.load_daily(spark, d).where("code % 20 = 3 and month(ts) <> 4"), "2 months", "sum"), 3)


@query(with_tables("full_load", "q AS (SELECT code, count(kwh) / count(*) AS coverage FROM full_load GROUP BY code) SELECT code, round(coverage, 8) AS coverage, row_number() OVER (ORDER BY coverage, code) AS place FROM q"))
def qc_by_coverage(spark, d):
    """The profile in order; its places are taken from the order of the rows."""
    qc = quality.by_coverage(quality.qc_profile(fx.load_gappy(spark, d))).withColumn("at", F.monotonically_increasing_id())
    return rounded(qc.select("code", "coverage", F.row_number().over(Window.orderBy("at")).alias("place")), 8)


# --- segmented fits ---------------------------------------------------------------------------------------------------


def _fits(df):
    parts = {p: 4 for p in prism.PARAMETERS} | {"sse": 3}
    return df.select(*[F.round(c, parts.get(c, 6)).alias(c) if k == "double" else F.col(c).cast("long").alias(c) if k == "int" else F.col(c) for c, k in df.dtypes])


FITTED = f"SELECT {FITS} FROM fits"


@query(with_tables("aligned", prism_sql("aligned") + " " + FITTED))
def prism_fit(spark, d):
    return _fits(prism.prism_fit(_aligned(spark, d)).drop("candidates"))


@query(with_tables("aligned", prism_sql("aligned") + f" SELECT code, model, valid, n::BIGINT AS n_points, round(sse, 3) AS sse, {PARTS} FROM candidates"))
def prism_candidates(spark, d):
    """All five models of each area."""
    return _fits(prism.prism_candidates(_aligned(spark, d)).select("code", "model", "valid", "n_points", "sse", *prism.PARAMETERS))


#: Load with a response of each kind: the area's code says which.
SHAPED = """shaped AS (SELECT code, temperature, kwh / 50 + 40 + CASE WHEN length(code) % 5 <> 1 THEN 3 * greatest(11 - temperature, 0) ELSE 0 END
  + CASE WHEN length(code) % 5 <> 2 THEN 4 * greatest(temperature - 18, 0) ELSE 0 END - CASE WHEN length(code) % 5 > 2 THEN 3.5 * greatest(-6 - temperature, 0) ELSE 0 END AS kwh FROM aligned)"""


@query(with_tables("aligned", SHAPED + ", " + prism_sql("shaped") + " " + FITTED))
def prism_table(spark, d):
    """Areas that heat, cool, or saturate in the cold, beside the noise of the load table."""
    load, t, kind = fx.load_hourly(spark, d), F.col("temperature"), F.length("code") % 5
    heat, cool, cold = 3 * F.greatest(11 - t, F.lit(0.0)), 4 * F.greatest(t - 18, F.lit(0.0)), 3.5 * F.greatest(-6 - t, F.lit(0.0))
    shaped = F.col("kwh") / 50 + 40 + F.when(kind != 1, heat).otherwise(0) + F.when(kind != 2, cool).otherwise(0) - F.when(kind > 2, cold).otherwise(0)
    weather = fx.weather_hourly(spark, d)
    table = prism.prism_table(load.join(weather, "ts").select("code", "ts", shaped.alias("kwh")), weather)
    return _fits(table.drop("candidates", "heating_change_point_temp_c", "baseload_intercept", "heating_slope_per_hdd", "cooling_slope_per_cdd"))


GRID = "t AS (SELECT -20 + i * 0.5::DOUBLE AS t FROM (SELECT unnest(range(101)) AS i))"


@query(
    with_tables(
        "aligned",
        SHAPED + ", " + prism_sql("shaped") + ", " + GRID + """, y AS (SELECT code, t, sqrt(sse / (n - 1)) AS sd, CASE WHEN model IN ('3be', '4sg') AND t <= x0 THEN y0 + k0 * (t - x0)
  ELSE y1 + CASE WHEN model <> '2cl' THEN k1 * least(t - x1, 0) ELSE 0 END + CASE WHEN model IN ('2cl', '3sg', '4sg') THEN k2 * greatest(t - x2, 0) ELSE 0 END END AS v
  FROM (SELECT * REPLACE (round(x0, 4) AS x0, round(x1, 4) AS x1, round(x2, 4) AS x2, round(y0, 4) AS y0, round(y1, 4) AS y1, round(k0, 4) AS k0, round(k1, 4) AS k1, round(k2, 4) AS k2) FROM fits), t)
SELECT code, t AS temperature, round(v, 5) AS fitted, round(v - 1.96 * sd, 5) AS lower, round(v + 1.96 * sd, 5) AS upper FROM y""",
    )
)
def prism_curve(spark, d):
    """Curves of the fits of a table."""
    load, t, kind = _aligned(spark, d), F.col("temperature"), F.length("code") % 5
    heat, cool, cold = 3 * F.greatest(11 - t, F.lit(0.0)), 4 * F.greatest(t - 18, F.lit(0.0)), 3.5 * F.greatest(-6 - t, F.lit(0.0))
    shaped = F.col("kwh") / 50 + 40 + F.when(kind != 1, heat).otherwise(0) + F.when(kind != 2, cool).otherwise(0) - F.when(kind > 2, cold).otherwise(0)
    return rounded(prism.prism_curve(prism.prism_fit(load.withColumn("kwh", shaped)), -20.0, 30.0, 101), 5)


# --- cities with weather of their own ---------------------------------------------------------------------------------

#: Two cities: areas by the parity of {parity}, each with a weather that isn't the other's.
CITIES = """weathers AS (SELECT 'x' AS city, ts, temperature FROM weather_hourly UNION ALL SELECT 'y', ts, ((day(ts) * 11 + hour(ts) * 5) % 37 - 12)::DOUBLE FROM weather_hourly),
w AS (SELECT l.code, l.ts, l.kwh, h.temperature FROM {source} l JOIN weathers h ON h.ts = l.ts AND h.city = CASE WHEN {parity} % 2 = 0 THEN 'x' ELSE 'y' END)"""
NORMAL = """, f AS (SELECT code, CASE WHEN var_pop(temperature) > 0 THEN covar_pop(temperature, kwh) / var_pop(temperature) ELSE 0 END AS b, avg(temperature) AS m FROM w GROUP BY code),
normal AS (SELECT w.code, w.ts, w.kwh - f.b * (w.temperature - f.m) AS kwh FROM w JOIN f USING (code))"""


def _weathers(spark, d):
    x = fx.weather_hourly(spark, d).select(F.lit("x").alias("city"), "ts", "temperature")
    y = ((F.dayofmonth("ts") * 11 + F.hour("ts") * 5) % 37 - 12).cast("double")
    return x.unionByName(x.select(F.lit("y").alias("city"), "ts", y.alias("temperature")))


def _cities(spark, d):
    load = fx.load_hourly(spark, d).withColumn("unit", F.lit("fsa"))
    codes = load.select("code").distinct()
    city = F.when(F.length("code") % 2 == 0, "x").otherwise("y")
    areas = codes.select(city.alias("city"), F.lit("fsa").alias("unit"), "code", F.length("code").cast("double").alias("cx"), F.lit(0.0).alias("cy"))
    known = codes.select("code", F.lit(POPULATION).alias("feature"), (100 + F.length("code")).cast("double").alias("value"))
    return catalog.Catalog(areas, load, _weathers(spark, d), known)


@query(
    with_tables(
        "load_hourly weather_hourly",
        CITIES.format(source="load_hourly", parity="length(l.code)")
        + NORMAL
        + ", heads AS (SELECT code, ts, kwh / (100 + length(code)) AS kwh FROM normal WHERE month(ts) IN (11, 12, 1, 2, 3, 4) AND isodow(ts) <= 5), "
        + DAILY.format(source="heads")
        + f" SELECT code, {MEANS}, count(*) AS n_days FROM daily GROUP BY code",
    )
)
def city_tables(spark, d):
    """The short-term table of two cities: per head and normalised by each city's own weather."""
    return rounded(catalog.city_tables(_cities(spark, d))[1].drop("dtw_cluster_label"))


@query(with_tables("load_hourly weather_hourly", CITIES.format(source="load_hourly", parity="length(l.code)") + ", heads AS (SELECT code, kwh / (100 + length(code)) AS kwh, temperature FROM w), " + prism_sql("heads") + " " + FITTED))
def city_prism_table(spark, d):
    """The segmented fits of two cities."""
    table = catalog.city_tables(_cities(spark, d))[0]
    return _fits(table.drop("candidates", "heating_change_point_temp_c", "baseload_intercept", "heating_slope_per_hdd", "cooling_slope_per_cdd"))


@query(
    with_tables(
        "load_user weather_hourly census",
        CITIES.format(source="load_user", parity="l.code")
        + NORMAL
        + ", "
        + IMPUTED.replace("held AS (SELECT * FROM load_user WHERE code % 10 <> 3)", "held AS (SELECT code, ts, kwh / (100 + code % 97) AS kwh FROM normal WHERE code % 10 <> 3)")
        + " SELECT code, ts, round(kwh * (100 + code % 97), 4) AS kwh FROM (SELECT code, ts, kwh FROM held UNION ALL SELECT code, ts, kwh FROM imputed)",
    )
)
def rebuild_by_city(spark, d):
    """What follows the treatment of anomalies, over two cities."""
    load = fx.load_user(spark, d)
    areas = load.select("code").distinct().withColumn("city", F.when(F.col("code") % 2 == 0, "x").otherwise("y"))
    out, _ = catalog.complete(load.where("code % 10 <> 3"), _weathers(spark, d), fx.census_long(spark, d), areas, fx.people(spark, d))
    return out.select("code", "ts", F.round("kwh", 4).alias("kwh"))


@query(with_tables("load_user census", "part_of AS (SELECT * FROM census WHERE code % 4 <> 1), " + FEATURES.format(source="load_user").replace("FROM census", "FROM part_of") + " SELECT feature, round(score, 6) AS score, n_months FROM scores"))
def select_features_of_known_areas(spark, d):
    """Where the census lacks a quarter of the areas with load, features are judged on the others."""
    return rounded(census.select_features(fx.census_long(spark, d).where("code % 4 <> 1"), fx.load_user(spark, d)))


@query("WITH n AS (SELECT regexp_split_to_array(p_type, '\\s* \\s*') AS p FROM part), x AS (SELECT p, unnest(range(1, len(p) + 1)) AS depth FROM n) SELECT array_to_string(p[1:depth], ' / ') AS id, CASE WHEN depth > 1 THEN array_to_string(p[1:depth - 1], ' / ') ELSE '' END AS parent, p[depth] AS label, depth, count(*) AS n_columns FROM x GROUP BY ALL")
def column_hierarchy(spark, d):
    """Of the parts' kinds, whose words are the levels."""
    return census.column_hierarchy(fx.table(spark, d, "part").select(F.regexp_replace("p_type", " +", " / ").alias("name")))


# --- areas ------------------------------------------------------------------------------------------------------------


@query(
    with_tables(
        "load_user census",
        IMPUTED + ", h AS (SELECT a.code, a.kwh AS t, i.kwh AS p FROM load_user a LEFT JOIN imputed i ON i.code = a.code AND i.ts = a.ts WHERE a.code % 10 = 3) SELECT code, " + ERRORS.replace(", 6)", ", 9)") + " FROM h GROUP BY code",
    )
)
def evaluate_holdout_hourly(spark, d):
    load = fx.load_user(spark, d)
    codes = load.where("code % 10 = 3").select("code").distinct()
    return rounded(census.evaluate_holdout(load, fx.census_long(spark, d), load.select("code").distinct(), codes)[0], 9)


@query(
    with_tables(
        "areas points",
        f"""SELECT s.building_id, a.code AS fsa_code FROM points s, areas a QUALIFY row_number() OVER (PARTITION BY s.building_id
  ORDER BY NOT (abs(s.cx - a.cx) < 7.95 AND abs(s.cy - a.cy) < 7.95), {NEAR}, a.code) = 1""",
    )
)
def assign_footprints(spark, d):
    """Buildings whose square footprints may lie over several areas, or beside the one that holds their point."""
    at = lambda dx, dy: F.struct((F.col("cx") + dx).alias("x"), (F.col("cy") + dy).alias("y"))
    ring = F.array(at(-2.95, -2.95), at(2.95, -2.95), at(2.95, 2.95), at(-2.95, 2.95))
    shapes = fx.building_points(spark, d).withColumn("rings", F.array(ring))
    return spatial.assign_units(shapes, fx.areas(spark, d), "fsa_code", 7.0).select("building_id", "fsa_code")


@query(with_tables("areas", CATALOG + " SELECT CASE WHEN code::INT % 2 = 0 THEN 'a' ELSE 'x' END AS city, code, cx, cy FROM k WHERE code = '04'"))
def catalog_area(spark, d):
    return _catalog(spark, d).area("04").select("city", "code", "cx", "cy")


@query(
    with_tables(
        "load_hourly",
        "l AS (SELECT code, ts - INTERVAL 5 HOUR AS ts, kwh FROM load_hourly), e AS (SELECT max(ts)::DATE AS last FROM l), " + DAILY.format(source="l") + f" SELECT code, date::VARCHAR AS date, {ROUNDED} FROM daily, e WHERE date < last",
    )
)
def stream_daily_metrics(spark, d):
    """The stream over files, to its end, by days of Toronto in winter; the last day isn't final."""
    path, out, mark = (fresh_path(spark, f"metrics-{x}") for x in ("in", "out", "mark"))
    load = fx.load_hourly(spark, d).select("code", F.col("ts").cast("timestamp").alias("ts"), "kwh")
    load.write.parquet(path)
    found = daily_metrics_stream(spark.readStream.schema(load.schema).parquet(path), "America/Toronto")
    found.writeStream.outputMode("append").format("parquet").option("checkpointLocation", mark).trigger(availableNow=True).start(out).awaitTermination()
    return rounded(spark.read.schema(found.schema).parquet(out))


# --- decomposition ----------------------------------------------------------------------------------------------------


@query(with_tables("load_hourly", stl_sql("load_hourly", "parts") + " SELECT code, ts, round(trend, 6) AS trend, round(seasonal, 6) AS seasonal, round(resid, 6) AS resid FROM parts"))
def stl_decompose(spark, d):
    return rounded(anomalies.stl_decompose(fx.load_hourly(spark, d), 24, robust=False).select("code", "ts", "trend", "seasonal", "resid"))


#: Of a decomposition: which points are anomalies at 3, as treatment scores them.
HITS = """{to}_m AS (SELECT code, median(resid) AS m, stddev_pop(resid) AS sd FROM {source} GROUP BY code), {to}_d AS (SELECT s.code, median(abs(s.resid - m.m)) AS mad FROM {source} s JOIN {to}_m m USING (code) GROUP BY s.code),
{to} AS MATERIALIZED (SELECT s.*, abs(CASE WHEN d.mad > 0 THEN 0.6745 * (resid - m.m) / d.mad WHEN m.sd > 0 THEN (resid - m.m) / m.sd ELSE 0 END) >= 3 AS hit FROM {source} s JOIN {to}_m m USING (code) JOIN {to}_d d USING (code))"""
#: What a round makes of a series: as it was where few enough are hit, else without the anomalies.
ROUND = (
    stl_sql("{source}", "{to}_parts")
    + ", "
    + HITS.replace("{to}", "{to}_hits").replace("{source}", "{to}_parts")
    + ", {to}_rate AS MATERIALIZED (SELECT code, avg(hit::INT) AS rate, count(*) FILTER (WHERE hit) AS n FROM {to}_hits GROUP BY code), {to}_x AS (SELECT h.code, h.ts, CASE WHEN NOT h.hit THEN h.kwh END AS v, h.kwh AS was, r.rate FROM {to}_hits h JOIN {to}_rate r USING (code)), "
    + FILL.format(source="{to}_x", x="v").replace("p AS (", "{to}_p AS (").replace("n AS (", "{to}_n AS (").replace("FROM p ", "FROM {to}_p ").replace("filled AS (", "{to}_f AS (").replace("FROM n)", "FROM {to}_n)")
    + ", {to} AS MATERIALIZED (SELECT code, ts, CASE WHEN rate <= 0.001 THEN was ELSE y END AS kwh FROM {to}_f)"
)
TREATED = ROUND.replace("{source}", "load_hourly").replace("{to}", "one") + ", " + ROUND.replace("{source}", "one").replace("{to}", "two")


@query(with_tables("load_hourly", TREATED + " SELECT code, ts, round(kwh, 6) AS kwh FROM two"))
def treat_anomalies_twice(spark, d):
    """Two rounds of treatment."""
    return rounded(anomalies.treat_anomalies(fx.load_hourly(spark, d), 24, max_iter=2)[0])
