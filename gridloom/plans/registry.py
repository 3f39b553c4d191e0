"""The queries over the driver tables, one per operator, with their SQL oracles where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.columns import between_times, is_weekday, months_of
from gridloom.operators import anomalies, buildings, census, prism, quality, short_term, spatial, synpop, timeseries, weather_model
from gridloom.operators.catalog import rebuild
from gridloom.plans import fixtures as fx
from gridloom.plans.fixtures import with_tables
from gridloom.sources.readers import long_from_wide
from gridloom.sources.writers import wide_from_long

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """df with doubles rounded, small integers widened and dates as text, as both engines write them alike then."""
    kinds = dict(df.dtypes)
    wide = {c: F.round(c, digits).alias(c) if k == "double" else F.col(c).cast("string").alias(c) if k == "date" else F.col(c).cast("long").alias(c) if k in ("int", "smallint") else F.col(c) for c, k in kinds.items()}
    return df.select(*wide.values())


@query(
    with_tables(
        "aligned",
        """bases AS (SELECT unnest(generate_series(16, 48)) / 2.0::DOUBLE AS base), fit AS (
  SELECT code, base, count(*) AS n_obs, regr_slope(kwh, greatest(base - temperature, 0)) AS s,
         regr_intercept(kwh, greatest(base - temperature, 0)) AS i, regr_r2(kwh, greatest(base - temperature, 0)) AS r2
  FROM aligned, bases GROUP BY code, base)
SELECT code, n_obs, base AS change_point, round(i, 6) AS baseload, round(s, 6) AS heating_slope, round(r2, 6) AS r2
FROM fit WHERE n_obs >= 10 QUALIFY row_number() OVER (PARTITION BY code ORDER BY round(r2, 9) DESC, base) = 1""",
    )
)
def heating_change_point(spark, d):
    return rounded(weather_model.heating_change_point(timeseries.align_weather(fx.load_hourly(spark, d), fx.weather_hourly(spark, d))))


@query(with_tables("full_load", "SELECT code, ts, round(kwh, 6) AS kwh FROM full_load"))
def regularize(spark, d):
    return rounded(timeseries.regularize(fx.load_gappy(spark, d)))


@query(
    with_tables(
        "full_load",
        """SELECT code, count(*) AS n_rows, count(*) - count(kwh) AS n_missing, round(count(kwh) / count(*), 8) AS coverage,
       round(avg(kwh), 8) AS mean_kwh, round(quantile_cont(kwh, 0.95), 8) AS p95_kwh, round(max(kwh), 8) AS max_kwh FROM full_load GROUP BY code""",
    )
)
def qc_profile(spark, d):
    return rounded(quality.qc_profile(fx.load_gappy(spark, d)), 8)


FILL = """p AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY ts) AS i FROM {source}), n AS (
  SELECT *, last_value(CASE WHEN {x} IS NOT NULL THEN i END IGNORE NULLS) OVER w AS a, first_value(CASE WHEN {x} IS NOT NULL THEN i END IGNORE NULLS) OVER v AS b,
         last_value({x} IGNORE NULLS) OVER w AS ax, first_value({x} IGNORE NULLS) OVER v AS bx
  FROM p WINDOW w AS (PARTITION BY code ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                v AS (PARTITION BY code ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), filled AS (
  SELECT *, coalesce({x}, ax + (bx - ax) * (i - a) / nullif(b - a, 0), ax, bx) AS y FROM n)"""


@query(with_tables("full_load", FILL.format(source="full_load", x="kwh") + " SELECT code, ts, round(y, 6) AS kwh FROM filled"))
def interpolate_both(spark, d):
    return rounded(timeseries.interpolate_both(timeseries.regularize(fx.load_gappy(spark, d))))


@query(
    with_tables(
        "full_load",
        FILL.format(source="full_load", x="kwh")
        + " SELECT code, ts, round(CASE WHEN kwh IS NOT NULL OR i - a <= 1 OR b - i <= 1 THEN y END, 6) AS kwh FROM filled",
    )
)
def interpolate_limit(spark, d):
    return rounded(timeseries.interpolate_both(timeseries.regularize(fx.load_gappy(spark, d)), limit=1))


@query(with_tables("full_load", FILL.format(source="full_load", x="kwh") + " SELECT code, ts, round(CASE WHEN i - a <= 1 THEN ax END, 6) AS kwh FROM filled"))
def ffill(spark, d):
    return rounded(timeseries.ffill(timeseries.regularize(fx.load_gappy(spark, d)), limit=1))


@query(
    with_tables(
        "load_hourly",
        """a AS (SELECT *, CASE WHEN count(kwh) OVER w >= 8 THEN quantile_cont(kwh, 0.5) OVER w END AS m FROM load_hourly
  WINDOW w AS (PARTITION BY code ORDER BY ts ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING)),
b AS (SELECT *, abs(kwh - m) AS o FROM a), c AS (
  SELECT *, 1.4826 * CASE WHEN count(o) OVER w >= 8 THEN quantile_cont(o, 0.5) OVER w END AS s FROM b
  WINDOW w AS (PARTITION BY code ORDER BY ts ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING)),
e AS (SELECT *, coalesce(s > 0 AND o > 3 * s, false) AS is_outlier FROM c)
SELECT code, ts, round(CASE WHEN is_outlier THEN m ELSE kwh END, 6) AS kwh, is_outlier FROM e""",
    )
)
def hampel(spark, d):
    return rounded(timeseries.hampel(fx.load_hourly(spark, d), 24, 3.0, "median"))


@query(
    with_tables(
        "load_daily",
        """m AS (SELECT code, date_trunc('month', ts)::TIMESTAMP AS ts, sum(kwh) AS kwh FROM load_daily GROUP BY 1, 2),
g AS (SELECT c.code, s.ts FROM (SELECT DISTINCT code FROM m) c, (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 1 MONTH)) AS ts FROM m) s)
SELECT g.code, g.ts, round(coalesce(m.kwh, 0), 3) AS kwh FROM g LEFT JOIN m ON g.code = m.code AND g.ts = m.ts""",
    )
)
def monthly_energy(spark, d):
    return rounded(timeseries.monthly_energy(fx.load_daily(spark, d)), 3)


@query(with_tables("load_hourly", "SELECT code, date_trunc('day', ts)::TIMESTAMP AS ts, round(avg(kwh), 6) AS kwh FROM load_hourly GROUP BY 1, 2"))
def resample(spark, d):
    return rounded(timeseries.resample(fx.load_hourly(spark, d), "day", "mean"))


@query(
    with_tables(
        "load_hourly weather_sparse",
        "j AS (SELECT l.*, w.temperature FROM load_hourly l LEFT JOIN weather_sparse w ON l.ts = w.ts), "
        + FILL.format(source="j", x="temperature")
        + " SELECT code, ts, round(kwh, 6) AS kwh, round(y, 6) AS temperature FROM filled WHERE y IS NOT NULL",
    )
)
def align_weather(spark, d):
    out = timeseries.align_weather(fx.load_hourly(spark, d), fx.weather_sparse(spark, d))
    return rounded(out.select("code", "ts", "kwh", "temperature"))


@query(
    with_tables(
        "load_hourly weather_sparse",
        """SELECT l.code, l.ts, round(l.kwh, 6) AS kwh, round((SELECT w.temperature FROM weather_sparse w
   ORDER BY abs(epoch(w.ts) - epoch(l.ts)), w.ts DESC LIMIT 1), 6) AS temperature FROM load_hourly l""",
    )
)
def asof_nearest(spark, d):
    return rounded(timeseries.asof_nearest(fx.load_hourly(spark, d), fx.weather_sparse(spark, d), "temperature"))


@query(
    with_tables(
        "aligned load_hourly",
        """f AS (SELECT code, CASE WHEN var_pop(temperature) > 0 THEN covar_pop(temperature, kwh) / var_pop(temperature) ELSE 0 END AS b, avg(temperature) AS m FROM aligned GROUP BY code)
SELECT l.code, l.ts, round(a.kwh - f.b * (a.temperature - f.m), 6) AS kwh FROM load_hourly l LEFT JOIN aligned a ON l.code = a.code AND l.ts = a.ts LEFT JOIN f ON f.code = a.code""",
    )
)
def normalize_weather(spark, d):
    load = fx.load_hourly(spark, d)
    return rounded(weather_model.normalize_weather(load, timeseries.align_weather(load, fx.weather_hourly(spark, d))))


def _people(spark, d):
    return fx.people(spark, d)


@query(with_tables("load_user", "SELECT code, ts, round(kwh / (100 + code % 97), 9) AS kwh FROM load_user"))
def per_capita(spark, d):
    return rounded(weather_model.per_capita(fx.load_user(spark, d), _people(spark, d)).select("code", "ts", "kwh"), 9)


@query(
    with_tables(
        "aligned",
        """h AS (SELECT code, kwh AS y, greatest(18 - temperature, 0) AS h, greatest(temperature - 18, 0) AS c FROM aligned),
s AS (SELECT code, count(*) AS n, sum(h) AS sh, sum(c) AS sc, sum(y) AS sy, sum(h * h) AS shh, sum(c * c) AS scc, sum(h * y) AS shy, sum(c * y) AS scy, sum(y * y) AS syy FROM h GROUP BY code),
k AS (SELECT *, shh - sh * sh / n AS hh, scc - sc * sc / n AS cc, -sh * sc / n AS hc, shy - sh * sy / n AS hy, scy - sc * sy / n AS cy, syy - sy * sy / n AS yy FROM s),
b AS (SELECT *, (hy * cc - cy * hc) / (hh * cc - hc * hc) AS bh, (cy * hh - hy * hc) / (hh * cc - hc * hc) AS bc FROM k)
SELECT code, 18.0::DOUBLE AS base, n AS n_obs, round((sy - bh * sh - bc * sc) / n, 6) AS intercept, round(bh, 6) AS heating_slope, round(bc, 6) AS cooling_slope,
       round((bh * hy + bc * cy) / yy, 6) AS r2, round(sh / n, 6) AS mean_hdd, round(sc / n, 6) AS mean_cdd FROM b""",
    )
)
def degree_day_fit(spark, d):
    return rounded(weather_model.degree_day_fit(timeseries.align_weather(fx.load_hourly(spark, d), fx.weather_hourly(spark, d))))


DAILY = """r AS (SELECT code, ts::DATE AS date, hour(ts) AS h, kwh AS x, row_number() OVER (PARTITION BY code, ts::DATE ORDER BY kwh DESC) AS place,
       count(*) OVER (PARTITION BY code, ts::DATE) AS n, kwh - lag(kwh) OVER (PARTITION BY code, ts::DATE ORDER BY ts) AS rise FROM {source}),
daily AS (SELECT code, date, max(x) AS peak_load, avg(x) FILTER (WHERE place <= greatest(1, ceil(n / 10))) AS p90_top10_mean,
       max(x) FILTER (WHERE h BETWEEN 6 AND 11) / nullif(max(x) FILTER (WHERE h BETWEEN 16 AND 21), 0) AS am_pm_peak_ratio, max(rise) AS ramp_up_rate FROM r GROUP BY 1, 2)"""
METRICS = "peak_load", "p90_top10_mean", "am_pm_peak_ratio", "ramp_up_rate"
ROUNDED = ", ".join(f"round({m}, 6) AS {m}" for m in METRICS)
MEANS = ", ".join(f"round(avg({m}), 6) AS {m}" for m in METRICS)


@query(with_tables("load_hourly", DAILY.format(source="load_hourly") + f" SELECT code, date::VARCHAR AS date, {ROUNDED} FROM daily"))
def daily_metrics(spark, d):
    return rounded(short_term.daily_metrics(fx.load_hourly(spark, d)).drop("dtw_cluster_label"))


@query(
    with_tables(
        "load_hourly labels_of_days",
        DAILY.format(source="load_hourly")
        + f""", c AS (SELECT code, cluster_label, row_number() OVER (PARTITION BY code ORDER BY count(*) DESC, cluster_label) AS k FROM labels_of_days GROUP BY 1, 2)
SELECT daily.code, {MEANS}, min(c.cluster_label) AS dtw_cluster_label, count(*) AS n_days FROM daily JOIN c ON c.code = daily.code AND c.k = 1 GROUP BY daily.code""",
    )
)
def area_short_term(spark, d):
    return rounded(short_term.area_short_term(short_term.daily_metrics(fx.load_hourly(spark, d), fx.day_labels(spark, d))))


@query(
    with_tables(
        "load_hourly",
        "f AS (SELECT * FROM load_hourly WHERE month(ts) IN (11, 12, 1, 2, 3, 4) AND isodow(ts) <= 5), "
        + DAILY.format(source="f")
        + f" SELECT code, {MEANS}, count(*) AS n_days FROM daily GROUP BY code",
    )
)
def short_term_table(spark, d):
    return rounded(short_term.short_term_table(fx.load_hourly(spark, d)).drop("dtw_cluster_label"))


@query(with_tables("load_daily", "SELECT code, ts, kwh FROM load_daily WHERE month(ts) IN (11, 12, 1, 2, 3, 4) AND isodow(ts) <= 5 AND ts >= '1996-01-01' AND ts < '1998-07-01'"))
def winter_weekdays(spark, d):
    load = fx.load_daily(spark, d)
    return load.where(between_times("ts", "1996-01-01", "1998-06-30") & months_of("ts", short_term.WINTER) & is_weekday("ts"))


PROFILES = """x AS (SELECT code, ts::DATE AS date, hour(ts) AS hour, avg(kwh) AS x FROM load_gappy GROUP BY 1, 2, 3),
g AS (SELECT code, date, unnest(range(24)) AS hour FROM (SELECT code, date FROM x GROUP BY 1, 2 HAVING count(*) >= 20)),
j AS (SELECT g.code || ' ' || g.date AS code, g.code AS area, g.date, g.hour AS ts, x.x AS kwh FROM g LEFT JOIN x ON x.code = g.code AND x.date = g.date AND x.hour = g.hour), """


@query(
    with_tables(
        "load_gappy",
        PROFILES
        + FILL.format(source="j", x="kwh")
        + """ SELECT area AS code, date::VARCHAR AS date, ts AS hour, round((y - avg(y) OVER w) / CASE WHEN stddev_pop(y) OVER w > 0 THEN stddev_pop(y) OVER w ELSE 1 END, 6) AS x
FROM filled WINDOW w AS (PARTITION BY area, date)""",
    )
)
def daily_profiles(spark, d):
    out = short_term.daily_profiles(fx.load_gappy(spark, d))
    return rounded(out.select("code", "date", F.posexplode("profile").alias("hour", "x")))


@query(
    with_tables(
        "load_gappy labels_of_days",
        PROFILES
        + FILL.format(source="j", x="kwh")
        + """ SELECT f.area AS code, l.cluster_label, f.ts AS hour, round(quantile_cont(y, 0.05), 6) AS p05, round(quantile_cont(y, 0.5), 6) AS p50, round(quantile_cont(y, 0.95), 6) AS p95,
       round(avg(y), 6) AS mean, count(*) AS n_days FROM filled f JOIN labels_of_days l ON l.code = f.area AND l.date = f.date GROUP BY 1, 2, 3""",
    )
)
def cluster_hour_stats(spark, d):
    profiles = short_term.daily_profiles(fx.load_gappy(spark, d), normalize=False)
    return rounded(short_term.cluster_hour_stats(profiles, fx.day_labels(spark, d)))


@query(
    with_tables(
        "labels_of_days",
        """c AS (SELECT code, cluster_label, count(*) AS n, sum(count(*)) OVER (PARTITION BY code) AS total FROM labels_of_days GROUP BY 1, 2)
SELECT code, CASE WHEN n / total >= 0.4 THEN cluster_label ELSE 'no_decision' END AS dominant_label, round(n / total, 6) AS dominant_share, total::BIGINT AS n_labeled_days
FROM c QUALIFY row_number() OVER (PARTITION BY code ORDER BY n DESC, cluster_label) = 1""",
    )
)
def dominant_label(spark, d):
    return rounded(short_term.dominant_label(fx.day_labels(spark, d), 0.4))


@query(
    with_tables(
        "labels_of_days",
        """p AS (SELECT unnest(['weekday', 'weekend']) AS period), c AS (SELECT CASE WHEN isodow(date) <= 5 THEN 'weekday' ELSE 'weekend' END AS period, cluster_label, count(*) AS n FROM labels_of_days GROUP BY 1, 2)
SELECT p.period, l.cluster_label, round(coalesce(c.n / sum(c.n) OVER (PARTITION BY p.period), 0), 6) AS value
FROM p CROSS JOIN (SELECT DISTINCT cluster_label FROM labels_of_days) l LEFT JOIN c ON c.period = p.period AND c.cluster_label = l.cluster_label""",
    )
)
def label_calendar(spark, d):
    return rounded(short_term.label_calendar(fx.day_labels(spark, d), "weekpart"))


@query(with_tables("labels_of_days", "SELECT code, date::VARCHAR AS date, cluster_label, dense_rank() OVER (PARTITION BY code ORDER BY cluster_label) - 1 AS label_code FROM labels_of_days"))
def label_codes(spark, d):
    return rounded(short_term.label_codes(fx.day_labels(spark, d)))


def _residuals(spark, d):
    load = fx.load_hourly(spark, d)
    mean = load.groupBy("code", F.hour("ts").alias("hour")).agg(F.avg("kwh").alias("seasonal"))
    both = load.withColumn("hour", F.hour("ts")).join(mean, ["code", "hour"]).drop("hour")
    return both.withColumn("trend", F.lit(0.0)).withColumn("resid", F.round(F.col("kwh") - F.col("seasonal"), 6))


SCORED = """q AS (SELECT code, ts, kwh, avg(kwh) OVER (PARTITION BY code, hour(ts)) AS seasonal FROM load_hourly),
e AS (SELECT *, round(kwh - seasonal, 6) AS resid FROM q), m AS (SELECT code, median(resid) AS m, stddev_pop(resid) AS sd FROM e GROUP BY code),
o AS (SELECT e.*, resid - m AS off, sd FROM e JOIN m USING (code)), a AS (SELECT code, median(abs(off)) AS mad FROM o GROUP BY code),
z AS (SELECT o.*, CASE WHEN mad > 0 THEN 0.6745 * off / mad WHEN sd > 0 THEN off / sd ELSE 0 END AS robust_z FROM o JOIN a USING (code)),
scored AS (SELECT *, abs(robust_z) >= 2.5 AS is_anomaly, CASE WHEN abs(robust_z) < 2.5 THEN 'normal' WHEN resid >= 0 THEN 'high' ELSE 'low' END AS anomaly_direction FROM z)"""


@query(with_tables("load_hourly", SCORED + " SELECT code, ts, resid, round(robust_z, 6) AS robust_z, is_anomaly, anomaly_direction FROM scored"))
def score_residuals(spark, d):
    return rounded(anomalies.score_residuals(_residuals(spark, d), 2.5).drop("kwh", "seasonal", "trend"))


@query(
    with_tables(
        "load_hourly",
        SCORED
        + """ SELECT code, count(*) AS n_points, count(*) FILTER (WHERE is_anomaly) AS n_anomalies, round(count(*) FILTER (WHERE is_anomaly) / count(*), 6) AS anomaly_rate,
       count(*) FILTER (WHERE anomaly_direction = 'high') AS n_high, count(*) FILTER (WHERE anomaly_direction = 'low') AS n_low, round(avg(abs(robust_z)), 6) AS mean_abs_z,
       round(max(abs(robust_z)), 6) AS max_abs_z, round(avg(abs(resid)), 6) AS mean_abs_resid, round(max(abs(resid)), 6) AS max_abs_resid, round(stddev_pop(resid), 6) AS std_resid FROM scored GROUP BY code""",
    )
)
def anomaly_summary(spark, d):
    return rounded(anomalies.anomaly_summary(anomalies.score_residuals(_residuals(spark, d), 2.5)))


@query(
    with_tables(
        "load_hourly",
        SCORED + ", masked AS (SELECT code, ts, is_anomaly, CASE WHEN NOT is_anomaly THEN kwh END AS kwh FROM scored), " + FILL.format(source="masked", x="kwh") + " SELECT code, ts, is_anomaly, round(y, 6) AS kwh FROM filled",
    )
)
def replace_anomalies(spark, d):
    out = anomalies.replace_anomalies(anomalies.score_residuals(_residuals(spark, d), 2.5))
    return rounded(out.select("code", "ts", "is_anomaly", "kwh"))


@query(with_tables("load_hourly", SCORED + " SELECT code, ts, is_anomaly, round(CASE WHEN is_anomaly THEN seasonal ELSE kwh END, 6) AS kwh FROM scored"))
def rebuild_anomalies(spark, d):
    out = anomalies.replace_anomalies(anomalies.score_residuals(_residuals(spark, d), 2.5), "stl_rebuild")
    return rounded(out.select("code", "ts", "is_anomaly", "kwh"))


@query()
def stl_anomalies(spark, d):
    return anomalies.stl_anomalies(fx.load_hourly(spark, d), 24)


@query()
def treat_anomalies(spark, d):
    return anomalies.treat_anomalies(fx.load_hourly(spark, d), 24)[1]


@query()
def cluster_profiles(spark, d):
    return short_term.cluster_profiles(short_term.daily_profiles(fx.load_hourly(spark, d)))


def _aligned(spark, d):
    return timeseries.align_weather(fx.load_hourly(spark, d), fx.weather_hourly(spark, d))


@query(
    with_tables(
        "aligned",
        """h AS (SELECT code, '2ch' AS model, 2 + k * 0.5::DOUBLE AS x, kwh AS y, greatest(2 + k * 0.5 - temperature, 0) AS h FROM aligned, (SELECT unnest(range(37)) AS k)
  UNION ALL SELECT code, '2cl', 15 + k * 0.5::DOUBLE, kwh, greatest(temperature - 15 - k * 0.5, 0) FROM aligned, (SELECT unnest(range(21)) AS k)),
f AS (SELECT code, model, x, regr_slope(y, h) AS s, regr_intercept(y, h) AS i, regr_syy(y, h) * (1 - regr_r2(y, h)) AS e, count(*) FILTER (WHERE h > 0) AS n FROM h GROUP BY 1, 2, 3)
SELECT code, model, x AS break_temp, round(i, 6) AS baseload, round(s, 6) AS slope, round(e, 3) AS sse FROM f WHERE s > 0 AND i >= 0 AND n > 5
QUALIFY row_number() OVER (PARTITION BY code, model ORDER BY round(e, 6), x) = 1""",
    )
)
def prism_grid(spark, d):
    return rounded(prism.prism_grid(_aligned(spark, d))).withColumn("sse", F.round("sse", 3))


@query(with_tables("weather_hourly", "SELECT ts, round(50 + -2 * least(temperature - 12, 0) + 1.5 * greatest(temperature - 20, 0), 6) AS fitted FROM weather_hourly"))
def prism_predict(spark, d):
    p = {k: F.lit(v) for k, v in {"x0": -10.0, "x1": 12.0, "x2": 20.0, "y0": 0.0, "y1": 50.0, "k0": 0.0, "k1": -2.0, "k2": 1.5}.items()}
    return rounded(fx.weather_hourly(spark, d).select("ts", prism.prism_predict(F.col("temperature"), F.lit("3sg"), p).alias("fitted")))


FEATURES = """monthly AS (SELECT code, date_trunc('month', ts) AS m, sum(kwh) AS kwh FROM {source} GROUP BY 1, 2), known AS (SELECT c.* FROM census c WHERE value IS NOT NULL AND code IN (SELECT code FROM monthly)),
good AS (SELECT feature FROM known GROUP BY feature HAVING count(DISTINCT code) / (SELECT count(DISTINCT code) FROM monthly WHERE code IN (SELECT code FROM census)) >= 0.8 AND count(DISTINCT value) >= 5),
pairs AS (SELECT k.feature, m.m, k.value AS x, m.kwh AS y FROM known k JOIN good USING (feature) JOIN monthly m ON m.code = k.code),
ranks AS (SELECT feature, m, rank() OVER (PARTITION BY feature, m ORDER BY x) + (count(*) OVER (PARTITION BY feature, m, x) - 1) / 2 AS rx,
  rank() OVER (PARTITION BY feature, m ORDER BY y) + (count(*) OVER (PARTITION BY feature, m, y) - 1) / 2 AS ry FROM pairs),
scores AS (SELECT feature, avg(r) AS score, count(*) AS n_months FROM (SELECT feature, m, abs(corr(rx, ry)) AS r FROM ranks GROUP BY 1, 2 HAVING count(*) >= 8) WHERE r IS NOT NULL GROUP BY feature)"""


@query(with_tables("load_user census", FEATURES.format(source="load_user") + " SELECT feature, round(score, 6) AS score, n_months FROM scores"))
def select_features(spark, d):
    return rounded(census.select_features(fx.census_long(spark, d), fx.load_user(spark, d)))


IMPUTED = """held AS (SELECT * FROM load_user WHERE code % 10 <> 3), """ + FEATURES.format(source="held") + """,
donors AS (SELECT DISTINCT code FROM held), targets AS (SELECT DISTINCT code FROM load_user WHERE code NOT IN (SELECT code FROM held)),
st AS (SELECT c.feature, avg(value) AS m, stddev_pop(value) AS s FROM census c JOIN scores USING (feature) WHERE value IS NOT NULL AND c.code IN (SELECT code FROM donors) GROUP BY c.feature HAVING stddev_pop(value) > 0),
zs AS (SELECT c.code, c.feature, (value - m) / s AS z, score FROM census c JOIN st USING (feature) JOIN scores USING (feature) WHERE value IS NOT NULL),
dist AS (SELECT t.code, d.code AS donor, sqrt(sum(t.score / t.total * (d.z - t.z) ** 2)) AS distance FROM (SELECT *, sum(score) OVER (PARTITION BY code) AS total FROM zs WHERE code IN (SELECT code FROM targets)) t
  JOIN zs d ON d.feature = t.feature AND d.code IN (SELECT code FROM donors) GROUP BY 1, 2),
best AS (SELECT * FROM dist QUALIFY row_number() OVER (PARTITION BY code ORDER BY round(distance, 9), donor) = 1),
report AS (SELECT code, donor, distance, least(greatest((100 + code % 97)::DOUBLE / (100 + donor % 97), 0.5), 2) AS scale, 'imputed' AS status FROM best),
imputed AS (SELECT r.code, h.ts, h.kwh * r.scale AS kwh FROM report r JOIN held h ON h.code = r.donor)"""


def _held(spark, d):
    load = fx.load_user(spark, d)
    return load.where("code % 10 <> 3"), load.select("code").distinct()


@query(with_tables("load_user census", IMPUTED + " SELECT code, donor, round(distance, 6) AS distance, round(scale, 6) AS scale, status FROM report"))
def impute_report(spark, d):
    load, areas = _held(spark, d)
    return rounded(census.impute_by_census(load, fx.census_long(spark, d), areas)[1])


@query(with_tables("load_user census", IMPUTED + " SELECT code, ts, round(kwh, 6) AS kwh FROM held UNION ALL SELECT code, ts, round(kwh, 6) FROM imputed"))
def impute_by_census(spark, d):
    load, areas = _held(spark, d)
    return rounded(census.impute_by_census(load, fx.census_long(spark, d), areas)[0])


ERRORS = """count(CASE WHEN p IS NOT NULL THEN t END) AS n_obs, round(avg(abs(p - t)), 6) AS mae, round(sqrt(avg((p - t) ** 2)), 6) AS rmse, round(avg(p - t), 6) AS mbe,
       round(100 * avg(CASE WHEN abs(t) >= 1e-9 THEN abs(p - t) / abs(t) END), 6) AS mape_pct, round(CASE WHEN count(CASE WHEN p IS NOT NULL THEN t END) >= 2 THEN corr(t, p) END, 6) AS corr"""


@query(
    with_tables(
        "load_hourly",
        "e AS (SELECT code, kwh AS t, CASE WHEN hour(ts) % 5 > 0 THEN lag(kwh) OVER (PARTITION BY code ORDER BY ts) END AS p FROM load_hourly) SELECT code, " + ERRORS + " FROM e GROUP BY code",
    )
)
def error_metrics(spark, d):
    from pyspark.sql import Window

    before = F.lag("kwh").over(Window.partitionBy("code").orderBy("ts"))
    pairs = fx.load_hourly(spark, d).select("code", F.col("kwh").alias("truth"), F.when(F.hour("ts") % 5 > 0, before).alias("predicted"))
    return rounded(census.error_metrics(pairs, ["code"]))


@query(
    with_tables(
        "load_user census",
        IMPUTED
        + ", m AS (SELECT a.code, date_trunc('month', a.ts) AS m, sum(a.kwh) AS t FROM load_user a WHERE a.code % 10 = 3 GROUP BY 1, 2), q AS (SELECT code, date_trunc('month', ts) AS m, sum(kwh) AS p FROM imputed GROUP BY 1, 2) SELECT m.code, "
        + ERRORS.replace(", 6)", ", 9)")
        + " FROM m LEFT JOIN q ON q.code = m.code AND q.m = m.m GROUP BY m.code",
    )
)
def evaluate_holdout(spark, d):
    load = fx.load_user(spark, d)
    codes = load.where("code % 10 = 3").select("code").distinct()
    return rounded(census.evaluate_holdout(load, fx.census_long(spark, d), load.select("code").distinct(), codes)[1], 9)


@query(with_tables("load_hourly", "SELECT code, round(arg_max(kwh, ts), 6) AS metric FROM load_hourly GROUP BY code"))
def area_metric(spark, d):
    return rounded(timeseries.area_metric(fx.load_hourly(spark, d), "latest"))


@query(with_tables("load_hourly", "SELECT round(quantile_cont(kwh, 0.02), 6) AS low, round(quantile_cont(kwh, 0.98), 6) AS high FROM load_hourly"))
def color_limits(spark, d):
    return rounded(timeseries.color_limits(fx.load_hourly(spark, d), "kwh"))


@query(
    with_tables(
        "load_daily",
        """SELECT code, date_trunc('month', ts)::TIMESTAMP AS ts, round(sum(kwh), 3) AS truth, round(sum(kwh * (1 + code % 3 / 10)), 3) AS imputed,
       round(abs(sum(kwh * (1 + code % 3 / 10)) - sum(kwh)) / nullif(abs(sum(kwh)), 0), 6) AS ape FROM load_daily GROUP BY 1, 2""",
    )
)
def monthly_ape(spark, d):
    load = fx.load_daily(spark, d)
    out = timeseries.monthly_ape(load, load.withColumn("kwh", F.col("kwh") * (1 + F.col("code") % 3 / 10)))
    return out.select("code", "ts", F.round("truth", 3).alias("truth"), F.round("imputed", 3).alias("imputed"), F.round("ape", 6).alias("ape"))


@query(with_tables("areas", "SELECT code, cx, cy FROM areas"))
def with_centroid(spark, d):
    return rounded(spatial.with_centroid(fx.areas(spark, d).select("code", "rings")).select("code", "cx", "cy"))


NEAR = "sqrt((s.cx - a.cx) ** 2 + (s.cy - a.cy) ** 2)"


@query(
    with_tables(
        "areas small_areas",
        f"""r AS (SELECT s.code, a.code AS unit, row_number() OVER (PARTITION BY s.code ORDER BY {NEAR}, a.code) AS k FROM small_areas s, areas a)
SELECT code, string_agg(unit, ',' ORDER BY k) AS nearest FROM r WHERE k <= 3 GROUP BY code""",
    )
)
def nearest_units(spark, d):
    return spatial.nearest_units(fx.small_areas(spark, d), fx.areas(spark, d)).withColumn("nearest", F.array_join("nearest", ","))


ASSIGNED = f"""SELECT s.building_id, s.cx, s.cy, a.code AS fsa_code FROM points s, areas a QUALIFY row_number() OVER (PARTITION BY s.building_id
  ORDER BY NOT (s.cx BETWEEN a.cx - 5 AND a.cx + 5 AND s.cy BETWEEN a.cy - 5 AND a.cy + 5), {NEAR}, a.code) = 1"""


@query(with_tables("areas points", ASSIGNED))
def assign_units(spark, d):
    return spatial.assign_units(fx.building_points(spark, d), fx.areas(spark, d), "fsa_code", 7.0)


def _doubles(df, *columns):
    """df with nullable whole numbers as doubles, as both engines hand these over alike."""
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def _standard(spark, d):
    return buildings.standardize_buildings(fx.raw_buildings(spark, d)).select("building_id", "building_type", "building_category", "year_built", "stories", "total_floor_area", "height_m")


@query(with_tables("standard", "SELECT * EXCLUDE (p_partkey) REPLACE (year_built::DOUBLE AS year_built) FROM standard"))
def standardize_buildings(spark, d):
    return _doubles(_standard(spark, d), "year_built")


TWICE = """twice AS (SELECT building_id, CASE WHEN p_partkey % 7 > 0 THEN building_type END AS building_type, year_built, 1 AS o FROM standard
  UNION ALL SELECT building_id, building_category, NULL, 2 FROM standard WHERE p_partkey % 7 = 0)"""


def _twice(spark, d):
    b = _standard(spark, d)
    seventh = F.substring("building_id", 2, 20).cast("long") % 7 == 0
    a = b.select("building_id", F.when(~seventh, F.col("building_type")).alias("building_type"), "year_built", F.lit(1).alias("o"))
    return a.unionByName(b.where(seventh).select("building_id", F.col("building_category").alias("building_type"), F.lit(None).cast("long").alias("year_built"), F.lit(2).alias("o")))


@query(with_tables("standard", TWICE + " SELECT building_id, arg_min(building_type, o) AS building_type, arg_min(year_built, o)::DOUBLE AS year_built FROM twice GROUP BY building_id"))
def collapse_buildings(spark, d):
    return _doubles(buildings.collapse_buildings(_twice(spark, d), order="o"), "year_built")


@query(
    with_tables(
        "standard",
        """i AS (SELECT building_id, year_built, building_type FROM standard WHERE p_partkey % 3 > 0), p AS (SELECT building_id, 1950 AS year_built, height_m, 'p' AS geometry FROM standard WHERE p_partkey % 2 = 0),
s AS (SELECT building_id, building_category AS building_type, 's' AS geometry FROM standard)
SELECT building_id, coalesce(i.year_built, p.year_built)::DOUBLE AS year_built, coalesce(i.building_type, s.building_type) AS building_type, p.height_m, coalesce(p.geometry, s.geometry) AS geometry
FROM s FULL JOIN i USING (building_id) FULL JOIN p USING (building_id)""",
    )
)
def combine_buildings(spark, d):
    b = _standard(spark, d).withColumn("k", F.substring("building_id", 2, 20).cast("long"))
    i = b.where("k % 3 > 0").select("building_id", "year_built", "building_type")
    p = b.where("k % 2 = 0").select("building_id", F.lit(1950).cast("long").alias("year_built"), "height_m", F.lit("p").alias("geometry"))
    s = b.select("building_id", F.col("building_category").alias("building_type"), F.lit("s").alias("geometry"))
    return _doubles(buildings.combine_buildings(i, p, s), "year_built")


def _attributed(spark, d):
    b = _standard(spark, d).withColumn("k", F.substring("building_id", 2, 20).cast("long"))
    known = ["building_id", "building_type", "building_category", "year_built", "stories", "total_floor_area", "height_m", "fsa_code", "da_code", "footprint_area", "volume", "num_dwellings"]
    none = {c: F.lit(None).cast("double") for c in ("footprint_area", "volume", "num_dwellings")}
    rich = b.withColumns(
        none
        | {
            "fsa_code": F.concat(F.lit("F"), (F.col("k") % 9).cast("string")),
            "da_code": F.when(F.col("k") % 4 == 0, F.concat(F.lit("D"), (F.col("k") % 13).cast("string"))),
            "CODE_UTILI": F.when(F.col("k") % 2 == 0, F.lit("1000")),
            "alias_b": F.lit("x"),
            "alias_a": F.when(F.col("k") % 3 == 0, F.col("building_id")),
        }
    )
    return buildings.attribute_maps(rich.drop("k"), known)


@query(
    with_tables(
        "standard",
        """SELECT building_id AS id, CASE WHEN p_partkey % 2 = 0 THEN '1000' ELSE building_type END AS function, year_built::DOUBLE AS year_of_construction, stories AS storeys_above_ground,
  round(height_m / nullif(stories, 0), 6) AS storey_height_m, CASE WHEN p_partkey % 4 = 0 THEN 'da' ELSE 'fsa' END AS fallback_unit_type,
  CASE WHEN p_partkey % 4 = 0 THEN 'D' || (p_partkey % 13) ELSE 'F' || (p_partkey % 9) END AS fallback_unit_code,
  CASE WHEN p_partkey % 3 = 0 THEN '{"a":"' || building_id || '","b":"x"}' ELSE '{"b":"x"}' END AS aliases_json, 'x' AS alias_b, 'EPSG:2950' AS hub_city_crs FROM standard""",
    )
)
def hub_building_table(spark, d):
    out = buildings.hub_building_table(_attributed(spark, d), "montreal", alias_keys=["b"])
    return _doubles(rounded(out), "year_of_construction").select("id", "function", "year_of_construction", "storeys_above_ground", "storey_height_m", "fallback_unit_type", "fallback_unit_code", "aliases_json", "alias_b", "hub_city_crs")


def _synpop(spark, d):
    o = fx.table(spark, d, "orders")
    return o.select((F.col("o_custkey") % 50).cast("string").alias("area"), F.when(F.col("o_orderkey") % 11 == 0, -1).otherwise(F.col("o_custkey")).alias("HID"))


@query("SELECT (o_custkey % 50)::VARCHAR AS da_code, count(*) AS n_individuals_syn, count(DISTINCT CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey END) AS n_households_syn FROM orders GROUP BY 1")
def summarize_synpop(spark, d):
    return synpop.summarize_synpop(_synpop(spark, d))


def _da_input(spark, d):
    small = fx.small_areas(spark, d).withColumn("has_geometry", F.lit(True))
    people = fx.people(spark, d).where("code % 2 = 0").select(F.col("code").cast("string").alias("code"), "population")
    return synpop.synpop_input(small, spatial.nearest_units(small, fx.areas(spark, d)), people, "montreal")


INPUT = f"""r AS (SELECT s.code, a.code AS unit, row_number() OVER (PARTITION BY s.code ORDER BY {NEAR}, a.code) AS k FROM small_areas s, areas a),
n AS (SELECT code, max(CASE WHEN k = 1 THEN unit END) AS u1, max(CASE WHEN k = 2 THEN unit END) AS u2, max(CASE WHEN k = 3 THEN unit END) AS u3 FROM r GROUP BY code),
i AS (SELECT n.*, c.c_custkey IS NOT NULL AS has, (100 + c.c_custkey % 97)::DOUBLE AS people FROM n LEFT JOIN customer c ON c.c_custkey = n.code::BIGINT AND c.c_custkey % 2 = 0)"""


@query(with_tables("areas small_areas", INPUT + " SELECT 'montreal' AS city_name, code AS da_code, people AS population_2021, u1 AS nearest_fsa_1, u2 AS nearest_fsa_2, u3 AS nearest_fsa_3, has AS has_census, true AS has_geometry FROM i"))
def synpop_input(spark, d):
    return _da_input(spark, d).drop("city_crs")


@query(
    with_tables(
        "areas small_areas",
        INPUT + " SELECT 'montreal' AS city_name, 25 AS n_fsas, count(*) AS n_das, 7 AS n_buildings, count(*) FILTER (WHERE has) AS n_das_with_census, count(*) AS n_das_with_geometry, sum(people) AS population_2021_sum, string_agg(code, ',' ORDER BY code) AS da_codes FROM i",
    )
)
def synpop_manifest(spark, d):
    return synpop.synpop_manifest(_da_input(spark, d), 25, 7).drop("city_crs").withColumn("da_codes", F.array_join("da_codes", ","))


@query(
    with_tables(
        "areas small_areas",
        INPUT + """, s AS (SELECT (o_custkey % 50)::VARCHAR AS code, count(*) AS p, count(DISTINCT CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey END) AS h FROM orders GROUP BY 1)
SELECT i.code AS da_code, people AS population_2021, s.p::DOUBLE AS n_individuals_syn, s.h::DOUBLE AS n_households_syn FROM i LEFT JOIN s ON s.code = i.code""",
    )
)
def merge_synpop(spark, d):
    out = synpop.merge_synpop(_da_input(spark, d), synpop.summarize_synpop(_synpop(spark, d)))
    return _doubles(out.select("da_code", "population_2021", "n_individuals_syn", "n_households_syn"), "n_individuals_syn", "n_households_syn")


@query(
    with_tables(
        "full_load",
        "kept AS (SELECT code FROM full_load GROUP BY code HAVING count(kwh) / count(*) >= 0.8), s AS (SELECT * FROM full_load WHERE code IN (SELECT code FROM kept)), "
        + FILL.format(source="s", x="kwh")
        + " SELECT code, ts, round(y, 6) AS kwh FROM filled",
    )
)
def preprocess_load(spark, d):
    return rounded(quality.preprocess_load(fx.load_gappy(spark, d), min_coverage=0.8, fill="interpolate")[0])


@query(with_tables("load_hourly", "g AS (SELECT c.code, t.ts FROM (SELECT DISTINCT code FROM load_hourly) c, (SELECT DISTINCT ts FROM load_hourly) t) SELECT g.code, g.ts, round(l.kwh, 6) AS kwh FROM g LEFT JOIN load_hourly l ON l.code = g.code AND l.ts = g.ts"))
def wide_and_back(spark, d):
    return rounded(long_from_wide(wide_from_long(fx.load_hourly(spark, d))))


@query()
def rebuild_load(spark, d):
    load = fx.load_user(spark, d).where("code % 10 <> 3").withColumn("code", F.col("code").cast("string"))
    known = fx.census_long(spark, d).withColumn("code", F.col("code").cast("string"))
    areas = fx.load_user(spark, d).select(F.col("code").cast("string").alias("code")).distinct()
    options = {"min_coverage": 0.0}
    return rebuild(load, fx.weather_hourly(spark, d), known, areas, preprocess=options)[0]


from gridloom.plans import file_queries, model_queries, series_queries  # noqa: E402, F401  (they register their queries here)
