import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.operators import quality, short_term, timeseries, weather_model

START = dt.datetime(2024, 1, 1)


def series(spark, values, code="a", step=1):
    rows = [(code, START + dt.timedelta(hours=step * k), None if v is None else float(v)) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "code string, ts timestamp_ntz, kwh double")


def values(df):
    return [r.kwh for r in df.orderBy("ts").collect()]


GAPS = [None, None, 1, None, None, None, None, None, 7, None, None]


def test_interpolation_is_linear_by_position_and_flat_outside(spark):
    assert values(timeseries.interpolate_both(series(spark, GAPS))) == [1, 1, 1, 2, 3, 4, 5, 6, 7, 7, 7]


def test_interpolation_limit_fills_from_both_sides(spark):
    assert values(timeseries.interpolate_both(series(spark, GAPS), limit=1)) == [None, 1, 1, 2, None, None, None, 6, 7, 7, None]


def test_interpolation_of_nothing_is_nothing(spark):
    assert values(timeseries.interpolate_both(series(spark, [None, None]))) == [None, None]


def test_ffill_limit(spark):
    assert values(timeseries.ffill(series(spark, GAPS), limit=2)) == [None, None, 1, 1, 1, None, None, None, 7, 7, 7]


@pytest.mark.parametrize("replace", ["interp", "median"])
def test_hampel_matches_pandas(spark, replace):
    rng = np.random.default_rng(0)
    x = rng.normal(10, 1, 200)
    x[[30, 31, 120]] = 60
    x[50:54] = np.nan
    s = pd.Series(x)
    med = s.rolling(24, center=True, min_periods=8).median()
    off = (s - med).abs()
    sigma = 1.4826 * off.rolling(24, center=True, min_periods=8).median()
    hit = (sigma > 0) & (off > 5 * sigma)
    want = s.where(~hit, med) if replace == "median" else s.where(~hit).interpolate(limit_direction="both")
    got = timeseries.hampel(series(spark, [None if np.isnan(v) else v for v in x]), replace=replace)
    assert hit.sum() == 3 and [r.is_outlier for r in got.orderBy("ts").collect()] == hit.tolist()
    np.testing.assert_allclose(np.array(values(got), float), want.to_numpy())


def test_regularize_fills_the_shared_grid(spark):
    both = series(spark, [1, 2, 3], "a").unionByName(series(spark, [5], "b", 2)).where("not (code = 'a' and kwh = 2)")
    got = timeseries.regularize(both)
    assert [(r.code, r.kwh) for r in got.orderBy("code", "ts").collect()] == [("a", 1), ("a", None), ("a", 3), ("b", 5), ("b", None), ("b", None)]
    assert timeseries.regularize(both, own_range=True).where("code = 'b'").count() == 1


def test_empty_month_sums_to_zero(spark):
    rows = [("a", dt.datetime(2024, 1, 5), 2.0), ("a", dt.datetime(2024, 3, 5), None)]
    df = spark.createDataFrame(rows, "code string, ts timestamp_ntz, kwh double")
    assert values(timeseries.monthly_energy(df)) == [2.0, 0.0, 0.0]
    assert values(timeseries.monthly_energy(df, "mean")) == [2.0, None, None]


def test_nearest_weather_prefers_the_later_on_ties(spark):
    left = series(spark, [1, 2, 3, 4])
    right = spark.createDataFrame([(START, 10.0), (START + dt.timedelta(hours=2), 20.0)], "ts timestamp_ntz, t double")
    got = timeseries.asof_nearest(left, right, "t").orderBy("ts").collect()
    assert [r.t for r in got] == [10, 20, 20, 20]


def test_weather_that_repeats_a_time_is_averaged(spark):
    load = series(spark, [1, 2, None, 4])
    weather = spark.createDataFrame([(START, 0.0), (START, 4.0), (START + dt.timedelta(hours=3), 8.0)], "ts timestamp_ntz, temperature double")
    got = timeseries.align_weather(load, weather).orderBy("ts").collect()
    assert [r.temperature for r in got] == [2, 5, 8]
    assert timeseries.align_weather(load, weather, deduplicate=False).count() == 4


def test_coverage_drops_the_area_that_lacks_it(spark):
    both = series(spark, [1, None, None, 4], "low").unionByName(series(spark, [1, -2, 3, 4], "high"))
    clean, qc = quality.preprocess_load(both, min_coverage=0.7, fill="interpolate")
    assert {r.code: r.coverage for r in qc.collect()} == {"low": 0.5, "high": 0.75}
    assert [(r.code, r.kwh) for r in clean.orderBy("ts").collect()] == [("high", 1), ("high", 2), ("high", 3), ("high", 4)]
    with pytest.raises(Exception, match="negative"):
        quality.preprocess_load(both, clip=False)[0].collect()


def weather_and_load(spark, t, y):
    rows = [("a", START + dt.timedelta(hours=k), float(b), float(a)) for k, (a, b) in enumerate(zip(t, y, strict=True))]
    return spark.createDataFrame(rows, "code string, ts timestamp_ntz, kwh double, temperature double")


def test_degree_days_recover_the_coefficients(spark):
    t = np.linspace(-20, 35, 300)
    y = 5 + 2 * np.maximum(18 - t, 0) + 3 * np.maximum(t - 18, 0)
    r = weather_model.degree_day_fit(weather_and_load(spark, t, y)).first()
    assert (r.intercept, r.heating_slope, r.cooling_slope, r.r2) == pytest.approx((5, 2, 3, 1))
    r = weather_model.degree_day_fit(weather_and_load(spark, [10.0] * 20, [6.0] * 20)).first()
    assert (r.intercept, r.heating_slope, r.cooling_slope) == pytest.approx((6 / 65, 48 / 65, 0))


def test_change_point_is_found_and_ties_go_low(spark):
    t = np.linspace(-20, 35, 300)
    y = 5 + 2 * np.maximum(14.5 - t, 0)
    r = weather_model.heating_change_point(weather_and_load(spark, t, y)).first()
    assert (r.change_point, r.baseload, r.heating_slope) == pytest.approx((14.5, 5, 2))
    r = weather_model.heating_change_point(weather_and_load(spark, t, np.full(300, 4.0))).first()
    assert r.change_point == 8.0
    assert weather_model.heating_change_point(weather_and_load(spark, t[:9], y[:9])).count() == 0


def test_normalisation_removes_the_slope_and_keeps_the_rows(spark):
    t = np.tile([0.0, 10.0, 20.0], 10)
    load = weather_and_load(spark, t, 100 - 2 * t)
    got = weather_model.normalize_weather(load.select("code", "ts", "kwh"), load)
    assert {round(v, 9) for v in values(got)} == {80.0} and got.count() == 30


def test_invalid_population_is_an_error_or_null(spark):
    load = series(spark, [10, 20])
    people = lambda n: spark.createDataFrame([("a", n)], "code string, population double")
    assert values(weather_model.per_capita(load, people(10.0))) == [1, 2]
    assert values(weather_model.per_capita(load, people(0.0), strict=False)) == [None, None]
    with pytest.raises(Exception, match="no valid population"):
        weather_model.per_capita(load, people(0.0)).collect()


def test_weather_first_then_population(spark):
    t = np.tile([0.0, 10.0], 240)
    df = weather_and_load(spark, t, 100 - t)
    people = spark.createDataFrame([("a", 5.0)], "code string, population double")
    r = short_term.short_term_table(df.select("code", "ts", "kwh"), df.select("ts", "temperature"), people, weekdays_only=False).first()
    assert r.peak_load == pytest.approx(95 / 5) and r.n_days == 20


def test_daily_metrics_of_short_and_long_days(spark):
    day = [float(k) for k in range(25)]
    rows = [("a", dt.datetime(2024, 11, 3, min(k, 23), 30 * (k == 24)), v) for k, v in enumerate(day)]
    rows += [("b", dt.datetime(2024, 3, 10, 5), 4.0)]
    got = {r.code: r for r in short_term.daily_metrics(spark.createDataFrame(rows, "code string, ts timestamp_ntz, kwh double")).collect()}
    assert (got["a"].peak_load, got["a"].p90_top10_mean, got["a"].am_pm_peak_ratio, got["a"].ramp_up_rate) == (24, 23, 11 / 21, 1)
    assert (got["b"].peak_load, got["b"].am_pm_peak_ratio, got["b"].ramp_up_rate) == (4, None, None)


def test_profiles_average_a_repeated_hour_and_fill_a_missing_one(spark):
    rows = [("a", dt.datetime(2024, 11, 3, h), float(h)) for h in range(24) if h != 2] + [("a", dt.datetime(2024, 11, 3, 1, 30), 3.0)]
    df = spark.createDataFrame(rows, "code string, ts timestamp_ntz, kwh double")
    profile = short_term.daily_profiles(df, normalize=False).first().profile
    assert profile == [0, 2, 2.5] + list(range(3, 24))
    z = short_term.daily_profiles(df).first().profile
    assert np.mean(z) == pytest.approx(0) and np.std(z) == pytest.approx(1)
    assert short_term.daily_profiles(df, min_hours=24).count() == 0


def test_dst_days_in_local_time(spark):
    from gridloom.sources.readers import long_from_raw

    rows = [("H1A ", f"2024-{m}-{d} {h:02d}:00:00", "1.5") for m, d in (("03", "10"), ("11", "03")) for h in range(4, 9)]
    got = long_from_raw(spark.createDataFrame(rows, "CP3 string, DateIntervalUTC string, kWh string")).orderBy("ts").collect()
    spring = [(r.ts.hour, r.kwh) for r in got if r.ts.month == 3]
    autumn = [(r.ts.hour, r.kwh) for r in got if r.ts.month == 11]
    assert {r.code for r in got} == {"H1A"}
    assert [h for h, _ in spring if h < 23] == [0, 1, 3, 4]
    assert sorted(h for h, _ in autumn) == [0, 1, 1, 2, 3] and {v for _, v in autumn} == {1.5}  # the repeated hour is there twice
    assert [r.utc for r in sorted(got, key=lambda r: r.utc)] == [r.utc for r in sorted(got, key=lambda r: (r.ts, r.utc))]
    for bad in ("x", None):
        with pytest.raises(Exception, match="cannot read kWh"):
            long_from_raw(spark.createDataFrame([("a", "2024-01-01 00:00:00", bad)], "CP3 string, DateIntervalUTC string, kWh string")).collect()


def test_color_limits_fall_back_to_extremes(spark):
    r = timeseries.color_limits(series(spark, list(range(101))), "kwh").first()
    assert (r.low, r.high) == (2, 98)
    r = timeseries.color_limits(series(spark, [5] * 200 + [9]), "kwh").first()
    assert (r.low, r.high) == (5, 9)


def test_months_are_checked():
    from gridloom.functions.columns import months_of

    with pytest.raises(ValueError):
        months_of("ts", [0])
    assert F.col("x") is not None


def test_grids_of_fixed_steps_take_no_join(spark):
    """As by a join with the grid: rows off it, repeated ones, those without time or key, and keys with none on it."""
    rows = [("a", "2024-03-10 01:00:00", 1.0), ("a", "2024-03-10 04:00:00", 2.0), ("a", "2024-03-10 04:00:00", 3.0), ("a", "2024-03-10 02:30:00", 4.0), ("a", None, 5.0)]
    rows += [("b", "2024-03-10 03:00:00", None), (None, "2024-03-10 02:00:00", 6.0), ("c", "2024-03-10 02:20:00", 7.0), ("d", None, 8.0), ("e", "2024-03-10 00:00:00", 9.0)]
    df = spark.createDataFrame(rows, "code string, ts string, kwh double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Toronto")  # its clocks skip an hour here
    try:
        for own in (False, True):
            ends = df.groupBy("code").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
            if not own:
                ends = ends.select("code").crossJoin(df.agg(F.min("ts").alias("a"), F.max("ts").alias("b")))
            grid = ends.select("code", F.explode(F.sequence("a", "b", F.expr("interval 1 hour"))).alias("ts"))
            want = grid.join(df, ["code", "ts"], "left").select("code", "ts", "kwh")
            got = timeseries.regularize(df, own_range=own)
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
            assert "LeftOuter" not in got._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_weather_normalises_without_joining_load_to_itself(spark):
    """As in two steps, with gaps of temperature, missing load and areas without weather; the load is in one join by area only."""
    hours = spark.range(60).selectExpr("timestamp_ntz'2024-01-01' + make_dt_interval(0, cast(id as int)) as ts", "id")
    load = hours.selectExpr("'a' as code", "ts", "if(id % 7 = 0, null, cast(id * 5 % 13 as double)) as kwh").union(hours.selectExpr("'b'", "ts", "cast(id * 3 % 17 as double)"))
    load = load.union(spark.range(3).selectExpr("'c'", "timestamp_ntz'2025-01-01' + make_dt_interval(0, cast(id as int))", "1.0D"))
    weather = hours.where("id % 9 <> 2").selectExpr("ts", "cast(id * 7 % 11 as double) as temperature")
    want = weather_model.normalize_weather(load, timeseries.align_weather(load, weather))
    got = weather_model.normalize_by_weather(load, weather)
    rows = lambda df: sorted((r.code, str(r.ts), None if r.kwh is None else round(r.kwh, 9)) for r in df.collect())
    assert rows(got) == rows(want) and got.columns == load.columns
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter, ((code")
    assert joins(got) < joins(want)
