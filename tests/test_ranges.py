"""Ranges of an order: the same results for any number of ranges, against numpy and the operators that take a group whole."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import ranges, timeseries
from tests.test_timeseries import START


@pytest.mark.parametrize("n", [1, 3, 40])
def test_quantiles(spark, n):
    """Of groups with repeated values, nulls, NaN, one value, and none; a third of the table is one value of one group."""
    rng = np.random.default_rng(2)
    groups = {"a": rng.normal(0, 1e6, 700), "b": rng.integers(-3, 4, 500).astype(float), "c": np.array([7.5]), None: rng.uniform(0, 1, 90)}
    rows = [(g, float(v)) for g, own in groups.items() for v in own] + [("b", 2.0)] * 600 + [("a", None), ("a", float("nan")), ("none", None)]
    groups["b"] = np.append(groups["b"], [2.0] * 600)
    at = {"low": 0.0, "some": 0.023, "mid": 0.5, "high": 0.98, "top": 1.0}
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in ranges.quantiles(df, "v", at, ["g"], n).collect()}
    assert set(got) == set(groups)
    for g, own in groups.items():
        for name, p in at.items():
            assert got[g][name] == pytest.approx(np.quantile(own, p), rel=1e-12, abs=1e-12)
    whole = ranges.quantiles(df, "v", {"q": 0.37}, ranges=n).first()
    assert whole.q == pytest.approx(np.quantile(np.concatenate(list(groups.values())), 0.37))
    assert ranges.quantiles(df.limit(0), "v", at, ["g"], n).count() == 0
    assert set(ranges.quantiles(df.limit(0), "v", at).first()) == {None}


def test_no_range_holds_much_more_than_its_share(spark):
    df = spark.range(20_000).select((F.col("id") * F.col("id")).alias("v"))
    sizes = [r["count"] for r in ranges.with_ranges(df, "v", 20).groupBy("range").count().collect()]
    assert len(sizes) >= 19 and max(sizes) < 3 * 1000
    ends = ranges.with_ranges(df, "v", 20).groupBy("range").agg(F.min("v").alias("a"), F.max("v").alias("b")).orderBy("range").collect()
    assert all(x.b < y.a for x, y in zip(ends, ends[1:], strict=False))


def gappy(spark):
    rng = np.random.default_rng(5)
    rows = []
    for code, n in (("a", 200), ("b", 30), ("c", 3), ("d", 4)):
        for h in range(n):
            missing = code == "d" or rng.random() < 0.4 or 60 < h < 120
            rows.append((code, START + dt.timedelta(hours=h), None if missing and code != "c" else float(rng.integers(1, 90))))
    return spark.createDataFrame(rows, "code string, ts timestamp_ntz, kwh double")


@pytest.mark.parametrize("n", [1, 2, 9, 64])
def test_gaps_are_filled_alike_in_any_number_of_ranges(spark, n):
    df = gappy(spark)
    for f, options in ((timeseries.interpolate_both, {}), (timeseries.interpolate_both, {"limit": 2}), (timeseries.ffill, {"limit": 3}), (timeseries.ffill, {})):
        want = {(r.code, r.ts): r.kwh for r in f(df, **options).collect()}
        got = {(r.code, r.ts): r.kwh for r in f(df, ranges=n, **options).collect()}
        assert got == want and f(df, ranges=n).columns == df.columns


@pytest.mark.parametrize("n", [1, 2, 7, 50])
@pytest.mark.parametrize("by", [None, ["code"]])
def test_nearest_in_time(spark, n, by):
    rng = np.random.default_rng(9)
    time = lambda m: START + dt.timedelta(minutes=int(m))
    left = [("ab"[k % 2], time(m), k) for k, m in enumerate(rng.integers(-500, 3000, 300))]
    right = [("ab"[k % 2], time(m), None if k % 9 == 0 else float(k)) for k, m in enumerate(rng.permutation(np.arange(0, 2400, 8))[:60])]
    a, b = spark.createDataFrame(left, "code string, ts timestamp_ntz, k int"), spark.createDataFrame(right, "code string, ts timestamp_ntz, t double")
    got = {r.k: r.t for r in timeseries.asof_nearest(a, b if by else b.drop("code"), "t", by=by, ranges=n).collect()}
    assert len(got) == 300
    for code, ts, k in left:
        own = [(abs(at - ts), -(at - ts), t) for c, at, t in right if t is not None and (c == code or not by)]
        assert got[k] == min(own)[2]
    assert {r.t for r in timeseries.asof_nearest(a, b.limit(0).drop("code"), "t", ranges=n).collect()} == {None}


def test_bins_of_several_units(spark):
    rows = [("a", dt.datetime(2024, 1, 1, 7), 1.0), ("a", dt.datetime(2024, 1, 4, 1), 2.0), ("b", dt.datetime(2024, 1, 2, 2), 4.0)]
    df = spark.createDataFrame(rows, "code string, ts timestamp_ntz, kwh double")
    days = {(r.code, r.ts.day): r.kwh for r in timeseries.resample(df, "day", "sum").collect()}
    assert days == {("a", 1): 1, ("a", 2): 0, ("a", 3): 0, ("a", 4): 2, ("b", 1): 0, ("b", 2): 4, ("b", 3): 0, ("b", 4): 0}
    hours = {(r.code, r.ts): r.kwh for r in timeseries.resample(df, "6 hours", "mean").collect()}
    assert len(hours) == 2 * 12 and hours["a", dt.datetime(2024, 1, 1, 6)] == 1 and hours["a", dt.datetime(2024, 1, 1, 12)] is None and hours["b", dt.datetime(2024, 1, 2)] == 4
    months = {r.ts for r in timeseries.resample(spark.createDataFrame([("a", dt.datetime(2023, 11, 5), 1.0), ("a", dt.datetime(2024, 4, 2), 1.0)], df.schema), "3 months").collect()}
    assert months == {dt.datetime(2023, 11, 1), dt.datetime(2024, 2, 1)}
    with pytest.raises(ValueError, match="no unit"):
        timeseries.resample(df, "2 moons")
