import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import anomalies, prism, short_term
from tests import plain_prism as plain
from tests.test_timeseries import START, series


def test_stl_adds_up_and_isolates_spikes(spark):
    n = 24 * 20
    k = np.arange(n)
    clean = 50 + 0.02 * k + 10 * np.sin(2 * np.pi * k / 24)
    y = clean + np.random.default_rng(0).normal(0, 0.2, n)
    y[[100, 300]] += [25, -25]
    for robust in (True, False):
        trend, season, resid = anomalies.stl(y, 24, robust)
        np.testing.assert_allclose(trend + season + resid, y)
        inner = slice(24, -24)
        assert np.abs(trend - (50 + 0.02 * k))[inner].max() < (0.5 if robust else 3)
    got = anomalies.stl_anomalies(series(spark, y.tolist()), 24, z_thresh=8.0).orderBy("ts").collect()
    assert {i: r.anomaly_direction for i, r in enumerate(got) if r.is_anomaly and abs(r.robust_z) > 40} == {100: "high", 300: "low"}


def test_stl_of_a_pure_cycle_has_no_residual():
    k = np.arange(24 * 14)
    trend, season, resid = anomalies.stl(5 + np.sin(2 * np.pi * k / 24), 24, False)
    assert np.abs(resid).max() < 0.02 and np.abs(season.reshape(-1, 24).sum(1)).max() < 0.5
    with pytest.raises(ValueError):
        anomalies.stl(np.ones(47), 24)


def test_loess_keeps_lines():
    y = 3 + 0.5 * np.arange(60.0)
    np.testing.assert_allclose(anomalies.loess(y, 15), y)
    np.testing.assert_allclose(anomalies.loess(y, 15, np.array([-1.0, 60.0])), [2.5, 33.0])


def test_scores_without_deviation(spark):
    df = series(spark, [1.0] * 9 + [5.0]).withColumnRenamed("kwh", "resid")
    got = anomalies.score_residuals(df, 2.0).orderBy("ts").collect()
    assert got[-1].robust_z == pytest.approx(4 / np.std([1] * 9 + [5])) and got[-1].anomaly_direction == "high"
    flat = anomalies.score_residuals(series(spark, [2.0] * 5).withColumnRenamed("kwh", "resid")).collect()
    assert {r.robust_z for r in flat} == {0.0}


def test_treatment_reaches_the_target_or_says_so(spark):
    rng = np.random.default_rng(1)
    y = 20 + 5 * np.sin(2 * np.pi * np.arange(480) / 24) + rng.normal(0, 0.1, 480)
    y[[50, 200, 333]] += 30
    treated, report = anomalies.treat_anomalies(series(spark, y.tolist()), target_rate=0.01, z_thresh=8.0)
    r = report.first()
    assert r.status == "ok" and r.n_replaced >= 3 and r.initial_rate > 0.01 >= r.final_rate
    assert max(x.kwh for x in treated.collect()) < 30
    short = anomalies.treat_anomalies(series(spark, [1.0] * 10))[1].first()
    assert short.status == "too_short"
    capped = anomalies.treat_anomalies(series(spark, y.tolist()), target_rate=0.0, max_iter=1, z_thresh=2.0)[1].first()
    assert capped.status == "not_conformed" and capped.iterations == 1


def test_replacement_methods(spark):
    df = anomalies.score_residuals(series(spark, [1, 2, 30, 4, 5, 6, 7, 8.0]).withColumnRenamed("kwh", "resid"), 3.0)
    df = df.selectExpr("*", "resid as kwh", "1.5 as trend", "2.0 as seasonal")
    by = {m: [float(r.kwh) for r in anomalies.replace_anomalies(df, m, 5).orderBy("ts").collect()] for m in anomalies.METHODS}
    assert by["interp"][2] == 3 and by["stl_rebuild"][2] == 3.5 and by["rolling_median"][2] == 3.0
    with pytest.raises(ValueError):
        anomalies.replace_anomalies(df, "rolling_median", 2)


def dtw(x, y):
    table = np.full((len(x) + 1, len(y) + 1), np.inf)
    table[0, 0] = 0
    for i, a in enumerate(x, 1):
        for j, b in enumerate(y, 1):
            table[i, j] = abs(a - b) + min(table[i - 1, j], table[i, j - 1], table[i - 1, j - 1])
    return table[-1, -1]


def test_time_warping_matches_the_textbook():
    p = np.random.default_rng(2).normal(size=(12, 24))
    d = short_term.dtw_pairs(p)
    assert np.array_equal(d, d.T) and not d.diagonal().any()
    for i, j in ((0, 1), (3, 9), (10, 11)):
        assert d[i, j] == pytest.approx(dtw(p[i], p[j]))


def test_medoids_separate_clear_groups():
    p = np.concatenate([np.random.default_rng(3).normal(m, 0.1, (15, 24)) for m in (0, 5)])
    d = short_term.dtw_pairs(p)
    labels, medoids = short_term.k_medoids(d, 2)
    assert len(set(labels[:15])) == len(set(labels[15:])) == 1 and labels[0] != labels[15]
    assert short_term.silhouette(d, labels) > 0.9 and short_term.silhouette(d, np.zeros(30, int)) == -1
    single = np.array([0] * 29 + [1])
    assert short_term.silhouette(d, single, 1.0) > short_term.silhouette(d, single, 0.0)


def test_clusters_of_days(spark):
    rows = []
    for day in range(40):
        for h in range(24):
            x = np.sin(2 * np.pi * (h + 12 * (day % 2)) / 24) + 0.01 * day
            rows.append(("a", START + dt.timedelta(days=day, hours=h), float(x)))
    load = spark.createDataFrame(rows, "code string, ts timestamp_ntz, kwh double")
    profiles = short_term.daily_profiles(load)
    labels = short_term.cluster_profiles(profiles)
    got = labels.orderBy("date").collect()
    assert {r.k for r in got} == {2} and len({r.cluster_label for r in got[::2]}) == 1 and got[0].cluster_label != got[1].cluster_label
    d = short_term.dominant_label(labels, 0.6).first()
    assert (d.dominant_label, d.dominant_share, d.n_labeled_days) == ("no_decision", 0.5, 40)
    few = short_term.cluster_profiles(profiles, min_days=50).collect()
    assert {r.cluster_label for r in few} == {"no_decision"}
    stats = short_term.cluster_hour_stats(profiles, labels)
    assert stats.count() == 48 and {r.n_days for r in stats.collect()} == {20}
    table = short_term.short_term_table(load, weekdays_only=False, clusters=True).first()
    assert table.dominant_share == 0.5
    own = short_term.label_days(profiles, lambda p: "up" if p[6] > 0 else "down")
    assert {r.cluster_label for r in own.collect()} == {"up", "down"}


def test_long_areas_are_clustered_over_a_table(spark, monkeypatch):
    """Distances by blocks are those of one matrix; labels, k and silhouettes too; areas of few days stay in their group."""
    rng = np.random.default_rng(7)
    shapes = rng.normal(size=(3, 24))
    rows = [(c, START.date() + dt.timedelta(days=k), (shapes[k % 3] + rng.normal(0, 0.4, 24)).tolist()) for c, n in (("a", 37), ("b", 24), ("c", 9), ("d", 1)) for k in range(n)]
    profiles = spark.createDataFrame(rows, "code string, date date, profile array<double>")
    own = {c: np.array([p for code, _, p in rows if code == c]) for c in "abcd"}
    far = {c: short_term.dtw_pairs(p) for c, p in own.items()}
    got = short_term.dtw_table(profiles, block=7).collect()
    assert len(got) == sum(n * (n - 1) // 2 for n in (37, 24, 9, 1))
    assert all(r.i < r.j and r.date < r.other and r.distance == pytest.approx(far[r.code][r.i, r.j]) for r in got)
    monkeypatch.setattr(short_term, "BLOCK_DAYS", 10)
    key = lambda r: (r.code, r.date)
    want = sorted(short_term.cluster_profiles(profiles, k_max=4).collect(), key=key)
    for most in (8, 30):
        found = sorted(short_term.cluster_profiles(profiles, k_max=4, most=most).collect(), key=key)
        assert [(key(r), r.cluster_label, r.k) for r in found] == [(key(r), r.cluster_label, r.k) for r in want]
        scores = [[-9 if r.silhouette is None else r.silhouette for r in x] for x in (found, want)]
        assert scores[0] == pytest.approx(scores[1])


def points(t, **p):
    full = {"x0": -10.0, "x1": 10.0, "x2": 20.0, "y0": 0.0, "y1": 30.0, "k0": 0.0, "k1": 0.0, "k2": 0.0} | p
    return full


SHAPES = [("2ch", {"x1": 13.3, "k1": -2.0}), ("2cl", {"x2": 18.65, "k2": 1.5}), ("3sg", {"x1": 11.2, "x2": 19.4, "k1": -2.0, "k2": 3.0})]


def fitted(spark, series, **options):
    """One fit for each of {name: (t, y)}."""
    rows = [(name, float(a), float(b)) for name, (t, y) in series.items() for a, b in zip(t, y, strict=True)]
    return prism.prism_fit(spark.createDataFrame(rows, "code string, temperature double, kwh double"), **options)


def test_segments_are_recovered(spark):
    t = np.linspace(-25, 35, 700)
    series = {m: (t, plain.evaluate(m, t, points(t, **p))) for m, p in SHAPES}
    fit = fitted(spark, series)
    curves = prism.prism_curve(fit, -20.0, 30.0, 11).orderBy("temperature").collect()
    for m, p in SHAPES:
        r = fit.where(F.col("code") == m).first()
        y = series[m][1]
        assert r.model == m and r.r2 > 0.9999 and m in r.candidates and r.sse < 1e-4 * ((y - y.mean()) ** 2).sum()
        for k, v in p.items():
            assert r[k] == pytest.approx(v, abs=0.026)
        want = plain.evaluate(m, np.linspace(-20, 30, 11), {k: r[k] for k in prism.PARAMETERS})
        assert [c.fitted for c in curves if c.code == m] == pytest.approx(want.tolist())


def test_fits_are_never_worse_than_a_plain_grid(spark):
    """Every model of noisy series of every shape, and the choice among them, against least squares on a grid."""
    rng = np.random.default_rng(11)
    t = np.round(rng.uniform(-28, 33, 400), 1)
    shapes = {m: (t, plain.evaluate(m, t, points(t, **p)) + rng.normal(0, 3, len(t))) for m, p in SHAPES}
    cold = {"x0": -12.0, "x1": 12.0, "k1": -2.0, "k0": 0.5, "y0": 78.0}
    shapes["3be"] = t, plain.evaluate("3be", t, points(t, **cold)) + rng.normal(0, 2, len(t))
    shapes["4sg"] = t, plain.evaluate("4sg", t, points(t, **cold, k2=2.5)) + rng.normal(0, 2, len(t))
    shapes["noise"] = t, 20 + rng.normal(0, 3, len(t))
    every = ("2ch", "2cl", "3seg", "3be", "4sg")
    for options in ({}, {"models": every}, {"models": every, "f_rule": "critical"}):
        got = {r.code: r for r in fitted(spark, shapes, **options).collect()}
        for name, (x, y) in shapes.items():
            want = plain.fit_segments(x, y, options.get("models", ("2ch", "2cl", "3seg")), options.get("f_rule", "pdf"))
            assert set(want["candidates"]) <= set(got[name].candidates)
            for m, c in want["candidates"].items():
                slack = 2e-3 if m == "4sg" else 1e-6  # the coarse grid of three breaks is another, which may lead to another local optimum
                assert got[name].candidates[m].sse <= c["sse"] * (1 + slack), (name, m)
            assert got[name].model == want["model"] and (got[name].n_left, got[name].n_right) == ((x <= got[name].x1).sum(), (x >= got[name].x2).sum())
            rest = y - plain.evaluate(got[name].model, x, {k: got[name][k] for k in prism.PARAMETERS})
            assert (rest**2).sum() == pytest.approx(got[name].sse, rel=1e-5) and rest.std(ddof=1) == pytest.approx(got[name].resid_std, rel=1e-5)


def test_cold_break_is_a_candidate_that_needs_leave(spark):
    t = np.linspace(-30, 30, 900)
    y = plain.evaluate("3be", t, points(t, x0=-12.0, x1=12.0, k1=-2.0, k0=0.5, y0=78.0))
    assert fitted(spark, {"a": (t, y)}, models=("2ch", "2cl", "3seg", "3be")).first().model == "3be"
    assert fitted(spark, {"a": (t, y)}).first().model in ("2ch", "2cl", "3sg")


def test_f_distribution(spark):
    value = lambda x: spark.range(1).select(x).first()[0]
    for d1 in (2, 4):
        for d2 in (3, 50, 4000):
            assert value(prism.f_density(0.05, d1, F.lit(float(d2)))) == pytest.approx(plain.f_density(0.05, d1, d2), rel=1e-9)
        assert value(prism.f_critical(0.05, d1, F.lit(100.0))) == pytest.approx(plain.f_critical(0.05, d1, 100), rel=0.02)
    assert value(prism.f_critical(0.05, 4, F.lit(100.0))) == pytest.approx(2.4626, rel=1e-4)


def test_few_points_or_no_variation_give_no_fit(spark):
    df = spark.createDataFrame([("a", 5.0, 1.0)] * 30 + [("b", float(k), 1.0) for k in range(10)], "code string, temperature double, kwh double")
    assert prism.prism_fit(df).count() == 0


def test_treatment_leaves_gaps_of_a_series_that_conforms(spark):
    """Gaps are filled for the decomposition only; a series with replaced points has none left; other areas pass through."""
    k = np.arange(240)
    y = 20 + 5 * np.sin(2 * np.pi * k / 24) + np.random.default_rng(1).normal(0, 0.1, 240)
    gap = [None if 50 <= i < 53 else float(v) for i, v in enumerate(y)]
    treated, report, parts = anomalies.treat_anomalies(series(spark, gap), target_rate=0.1, z_thresh=8.0, components=True)
    assert treated.where("kwh is null").count() == 3 and report.first().status == "ok" and report.first().n_replaced == 0
    assert parts.count() == 240 and parts.where("is_anomaly").count() == report.first().final_n_anomalies
    y[100] += 40
    spiked = series(spark, [None if 50 <= i < 53 else float(v) for i, v in enumerate(y)])
    treated, report = anomalies.treat_anomalies(spiked, target_rate=0.0, z_thresh=8.0)
    assert treated.where("kwh is null").count() == 0 and report.first().n_replaced >= 1
    other, none = anomalies.treat_anomalies(spiked, target_rate=0.0, codes=["zz"])
    assert none.count() == 0 and other.exceptAll(spiked).count() == 0


@pytest.mark.parametrize(("method", "robust"), [("interp", False), ("stl_rebuild", False), ("interp", True)])
def test_treatment_of_many_areas_is_that_of_each(monkeypatch, method, robust):
    """Series of a length are treated together by tables, fewer decompositions than rounds, with the same hits and statuses."""
    rng = np.random.default_rng(5)
    y = 5 + np.sin(np.arange(96) * np.pi / 12) + rng.normal(0, 0.1, (40 if not robust else 4, 96))
    y[rng.random(y.shape) < 0.03] += 4
    y[0, 5:9], y[1], y[2] = np.nan, np.nan, 0.0
    calls, stl = [], anomalies.stl
    monkeypatch.setattr(anomalies, "stl", lambda *a: calls.append(a) or stl(*a))
    anomalies._linear.cache_clear()
    together = anomalies._treated(y, 24, 3.0, 0.001, 10, method, robust, True)
    assert robust or len(calls) == 96
    for k in range(len(y)):
        alone = anomalies._treated(y[k : k + 1], 24, 3.0, 0.001, 10, method, robust, True)
        assert np.allclose(together[0][k], alone[0][0], equal_nan=True, atol=1e-9)
        for one, all_ in zip(alone[1:], together[1:], strict=True):
            for c in one:
                same = one[c][0] == all_[c][k] if c == "status" else np.allclose(one[c][0].astype(float), all_[c][k].astype(float), equal_nan=True, atol=1e-6)
                assert same, (k, c)


def test_areas_longer_and_shorter_than_a_batch(spark, monkeypatch):
    """Each area keeps its own rows and report where batches end within areas; a null key is an area."""
    hours = "transform(sequence(0, n - 1), k -> struct(timestamp_ntz'2024-01-01' + make_dt_interval(0, k) as ts, 5 + sin(k / 12 * pi()) + if(k = 30, 9, 0) as kwh))"
    areas = spark.createDataFrame([(f"a{k:02}", 60 + k) for k in range(30)] + [("long", 4000), (None, 70), ("short", 10)], "code string, n int")
    treated, report = anomalies.treat_anomalies(areas.selectExpr("code", f"inline({hours})"), z_thresh=8.0, target_rate=0.5)
    got = {r.code: r for r in report.collect()}
    sizes = {r.code: r["count"] for r in treated.groupBy("code").count().collect()}
    want = {r.code: r.n for r in areas.collect()}
    assert sizes == want == {c: r.n_points for c, r in got.items()} and got["short"].status == "too_short" and got["a00"].status == "ok"
