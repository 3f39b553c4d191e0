"""Daily peak and ramp metrics, daily profiles, and profile clusters.

Metrics and profiles are windows and aggregates by (code, day). Only time warping runs in Python. The clustering needs it between
all pairs of an area's days: an area of up to MAX_DAYS days is one task's matrix; the pairs of a longer one are dealt to tasks by blocks of
days and kept as a table, over which assignments, medoids and silhouettes are aggregates.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.columns import is_weekday, months_of
from gridloom.operators.timeseries import align_weather, interpolate_both
from gridloom.operators.weather_model import normalize_weather, per_capita
from gridloom.storage import discard, stored

# Winter months, first and last morning and evening hours, the label of undecided days.
WINTER = (11, 12, 1, 2, 3, 4)
AM, PM = (6, 11), (16, 21)
NO_DECISION = "no_decision"
#: Days of an area that one task clusters: pairwise distances take 8 * MAX_DAYS^2 bytes. Days of a block of a longer one.
MAX_DAYS, BLOCK_DAYS = 4000, 256
METRICS = ["peak_load", "p90_top10_mean", "am_pm_peak_ratio", "ramp_up_rate"]


def daily_metrics(
    df: DataFrame, labels: DataFrame | None = None, key: str = "code", ts: str = "ts", value: str = "kwh", order: str | None = None
) -> DataFrame:
    """(key, date, peak_load, p90_top10_mean, am_pm_peak_ratio, ramp_up_rate, dtw_cluster_label) on rows with a value.

    labels: (key, date, cluster_label); days without one get null. order: the column that orders a day's rows
    where ts doesn't, such as utc if ts is local and an hour occurs twice.
    """
    rows = df.where(F.col(value).isNotNull()).select(key, F.to_date(ts).alias("date"), F.hour(ts).alias("hour"), F.col(order or ts).alias("at"), F.col(value).alias("x"))
    day = Window.partitionBy(key, "date")
    ranked = rows.withColumns(
        {
            "place": F.row_number().over(day.orderBy(F.desc("x"))),
            "n": F.count(F.lit(1)).over(day),
            "rise": F.col("x") - F.lag("x").over(day.orderBy("at")),
        }
    )
    top = F.col("place") <= F.greatest(F.lit(1), F.ceil(F.col("n") / 10))
    am, pm = (F.max(F.when(F.col("hour").between(*h), F.col("x"))) for h in (AM, PM))
    out = ranked.groupBy(key, "date").agg(
        F.max("x").alias("peak_load"),
        F.avg(F.when(top, F.col("x"))).alias("p90_top10_mean"),
        F.when(pm != 0, am / pm).alias("am_pm_peak_ratio"),
        F.max("rise").alias("ramp_up_rate"),
    )
    if labels is None:
        return out.withColumn("dtw_cluster_label", F.lit(None).cast("string"))
    return out.join(labels.select(key, "date", F.col("cluster_label").alias("dtw_cluster_label")), [key, "date"], "left")


def label_days(profiles: DataFrame, labeler, key: str = "code") -> DataFrame:
    """(key, date, cluster_label) by a function from a day's profile (numpy array) to a label; Arrow batches."""

    @F.pandas_udf("string")
    def label(column: pd.Series) -> pd.Series:
        return column.map(lambda p: labeler(np.asarray(p, float)))

    return profiles.select(key, "date", label("profile").alias("cluster_label"))


def area_short_term(daily: DataFrame, key: str = "code") -> DataFrame:
    """Per key the mean of each daily metric, the number of days and the most common label (the first in order on ties)."""
    return daily.groupBy(key).agg(
        *[F.avg(m).alias(m) for m in METRICS],
        F.mode("dtw_cluster_label", True).alias("dtw_cluster_label"),
        F.count(F.lit(1)).alias("n_days"),
    )


def short_term_table(
    load: DataFrame,
    weather: DataFrame | None = None,
    population: DataFrame | None = None,
    winter_only: bool = True,
    weekdays_only: bool = True,
    months: tuple[int, ...] = WINTER,
    clusters: bool = False,
    aggregate: bool = True,
    city: str | None = None,
    key: str = "code",
    ts: str = "ts",
    value: str = "kwh",
) -> DataFrame:
    """Daily metrics after, in this order: weather normalisation, division by population, month and weekday filters.

    With city, load and weather have such a column and each area meets its own city's weather.
    """
    df = load.select(key, ts, value, *[city] * bool(city))
    if weather is not None:
        df = normalize_weather(df, align_weather(df, weather, key, ts, value, city=city), key, ts, value)
    if population is not None:
        df = per_capita(df, population, True, key, value)
    if winter_only:
        df = df.where(months_of(ts, months))
    if weekdays_only:
        df = df.where(is_weekday(ts))
    labels = cluster_profiles(daily_profiles(df, key=key, ts=ts, value=value), key=key) if clusters else None
    daily = daily_metrics(df, labels, key, ts, value)
    if not aggregate:
        return daily
    out = area_short_term(daily, key)
    return out if labels is None else out.drop("dtw_cluster_label").join(dominant_label(labels, key=key), key, "left")


def daily_profiles(
    df: DataFrame, min_hours: int = 20, normalize: bool = True, key: str = "code", ts: str = "ts", value: str = "kwh"
) -> DataFrame:
    """(key, date, profile): 24 hourly means of each day with min_hours hours or more, gaps interpolated, by default as z-scores.

    An hour that occurs twice on a day is averaged; one that is skipped is interpolated. A day without
    variation is only centred.
    """
    hourly = df.where(F.col(value).isNotNull()).groupBy(key, F.to_date(ts).alias("date"), F.hour(ts).alias("hour")).agg(F.avg(value).alias("x"))
    days = hourly.groupBy(key, "date").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_hours)
    grid = days.select(key, "date", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    full = grid.join(hourly, [key, "date", "hour"], "left").withColumn("_day", F.struct(key, "date"))
    filled = interpolate_both(full, "_day", "hour", "x")
    items = F.sort_array(F.collect_list(F.struct("hour", "x")))
    raw = filled.groupBy(key, "date").agg(F.transform(items, lambda s: s["x"]).alias("profile"), F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    if normalize:
        spread = F.when(F.col("s") > 0, F.col("s")).otherwise(1.0)
        raw = raw.withColumn("profile", F.transform("profile", lambda x: (x - F.col("m")) / spread))
    return raw.select(key, "date", "profile")


def warped(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Dynamic time warping of each row of x to the row of y beside it: absolute cost, steps right, down and diagonal, no window.

    All advance together, one anti-diagonal of the cost table at a time.
    """
    w, out = x.shape[1], np.zeros(len(x))
    for a in range(0, len(x), 20_000):
        own, other = x[a : a + 20_000], y[a : a + 20_000]
        table = np.full((len(own), w + 1, w + 1), np.inf)
        table[:, 0, 0] = 0.0
        for d in range(2 * w - 1):
            r = np.arange(max(0, d - w + 1), min(w, d + 1))
            c = d - r
            step = np.minimum(np.minimum(table[:, r, c + 1], table[:, r + 1, c]), table[:, r, c])
            table[:, r + 1, c + 1] = np.abs(own[:, r] - other[:, c]) + step
        out[a : a + 20_000] = table[:, w, w]
    return out


def dtw_pairs(profiles: np.ndarray) -> np.ndarray:
    """Time warping between all pairs of rows."""
    i, j = np.triu_indices(len(profiles), 1)
    out = np.zeros((len(profiles), len(profiles)))
    out[i, j] = warped(profiles[i], profiles[j])
    return out + out.T


def dtw_table(profiles: DataFrame, block: int = BLOCK_DAYS, key: str = "code") -> DataFrame:
    """(key, i, j, date, other, distance) for all pairs of a key's days, i before j, numbered from 0 by date.

    Days come in blocks; each pair of blocks is a task's work, so no task holds an area's pairs.
    """
    kind = profiles.schema[key].dataType.simpleString()
    days = profiles.withColumn("i", F.row_number().over(Window.partitionBy(key).orderBy("date")) - 1)
    days = days.withColumns({"own": F.floor(F.col("i") / block), "n": F.count(F.lit(1)).over(Window.partitionBy(key))})
    last = F.floor((F.col("n") - 1) / block)
    first = days.withColumn("low", F.col("own")).withColumn("high", F.explode(F.sequence("own", last)))
    second = days.withColumn("high", F.col("own")).withColumn("low", F.explode(F.sequence(F.lit(0).cast("long"), "own")))
    sides = [x.select(*[F.col(c).alias(c) for c in (key, "low", "high", "i", "date", "profile")]) for x in (first, second)]  # columns of their own

    def pairs(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        i, j = np.nonzero(a["i"].to_numpy()[:, None] < b["i"].to_numpy()[None, :])
        if not len(i):
            return a[[key, "i", "date"]].iloc[:0].assign(j=0, other=None, distance=0.0)
        x, y = np.stack(a["profile"].to_numpy()).astype(float), np.stack(b["profile"].to_numpy()).astype(float)
        own, other = a.iloc[i].reset_index(drop=True), b.iloc[j].reset_index(drop=True)
        return pd.DataFrame({key: own[key], "i": own["i"], "j": other["i"], "date": own["date"], "other": other["date"], "distance": warped(x[i], y[j])})

    by = (key, "low", "high")
    return sides[0].groupBy(*by).cogroup(sides[1].groupBy(*by)).applyInPandas(pairs, f"{key} {kind}, i int, j int, date date, other date, distance double")


def k_medoids(distance: np.ndarray, k: int, seed: int = 42, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """(labels, medoids): nearest medoid, then the member of least total distance, until neither changes."""
    medoids = np.random.default_rng(seed).choice(len(distance), size=k, replace=False)
    labels = distance[:, medoids].argmin(1)
    for _ in range(rounds):
        new = medoids.copy()
        for c in range(k):
            own = np.flatnonzero(labels == c)
            if len(own):
                new[c] = own[distance[np.ix_(own, own)].sum(1).argmin()]
        again = distance[:, new].argmin(1)
        if (new == medoids).all() and (again == labels).all():
            break
        medoids, labels = new, again
    return labels, medoids


def silhouette(distance: np.ndarray, labels: np.ndarray, single: float = 1.0) -> float:
    """Mean silhouette; -1 with fewer than two clusters. A cluster of one counts as single."""
    names = np.unique(labels)
    if len(names) < 2:
        return -1.0
    member = (labels[:, None] == names[None, :]).astype(float)
    total, size = distance @ member, member.sum(0)
    own = np.searchsorted(names, labels)
    rows = np.arange(len(labels))
    inside = total[rows, own] / np.maximum(size[own] - 1, 1)
    mean = total / size
    mean[rows, own] = np.inf
    outside = mean.min(1)
    top = np.maximum(inside, outside)
    s = np.where(top > 0, (outside - inside) / np.where(top > 0, top, 1), 0.0)
    return float(np.where(size[own] == 1, single, s).mean())


CLUSTERS = "date date, cluster_label string, k int, silhouette double"


def cluster_profiles(
    profiles: DataFrame,
    k_min: int = 2,
    k_max: int = 6,
    min_days: int = 20,
    seed: int = 42,
    single: float = 1.0,
    most: int = MAX_DAYS,
    key: str = "code",
) -> DataFrame:
    """(key, date, cluster_label, k, silhouette): k-medoids under time warping, the k of best silhouette, the first on ties.

    Areas with too few days get the label no_decision. Areas of more than most days are clustered over a table of distances.
    """

    sizes = stored(profiles.groupBy(key).agg(F.count(F.lit(1)).alias("n")), "sizes")  # a row per area
    small = profiles if not sizes.where(F.col("n") > most).limit(1).count() else profiles.join(sizes.where(F.col("n") <= most), key, "left_semi")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        n = len(pdf)
        out = pdf[[key, "date"]].assign(cluster_label=NO_DECISION, k=0, silhouette=np.nan)
        choices = range(max(2, k_min), min(k_max, n - 1) + 1)
        if n < min_days or not len(choices):
            return out
        distance = dtw_pairs(np.stack(pdf["profile"].to_numpy()).astype(float))
        best = None
        for k in choices:
            labels, _ = k_medoids(distance, k, seed)
            score = silhouette(distance, labels, single)
            if best is None or score > best[0]:
                best = score, k, labels
        return out.assign(cluster_label=[f"cluster_{c}" for c in best[2]], k=best[1], silhouette=best[0])

    kind = profiles.schema[key].dataType.simpleString()
    found = small.groupBy(key).applyInPandas(fit, f"{key} {kind}, {CLUSTERS}")
    if small is profiles:
        return found
    return found.unionByName(_clustered_by_table(profiles.join(sizes.where(F.col("n") > most), key), k_min, k_max, min_days, seed, single, key))


def _clustered_by_table(profiles: DataFrame, k_min: int, k_max: int, min_days: int, seed: int, single: float, key: str, rounds: int = 50) -> DataFrame:
    """As cluster_profiles, for areas (with their number of days n) whose distances are a table; all areas go through a round together."""
    one_way = stored(dtw_table(profiles, key=key), "pairs")
    turned = one_way.select(key, F.col("j").alias("i"), F.col("i").alias("j"), "distance")
    days = stored(profiles.withColumn("i", F.row_number().over(Window.partitionBy(key).orderBy("date")) - 1).select(key, "i", "date", "n"), "days")
    itself = days.select(key, "i", F.col("i").alias("j"), F.lit(0.0).alias("distance"))
    pairs = stored(one_way.select(key, "i", "j", "distance").unionByName(turned).unionByName(itself), "pairs")
    scores = []
    for k in range(max(2, k_min), k_max + 1):

        @F.udf("array<int>")
        def start(n: int, k: int = k) -> list[int]:
            return np.random.default_rng(seed).choice(n, size=k, replace=False).tolist()

        areas = days.where((F.col("n") >= max(min_days, k + 1))).select(key, "n").distinct()
        medoids = stored(areas.select(key, F.posexplode(start("n")).alias("c", "j")), "medoids")
        labels = stored(_nearest_medoid(pairs, medoids, key), "labels")
        for _ in range(rounds):
            mates = pairs.join(labels.select(key, "i", "c"), [key, "i"]).join(labels.select(key, F.col("i").alias("j"), F.col("c").alias("c_")), [key, "j"])
            total = mates.where("c = c_").groupBy(key, "c", "i").agg(F.sum("distance").alias("total"))
            best = total.groupBy(key, "c").agg(F.min(F.struct("total", "i")).alias("b")).select(key, "c", F.col("b.i").alias("new"))
            new = stored(medoids.join(best, [key, "c"], "left").select(key, "c", F.coalesce("new", "j").alias("j")), "medoids")
            again = stored(_nearest_medoid(pairs, new, key), "labels")
            still = new.exceptAll(medoids).limit(1).count() or again.exceptAll(labels).limit(1).count()
            discard(medoids, labels)
            medoids, labels = new, again
            if not still:
                break
        score = silhouettes(pairs, labels, single, key)
        scores.append(labels.join(score, key).withColumn("k", F.lit(k)))
    none = days.select(key, "date", F.lit(NO_DECISION).alias("cluster_label"), F.lit(0).alias("k"), F.lit(None).cast("double").alias("silhouette"))
    if not scores:
        return none
    every = scores[0]
    for x in scores[1:]:
        every = every.unionByName(x)
    best = every.groupBy(key).agg(F.max_by("k", F.struct("silhouette", -F.col("k"))).alias("k"))
    won = every.join(best, [key, "k"]).select(key, "i", F.concat(F.lit("cluster_"), "c").alias("label"), F.col("k").alias("k_"), F.col("silhouette").alias("s_"))
    return days.join(won, [key, "i"], "left").select(key, "date", F.coalesce("label", F.lit(NO_DECISION)).alias("cluster_label"), F.coalesce("k_", F.lit(0)).alias("k"), F.col("s_").alias("silhouette"))


def _nearest_medoid(pairs: DataFrame, medoids: DataFrame, key: str) -> DataFrame:
    """(key, i, c): the number of the nearest medoid of each day, the first on ties."""
    near = pairs.join(medoids, [key, "j"]).groupBy(key, "i").agg(F.min(F.struct("distance", "c")).alias("b"))
    return near.select(key, "i", F.col("b.c").alias("c"))


def silhouettes(pairs: DataFrame, labels: DataFrame, single: float = 1.0, key: str = "code") -> DataFrame:
    """(key, silhouette): the mean silhouette of each key's labels (key, i, c) over a table of distances (key, i, j, distance) of both directions; -1 with fewer than two clusters."""
    size = labels.groupBy(key, "c").agg(F.count(F.lit(1)).alias("size"))
    other = labels.select(key, F.col("i").alias("j"), F.col("c").alias("c_"))
    sums = pairs.join(other, [key, "j"]).groupBy(key, "i", "c_").agg(F.sum("distance").alias("total")).join(size.withColumnRenamed("c", "c_"), [key, "c_"])
    own = F.col("c") == F.col("c_")
    each = sums.join(labels, [key, "i"]).groupBy(key, "i").agg(
        F.max(F.when(own, F.col("total") / F.greatest(F.col("size") - 1, F.lit(1)))).alias("inside"),
        F.min(F.when(~own, F.col("total") / F.col("size"))).alias("outside"),
        F.max(F.when(own, F.col("size"))).alias("size"),
    )
    top = F.greatest("inside", "outside")
    s = F.when(F.col("size") == 1, single).otherwise(F.when(top > 0, (F.col("outside") - F.col("inside")) / top).otherwise(0.0))
    found = each.groupBy(key).agg(F.avg(s).alias("silhouette"), F.count("outside").alias("n"))
    return found.select(key, F.when(F.col("n") > 0, F.col("silhouette")).otherwise(-1.0).alias("silhouette"))


def dominant_label(labels: DataFrame, threshold: float = 0.5, key: str = "code") -> DataFrame:
    """(key, dominant_label, dominant_share, n_labeled_days): the most common label if its share reaches threshold."""
    counts = labels.groupBy(key, "cluster_label").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(key))
    best = Window.partitionBy(key).orderBy(F.desc("n"), "cluster_label")
    shares = counts.withColumns({"total": total, "place": F.row_number().over(best)}).where("place = 1")
    share = F.col("n") / F.col("total")
    return shares.select(
        key,
        F.when(share >= threshold, F.col("cluster_label")).otherwise(NO_DECISION).alias("dominant_label"),
        share.alias("dominant_share"),
        F.col("total").alias("n_labeled_days"),
    )


def cluster_hour_stats(profiles: DataFrame, labels: DataFrame, key: str = "code") -> DataFrame:
    """(key, cluster_label, hour, p05, p50, p95, mean, n_days) of the profiles of each cluster."""
    q = F.percentile("x", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    hours = profiles.join(labels.select(key, "date", "cluster_label"), [key, "date"]).select(key, "cluster_label", F.posexplode("profile").alias("hour", "x"))
    return (
        hours.groupBy(key, "cluster_label", "hour")
        .agg(q.alias("q"), F.avg("x").alias("mean"), F.count(F.lit(1)).alias("n_days"))
        .select(key, "cluster_label", "hour", *[F.col("q")[k].alias(p) for k, p in enumerate(("p05", "p50", "p95"))], "mean", "n_days")
    )


def label_codes(labels: DataFrame, key: str = "code") -> DataFrame:
    """labels with label_code: the place of the label, from 0, in the key's labels in order."""
    return labels.withColumn("label_code", F.dense_rank().over(Window.partitionBy(key).orderBy("cluster_label")) - 1)


def _season(date: Column) -> Column:
    m = F.month(date)
    return F.when(m.isin(12, 1, 2), "winter").when(m.isin(3, 4, 5), "spring").when(m.isin(6, 7, 8), "summer").otherwise("fall")


CALENDAR = {
    "weekpart": (lambda d: F.when(is_weekday(d), "weekday").otherwise("weekend"), ["weekday", "weekend"]),
    "season": (_season, ["winter", "spring", "summer", "fall"]),
    "month": (lambda d: F.lpad(F.month(d).cast("string"), 2, "0"), [f"{m:02d}" for m in range(1, 13)]),
}


def label_calendar(labels: DataFrame, by: str = "season", normalize: bool = True) -> DataFrame:
    """(period, cluster_label, value): the share of each label in the days of a period, or its count; 0 where there is none."""
    group, periods = CALENDAR[by]
    spark = labels.sparkSession
    rows = labels.select(group(F.col("date")).alias("period"), "cluster_label")
    counts = rows.groupBy("period", "cluster_label").agg(F.count(F.lit(1)).alias("n"))
    calendar = spark.createDataFrame([(p,) for p in periods], "period string")
    grid = rows.select("cluster_label").distinct().join(F.broadcast(calendar))
    full = grid.join(counts, ["period", "cluster_label"], "left").fillna(0, ["n"])
    total = F.sum("n").over(Window.partitionBy("period"))
    value = F.when(total > 0, F.col("n") / total).otherwise(0.0) if normalize else F.col("n").cast("double")
    return full.withColumn("value", value).select("period", "cluster_label", "value")


PROFILE = T.ArrayType(T.DoubleType())
