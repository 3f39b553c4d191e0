"""Temperature response in closed form: normalisation, degree days, heating change-point.

Each model is a set of sums per area, so tasks combine before the shuffle and an area of any size
costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.timeseries import instants_of, interpolate_both
from gridloom.storage import stored

BASES = (8.0, 24.0, 0.5)


def normalize_weather(
    load: DataFrame, aligned: DataFrame, key: str = "code", ts: str = "ts", value: str = "kwh", temperature: str = "temperature"
) -> DataFrame:
    """load - slope * (temperature - its mean) on the rows of load, other columns kept; rows without weather or load come back null.

    slope is covariance over variance of an area's aligned rows, 0 without variance.
    """
    fit = aligned.groupBy(key).agg(
        F.covar_pop(temperature, value).alias("cov"), F.var_pop(temperature).alias("var"), F.avg(temperature).alias("mean")
    )
    slope = F.when(F.col("var") > 0, F.col("cov") / F.col("var")).otherwise(0.0)
    adjusted = aligned.join(fit, key).select(
        key, ts, (F.col(value) - slope * (F.col(temperature) - F.col("mean"))).alias(value)
    )
    return load.drop(value).join(adjusted, [key, ts], "left").select(*load.columns)


def normalize_by_weather(
    load: DataFrame, weather: DataFrame, key: str = "code", ts: str = "ts", value: str = "kwh", temperature: str = "temperature", city: str | None = None, zone: str | None = None
) -> DataFrame:
    """normalize_weather of load and align_weather(load, weather), for load that has a key's time once: no join of load with itself.

    Gaps of temperature are searched first, as only they need the order of rows.
    """
    on = [city, ts] if city else [ts]
    if zone:
        weather = instants_of(weather, zone, ts, [city] if city else [], temperature)
    weather = stored(weather.groupBy(*on).agg(F.avg(temperature).alias(temperature)), "weather")
    rows = load.join(weather, on, "left").withColumn("_none", F.col(value).isNull())
    if rows.where(~F.col("_none") & F.col(temperature).isNull()).limit(1).count():
        rows = interpolate_both(rows, [key, "_none"], ts, temperature)
    used = rows.where(~F.col("_none") & F.col(temperature).isNotNull())
    fit = used.groupBy(key).agg(F.covar_pop(temperature, value).alias("_cov"), F.var_pop(temperature).alias("_var"), F.avg(temperature).alias("_mean"))
    slope = F.when(F.col("_var") > 0, F.col("_cov") / F.col("_var")).otherwise(0.0)
    new = F.when(F.col(ts).isNotNull(), F.col(value) - slope * (F.col(temperature) - F.col("_mean")))
    return rows.join(fit, key, "left").withColumn(value, new).select(*load.columns)


def per_capita(
    df: DataFrame, population: DataFrame, strict: bool = True, key: str = "code", value: str = "kwh", people: str = "population"
) -> DataFrame:
    """value over the key's population. A population that is missing, not finite or not positive is an error, or with strict=False gives null."""
    x = F.col(people)
    good = x.isNotNull() & ~F.isnan(x) & (x > 0) & (x < float("inf"))
    bad = F.raise_error(F.concat(F.lit("no valid population for "), F.col(key))) if strict else F.lit(None)
    joined = df.join(population.select(key, F.col(people).cast("double").alias(people)), key, "left")
    return joined.withColumn(value, F.when(good, F.col(value) / x).otherwise(bad.cast("double"))).drop(people)


def expand_by_population(df: DataFrame, population: DataFrame, key: str = "code", value: str = "kwh", people: str = "population") -> DataFrame:
    """Per-capita values times the population; null where that isn't positive."""
    joined = df.join(population.select(key, people), key, "left")
    return joined.withColumn(value, F.when(F.col(people) > 0, F.col(value) * F.col(people))).drop(people)


def degree_day_fit(
    aligned: DataFrame, base: float = 18.0, key: str = "code", value: str = "kwh", temperature: str = "temperature"
) -> DataFrame:
    """Least squares of load on 1, heating and cooling degrees, from nine sums.

    Without variation in cooling (or heating) degrees, or if one is a multiple of the other, the model
    has one of them alone.
    """
    t, y = F.col(temperature), F.col(value).cast("double")
    h, c = F.greatest(F.lit(base) - t, F.lit(0.0)), F.greatest(t - F.lit(base), F.lit(0.0))
    rows = aligned.where(y.isNotNull() & t.isNotNull()).select(key, h.alias("h"), c.alias("c"), y.alias("y"))
    s = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("h").alias("mh"),
        F.avg("c").alias("mc"),
        F.avg("y").alias("my"),
        F.var_pop("h").alias("hh"),
        F.var_pop("c").alias("cc"),
        F.covar_pop("h", "c").alias("hc"),
        F.covar_pop("h", "y").alias("hy"),
        F.covar_pop("c", "y").alias("cy"),
        F.var_pop("y").alias("yy"),
    )
    hh, cc, hc, hy, cy = (F.col(x) for x in ("hh", "cc", "hc", "hy", "cy"))
    det = hh * cc - hc * hc
    both = det > 1e-9 * hh * cc
    bh = F.when(both & (hh > 0) & (cc > 0), (hy * cc - cy * hc) / det).when(hh > 0, hy / hh).otherwise(0.0)
    bc = F.when(both & (hh > 0) & (cc > 0), (cy * hh - hy * hc) / det).when((hh > 0) | (cc <= 0), 0.0).otherwise(cy / cc)
    # With both constant the solution of least norm shares the mean among the three coefficients.
    flat = (hh <= 0) & (cc <= 0)
    level = F.col("my") / (1 + F.col("mh") ** 2 + F.col("mc") ** 2)
    s = s.withColumns(
        {
            "heating_slope": F.when(flat, level * F.col("mh")).otherwise(bh),
            "cooling_slope": F.when(flat, level * F.col("mc")).otherwise(bc),
        }
    )
    explained = F.col("heating_slope") * hy + F.col("cooling_slope") * cy
    return s.select(
        key,
        F.lit(base).alias("base"),
        F.col("n").alias("n_obs"),
        (F.col("my") - F.col("heating_slope") * F.col("mh") - F.col("cooling_slope") * F.col("mc")).alias("intercept"),
        "heating_slope",
        "cooling_slope",
        F.when(F.col("yy") > 0, explained / F.col("yy")).otherwise(0.0).alias("r2"),
        F.col("mh").alias("mean_hdd"),
        F.col("mc").alias("mean_cdd"),
    )


def by_temperature(aligned: DataFrame, key: str, value: str, temperature: str) -> DataFrame:
    """(key, t, n, y, yy): rows with both values, their number, load and squared load, by temperature; load is less its key's mean m."""
    rows = aligned.where(F.col(value).isNotNull() & F.col(temperature).isNotNull()).select(key, F.col(value).cast("double").alias("y"), F.col(temperature).alias("t"))
    level = rows.groupBy(key).agg(F.avg("y").alias("m"))
    y = F.col("y") - F.col("m")  # sums of squares of values far from 0 would lose digits
    return rows.join(level, key).groupBy(key, "m", "t").agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("y"), F.sum(y * y).alias("yy"))


def hinge_fit(rows: DataFrame, key: str, by: str) -> DataFrame:
    """Least squares of load on h (a column of by_temperature rows) for each key and by: n, slope, level, r2, sse, mean_h, mean_y, beyond (rows with h above 0).

    slope, level and r2 are null where h doesn't vary; r2 is 1 where the load doesn't.
    """
    n, h = F.col("n"), F.col("h")
    s = rows.groupBy(key, by).agg(
        F.sum("n").alias("n"), F.sum(n * h).alias("sh"), F.sum(n * h * h).alias("shh"), F.sum(h * F.col("y")).alias("shy"), F.sum("y").alias("sy"),
        F.sum("yy").alias("syy"), F.max("m").alias("m"), F.sum(F.when(h > 0, n).otherwise(0)).alias("beyond"), (F.min("h") < F.max("h")).alias("varied"),
    )
    hh, hy, yy = F.col("shh") - F.col("sh") ** 2 / n, F.col("shy") - F.col("sh") * F.col("sy") / n, F.col("syy") - F.col("sy") ** 2 / n
    slope = F.when(F.col("varied"), hy / hh)
    out = s.withColumns({"slope": slope, "mean_h": F.col("sh") / n, "mean_y": F.col("m") + F.col("sy") / n, "yy": yy})
    r2 = F.when(F.col("yy") > 0, F.col("slope") * hy / F.col("yy")).otherwise(F.when(F.col("varied"), 1.0))
    level = F.col("mean_y") - F.col("slope") * F.col("mean_h")
    return out.select(key, by, "n", "slope", level.alias("level"), r2.alias("r2"), (F.col("yy") - F.col("slope") * hy).alias("sse"), "mean_h", "mean_y", "beyond")


def heating_change_point(
    aligned: DataFrame,
    bases: tuple[float, float, float] = BASES,
    least: int = 10,
    key: str = "code",
    value: str = "kwh",
    temperature: str = "temperature",
) -> DataFrame:
    """The base temperature whose heating degrees explain most of the load; the lowest base on ties.

    Rows are summed by key and temperature first, so only distinct temperatures meet every base.
    With constant degrees c the fit is the minimum-norm one: intercept m / (1 + c^2), slope c times that.
    """
    low, high, step = bases
    n = round((high - low) / step)
    grid = F.array(*[F.lit(low + step * k) for k in range(n + 1)])
    rows = by_temperature(aligned, key, value, temperature).withColumn("base", F.explode(grid))
    h = F.greatest(F.col("base") - F.col("t"), F.lit(0.0))
    fit = hinge_fit(rows.withColumn("h", h), key, "base").select(
        key, "base", F.col("n").alias("n_obs"), "slope", F.col("level").alias("intercept"), "r2", F.col("mean_h").alias("c"), F.col("mean_y").alias("m")
    )
    flat = F.col("slope").isNull()
    level = F.col("m") / (1 + F.col("c") * F.col("c"))
    fit = fit.where(F.col("n_obs") >= least).select(
        key,
        "n_obs",
        F.col("base").alias("change_point"),
        F.when(flat, level).otherwise(F.col("intercept")).alias("baseload"),
        F.when(flat, level * F.col("c")).otherwise(F.col("slope")).alias("heating_slope"),
        F.when(flat, 0.0).otherwise(F.coalesce("r2", F.lit(0.0))).alias("r2"),
    )
    # Sums in another order move R2 in its last digits; equal fits are told by 9 of them.
    best = Window.partitionBy(key).orderBy(F.desc(F.round("r2", 9)), "change_point")
    return fit.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").drop("_rank")


def predicted_degree_days(temperature: Column, intercept: Column, heating: Column, cooling: Column, base: Column) -> Column:
    zero = F.lit(0.0)
    return intercept + heating * F.greatest(base - temperature, zero) + cooling * F.greatest(temperature - base, zero)
