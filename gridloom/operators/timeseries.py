"""Operators over long series (code, ts, value): grids, gaps, filters, resampling, weather alignment.

All are windows or aggregates by code, so a table partitioned by code goes through a chain of them
with one shuffle. Missing is null, never NaN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.columns import hour_of, month_of, number
from gridloom.operators.ranges import quantiles, with_neighbours

AGGREGATES = {"mean": F.avg, "min": F.min, "max": F.max, "sum": lambda c: F.coalesce(F.sum(c), F.lit(0.0))}


def regularize(
    df: DataFrame, step: str = "1 hour", key: str = "code", ts: str = "ts", value: str = "kwh", own_range: bool = False
) -> DataFrame:
    """(key, ts, value) on a full grid of step from the first to the last time, null where a row is missing.

    The range is that of all keys together, or each key's own. Rows off the grid are left out. Steps of a fixed length take no join.
    """
    unit = step.split()[-1].lower().rstrip("s")
    if unit in ("second", "minute", "hour", "day", "week") and df.schema[ts].dataType.typeName() == "timestamp_ntz":
        return _between(df, step, key, ts, value, own_range)
    ends = df.groupBy(key).agg(F.min(ts).alias("from"), F.max(ts).alias("to"))
    if not own_range:
        whole = df.agg(F.min(ts).alias("from"), F.max(ts).alias("to"))
        ends = ends.select(key).crossJoin(F.broadcast(whole))  # one row
    grid = ends.select(key, F.explode(F.sequence("from", "to", F.expr(f"interval {step}"))).alias(ts))
    return grid.join(df.select(key, ts, value), [key, ts], "left")


def _micros(c: Column) -> Column:
    """Microseconds of a time without zone, whatever the session's zone is."""
    day = F.unix_date(c.cast("date")).cast("long") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60
    return day * 1000000 + (F.date_part(F.lit("SECOND"), c) * 1000000).cast("long")


def _between(df: DataFrame, step: str, key: str, ts: str, value: str, own_range: bool) -> DataFrame:
    """regularize where all steps are of one length: each row makes the steps up to the next row of its key, the first also those before it.

    A row off the grid stands one step before the grid, so it makes none of its own.
    """
    rows = df.select(key, ts, value)
    if own_range:
        own = Window.partitionBy(key)
        rows = rows.withColumns({"_from": F.min(ts).over(own), "_to": F.max(ts).over(own)})
    else:
        rows = rows.crossJoin(F.broadcast(rows.agg(F.min(ts).alias("_from"), F.max(ts).alias("_to"))))  # one row
    since = lambda a, b: _micros(b) - _micros(F.col(a))
    size = since("_from", F.col("_from") + F.expr(f"interval {step}"))
    on = F.coalesce(since("_from", F.col(ts)) % size == 0, F.lit(False)) & F.col(key).isNotNull()
    rows = rows.withColumns({"_on": on, "_size": size, "_last": F.floor(since("_from", F.col("_to")) / size)})
    rows = rows.withColumn("_at", F.when(F.col("_on"), (since("_from", F.col(ts)) / F.col("_size")).cast("long")).otherwise(F.lit(-1).cast("long")))
    # A number of its own, as tasks aren't to be merged by the size of rows that become many.
    rows = rows.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    order = Window.partitionBy(key).orderBy("_at")
    after = F.coalesce(F.lead("_at").over(order) - 1, F.col("_last"))
    rows = rows.withColumns({"_first": F.row_number().over(order) == 1, "_end": F.greatest(F.col("_at"), after)})
    steps = F.sequence(F.when(F.col("_first"), F.least("_at", F.lit(0).cast("long"))).otherwise(F.col("_at")), F.col("_end"))
    full = rows.withColumn("_k", F.explode(steps)).where("_k >= 0 AND _size IS NOT NULL")
    time = F.timestamp_add("MICROSECOND", F.col("_k") * F.col("_size"), F.col("_from"))
    return full.select(key, time.alias(ts), F.when(F.col("_k") == F.col("_at"), F.col(value)).alias(value))


def _with_neighbours(df: DataFrame, key: str | list[str], ts: str, value: str, ranges: int | None) -> DataFrame:
    """df with _place (row number), and _before and _after: (place, hit) of the nearest value at or before and at or after each row.

    Both look back over a running frame, the second in reversed order: a frame that runs to the end of
    the series would be evaluated anew for each row. With ranges a series is cut into so many (of time), for one that is too
    long for a task.
    """
    if ranges:
        return with_neighbours(df, [key] if isinstance(key, str) else key, ts, F.col(value), ranges)
    order = Window.partitionBy(key).orderBy(ts)
    place = F.row_number().over(order)
    here = F.when(F.col(value).isNotNull(), F.struct(F.col("_place").alias("place"), F.col(value).alias("hit")))
    before = F.last(here, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    back = Window.partitionBy(key).orderBy(F.desc("_place"))
    after = F.last(here, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_place", place).withColumns({"_before": before, "_after": after})


def interpolate_both(
    df: DataFrame, key: str | list[str] = "code", ts: str = "ts", value: str = "kwh", limit: int | None = None, ranges: int | None = None
) -> DataFrame:
    """Missing values become linear by row position; those before the first or after the last take the nearest.

    With limit, a value fills at most so many rows to each side, still along the whole gap's line. ranges cuts series that
    are too long for one task.
    """
    a, b, p = F.col("_before"), F.col("_after"), F.col("_place")
    line = a["hit"] + (b["hit"] - a["hit"]) * (p - a["place"]) / F.nullif(b["place"] - a["place"], F.lit(0))
    filled = F.coalesce(F.col(value), line, a["hit"], b["hit"])
    if limit is not None:
        near = F.least(p - a["place"], b["place"] - p) <= limit
        filled = F.when(F.col(value).isNotNull() | near, filled)
    return _with_neighbours(df, key, ts, value, ranges).withColumn(value, filled).drop("_place", "_before", "_after")


def ffill(df: DataFrame, key: str = "code", ts: str = "ts", value: str = "kwh", limit: int | None = None, ranges: int | None = None) -> DataFrame:
    """Missing values take the last one before, over at most limit rows."""
    near = F.lit(True) if limit is None else F.col("_place") - F.col("_before.place") <= limit
    filled = F.when(near, F.col("_before.hit"))
    return _with_neighbours(df, key, ts, value, ranges).withColumn(value, filled).drop("_place", "_before", "_after")


def _centred(key: str, ts: str, window: int):
    return Window.partitionBy(key).orderBy(ts).rowsBetween(-(window // 2), (window - 1) // 2)


def rolling_median(column: Column, key: str, ts: str, window: int, least: int) -> Column:
    """The centred rolling median; null where the frame has fewer than least values."""
    frame = _centred(key, ts, window)
    return F.when(F.count(column).over(frame) >= least, F.percentile(column, F.lit(0.5)).over(frame))


def hampel(
    df: DataFrame,
    window: int = 24,
    n_sigmas: float = 5.0,
    replace: str = "interp",
    key: str = "code",
    ts: str = "ts",
    value: str = "kwh",
) -> DataFrame:
    """df with value cleaned and is_outlier: further than n_sigmas * 1.4826 * MAD from the rolling median."""
    if replace not in ("interp", "median"):
        raise ValueError("replace must be 'interp' or 'median'")
    least = max(3, window // 3)
    marked = df.withColumn("_median", rolling_median(F.col(value), key, ts, window, least))
    marked = marked.withColumn("_off", F.abs(F.col(value) - F.col("_median")))
    sigma = 1.4826 * rolling_median(F.col("_off"), key, ts, window, least)
    marked = marked.withColumn("_sigma", sigma).withColumn(
        "is_outlier", F.coalesce((F.col("_sigma") > 0) & (F.col("_off") > n_sigmas * F.col("_sigma")), F.lit(False))
    )
    new = F.when(F.col("is_outlier"), F.col("_median") if replace == "median" else F.lit(None)).otherwise(F.col(value))
    cleaned = marked.withColumn(value, new).drop("_median", "_off", "_sigma")
    return interpolate_both(cleaned, key, ts, value) if replace == "interp" else cleaned


def _bin_start(ts: str, count: int, unit: str) -> Column:
    """The start of the bin of count units that a time is in: from midnight of the first day of all for hours and minutes, else by calendar."""
    if count == 1:
        return F.date_trunc(unit, ts).cast("timestamp_ntz")
    if unit in ("month", "quarter", "year"):
        months = count * {"month": 1, "quarter": 3, "year": 12}[unit]
        since = (F.year(ts) - F.year("_from")) * 12 + F.month(ts) - F.month("_from")
        return F.add_months(F.trunc("_from", "month"), F.floor(since / months).cast("int") * months).cast("timestamp_ntz")
    origin = F.date_trunc("day", "_from").cast("timestamp_ntz")
    seconds = count * {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}[unit]
    since = F.timestamp_diff("SECOND", origin, ts)
    return F.timestamp_add("SECOND", F.floor(since / seconds) * seconds, origin).cast("timestamp_ntz")


def resample(
    df: DataFrame, unit: str = "day", how: str = "mean", key: str = "code", ts: str = "ts", value: str = "kwh"
) -> DataFrame:
    """(key, ts, value) by bins of local time, such as "day", "month", "3 hours" or "2 weeks", with a row for every bin from the first to the last of the table.

    An empty sum is 0, an empty mean, min or max null. Single units begin with the calendar's; bins of several hours, days or weeks count from
    midnight of the table's first day, of several months or years from its first month. Rows without a time are left out.
    """
    count, _, name = unit.rpartition(" ")
    count, name = int(count or 1), name.rstrip("s")
    if count < 1 or name not in ("second", "minute", "hour", "day", "week", "month", "quarter", "year"):
        raise ValueError(f"no unit: {unit}")
    rows = df.where(F.col(ts).isNotNull()).select(key, ts, value)
    if count > 1:
        rows = rows.crossJoin(F.broadcast(rows.agg(F.min(ts).alias("_from"))))  # one row
    binned = rows.groupBy(key, _bin_start(ts, count, name).alias(ts)).agg(AGGREGATES[how](value).alias(value))
    months = {"quarter": 3}.get(name)
    full = regularize(binned, f"{3 * count} month" if months else f"{count} {name}", key, ts, value)
    return full.fillna(0.0, [value]) if how == "sum" else full


def monthly_energy(df: DataFrame, how: str = "sum", key: str = "code", ts: str = "ts", value: str = "kwh") -> DataFrame:
    """As resample by month, with a row for every month from the first to the last of the table."""
    if how not in ("sum", "mean"):
        raise ValueError("how must be 'sum' or 'mean'")
    by_month = df.groupBy(key, month_of(ts).alias(ts)).agg(AGGREGATES[how](value).alias(value))
    full = regularize(by_month, "1 month", key, ts, value)
    return full.fillna(0.0, [value]) if how == "sum" else full


def align_weather(
    load: DataFrame,
    weather: DataFrame,
    key: str = "code",
    ts: str = "ts",
    value: str = "kwh",
    temperature: str = "temperature",
    city: str | None = None,
    deduplicate: bool = True,
    zone: str | None = None,
) -> DataFrame:
    """Load rows with a value and the temperature at their time, gaps of temperature interpolated by position.

    Several temperatures at one time are averaged; with deduplicate=False they multiply the load rows.
    Keys whose rows have no temperature at all drop out. With a zone, ts of the load is in UTC (as the
    column utc of raw load) and ts of the weather is local there.
    """
    on = [city, ts] if city else [ts]
    if zone:
        weather = instants_of(weather, zone, ts, [city] if city else [], temperature)
    if deduplicate:
        weather = weather.groupBy(*on).agg(F.avg(temperature).alias(temperature))
    joined = load.where(F.col(value).isNotNull()).join(weather.select(*on, temperature), on, "left")
    return interpolate_both(joined, key, ts, temperature).where(F.col(temperature).isNotNull())


def local_of(utc: Column, zone: str) -> Column:
    """The local time (without zone) of a UTC one."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def utc_of(ts: Column, zone: str, second: Column) -> Column:
    """The UTC time (without zone) of a local one; second tells the later of two occurrences.

    A time that the spring change skips becomes the first one after the gap.
    """
    name = F.lit(zone)
    first = F.convert_timezone(name, F.lit("UTC"), ts)
    skipped = F.convert_timezone(F.lit("UTC"), name, first) != ts
    # The gap ends where local time jumps; it is an hour long, so the hour of the shifted time is it.
    shifted = F.convert_timezone(name, F.lit("UTC"), hour_of(F.convert_timezone(F.lit("UTC"), name, first)))
    hour = F.expr("interval 1 hour")
    return F.when(skipped, shifted).when(second, first + hour).otherwise(first)


def is_repeated(ts: Column, zone: str) -> Column:
    """Whether a local time occurs twice, at the autumn change."""
    first = F.convert_timezone(F.lit(zone), F.lit("UTC"), ts)
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), first + F.expr("interval 1 hour")) == ts


def instants_of(df: DataFrame, zone: str, ts: str = "ts", by: list[str] | None = None, value: str = "temperature") -> DataFrame:
    """df with ts in UTC instead of local time in zone.

    If every repeated local time is there twice, in each of by, the first of a pair (by value, as rows have no order) is
    the one before the change. Otherwise that can't be told and all repeated times are left out.
    """
    by = by or []
    marked = df.withColumn("_twice", is_repeated(F.col(ts), zone))
    same = Window.partitionBy(*by, ts)
    told = marked.withColumn("_k", F.row_number().over(same.orderBy(value)))
    odd = marked.where("_twice").groupBy(*by, ts).count().where("count <> 2").select(*by)
    if by:
        told = told.join(odd.distinct().withColumn("_odd", F.lit(True)), by, "left")
    else:
        told = told.join(F.broadcast(odd.agg((F.count(F.lit(1)) > 0).alias("_odd"))))
    left = told.where(~(F.col("_twice") & F.coalesce("_odd", F.lit(False))))
    return left.withColumn(ts, utc_of(F.col(ts), zone, F.col("_twice") & (F.col("_k") == 2))).drop("_twice", "_k", "_odd")


def asof_nearest(
    left: DataFrame, right: DataFrame, value: str, ts: str = "ts", by: list[str] | None = None, ranges: int | None = None
) -> DataFrame:
    """Each left row with value from the right row of the nearest time, the later one on ties.

    Only the distinct times of both sides are ordered; the rows of left then join on the time, so a place with very many
    rows costs no more than its times, and there is no range join. Times are ordered within ranges, and the hits that lie beyond a
    range's ends come from a scan over the ranges, so one long series is many tasks' work.
    """
    on = [*(by or []), ts]
    times = left.select(*on).distinct().withColumn("_given", F.lit(None)).withColumn("_asks", F.lit(True))
    given = right.where(F.col(value).isNotNull()).groupBy(*on).agg(F.struct(F.col(ts).alias("at"), F.min(value).alias("value")).alias("_given"))
    both = times.unionByName(given.withColumn("_asks", F.lit(False)))
    both = both.groupBy(*on).agg(F.first("_given", ignorenulls=True).alias("_given"), F.bool_or("_asks").alias("_asks"))  # a row for each time
    found = with_neighbours(both, on[:-1], ts, F.col("_given"), ranges).where("_asks")
    since, until = (F.unix_micros(F.col(x).cast("timestamp")) for x in ("_before.hit.at", "_after.hit.at"))
    now = F.unix_micros(F.col(ts).cast("timestamp"))
    later = F.col("_before").isNull() | (until - now <= now - since)
    nearest = F.when(F.col("_after").isNotNull() & later, F.col("_after.hit.value")).otherwise(F.col("_before.hit.value"))
    return left.join(found.select(*on, nearest.alias(value)), on, "left")


def area_metric(df: DataFrame, how: str = "mean", key: str = "code", ts: str = "ts", value: str = "kwh") -> DataFrame:
    """(key, metric): mean, sum, min, max or latest (the last value that isn't missing)."""
    if how == "latest":
        have = F.col(value).isNotNull()
        return df.groupBy(key).agg(F.max_by(F.when(have, F.col(value)), F.when(have, F.col(ts))).alias("metric"))
    return df.groupBy(key).agg(AGGREGATES[how](value).alias("metric"))


def color_limits(df: DataFrame, value: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """One row (low, high): exact quantiles of the whole table, found by ranges of the values, or the extremes where these are equal; nulls for an empty table."""
    q = quantiles(df, value, {"_low": low, "_high": high})
    ends = df.agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
    both = ends.join(F.broadcast(q), F.lit(True), "left")  # a row on either side
    flat = F.col("_low") == F.col("_high")
    return both.select(F.when(flat, F.col("_a")).otherwise(F.col("_low")).alias("low"), F.when(flat, F.col("_b")).otherwise(F.col("_high")).alias("high"))


def monthly_ape(truth: DataFrame, imputed: DataFrame, key: str = "code", ts: str = "ts", value: str = "kwh") -> DataFrame:
    """(key, ts, truth, imputed, ape): monthly sums of both and the absolute error over the truth, null where that is 0."""
    a = truth.groupBy(key, month_of(ts).alias(ts)).agg(F.sum(value).alias("truth"))
    b = imputed.groupBy(key, month_of(ts).alias(ts)).agg(F.sum(value).alias("imputed"))
    ape = F.abs(F.col("imputed") - F.col("truth")) / F.nullif(F.abs("truth"), F.lit(0.0))
    return a.join(b, [key, ts]).withColumn("ape", ape)


def area_map(areas: DataFrame, df: DataFrame, how: str = "mean", key: str = "code", ts: str = "ts", value: str = "kwh") -> DataFrame:
    """areas with their metric, null where an area has no load."""
    return areas.join(area_metric(df, how, key, ts, value), key, "left")


def scatter(df: DataFrame, x: str, y: str, key: str = "code") -> DataFrame:
    """(key, x, y): the rows where both columns can be read as numbers."""
    return df.select(key, number(F.col(x).cast("string")).alias("x"), number(F.col(y).cast("string")).alias("y")).na.drop(subset=["x", "y"])
