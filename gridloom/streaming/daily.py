"""Daily peaks and metrics over a stream of load readings.

Peaks combine reading by reading, as a windowed aggregate. Metrics that depend on a day's rows in order (the ramp, the top tenth) keep
an open day's readings as state, by area and local day, and a timer at the day's end in its zone makes the row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gridloom.operators.short_term import AM, METRICS, PM
from gridloom.operators.timeseries import local_of


def daily_peaks(readings: DataFrame, delay: str = "2 hours", key: str = "code", ts: str = "ts", value: str = "kwh") -> DataFrame:
    """(key, day, peak_load, am_peak, pm_peak, n): a day's row is final once the watermark passes its end.

    ts is a timestamp; days are those of the session's zone at a whole-hour offset from UTC.
    """
    hour = F.hour(ts)
    am, pm = (F.max(F.when(hour.between(*h), F.col(value))) for h in (AM, PM))
    return (
        readings.where(F.col(value).isNotNull())
        .withWatermark(ts, delay)
        .groupBy(key, F.window(ts, "1 day").alias("w"))
        .agg(F.max(value).alias("peak_load"), am.alias("am_peak"), pm.alias("pm_peak"), F.count(F.lit(1)).alias("n"))
        .select(key, F.col("w.start").alias("day"), "peak_load", "am_peak", "pm_peak", "n")
    )


def _metrics(at: np.ndarray, hour: np.ndarray, x: np.ndarray) -> dict[str, float]:
    """As short_term.daily_metrics gives for a day's readings."""
    x = x[np.argsort(at, kind="stable")]
    hour = hour[np.argsort(at, kind="stable")]
    am, pm = (x[(hour >= a) & (hour <= b)].max(initial=-np.inf) for a, b in (AM, PM))
    top = np.sort(x)[::-1][: max(1, -(-len(x) // 10))]
    ratio = am / pm if np.isfinite(am) and np.isfinite(pm) and pm != 0 else None
    return {"peak_load": x.max(), "p90_top10_mean": top.mean(), "am_pm_peak_ratio": ratio, "ramp_up_rate": np.diff(x).max() if len(x) > 1 else None}


def daily_metrics_stream(readings: DataFrame, zone: str = "UTC", delay: str = "2 hours", key: str = "code", ts: str = "ts", value: str = "kwh") -> DataFrame:
    """(key, date, and METRICS) of each local day, once the watermark passes its end; days of 23 and 25 hours too.

    ts is a timestamp. A reading that is later than the watermark is left out, as its day may be final. The state of an open day is its
    readings, so it is bounded by how often an area reads.
    """
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    utc = F.timestamp_add("MICROSECOND", F.unix_micros(ts), epoch)
    local = local_of(utc, zone)
    midnight = F.date_add(F.to_date(local), 1).cast("timestamp_ntz")
    ends = F.timestamp_diff("MILLISECOND", epoch, F.convert_timezone(F.lit(zone), F.lit("UTC"), midnight))
    rows = readings.where(F.col(value).isNotNull()).withWatermark(ts, delay)
    rows = rows.select(key, ts, F.to_date(local).alias("date"), F.unix_micros(ts).alias("at"), F.hour(local).alias("hour"), F.col(value).cast("double").alias("x"), ends.alias("ends"))

    def day(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            found = _metrics(*map(np.asarray, state.get))
            state.remove()
            yield pd.DataFrame([{key: group[0], "date": group[1], **found}])
            return
        held = [list(c) for c in state.get] if state.exists else [[], [], []]
        for batch in batches:
            for own, name in zip(held, ("at", "hour", "x"), strict=True):
                own += batch[name].tolist()
            ends = int(batch["ends"].iloc[0])
        state.update(tuple(held))
        state.setTimeoutTimestamp(ends)

    kind = readings.schema[key].dataType.simpleString()
    out = f"{key} {kind}, date date, " + ", ".join(f"{m} double" for m in METRICS)
    return rows.groupBy(key, "date").applyInPandasWithState(day, out, "at array<long>, hour array<int>, x array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def write_daily_peaks(readings: DataFrame, path: str, checkpoint: str, **options):
    """Starts a query that appends final days to Parquet files."""
    return daily_peaks(readings, **options).writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).start(path)
