"""Seasonal-trend decomposition, robust anomaly scores, replacement and iterative treatment.

The decomposition (Cleveland et al. 1990) is iterative over one series, so it runs as a grouped map
by area, and treatment over batches of whole areas; the scores from the residual on, the replacement and the summary are windows and aggregates.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.timeseries import interpolate_both, rolling_median
from gridloom.storage import stored

COLUMNS = "trend double, seasonal double, resid double"
#: Cells of the tables (places by span) that smoothing makes at once.
CELLS = 1_000_000
METHODS = ("interp", "stl_rebuild", "rolling_median")


def _odd_above(x: float) -> int:
    n = int(np.floor(x)) + 1
    return n + 1 - n % 2


def _kernel(n: int, span: int, first: float, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For count places from first on: the places themselves, their span nearest points of n, and tricube weights of these."""
    at = first + np.arange(count)
    q = min(span, n)
    left = np.clip(np.floor(at).astype(int) - (q - 1) // 2, 0, n - q)
    place = left[:, None] + np.arange(q)
    reach = np.maximum(at - left, left + q - 1 - at) + max(0, (span - n) // 2)
    r = np.abs(place - at[:, None]) / np.maximum(reach, 1e-12)[:, None]
    return at, place, np.where(r <= 0.001, 1.0, np.where(r <= 0.999, (1 - np.minimum(r, 1) ** 3) ** 3, 0.0))


def _line_weights(w: np.ndarray, place: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """What each point adds to the fitted line's value, for weights w (..., places, points)."""
    total = w.sum(-1, keepdims=True)
    w = np.divide(w, total, out=np.full_like(w, 1.0 / w.shape[-1]), where=total > 0)
    centre = (w * place).sum(-1)
    off = place - centre[..., None]
    spread = (w * off * off).sum(-1)
    slope = np.where(np.sqrt(spread) > 0.001 * (n - 1), (at - centre) / np.where(spread > 0, spread, 1), 0.0)
    return w * (1 + slope[..., None] * off)


@lru_cache(maxsize=16)
def _fixed(n: int, span: int, first: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Without other weights what points add is the same for all series of a length."""
    at, place, w = _kernel(n, span, first, count)
    return place, _line_weights(w, place, at, n)


def loess(y: np.ndarray, span: int, at: np.ndarray | None = None, weights: np.ndarray | None = None) -> np.ndarray:
    """Local linear smoothing of evenly spaced series (..., n) at the given places (may lie outside), tricube weights.

    Tables of CELLS are made at once at most; those of unweighted fits are kept for the next series.
    """
    n = y.shape[-1]
    at = np.arange(n) if at is None else np.asarray(at)
    q, series = min(span, n), y.size // n
    if len(at) * q * series > CELLS and len(at) > 1:
        step = max(1, CELLS // (q * series))
        return np.concatenate([_smoothed(y, span, at[k : k + step], weights) for k in range(0, len(at), step)], -1)
    return _smoothed(y, span, at, weights)


def _smoothed(y: np.ndarray, span: int, at: np.ndarray, weights: np.ndarray | None) -> np.ndarray:
    n, even = y.shape[-1], len(at) < 2 or bool((np.diff(at) == 1).all())
    if weights is None and even:
        place, add = _fixed(n, span, float(at[0]), len(at))
        return (add * y[..., place]).sum(-1)
    if even:
        at, place, w = _kernel(n, span, float(at[0]), len(at))
    else:
        at, place, w = (np.concatenate(x) for x in zip(*(_kernel(n, span, float(a), 1) for a in at), strict=True))
    return (_line_weights(w if weights is None else w * weights[..., place], place, at, n) * y[..., place]).sum(-1)


def _moving(x: np.ndarray, n: int) -> np.ndarray:
    return np.convolve(x, np.full(n, 1.0 / n), "valid")


def stl(y: np.ndarray, period: int, robust: bool = True, seasonal: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trend, seasonal, resid) of a series without gaps; they add up to it."""
    n = len(y)
    if period < 2 or n < 2 * period:
        raise ValueError("a period of 2 or more and two whole periods are needed")
    trend_span, low_span = _odd_above(1.5 * period / (1 - 1.5 / seasonal) - 1e-9), _odd_above(period)
    trend, season, weights = np.zeros(n), np.zeros(n), None
    outer, inner = (15, 2) if robust else (1, 5)
    more = np.arange(n % period)
    lengths = [(p, size) for p, size in ((more, n // period + 1), (np.arange(len(more), period), n // period)) if len(p)]
    for _ in range(outer):
        for _ in range(inner):
            cycle = np.zeros(n + 2 * period)
            for phase, size in lengths:  # the series of one phase each, those of equal length together
                own = phase[:, None] + period * np.arange(size)
                w = None if weights is None else weights[own]
                cycle[phase[:, None] + period * np.arange(size + 2)] = loess((y - trend)[own], seasonal, np.arange(-1.0, size + 1), w)
            low = loess(_moving(_moving(_moving(cycle, period), period), 3), low_span)
            season = cycle[period : period + n] - low
            trend = loess(y - season, trend_span, None, weights)
        if robust:
            size = np.abs(y - trend - season)
            top = 6 * np.median(size)
            u = size / top if top > 0 else np.zeros(n)
            weights = np.where(u <= 0.001, 1.0, np.where(u <= 0.999, (1 - np.minimum(u, 1) ** 2) ** 2, 0.0))
    return trend, season, y - trend - season


def stl_decompose(df: DataFrame, period: int = 24, robust: bool = True, key: str = "code", ts: str = "ts", value: str = "kwh") -> DataFrame:
    """(key, ts, value, trend, seasonal, resid); gaps are interpolated first. Areas with under two periods give no rows."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts)
        y = pdf[value].to_numpy(float)
        if len(y) < 2 * period or np.isnan(y).any():
            return pdf.iloc[:0].assign(trend=0.0, seasonal=0.0, resid=0.0)
        trend, season, resid = stl(y, period, robust)
        return pdf.assign(trend=trend, seasonal=season, resid=resid)

    full = interpolate_both(df.select(key, ts, F.col(value).cast("double").alias(value)), key, ts, value)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in full.schema.fields)
    return full.groupBy(key).applyInPandas(fit, f"{schema}, {COLUMNS}")


def score_residuals(df: DataFrame, z_thresh: float = 3.5, key: str = "code") -> DataFrame:
    """df with robust_z, is_anomaly and anomaly_direction from its resid.

    0.6745 (r - median) / MAD; with MAD 0 (r - median) / standard deviation, 0 where that is 0 too.
    """
    own = Window.partitionBy(key)
    half = F.lit(0.5)
    mid = df.withColumn("_m", F.percentile("resid", half).over(own)).withColumn("_sd", F.stddev_pop("resid").over(own))
    mad = mid.withColumn("_mad", F.percentile(F.abs(F.col("resid") - F.col("_m")), half).over(own))
    off = F.col("resid") - F.col("_m")
    z = F.when(F.col("_mad") > 0, 0.6745 * off / F.col("_mad")).when(F.col("_sd") > 0, off / F.col("_sd")).otherwise(0.0)
    scored = mad.withColumn("robust_z", z).withColumn("is_anomaly", F.abs("robust_z") >= z_thresh)
    way = F.when(F.col("is_anomaly"), F.when(F.col("resid") >= 0, "high").otherwise("low")).otherwise("normal")
    return scored.withColumn("anomaly_direction", way).drop("_m", "_sd", "_mad")


def stl_anomalies(df: DataFrame, period: int = 24, z_thresh: float = 3.5, robust: bool = True, key: str = "code", ts: str = "ts", value: str = "kwh") -> DataFrame:
    return score_residuals(stl_decompose(df, period, robust, key, ts, value), z_thresh, key)


def anomaly_summary(scored: DataFrame, key: str = "code") -> DataFrame:
    high, low = (F.count_if((F.col("anomaly_direction") == d)) for d in ("high", "low"))
    n, hits = F.count(F.lit(1)), F.count_if("is_anomaly")
    z = F.abs("robust_z")
    return scored.groupBy(key).agg(
        n.alias("n_points"),
        hits.alias("n_anomalies"),
        (hits / n).alias("anomaly_rate"),
        high.alias("n_high"),
        low.alias("n_low"),
        F.avg(z).alias("mean_abs_z"),
        F.max(z).alias("max_abs_z"),
        F.avg(F.abs("resid")).alias("mean_abs_resid"),
        F.max(F.abs("resid")).alias("max_abs_resid"),
        F.stddev_pop("resid").alias("std_resid"),
    )


def anomalies_of(scored: DataFrame, direction: str = "both") -> DataFrame:
    """The rows that are anomalies, of one direction (high, low) or of both."""
    if direction not in ("both", "high", "low"):
        raise ValueError("direction must be 'both', 'high' or 'low'")
    hits = scored.where("is_anomaly")
    return hits if direction == "both" else hits.where(F.col("anomaly_direction") == direction)


def by_rate(report: DataFrame, key: str = "code") -> DataFrame:
    """A treatment report in order: the highest final rate first, ties by key, areas without a rate last."""
    return report.orderBy(F.desc_nulls_last("final_rate"), key)


def replace_anomalies(
    scored: DataFrame, method: str = "interp", window: int = 24, key: str = "code", ts: str = "ts", value: str = "kwh"
) -> DataFrame:
    """scored with the values of anomalies replaced: along the line, by trend + seasonal, or by the rolling median of the rest."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    hit = F.col("is_anomaly")
    if method == "stl_rebuild":
        return scored.withColumn(value, F.when(hit, F.col("trend") + F.col("seasonal")).otherwise(F.col(value)))
    masked = scored.withColumn(value, F.when(~hit, F.col(value)))
    if method == "rolling_median":
        if window < 3:
            raise ValueError("window must be 3 or more")
        masked = masked.withColumn("_median", rolling_median(F.col(value), key, ts, window, 1))
        masked = masked.withColumn(value, F.coalesce(value, "_median")).drop("_median")
    return interpolate_both(masked, key, ts, value)


REPORT = "iterations int, initial_rate double, final_rate double, final_n_anomalies long, n_points long, n_replaced long, status string"
COMPONENTS = "trend double, seasonal double, resid double, robust_z double, is_anomaly boolean"


def _line(y: np.ndarray) -> np.ndarray:
    have = np.flatnonzero(~np.isnan(y))
    return np.interp(np.arange(len(y)), have, y[have]) if len(have) else y


@lru_cache(maxsize=4)
def _linear(n: int, period: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Not robust, the decomposition is linear: tables by which series (rows, of n points) are multiplied for trend, seasonal and both together."""
    trend, season, _ = (np.array(x) for x in zip(*(stl(unit, period, False) for unit in np.eye(n)), strict=True))
    return trend, season, trend + season


def _residuals(y: np.ndarray, period: int, robust: bool, linear: bool, parts: bool) -> tuple[np.ndarray | None, np.ndarray | None, np.ndarray]:
    """(trend, seasonal, resid) of the rows; the first two only if parts are wanted or linear tables aren't."""
    if not linear:
        return tuple(np.array(x) for x in zip(*(stl(row, period, robust) for row in y), strict=True))
    to_trend, to_season, to_both = _linear(y.shape[1], period)
    return (y @ to_trend, y @ to_season, y - y @ to_both) if parts else (None, None, y - y @ to_both)


def _treated(given: np.ndarray, period: int, z_thresh: float, target_rate: float, max_iter: int, method: str, robust: bool, components: bool) -> tuple[np.ndarray, dict, dict]:
    """(values, report, components) of series of one length (rows), all rounds; the rows that go on are decomposed together."""
    count, n = given.shape
    given, y = given.copy(), given.copy()
    for k in np.flatnonzero(np.isnan(y).any(1)):
        y[k] = _line(y[k])
    ints = lambda: np.zeros(count, np.int64)
    report = {"iterations": ints(), "initial_rate": np.full(count, np.nan), "final_rate": np.full(count, np.nan), "final_n_anomalies": ints()}
    report |= {"n_points": np.full(count, n), "n_replaced": ints(), "status": np.full(count, "too_short", object)}
    names = ("trend", "seasonal", "resid", "robust_z") if components else ()
    found = {c: np.full(given.shape, np.nan) for c in names} | ({"is_anomaly": np.zeros(given.shape, bool)} if components else {})
    active = np.flatnonzero(~np.isnan(y).any(1)) if n >= 2 * period else np.zeros(0, np.int64)
    report["status"][active] = "not_conformed"
    # The tables take n decompositions to make and serve all batches of a worker.
    linear = not robust and n * n <= CELLS and len(active) * max_iter >= n
    for step in range(1, max_iter + 1):
        if not len(active):
            break
        now = y[active]
        trend, season, resid = _residuals(now, period, robust, linear, components or method == "stl_rebuild")
        off = resid - np.median(resid, 1, keepdims=True)
        mad, sd = np.median(np.abs(off), 1, keepdims=True), resid.std(1, keepdims=True)
        z = np.where(mad > 0, 0.6745 * off / np.where(mad > 0, mad, 1), np.where(sd > 0, off / np.where(sd > 0, sd, 1), 0.0))
        hit = np.abs(z) >= z_thresh
        rate, hits = hit.mean(1), hit.sum(1)
        report["iterations"][active], report["final_rate"][active], report["final_n_anomalies"][active] = step, rate, hits
        if step == 1:
            report["initial_rate"][active] = rate
        for c, values in zip((*names, "is_anomaly"), (trend, season, resid, z, hit), strict=True) if components else ():
            found[c][active] = values
        ok = rate <= target_rate
        report["status"][active[ok]] = "ok"
        report["n_replaced"][active[~ok]] += hits[~ok]
        new = np.where(hit, trend + season, now) if method == "stl_rebuild" else np.where(hit, np.nan, now)
        if method == "interp":
            for k in np.flatnonzero(~ok & (hits > 0)):
                new[k] = _line(new[k])
        old = given[active]
        stalled = ~ok & ((new == old) | (np.isnan(new) & np.isnan(old))).all(1)
        report["status"][active[stalled]] = "stalled"
        on = ~ok & ~stalled
        active = active[on]
        y[active] = given[active] = new[on]
    return given, report, found


def treat_anomalies(
    df: DataFrame,
    period: int = 24,
    z_thresh: float = 3.0,
    target_rate: float = 0.001,
    max_iter: int = 10,
    method: str = "interp",
    robust: bool = False,
    key: str = "code",
    ts: str = "ts",
    value: str = "kwh",
    codes: list | None = None,
    components: bool = False,
) -> tuple[DataFrame, ...]:
    """(treated, report): decompose, score and replace per area until its rate of anomalies is low enough; with components also those of its last round.

    Gaps are filled for the decomposition only: a series that conforms at once comes back as it was, one that is replaced in without gaps.
    codes limits the areas that are treated; the others pass through, without a row in the report.
    The whole loop of an area is one task's work, for many areas of a length at once (about CELLS points); it runs once, its result is stored for all tables. Status: ok, stalled (nothing changed), not_conformed
    (max_iter reached; rate and anomalies are those before the last replacement, which still holds). n_replaced counts the points of all rounds.
    """
    if not 0 <= target_rate <= 1 or max_iter < 1:
        raise ValueError("target_rate must be in 0 to 1, max_iter 1 or more")
    if method not in ("interp", "stl_rebuild"):
        raise ValueError("method must be 'interp' or 'stl_rebuild'")
    names = [x.split()[0] for x in REPORT.split(", ")]
    parts = [x.split()[0] for x in COMPONENTS.split(", ")] if components else []
    kinds = [pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def treat(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        values = table.column(value).to_numpy().astype(float)
        starts = np.flatnonzero(table.column("_place").to_numpy() == 1)
        sizes = np.diff(np.append(starts, len(values)))
        reports = {c: np.zeros(len(starts), object if c == "status" else float if "rate" in c else np.int64) for c in names}
        found = {c: np.zeros(len(values), bool if c == "is_anomaly" else float) for c in parts}
        for n in np.unique(sizes):
            own = np.flatnonzero(sizes == n)
            at = starts[own][:, None] + np.arange(n)
            values[at], report, more = _treated(values[at], period, z_thresh, target_rate, max_iter, method, robust, components)
            for c in names:
                reports[c][own] = report[c]
            for c in parts:
                found[c][at] = more[c]
        whole = pa.StructArray.from_arrays([pa.array(reports[c], kind, from_pandas=True) for c, kind in zip(names, kinds, strict=True)], names)
        place = np.zeros(len(values), np.int64)
        place[starts] = np.arange(len(starts))
        first = np.ones(len(values), bool)
        first[starts] = False
        columns = [table.column(key), table.column(ts), pa.array(values, from_pandas=True), whole.take(pa.array(place, mask=first))]
        columns += [pa.array(found[c], from_pandas=True) for c in parts]
        yield from pa.table(columns, [key, ts, value, "_report", *parts]).combine_chunks().to_batches(CELLS // 10)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            starts = np.flatnonzero(batch.column(batch.schema.get_field_index("_place")).to_numpy() == 1)
            if size + len(batch) > CELLS and len(starts) and size + starts[-1]:
                yield from treat([*held, batch.slice(0, starts[-1])])
                held, size, batch = [], 0, batch.slice(starts[-1])
            held.append(batch)
            size += len(batch)
        if size:
            yield from treat(held)

    every = df.select(key, ts, F.col(value).cast("double").alias(value))
    rows = every if codes is None else every.where(F.col(key).isin(codes))
    order = F.col(ts).asc_nulls_last()
    placed = rows.withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy(order))).sortWithinPartitions(key, order)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    structure = ", ".join(x.replace(" ", ": ") for x in REPORT.split(", "))
    both = stored(placed.mapInArrow(fit, f"{schema}, _report struct<{structure}>" + (f", {COMPONENTS}" if components else "")), "treated")
    treated = both.select(key, ts, value)
    if codes is not None:
        treated = treated.unionByName(every.where(~F.col(key).isin(codes) | F.col(key).isNull()))
    report = both.where(F.col("_report").isNotNull()).select(key, "_report.*")
    if not components:
        return treated, report
    return treated, report, both.select(key, ts, *parts)
