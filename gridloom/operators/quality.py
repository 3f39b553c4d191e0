"""Coverage profile and the cleaning pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.columns import clip_negatives, number
from gridloom.operators.ranges import counts_of, quantiles_of_counts
from gridloom.operators.timeseries import ffill, interpolate_both, regularize


def qc_profile(df: DataFrame, step: str | None = "1 hour", key: str = "code", ts: str = "ts", value: str = "kwh") -> DataFrame:
    """Per key: n_rows, n_missing, coverage, mean_kwh, p95_kwh, max_kwh over the grid that all keys share."""
    full = regularize(df, step, key, ts, value) if step else df
    counts = counts_of(full, value, [key])
    n, have = F.sum("_n"), F.coalesce(F.sum(F.when(F.col("_v").isNotNull(), F.col("_n"))), F.lit(0))
    whole = counts.groupBy(key).agg(
        n.alias("n_rows"),
        (n - have).alias("n_missing"),
        (have / n).alias("coverage"),
        (F.sum(F.col("_v") * F.col("_n")) / F.nullif(have, F.lit(0))).alias("mean_kwh"),
        F.max("_v").alias("max_kwh"),
    )
    p95 = quantiles_of_counts(counts, {"p95_kwh": 0.95}, [key])
    return whole.join(p95, key, "left").select(key, "n_rows", "n_missing", "coverage", "mean_kwh", "p95_kwh", "max_kwh")


def by_coverage(qc: DataFrame, key: str = "code") -> DataFrame:
    """A profile in order: the poorest coverage first, ties by key."""
    return qc.orderBy("coverage", key)


def preprocess_load(
    df: DataFrame,
    step: str | None = "1 hour",
    min_coverage: float = 0.9,
    clip: bool = True,
    fill: str | None = None,
    max_fill: int | None = None,
    key: str = "code",
    ts: str = "ts",
    value: str = "kwh",
) -> tuple[DataFrame, DataFrame]:
    """(clean, qc): the grid of the keys with enough coverage, filled as asked ('ffill', 'interpolate'); the profile of all keys.

    Keys are dropped by their own coverage.
    """
    if fill not in (None, "ffill", "interpolate"):
        raise ValueError("fill must be None, 'ffill' or 'interpolate'")
    once = df.groupBy(key, ts).agg(F.sum(number(value)).alias(value))
    full = clip_negatives(regularize(once, step, key, ts, value) if step else once, value, clip)
    qc = qc_profile(full, None, key, ts, value)
    kept = full
    if min_coverage > 0:
        own = Window.partitionBy(key).orderBy(F.col(ts).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # in the order that later steps need
        share = F.count(value).over(own) / F.count(F.lit(1)).over(own)
        kept = full.withColumn("_share", share).where(F.col("_share") >= min_coverage).drop("_share")
    if fill == "ffill":
        kept = ffill(kept, key, ts, value, max_fill)
    elif fill == "interpolate":
        kept = interpolate_both(kept, key, ts, value, max_fill)
    return kept, qc
