"""Column helpers: aliases, coercion, and the missing-value rules of the load tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rename_first_present(df: DataFrame, canonical: str, candidates: Sequence[str]) -> DataFrame:
    """Rename the first of candidates that df has to canonical; df as it is if canonical is there or none matches."""
    if canonical in df.columns:
        return df
    found = next((c for c in candidates if c in df.columns), None)
    return df.withColumnRenamed(found, canonical) if found else df


def pick_column(df: DataFrame, candidates: Sequence[str]) -> str:
    """The first of candidates that df has; KeyError if none."""
    for c in candidates:
        if c in df.columns:
            return c
    raise KeyError(f"none of {list(candidates)} in {df.columns}")


def number(column: Column | str) -> Column:
    """As a double; text that isn't a number and NaN become null."""
    x = (F.col(column) if isinstance(column, str) else column).try_cast("double")
    return F.when(~F.isnan(x), x)


def first_present(df: DataFrame, candidates: Sequence[str]) -> Column:
    """Row-wise first value that isn't null of the candidates that df has; null if it has none."""
    own = [F.col(f"`{c}`") for c in candidates if c in df.columns]
    return F.coalesce(*own) if own else F.lit(None)


def first_numeric(df: DataFrame, candidates: Sequence[str]) -> Column:
    """As first_present, with each candidate read as a number first, so text falls through."""
    own = [number(F.col(f"`{c}`")) for c in candidates if c in df.columns]
    return F.coalesce(*own) if own else F.lit(None).cast("double")


def identifier(column: Column | str) -> Column:
    return F.trim((F.col(column) if isinstance(column, str) else column).cast("string"))


def whole_number(column: Column) -> Column:
    """As a long; an error for a fraction, as for nullable integer columns elsewhere."""
    return F.when(
        column == F.floor(column), column.cast("long")
    ).otherwise(F.when(column.isNotNull(), F.raise_error("a fraction where a whole number is expected").cast("long")))


def clip_negatives(df: DataFrame, value: str = "kwh", clip: bool = True) -> DataFrame:
    """Negative values become missing; with clip=False they are an error when read."""
    x = F.col(value)
    bad = F.lit(None) if clip else F.raise_error(F.concat(F.lit("negative value in "), F.lit(value)))
    return df.withColumn(value, F.when(x < 0, bad.cast("double")).otherwise(x))


def months_of(ts: Column | str, months: Sequence[int]) -> Column:
    if not set(months) <= set(range(1, 13)):
        raise ValueError(f"months must be 1 to 12: {months}")
    return F.month(ts).isin(list(months))


def is_weekday(ts: Column | str) -> Column:
    return F.weekday(ts) <= 4


def between_times(ts: str, start: str, end: str) -> Column:
    """Both ends included; an end without a time covers its whole day."""
    last = F.lit(end).cast("timestamp_ntz")
    if len(end.strip()) <= 10:
        return (F.col(ts) >= F.lit(start).cast("timestamp_ntz")) & (F.col(ts) < last + F.expr("interval 1 day"))
    return F.col(ts).between(F.lit(start).cast("timestamp_ntz"), last)


def correlation(x: Column | str, y: Column | str) -> Column:
    """Pearson's coefficient of pairs (both null or neither) as an aggregate; null if either side is constant."""
    varied = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(varied, F.covar_pop(x, y) / F.nullif(F.sqrt(F.var_pop(x) * F.var_pop(y)), F.lit(0.0)))


def hour_of(ts: Column | str) -> Column:
    """The start of the hour, without a time zone (date_trunc alone would bring the session's in)."""
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def month_of(ts: Column | str) -> Column:
    return F.date_trunc("month", ts).cast("timestamp_ntz")
