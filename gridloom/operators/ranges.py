"""Work on groups of any size by ranges of their order: exact quantiles, and the nearest values before and after a row.

Bounds come from a bounded sample of the order column, inside the same plan (one row, broadcast). Each range is one
piece of work; what it needs from the others (how many rows lie before it, the last value before and the first one
after it) is a scan over one summary row for each group and range. So neither a group nor the table meets in one task,
and nothing goes to the driver. Results don't depend on the bounds.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sampled values of a range, and ranges for each shuffle partition and at most.
PER_RANGE, EACH, MOST = 16, 2, 8192
SEED = 7


def with_ranges(df: DataFrame, order: str, ranges: int | None = None) -> DataFrame:
    """df with range, which rises with the column order and holds about as many rows each; equal values share one. Nulls are in range 0."""
    if ranges is None:
        ranges = EACH * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, min(ranges, MOST))
    total = F.broadcast(df.agg(F.count(order).alias("_n")))
    drawn = df.select(order).where(F.col(order).isNotNull()).crossJoin(total).where(F.rand(SEED) * F.col("_n") < PER_RANGE * ranges)
    sample = drawn.agg(F.sort_array(F.collect_list(order)).alias("s"))
    bounds = F.transform(F.sequence(F.lit(1), F.lit(ranges)), lambda k: F.get("s", (k * F.size("s") / ranges).cast("int")))
    bounds = sample.select(F.filter(bounds, lambda b: b.isNotNull()).alias("_bounds"))
    steps = [1 << b for b in reversed(range(ranges.bit_length()))]

    def halve(low: Column, step: Column) -> Column:
        """low bounds are at or below the value; so are low + step, if the last of these is."""
        at = low + step
        return F.when((at <= F.size("_bounds")) & (F.get("_bounds", at - 1) <= F.col(order)), at).otherwise(low)

    found = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), halve)
    return df.crossJoin(F.broadcast(bounds)).withColumn("range", found).drop("_bounds")


def _matched(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """A join in which nulls equal nulls."""
    right = right.withColumnsRenamed({c: f"_on_{c}" for c in on})
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on])
    return left.join(right, same, how).drop(*[f"_on_{c}" for c in on])


def counts_of(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, _v, _n): how often each value occurs in each group. Repeated values combine before they shuffle."""
    return df.groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))


def quantiles_of_counts(counts: DataFrame, at: dict[str, float], by: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """(by, a column for each of at): exact quantiles, linear between neighbours, of what counts_of gives. Nulls and NaN don't count; a group of nothing else gives no row (without by, a row of nulls)."""
    placed = with_ranges(counts.where(F.col("_v").isNotNull() & ~F.isnan("_v")), "_v", ranges)
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    per = placed.groupBy(*by, "range").agg(F.sum("_n").alias("_m"))  # a row for each group and range
    before = F.coalesce(F.sum("_m").over(group.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.withColumns({"_total": F.sum("_m").over(group), "_before": before})
    asks = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(p)).alias("p")) for name, p in at.items()])
    asked = per.withColumn("_ask", F.explode(asks)).withColumn("_pos", F.col("_ask.p") * (F.col("_total") - 1))
    asked = asked.withColumns({"_low": F.floor("_pos"), "_high": F.ceil("_pos")})
    wanted = asked.where((F.col("_low") < F.col("_before") + F.col("_m")) & (F.col("_high") >= F.col("_before")))
    wanted = wanted.select(*by, "range", "_before", "_pos", "_low", "_high", F.col("_ask.name").alias("_name"))
    rows = _matched(placed, wanted, [*by, "range"])
    inside = Window.partitionBy(*by, "range", "_name").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_end", F.col("_before") + F.sum("_n").over(inside))

    def holds(rank: str) -> Column:
        return (F.col(rank) < F.col("_end")) & (F.col(rank) >= F.col("_end") - F.col("_n"))

    def quantile(name: str) -> Column:
        own = F.col("_name") == name
        low, high = (F.max(F.when(own & holds(rank), F.col("_v"))) for rank in ("_low", "_high"))
        return (low + (high - low) * F.max(F.when(own, F.col("_pos") - F.col("_low")))).alias(name)

    return rows.groupBy(*by).agg(*[quantile(name) for name in at])


def quantiles(df: DataFrame, value: str, at: dict[str, float], by: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """Exact quantiles of a column by group: the ranks that are asked for are found by counts per range, and only their ranges are looked into."""
    return quantiles_of_counts(counts_of(df, value, by), at, by, ranges)


def with_neighbours(df: DataFrame, by: Sequence[str], order: str, hit: Column, ranges: int | None = None) -> DataFrame:
    """df with _place (from 1 by order in its group), and _before and _after: (place, hit) of the nearest rows up to and from it on whose hit isn't null.

    Rows of equal order have a place each and see the hits of rows beside them by place.
    """
    placed = with_ranges(df, order, ranges)
    own = Window.partitionBy(*by, "range").orderBy(order)
    placed = placed.withColumn("_hit", hit).withColumn("_place", F.row_number().over(own).cast("long"))
    here = F.when(F.col("_hit").isNotNull(), F.struct(F.col("_place").alias("place"), F.col("_hit").alias("hit")))
    up = Window.partitionBy(*by, "range").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*by, "range").orderBy(F.desc("_place")).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumns({"_before": F.last(here, True).over(up), "_after": F.last(here, True).over(down)})
    have = F.when(F.col("_hit").isNotNull(), F.col("_place"))
    per = placed.groupBy(*by, "range").agg(
        F.count(F.lit(1)).alias("_rows"), F.max_by("_hit", have).alias("_last"), F.max(have).alias("_last_at"), F.min_by("_hit", have).alias("_first"), F.min(have).alias("_first_at")
    )
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    earlier = group.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    later = group.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_base", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    ends = {x: F.when(F.col(f"_{x}_at").isNotNull(), F.struct((F.col("_base") + F.col(f"_{x}_at")).alias("place"), F.col(f"_{x}").alias("hit"))) for x in ("last", "first")}
    per = per.withColumns({"_carried": F.last(ends["last"], True).over(earlier), "_next": F.last(ends["first"], True).over(later)})
    joined = _matched(local, per.select(*by, "range", "_base", "_carried", "_next"), [*by, "range"])
    moved = {x: F.when(F.col(x).isNotNull(), F.struct((F.col("_base") + F.col(x)["place"]).alias("place"), F.col(x)["hit"].alias("hit"))) for x in ("_before", "_after")}
    return (
        joined.withColumn("_before", F.coalesce(moved["_before"], "_carried"))
        .withColumn("_after", F.coalesce(moved["_after"], "_next"))
        .withColumn("_place", F.col("_base") + F.col("_place"))
        .drop("range", "_hit", "_base", "_carried", "_next")
    )
