"""Ranges of a sort order: sampled bounds cut a table into pieces of about equal size, which tasks then order apart.

A row is placed by (key, tie): the key that orders the table, and a 64-bit hash of all that tells rows of one key
apart. So only rows that are alike in every column that counts have one place; where those fill several
ranges, their bounds are equal and the rows are dealt among these ranges at random, as any order of alike rows is right.
Nulls come first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sampled rows of a range, and ranges at most: so the driver holds at most PER_RANGE * MOST places.
PER_RANGE, MOST = 16, 16_384
SEED = 11


@dataclass(frozen=True)
class Bounds:
    """The first place of each range; the first bound is the least place of all."""

    places: list[tuple]
    kind: str

    def __len__(self) -> int:
        return len(self.places)

    def array(self) -> Column:
        rows = [F.struct(F.lit(k).cast(self.kind).alias("key"), F.lit(t).cast("long").alias("tie")) for k, t in self.places]
        return F.array(*rows)

    def repeats(self) -> list[int]:
        """For each range, how many before it begin at the same place."""
        out = []
        for k, place in enumerate(self.places):
            out.append(out[-1] + 1 if k and self.places[k - 1] == place else 0)
        return out


def bounds_of(places: DataFrame, ranges: int) -> Bounds | None:
    """Bounds of about so many ranges, from a sample of the rows of (key, tie); None for an empty table."""
    total = places.count()
    if not total:
        return None
    ranges = max(1, min(ranges, MOST, total))
    place = F.struct("key", "tie")
    drawn = places.select(place.alias("place"), (F.rand(SEED) < PER_RANGE * ranges / total).alias("drawn"))
    least, sample = drawn.agg(F.min("place"), F.sort_array(F.collect_list(F.when(F.col("drawn"), F.col("place"))))).first()
    inner = [sample[k * len(sample) // ranges] for k in range(1, ranges)] if sample else []
    return Bounds([(least[0], least[1]), *((r[0], r[1]) for r in inner)], places.schema["key"].dataType.simpleString())


def with_range(df: DataFrame, key: Column, tie: Column, bounds: Bounds) -> DataFrame:
    """df with range (long) and starts: whether the row is at the place where its range begins.

    The range is found by halving, so a row costs the logarithm of the number of ranges.
    """
    first, n = bounds.array(), len(bounds)
    steps = [1 << b for b in reversed(range((n - 1).bit_length()))]
    place = F.struct(key.alias("key"), tie.alias("tie"))
    placed = df.withColumn("_place", place)
    found = F.lit(0)
    if steps:

        def halve(low: Column, step: Column) -> Column:
            at = low + step
            return F.when((at < n) & (F.get(first, at) <= F.col("_place")), at).otherwise(low)

        found = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), halve)
    placed = placed.withColumn("range", found.cast("long"))
    placed = placed.withColumn("starts", F.get(first, F.col("range").cast("int")) == F.col("_place"))
    if any(repeats := bounds.repeats()):
        back = F.get(F.array(*map(F.lit, repeats)), F.col("range").cast("int"))
        dealt = F.when(F.col("starts"), F.floor(F.rand(SEED) * (back + 1))).otherwise(F.lit(0).cast("long"))
        placed = placed.withColumn("range", F.col("range") - dealt)
    return placed.drop("_place")
