"""Mixing sources to target weights by capped water-filling (native).

Sources share the total by weight; a source whose share exceeds ``max_epochs`` times its size is
clamped there and the excess is shared among the rest by weight, round by round, until none is
above. A round is one aggregate over the table of sources: the level that it finds is all that the
driver holds. The level only rises, so a source clamped once stays clamped.

Sampling: a source with target / size = k + f takes each document k times and, in the order of a
seeded hash of the id and text, those whose midpoint on the running sum of sizes lies below f * size once
more. The running sum is made in two steps so that no source is ordered in one task: sizes are
summed by (source, range of the hash), prefix sums go over the ranges, and documents are ordered
only within a range. Bounds of the ranges are sampled, so rows that are alike in all that the hash covers and fill
several ranges are dealt among these.

Defined results: null text has size 0; the null source is a source of its own, last in order; a
source of size 0 has target 0; rows of a null or repeated id are told by the MD5 of their texts, then (with carry) by a hash of all columns but maps; repeated rows each count and are drawn in any order; an empty table gives no rows; other columns are unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm._ranges import bounds_of, with_range
from gridloom.llm._shared import cut, hashable, partitions, table, word_count

MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
SEED = "mix-1"
#: The hash has 60 bits: 15 hexadecimal digits of an MD5.
HASH_BITS = 60
#: Rows of a range of the hash, about.
RANGE_ROWS = 20_000
KEY = ["source_key", "source_null"]


def mix_sources(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: str = SEED,
    carry: bool = False,
) -> DataFrame:
    """One row per input row: id, source, size (words), source_size, target, reps, taken; and row, all of its columns, if carry.

    weights go to the sources in the order of their code points, null last, and repeat.
    """
    spark = df.sparkSession
    row = [F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")] if carry else []
    told = [F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text_col), F.lit("")))]
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), *told)), 1, HASH_BITS // 4)
    sized = cut(
        df.select(
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source_key"),
            F.col(source_col).isNull().alias("source_null"),
            word_count(F.col(text_col)).alias("size"),
            F.conv(digits, 16, 10).cast("long").alias("h"),
            (F.xxhash64(*hashable(df)) if carry else F.lit(0).cast("long")).alias("tie"),
            *row,
        ),
        "sized",
    )
    targets = fill(_weighted(sized.groupBy(*KEY).agg(F.sum("size").alias("source_size")), weights), max_epochs)
    ranges = max(4 * partitions(spark), sized.count() // RANGE_ROWS)
    bounds = bounds_of(sized.select(F.col("h").alias("key"), "tie"), ranges)
    ranged = with_range(sized, F.col("h"), F.col("tie"), bounds).drop("starts") if bounds else sized.withColumn("range", F.lit(0).cast("long"))
    before = Window.partitionBy(*KEY).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    plan = (
        ranged.groupBy(*KEY, "range")
        .agg(F.sum("size").alias("range_size"))
        .withColumn("start", F.coalesce(F.sum("range_size").over(before), F.lit(0)))
        .join(targets, KEY)
        .drop("range_size")
    )
    inside = Window.partitionBy(*KEY, "range").orderBy("h", "tie")
    until = F.col("start") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(ratio)
    extra = (ratio - whole) * F.col("source_size")
    reps = whole + F.when((extra > 0) & (2 * F.col("until") - F.col("size") <= 2 * extra), 1).otherwise(0)
    return (
        ranged.join(plan, [*KEY, "range"])
        .withColumn("until", until)
        .withColumn("reps", reps.cast("long"))
        .select("id", "source", "size", "source_size", "target", "reps", (F.col("size") * F.col("reps")).alias("taken"), *["row"] * carry)
    )


def _weighted(sources: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """Weights by each source's place in order: ranges of sources are ordered apart, and prefix sums over the ranges give their bases."""
    order = ["source_null", "source_key"]
    ranged = cut(sources.repartitionByRange(partitions(sources.sparkSession), *order).withColumn("range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    bases = ranged.groupBy("range").count().withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    place = F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1 + F.col("base")
    cycle = F.array(*map(F.lit, weights))
    placed = ranged.join(F.broadcast(bases), "range").withColumn("place", place)
    return cut(placed.withColumn("weight", F.get(cycle, F.col("place") % len(weights)).cast("long")).drop("range", "base", "place"), "sources")


def fill(sources: DataFrame, max_epochs: float) -> DataFrame:
    """Adds target to (source_size, weight): weighted shares of the total, clamped at max_epochs * source_size."""
    cap = F.col("source_size") * F.lit(max_epochs)

    def over(rest: float, weight: float) -> Column:
        return F.lit(rest) * F.col("weight") > cap * F.lit(weight)

    total, weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    total, weight = total or 0, weight or 1
    rest, clamped = total, 0
    while True:
        above = over(rest, weight)
        n, capped, free = sources.agg(
            F.count_if(above), F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("weight")))
        ).first()
        if n == clamped or not free:
            break
        rest, weight, clamped = total - (capped or 0), free, n
    share = F.col("weight").cast("double") * F.lit(float(rest)) / F.lit(float(weight))
    return sources.withColumn("target", F.when(over(rest, weight), cap.cast("double")).otherwise(share))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "reps"
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS weight
  FROM d GROUP BY source
), o AS (
  SELECT *, sum(source_size) OVER () AS total,
         coalesce(sum(3 * source_size) OVER b, 0) AS capped, sum(weight) OVER a AS free
  FROM s WINDOW b AS (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                a AS (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), level AS (
  SELECT (total - capped)::DOUBLE AS rest, free::DOUBLE AS free FROM o
  WHERE (total - capped) * weight <= 3 * source_size * free ORDER BY capped LIMIT 1
), t AS (
  SELECT s.source, s.source_size,
         CASE WHEN l.rest * s.weight > 3 * s.source_size * l.free THEN (3 * s.source_size)::DOUBLE
              ELSE s.weight::DOUBLE * l.rest / l.free END AS target
  FROM s, level l
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS ratio,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS until
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), p AS (
  SELECT *, (floor(ratio) + CASE WHEN (ratio - floor(ratio)) * source_size > 0
      AND 2 * until - size <= 2 * ((ratio - floor(ratio)) * source_size) THEN 1 ELSE 0 END)::BIGINT AS reps
  FROM r
)
SELECT doc_id, size, source_size, target, size * reps AS taken, reps FROM p
"""
QUERIES = {"op2_mixing": (op2_mixing, SQL)}
