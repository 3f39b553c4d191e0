"""Exact dedup by content sort (native).

Texts are normalised by deleting white space. Sampled splitters range-partition the normalised
bytes, each partition is sorted externally so that equal texts are adjacent, and neighbours are
compared in full by the window that follows; the first row of a run is the one that stays.

The sampled splitters are openings of HEAD characters, so what sampling sends to the driver is bounded.
One opening that very many texts share would fill one range; such a tie is cut into several ranges by a
64-bit hash of the text, which equal texts share too. Inside a range rows are sorted by their whole
content: opening, then text. A text with more copies than a quarter of an average partition would make one
run too long for a task. The hashes of such texts (at most four for each partition) are found
first; their rows are kept without the text, numbered, and combined where they are read, and the few texts go back to them by digest.
(Salting the equal runs instead would sort and compare as many copies of one text as there are.)

Defined results: null text is the empty text; a null id ranks behind all others; of rows that repeat an id and a text length
the one whose original text has the smallest hash stays, of wholly equal rows any one; an empty table gives no rows; other columns are unread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm._shared import cut, partitions, strip_spaces, table

#: Characters of a splitter.
HEAD = 64
LEAST_HOT = 32


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, normalised text, keep_id, group_size, kept.

    The row with the most code points in its original text stays, then the one with the smallest id.
    """
    rows = df.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.length(text_col), F.lit(0)).alias("length"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("original"),
        strip_spaces(F.col(text_col)).alias("normalised"),
    ).withColumn("h", F.xxhash64("normalised"))
    hot = _hot_hashes(rows)
    if not hot.limit(1).count():
        return _sorted_runs(rows)
    return _sorted_runs(rows.join(F.broadcast(hot), "h", "left_anti")).unionByName(_combined_first(rows.join(F.broadcast(hot), "h", "left_semi")))


def _hot_hashes(rows: DataFrame) -> DataFrame:
    """Hashes of texts with over 1 / (4 * partitions) of all rows, so at most 4 * partitions of them."""
    counts = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    limit = max(LEAST_HOT, rows.count() // (4 * partitions(rows.sparkSession)))
    return cut(counts.where(F.col("n") > limit).select("h"), "hot")


def _sorted_runs(rows: DataFrame) -> DataFrame:
    ranged = rows.withColumn("head", F.substring("normalised", 1, HEAD)).repartitionByRange(
        partitions(rows.sparkSession), "head", "h"
    )
    run = Window.partitionBy("head", "normalised", "h")  # sorted in this order, and a run ends where a neighbour differs
    best = run.orderBy(F.desc("length"), F.col("id").asc_nulls_last(), "original")
    return ranged.select(
        "id",
        "normalised",
        F.first("id").over(best).alias("keep_id"),
        F.count(F.lit(1)).over(run).alias("group_size"),
        (F.row_number().over(best) == 1).alias("kept"),
    )


def _combined_first(rows: DataFrame) -> DataFrame:
    """Each task combines its own rows and sends one per text; what these give goes back to the rows by digest."""
    digest = F.sha2("normalised", 256).alias("digest")
    order = [(-F.col("length")).alias("short"), F.col("id").isNull().alias("no_id"), "id", "original", "place"]
    own = cut(rows.select("id", digest, F.struct(*order[:4], F.monotonically_increasing_id().alias("place")).alias("order")), "copies")
    best = own.groupBy("digest").agg(F.min("order").alias("best"), F.count(F.lit(1)).alias("group_size"))
    texts = rows.groupBy(digest).agg(F.any_value("normalised").alias("normalised"))
    found = cut(best.join(texts, "digest"), "groups")  # a row per hot text
    return own.join(F.broadcast(found), "digest").select(
        "id", "normalised", F.col("best.id").alias("keep_id"), "group_size", (F.col("order") == F.col("best")).alias("kept")
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.sha2("normalised", 256).alias("text_sha256")
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(length(text), 0) AS len,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm ORDER BY len DESC, doc_id ASC NULLS LAST)
"""
QUERIES = {"op8_exact_dedup": (op8_exact_dedup, SQL)}
