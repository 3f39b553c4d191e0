"""Line dedup over overlapping windows of three lines (native).

Every run of three consecutive lines is hashed (two seeded 64-bit hashes together). Windows that
occur more than once anywhere are found by one aggregate with map-side combining, whose result is
the first occurrence in the order (id, position). Every later occurrence covers its three lines;
covered positions are merged to intervals per document, and the lines between them are kept.
A window that a third of all documents hold reaches the aggregate as one row per task, and the join
that finds its later occurrences is one that adaptive execution splits.

Defined results: lines are parted by U+000A only and compared unchanged; a text with fewer than
three lines is kept; null text stays null with 0 lines; a null id ranks behind all others; rows that
repeat an id and a text are one document, so each keeps its lines; an empty table gives no rows;
other columns pass through, and existing columns named n_lines or n_removed are replaced.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm._shared import cut, table

WINDOW = 3
KEY = ["k1", "k2"]
DOC = ["no_id", "id", "body"]


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with text_col reduced to the kept lines, and n_lines and n_removed (of the whole text)."""
    covered = _covered(df, id_col, text_col)
    rest = [c for c in df.columns if c not in (text_col, "n_lines", "n_removed")]
    held = df.select(
        F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest"),
        F.col(text_col).alias("text"),
        F.col(id_col).isNull().alias("no_id"),
        F.col(id_col).alias("id"),
        F.xxhash64(text_col).alias("body"),
    )
    lines = F.split("text", "\n", -1)
    covered = covered.toDF(*[f"{c}_" for c in DOC], "spans")
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in DOC])
    joined = held.join(covered, same, "left").withColumn("lines", lines)
    spans = F.coalesce("spans", F.array().cast("array<struct<lo:int,hi:int>>"))

    def gap(i):
        """Kept lines between span i - 1 and span i (both 0-based)."""
        start = F.when(i == 0, 0).otherwise(F.get(spans, i - 1)["hi"] + 1)
        stop = F.coalesce(F.get(spans, i)["lo"], F.size("lines"))
        return F.slice("lines", start + 1, stop - start)

    kept = F.when(F.size(spans) == 0, F.col("lines")).otherwise(
        F.flatten(F.transform(F.sequence(F.lit(0), F.size(spans)), gap))
    )
    whole = joined.withColumn("kept", kept)
    texts = {
        text_col: F.when(F.col("text").isNotNull(), F.array_join("kept", "\n")),
        "n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long"),
        "n_removed": F.when(F.col("text").isNull(), 0).otherwise(F.size("lines") - F.size("kept")).cast("long"),
    }
    order = [c for c in df.columns if c not in ("n_lines", "n_removed")] + ["n_lines", "n_removed"]
    return whole.select(*[texts[c].alias(c) if c in texts else F.col("rest").getField(c).alias(c) for c in order])


def _covered(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(no_id, id, body, spans): the merged intervals of lines that later occurrences cover."""
    lines = F.split(F.col(text_col), "\n", -1)
    docs = df.where(F.contains(F.col(text_col), F.lit("\n"))).select(
        F.col(id_col).isNull().alias("no_id"),
        F.col(id_col).alias("id"),
        F.xxhash64(text_col).alias("body"),
        F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(7), x).alias("b"))).alias("h"),
    )

    def keys(i):
        a, b, c = (F.get("h", i + k) for k in range(WINDOW))
        return F.struct(F.xxhash64(a["a"], b["a"], c["a"]).alias("k1"), F.xxhash64(a["b"], b["b"], c["b"]).alias("k2"))

    starts = F.sequence(F.lit(0), F.size("h") - WINDOW)
    windows = cut(
        docs.where(F.size("h") >= WINDOW)
        .select(*DOC, F.posexplode(F.transform(starts, keys)).alias("pos", "key"))
        .select(*DOC, "pos", "key.k1", "key.k2"),
        "windows",
    )
    place = F.struct(*DOC, "pos")
    repeated = (
        windows.groupBy(*KEY)
        .agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
        .drop("n")
    )
    repeated = cut(repeated, "repeated")  # so that adaptive execution can split the join below at a window that very many documents hold
    later = windows.join(repeated, KEY).where(place != F.col("first")).select(*DOC, "pos").distinct()
    ordered = Window.partitionBy(*DOC).orderBy("pos")
    apart = F.coalesce(F.col("pos") - F.lag("pos").over(ordered) >= WINDOW, F.lit(True))
    return (
        later.withColumn("apart", apart)
        .withColumn("island", F.count_if("apart").over(ordered))
        .groupBy(*DOC, "island")
        .agg(F.min("pos").alias("lo"), (F.max("pos") + WINDOW - 1).alias("hi"))
        .groupBy(*DOC)
        .agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans"))
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


SQL = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
w AS (
  SELECT doc_id, pos, lines[pos] || chr(10) || lines[pos + 1] || chr(10) || lines[pos + 2] AS key
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) - 1)) AS pos FROM d WHERE len(lines) >= 3)
), later AS (
  SELECT doc_id, pos FROM w
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id, pos) > 1
), covered AS (
  SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest([pos, pos + 1, pos + 2]) AS p FROM later) GROUP BY doc_id
), kept AS (
  SELECT d.doc_id, d.lines,
         CASE WHEN c.ps IS NULL THEN d.lines
              ELSE [d.lines[i] FOR i IN range(1, len(d.lines) + 1) IF NOT list_contains(c.ps, i)] END AS k
  FROM d LEFT JOIN covered c ON d.doc_id = c.doc_id
)
SELECT doc_id, coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(len(lines) - len(k), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(k, chr(10)), '')) AS kept_sha256
FROM kept
"""
QUERIES = {"op9_line_dedup": (op9_line_dedup, SQL)}
