"""Chat formatting with collapse of cumulative snapshots.

Logs often hold a conversation again and again as it grows. Each turn is hashed with its place, and
a running combination over the turns gives the hash of every prefix. A conversation whose whole is a
proper prefix of a longer one is removed by an anti-join on (length, hash); of equal conversations
the one with the smallest id stays. The rest are rendered.

Equal ends are combined before the anti-join and prefixes are made distinct, both with map-side
combining, so a first turn or a conversation that a third of all rows share costs a row per task.
Only (id, place, hashes) is ordered; texts are shuffled once, for the rendering of what remains.

Defined results: turns are ordered by number, null first, and turns that share a number by their hash;
rows that repeat all four columns count once; null role or text reads as empty; a row without a conversation
id is a conversation of its own, after all others, so logs without ids don't meet in one task; an empty
table gives no rows; other columns are unread.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm._shared import cut, table

HASHES = ["x1", "x2"]
#: What tells conversations apart: the id, or the turn's number and hashes where there's none.
OWNER = ["alone", "conv"]
TEMPLATE = ("<|", "|>\n", "<|end|>\n")


def format_chats(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per maximal conversation: conv, n_turns, rendered, n_same (conversations equal to it, itself included)."""
    turns = df.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit(1), "role", "text")})
    no_id = F.struct(F.col("turn"), F.col("h1"), F.col("h2"))
    turns = turns.withColumn("alone", F.when(F.col("conv").isNull(), F.to_json(no_id)))
    prefixes = cut(_prefixes(turns), "prefixes")
    ends = (
        prefixes.where("is_last")
        .groupBy("n", *HASHES)
        .agg(F.min(F.struct(F.col("conv").isNull(), *OWNER)).alias("best"), F.count(F.lit(1)).alias("n_same"))
        .select("n", *HASHES, *[F.col(f"best.{c}").alias(f"{c}_kept") for c in OWNER], "n_same")
    )
    longer = prefixes.where(~F.col("is_last")).select("n", *HASHES).distinct()
    maximal = ends.join(longer, ["n", *HASHES], "left_anti").select(*[f"{c}_kept" for c in OWNER], "n_same")
    a, b, c = map(F.lit, TEMPLATE)
    said = F.array_sort(F.collect_set(F.struct("turn", "h1", "h2", "role", "text")))
    return (
        turns.join(maximal, reduce(and_, [F.col(c).eqNullSafe(F.col(f"{c}_kept")) for c in OWNER]))
        .groupBy(*OWNER, "n_same")
        .agg(said.alias("said"))
        .select(
            "conv",
            F.size("said").cast("long").alias("n_turns"),
            F.array_join(F.transform("said", lambda t: F.concat(a, t["role"], b, t["text"], c)), "").alias("rendered"),
            "n_same",
        )
    )


def _prefixes(turns: DataFrame) -> DataFrame:
    """(alone, conv, n, x1, x2, is_last): the hash of the first n turns of each conversation."""
    order = Window.partitionBy(*OWNER).orderBy("turn", "h1", "h2")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    return (
        turns.select(*OWNER, "turn", "h1", "h2")
        .distinct()
        .withColumn("n", F.row_number().over(order))
        .withColumns({"y1": F.xxhash64("n", "h1"), "y2": F.xxhash64("n", "h2")})
        .select(
            *OWNER,
            F.col("n").cast("long").alias("n"),
            F.bit_xor("y1").over(running).alias("x1"),
            F.bit_xor("y2").over(running).alias("x2"),
            F.lead("n").over(order).isNull().alias("is_last"),
        )
    )


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations")).select(
        F.col("conv").alias("conv_id"), "n_turns", "n_same", F.sha2("rendered", 256).alias("rendered_sha256"), "rendered"
    )


SQL = r"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         CASE WHEN conv_id IS NULL THEN hash(turn, coalesce(role, ''), coalesce(text, '')) END AS alone FROM conversations
), p AS (
  SELECT conv_id, row_number() OVER w AS n, count(*) OVER (PARTITION BY alone, conv_id) AS len,
         string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '') OVER w AS said
  FROM t WINDOW w AS (PARTITION BY alone, conv_id ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), ends AS (
  SELECT n, said, min(conv_id) AS conv_id, count(*) AS n_same FROM p WHERE n = len GROUP BY n, said
)
SELECT conv_id, n AS n_turns, n_same, sha256(said) AS rendered_sha256, said AS rendered
FROM ends e WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.n < p.len AND p.n = e.n AND p.said = e.said)
"""
QUERIES = {"op1_chat_format": (op1_chat_format, SQL)}
