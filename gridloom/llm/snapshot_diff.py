"""Difference of two snapshots of a table, with rows found again under another key. No joins.

The snapshots are tagged and united. One aggregate by key puts the rows of a key side by side: keys in
both are the same or updated. What is left (keys on one side only) is ranked by key within its content, each side
by itself, and a second aggregate by (content, rank) pairs the i-th smallest earlier key with the i-th largest later one.

Values are compared as tokens: texts of up to SHORT characters as they are, longer ones by their SHA-256. So only the later
snapshot's rows travel whole, those of the earlier one as tokens.

A content with very many leftovers isn't ranked in one task: ranges of the key (sampled bounds) part it, rows are numbered within
(content, side, range), and the number of its rows in earlier ranges is added as a row of its own in each range.
Aggregates by key and by (content, rank) combine before they shuffle. Nothing is broadcast.

Defined results: nulls equal only nulls, also as keys; a key with several rows in a snapshot is
paired row by row in the order of a hash of the compared columns, the rest are leftovers; leftovers of equal key and content
go in that order too; a snapshot without rows gives inserts or deletes only, two give no rows; null, empty and long texts are
values like others; columns that aren't compared are unread.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from gridloom.llm._ranges import bounds_of, with_range
from gridloom.llm._shared import cut, discard, partitions, table

COLUMNS, CONTENT = ("text", "lang", "source"), ("text", "lang")
#: Characters of a value that is compared as it is.
SHORT = 64


def snapshot_diff(old: DataFrame, new: DataFrame, key: str = "doc_id", columns: Sequence[str] = COLUMNS, content: Sequence[str] = CONTENT) -> DataFrame:
    """One row per pair or unpaired row: key (later, else earlier), old_key, op, changed, row.

    op is same, update, rekey, insert or delete; changed lists the columns in which a pair differs; row has the
    columns of the later row, null for a delete. content are those of columns that find a row again under another key.
    """
    names = [f"c{k}" for k in range(len(columns))]
    inside = [names[list(columns).index(c)] for c in content]
    tagged = _tagged(old, key, columns, names, later=False).unionByName(_tagged(new, key, columns, names, later=True))
    keyed = cut(_side_by_side(tagged, ["key"]), "keyed")
    if keyed.where("n_old > 1 or n_new > 1").limit(1).count():
        discard(keyed)
        keyed = cut(_side_by_side(_ranked(tagged, ["key"], names), ["key", "rank"]), "keyed")
    both = F.col("old").isNotNull() & F.col("new").isNotNull()
    left = keyed.where(~both).select("key", F.col("new").isNotNull().alias("later"), F.coalesce("new", "old").alias("seen"), "row")
    left = left.select("*", *[F.col("seen")[c].alias(f"in_{c}") for c in inside])
    found = _side_by_side(_ranked(left, [f"in_{c}" for c in inside], names), [f"in_{c}" for c in inside] + ["rank"])
    same = F.lit(True)
    for c in names:
        same = same & F.col("old")[c].eqNullSafe(F.col("new")[c])
    by_key = keyed.where(both).select("key", F.col("key").alias("old_key"), F.when(same, "same").otherwise("update").alias("op"), "old", "new", "row")
    kind = F.when(both, "rekey").when(F.col("new").isNotNull(), "insert").otherwise("delete")
    by_content = found.select(F.when(F.col("new").isNotNull(), F.col("new_key")).otherwise(F.col("old_key")).alias("key"), "old_key", kind.alias("op"), "old", "new", "row")
    differ = [F.when(~F.col("old")[c].eqNullSafe(F.col("new")[c]), F.lit(name)) for c, name in zip(names, columns, strict=True)]
    changed = F.when(both, F.filter(F.array(*differ), lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))
    return by_key.unionByName(by_content).select("key", "old_key", "op", changed.alias("changed"), "row")


def _token(column: str, kind) -> Column:
    """A short value for a column, equal for equal values: null for null."""
    c = F.col(f"`{column}`")
    if not isinstance(kind, StringType | BinaryType):
        return c
    if isinstance(kind, BinaryType):
        return F.sha2(c, 256)
    return F.when(F.length(c) <= SHORT, F.concat(F.lit("="), c)).when(c.isNotNull(), F.concat(F.lit("#"), F.sha2(c, 256)))


def _tagged(df: DataFrame, key: str, columns: Sequence[str], names: list[str], later: bool) -> DataFrame:
    """(key, later, seen: the tokens, row: the columns themselves, of a later row)."""
    seen = F.struct(*[_token(c, df.schema[c].dataType).alias(n) for c, n in zip(columns, names, strict=True)])
    row = F.struct(*[F.col(f"`{c}`").alias(c) for c in columns])
    row = row if later else F.when(F.lit(False), row)
    return df.select(F.col(f"`{key}`").alias("key"), F.lit(later).alias("later"), seen.alias("seen"), row.alias("row"))


def _side_by_side(rows: DataFrame, by: list[str]) -> DataFrame:
    """The earlier and the later row of each group: old and new (tokens), their keys, the later row, and how many of each there are."""

    def only(condition: Column, x: str) -> Column:
        return F.first(F.when(condition, F.col(x)), ignorenulls=True)

    late = F.col("later")
    keys = [] if "key" in by else [only(~late, "key").alias("old_key"), only(late, "key").alias("new_key")]
    return rows.groupBy(*by).agg(
        only(~late, "seen").alias("old"),
        only(late, "seen").alias("new"),
        only(late, "row").alias("row"),
        F.count_if(~late).alias("n_old"),
        F.count_if(late).alias("n_new"),
        *keys,
    )


def _ranked(rows: DataFrame, group: list[str], names: list[str]) -> DataFrame:
    """rows with rank: the place among the rows of their group and side, by ascending key, of later rows by descending key."""
    tie = F.xxhash64(*[F.col("seen")[c] for c in names])
    rows = rows.withColumn("tie", tie)
    bounds = bounds_of(rows.select("key", "tie"), partitions(rows.sparkSession))
    if bounds is None:
        return rows.withColumn("rank", F.lit(0).cast("long")).drop("tie")
    late = F.col("later")
    placed = with_range(rows, F.col("key"), F.col("tie"), bounds).drop("starts")
    placed = placed.withColumn("range", F.when(late, -F.col("range")).otherwise(F.col("range")))
    before = Window.partitionBy(*group, "later").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(*group, "later", "range").agg(F.count(F.lit(1)).alias("n"))
    bases = counts.withColumn("weight", F.sum("n").over(before)).where("weight > 0").drop("n").withColumn("own", F.lit(False))
    every = placed.withColumns({"weight": F.lit(1).cast("long"), "own": F.lit(True)}).unionByName(bases, allowMissingColumns=True)
    order = [F.when(~late, F.col("key")).asc(), F.when(late, F.col("key")).desc(), "tie"]
    inside = Window.partitionBy(*group, "later", "range").orderBy("own", *order).rowsBetween(Window.unboundedPreceding, 0)
    return every.withColumn("rank", F.sum("weight").over(inside)).where("own").drop("own", "weight", "range", "tie")


def later_snapshot(docs: DataFrame) -> DataFrame:
    """The contract's later snapshot: crc32 of the id modulo 25 says what becomes of a row."""
    how = F.coalesce((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 25).cast("int"), F.lit(-1))
    rekeyed = -1 - F.col("doc_id")
    keys = F.when(how == 5, F.array("doc_id", rekeyed)).when(how.isin(3, 4), F.array(rekeyed)).otherwise(F.array("doc_id"))
    return docs.where(how != 0).select(
        F.explode(keys).alias("doc_id"),
        F.when(how == 1, F.concat(F.coalesce("text", F.lit("")), F.lit("+"))).otherwise(F.col("text")).alias("text"),
        F.when(how == 2, F.col("source")).otherwise(F.col("lang")).alias("lang"),
        F.when(how == 2, F.col("lang")).when(how != 4, F.col("source")).alias("source"),
    )


def op11_snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    whole = F.concat_ws("\n", *[F.coalesce(F.col("row")[c], F.lit("~")) for c in COLUMNS])
    return snapshot_diff(docs, later_snapshot(docs)).select(
        "key",
        "old_key",
        "op",
        F.array_join("changed", ",").alias("changed"),
        F.when(F.col("row").isNotNull(), F.sha2(whole, 256)).alias("row_sha256"),
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, text, lang, source, coalesce(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                          lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) % 25, -1) AS how
  FROM documents
), n AS (
  SELECT unnest(CASE WHEN how = 5 THEN [doc_id, -1 - doc_id] WHEN how IN (3, 4) THEN [-1 - doc_id] ELSE [doc_id] END) AS doc_id,
         CASE WHEN how = 1 THEN coalesce(text, '') || '+' ELSE text END AS text,
         CASE WHEN how = 2 THEN source ELSE lang END AS lang,
         CASE WHEN how = 2 THEN lang WHEN how <> 4 THEN source END AS source
  FROM d WHERE how <> 0
), k AS (
  SELECT d.doc_id AS old_key, n.doc_id AS new_key, d.text AS t1, n.text AS t2, d.lang AS l1, n.lang AS l2, d.source AS s1, n.source AS s2
  FROM d JOIN n ON d.doc_id IS NOT DISTINCT FROM n.doc_id
), a AS (
  SELECT *, row_number() OVER (PARTITION BY text, lang ORDER BY doc_id) AS i FROM d WHERE doc_id NOT IN (SELECT new_key FROM k)
), b AS (
  SELECT *, row_number() OVER (PARTITION BY text, lang ORDER BY doc_id DESC) AS i FROM n WHERE doc_id NOT IN (SELECT old_key FROM k)
), u AS (
  SELECT a.doc_id AS old_key, b.doc_id AS new_key, a.text AS t1, b.text AS t2, a.lang AS l1, b.lang AS l2, a.source AS s1, b.source AS s2,
         CASE WHEN b.doc_id IS NULL THEN 'delete' WHEN a.doc_id IS NULL THEN 'insert' ELSE 'rekey' END AS op
  FROM a FULL JOIN b ON a.i = b.i AND a.text IS NOT DISTINCT FROM b.text AND a.lang IS NOT DISTINCT FROM b.lang
  UNION ALL SELECT *, 'paired' FROM k
), c AS (
  SELECT *, CASE WHEN op IN ('insert', 'delete') THEN '' ELSE array_to_string(list_filter([
    CASE WHEN t1 IS DISTINCT FROM t2 THEN 'text' END, CASE WHEN l1 IS DISTINCT FROM l2 THEN 'lang' END,
    CASE WHEN s1 IS DISTINCT FROM s2 THEN 'source' END], lambda x: x IS NOT NULL), ',') END AS changed
  FROM u
)
SELECT coalesce(new_key, old_key) AS "key", old_key,
       CASE WHEN op <> 'paired' THEN op WHEN changed = '' THEN 'same' ELSE 'update' END AS op, coalesce(changed, '') AS changed,
       CASE WHEN op <> 'delete' THEN sha256(coalesce(t2, '~') || chr(10) || coalesce(l2, '~') || chr(10) || coalesce(s2, '~')) END AS row_sha256
FROM c
"""
QUERIES = {"op11_snapshot_diff": (op11_snapshot_diff, SQL)}
