"""Document fingerprints: threshold-scaled sketches of word shingles (native).

A text's shingles are its runs of SHINGLE consecutive words (all its words as one, if it has fewer); the
sketch keeps every shingle hash (the first 64 bits of an MD5) below FRACTION of the range, so it grows with the document
and a shingle that is kept for one text is kept for every text that has it. Therefore the shared part of two sketches estimates
how much of the smaller document is in the larger one, whatever their sizes, and the sketch of a union is the union of sketches. A text of which no
hash is below the threshold keeps its least hash, so that short texts are told apart; merging drops it
again once anything is below.

``next_in_order`` gives each row the next one of the whole table: ranges of the order (sampled
bounds) are windows of their own, and the first row of each range is also sent, once, as the last of the range before it.

Defined results: null is the empty text; a text without words has an empty sketch, alike only to another
such (1, else 0); case and order of words count; equal texts have equal fingerprints; ids that repeat are ordered by a hash of the text, null ids
come first; the last row's next is the first, so a single row's is itself; repeated rows each give a row; an
empty table gives no rows; very long texts are hashed whole; other columns are unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm._ranges import bounds_of, with_range
from gridloom.llm._shared import partitions, table

SHINGLE, FRACTION = 5, 1 / 8
#: Hexadecimal digits of a hash.
DIGITS = 16
#: Ranges of the order for each shuffle partition.
RANGES = 4


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _threshold(fraction: float) -> str:
    if not 0 < fraction <= 0.5:
        raise ValueError("the fraction must be over 0 and up to a half")
    return f"{int(fraction * 2 ** (4 * DIGITS)):0{DIGITS}x}"


def with_sketch(df: DataFrame, text: str, to: str, fraction: float = FRACTION, shingle: int = SHINGLE) -> DataFrame:
    """df with the sketch of a text column: an ascending array of longs without repeats."""
    limit = _threshold(fraction)
    n = F.size("_words")
    # Words are taken one by one, as slice() copies the whole array each time and concat_ws() is slow.
    run = lambda k: F.concat(*[x for i in range(shingle) for x in (F.lit(" "), F.get("_words", k + i))][1:])
    every = F.transform(F.sequence(F.lit(0), n - shingle), lambda k: F.md5(run(k).cast("binary")))
    alone = F.when(n > 0, F.array(F.md5(F.array_join("_words", " ").cast("binary")))).otherwise(F.array().cast("array<string>"))
    below = F.filter("_hashes", lambda h: h < limit)
    numbers = F.transform("_below", lambda h: F.conv(F.substring(h, 1, DIGITS), 16, 10).cast("long"))
    # The least hash of a text without any below is kept as a number too, if it fits: half of the range is negative as a long.
    least = F.array_min("_hashes")
    high = F.array((F.conv(F.substring(least, 1, DIGITS), 16, -10)).cast("long"))
    return (
        df.withColumn("_words", words_of(F.col(text)))
        .withColumn("_hashes", F.when(n >= shingle, every).otherwise(alone))
        .withColumn("_below", below)
        .withColumn(to, F.when(F.size("_below") > 0, F.sort_array(F.array_distinct(numbers))).when(F.size("_hashes") > 0, high).otherwise(F.array().cast("array<long>")))
        .drop("_words", "_hashes", "_below")
    )


def as_text(sketch: Column) -> Column:
    """The fingerprint: its hashes in order, DIGITS hexadecimal digits each."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), DIGITS, "0")), "")


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the smaller document's shingles that the other has, 0 to 1."""
    small = F.least(F.size(a), F.size(b))
    return F.when(small > 0, F.size(F.array_intersect(a, b)) / small).otherwise(F.when(F.size(a) == F.size(b), 1.0).otherwise(0.0))


def merged(sketches: DataFrame, by: list[str], sketch: str = "sketch", fraction: float = FRACTION) -> DataFrame:
    """(by, sketch) of the union of the documents of each group: one row per hash is combined before it shuffles.

    A group's sketch is one array, so it holds FRACTION of the group's different shingles.
    """
    limit = int(_threshold(fraction), 16)
    hashes = sketches.select(*by, F.explode_outer(sketch).alias("h")).distinct()
    # A lone high hash is a negative long or at or above the limit: of such ones the least (as unsigned) stays where nothing is below.
    low = F.col("h").between(0, limit - 1)
    unsigned = F.when(~low, F.struct((F.col("h") < 0).alias("high"), F.col("h").alias("h")))
    found = hashes.groupBy(*by).agg(F.array_sort(F.collect_list(F.when(low, F.col("h")))).alias("_low"), F.min(unsigned).alias("_rest"))
    alone = F.when(F.col("_rest").isNotNull(), F.array("_rest.h")).otherwise(F.array().cast("array<long>"))
    return found.select(*by, F.when(F.size("_low") > 0, F.col("_low")).otherwise(alone).alias(sketch))


def next_in_order(df: DataFrame, key: str, tie: str, carried: list[str], prepare=lambda x: x) -> DataFrame:
    """prepare(df) with next: the carried columns of the following row by (key, tie), of the first row after the last.

    prepare makes columns row by row; it is applied after the ranges are known, so what it makes isn't made for the sample.
    """
    spark = df.sparkSession
    bounds = bounds_of(df.select(F.col(key).alias("key"), F.col(tie).alias("tie")), RANGES * partitions(spark))
    if bounds is None:
        kinds = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in prepare(df).select(*carried).schema.fields)
        return prepare(df).withColumn("next", F.lit(None).cast(f"struct<{kinds}>".replace(": ", ":")))
    placed = with_range(df, F.col(key), F.col(tie), bounds)
    n = len(bounds)
    begin = [k - back for k, back in enumerate(bounds.repeats())]  # of the ranges that begin at one place, the first
    end = [n - 1 - begin[::-1].index(k) for k in begin]  # and the last
    at = F.col("range").cast("int")
    firsts = placed.where("starts").groupBy(key, tie).agg(F.first(F.struct(*df.columns)).alias("row"), F.max("range").alias("range"))
    before = F.sequence(*[F.get(F.array(*map(F.lit, x)), at) - 1 for x in (begin, end)])
    guests = firsts.select("row.*", F.explode(before).alias("range")).withColumn("range", F.pmod("range", F.lit(n)).cast("long"))
    own = prepare(placed.drop("starts")).withColumn("_guest", F.lit(False))
    every = own.unionByName(prepare(guests).withColumn("_guest", F.lit(True)))
    order = Window.partitionBy("range").orderBy("_guest", key, tie)
    return every.withColumn("next", F.lead(F.struct(*carried)).over(order)).where("not _guest").drop("range", "_guest")


def edited_by_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text, n_chars, edited, and the sketches own, of_edited and of_next.

    The edited text has the last half of its code points replaced by the first as many of the next text.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), text.alias("text")).withColumn("tie", F.xxhash64("text"))
    found = next_in_order(rows, "id", "tie", ["text", "own"], lambda x: with_sketch(x, "text", "own"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half))
    found = found.select("id", "text", n.cast("long").alias("n_chars"), edited.alias("edited"), "own", F.col("next.own").alias("of_next"))
    return with_sketch(found, "edited", "of_edited")


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_by_next(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("of_edited")).alias("edited_fingerprint"),
        containment(F.col("own"), F.col("of_edited")).alias("near_edited"),
        containment(F.col("own"), F.col("of_next")).alias("near_next"),
    )


_SKETCH = """CASE WHEN len({h}) = 0 THEN []::VARCHAR[] WHEN len(list_filter({h}, lambda x: x < '2')) > 0
    THEN list_sort(list_distinct(list_filter({h}, lambda x: x < '2'))) ELSE [list_min({h})] END"""
_HASHES = """list_transform(range(1, CASE WHEN len({w}) = 0 THEN 1 ELSE greatest(len({w}) - 4, 1) + 1 END),
    lambda i: substr(md5(concat_ws(' ', {w}[i], {w}[i + 1], {w}[i + 2], {w}[i + 3], {w}[i + 4])), 1, 16))"""
_NEAR = """CASE WHEN least(len({a}), len({b})) > 0 THEN len(list_intersect({a}, {b})) / least(len({a}), len({b}))::DOUBLE
    WHEN len({a}) = len({b}) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"""
SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents
), e AS (
  SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id NULLS FIRST), first_value(text) OVER (ORDER BY doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS next FROM d
), f AS (
  SELECT *, substr(text, 1, n - n // 2) || substr(next, 1, n // 2) AS edited FROM e
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w1, regexp_extract_all(edited, '[^\x20\x09-\x0D]+') AS w2, regexp_extract_all(next, '[^\x20\x09-\x0D]+') AS w3 FROM f
), h AS (
  SELECT *, {_HASHES.format(w="w1")} AS h1, {_HASHES.format(w="w2")} AS h2, {_HASHES.format(w="w3")} AS h3 FROM w
), s AS (
  SELECT *, {_SKETCH.format(h="h1")} AS s1, {_SKETCH.format(h="h2")} AS s2, {_SKETCH.format(h="h3")} AS s3 FROM h
)
SELECT doc_id, n::BIGINT AS n_chars, sha256(edited) AS edited_sha256, array_to_string(s1, '') AS fingerprint, array_to_string(s2, '') AS edited_fingerprint,
       {_NEAR.format(a="s1", b="s2")} AS near_edited, {_NEAR.format(a="s1", b="s3")} AS near_next
FROM s
"""
QUERIES = {"op12_fingerprints": (op12_fingerprints, SQL)}
