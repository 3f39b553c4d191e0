"""Features of GeoJSON documents of any size: a file is read in splits that begin anywhere, and put together by scans.

A file is text parted by closing braces, which Spark reads in splits. Whether a piece begins inside a string, how deep its
braces lie, and which feature it belongs to follow from what is before it: sums within each split, and a scan over one
summary row for each split. Braces and quotes inside strings don't count. Features are then joined from their pieces, by file and number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.storage import stored

SPLIT = ["file", "block"]
#: What may stand before an object, with strings as wholes: loops that don't go back, so long texts need no deep stack.
BEFORE = r'^[^"{]*+(?:"(?:[^"\\]|\\.)*+"[^"{]*+)*+'
#: A string, its escapes removed, up to its end or that of the piece.
STRING = r'"[^"]*+(?:"|$)'


def _count(text: Column, mark: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))).cast("long")


def _with_sum_before(pieces: DataFrame, value: Column, name: str) -> DataFrame:
    """pieces with the sum of value over all pieces before each in its file."""
    pieces = pieces.withColumn("_v", value)
    inside = Window.partitionBy(*SPLIT).orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    splits = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = pieces.groupBy(*SPLIT).agg(F.sum("_v").alias("_s")).withColumn("_base", F.coalesce(F.sum("_s").over(splits), F.lit(0))).drop("_s")
    base = base.toDF("_file", "_block", "_base")
    joined = pieces.withColumn(name, F.coalesce(F.sum("_v").over(inside), F.lit(0))).join(base, (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")))
    return joined.withColumn(name, F.col(name) + F.col("_base")).drop("_v", "_file", "_block", "_base")


def read_feature_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, number, feature): the text of each object that lies directly in a list or value of a document's top object, in order from 0.

    Of a FeatureCollection these are its features, and such as its crs; choose by their type. Documents are UTF-8.
    """
    meta = F.col("_metadata")
    pieces = spark.read.option("lineSep", "}").text(path).select(
        meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("row"), "value"
    )
    plain = F.regexp_replace("value", r"\\.", "")  # no escape is cut by a closing brace
    pieces = _with_sum_before(pieces, _count(plain, '"'), "quotes")
    inside = F.col("quotes") % 2 == 1
    outside = F.regexp_replace(F.concat(F.when(inside, '"').otherwise(""), plain), STRING, "")
    ends = (F.col("quotes") + _count(plain, '"')) % 2 == 0  # the brace that ends the piece isn't in a string
    pieces = stored(pieces.select(*SPLIT, "row", "value", _count(outside, "{").alias("opens"), ends.cast("long").alias("closes")), "pieces")
    pieces = _with_sum_before(pieces, F.col("opens") - F.col("closes"), "depth")
    done = (F.col("closes") == 1) & (F.col("depth") + F.col("opens") == 2)
    pieces = _with_sum_before(pieces.withColumn("done", done.cast("long")), F.col("done"), "number")
    whole = pieces.groupBy("file", "number").agg(F.sort_array(F.collect_list(F.struct("block", "row", "value"))).alias("p"), F.max("done").alias("done"))
    text = F.array_join(F.transform("p", lambda x: x["value"]), "}")
    whole = whole.where("done = 1").select("file", "number", F.concat(text, F.lit("}")).alias("t"))
    within = F.when(F.col("number") == 0, F.regexp_replace(F.regexp_replace("t", BEFORE, ""), r"^\{", "")).otherwise(F.col("t"))
    return whole.select("file", "number", F.regexp_replace(within, BEFORE, "").alias("feature"))


def read_features(spark: SparkSession, path: str, properties: str = "string") -> DataFrame:
    """(properties, geometry) of each feature of GeoJSON documents; properties as a type, by default as JSON text."""
    kind = f"type string, properties {properties}, geometry struct<type:string,coordinates:string>"
    rows = read_feature_texts(spark, path).select(F.from_json("feature", kind).alias("f")).where("f.type = 'Feature'")
    return rows.select("f.properties", "f.geometry")
