"""Polygons of shapefiles. The index file (.shx) tells where records lie, so a file is cut into runs of records that many tasks decode."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.sources.readers import read_dbf

#: Records of a run.
RUN = 2000
#: Bytes of the header of both files and of an index entry; shape types that are polygons (plain, with heights, with measures).
HEADER, ENTRY, POLYGONS = 100, 8, (5, 15, 25)
RINGS = "array<array<struct<x:double,y:double>>>"


def _whole(data: Column, at: Column) -> Column:
    """The unsigned big-endian 32-bit number at a byte (from 1)."""
    return F.conv(F.hex(F.substring(data, at, F.lit(4))), 16, 10).cast("long")


def _decoded(data: bytes, at: int) -> list[list[dict]] | None:
    """The rings of the record whose content begins at a byte; None for a null shape."""
    kind = int.from_bytes(data[at : at + 4], "little")
    if kind == 0:
        return None
    if kind not in POLYGONS:
        raise ValueError(f"shapes of type {kind} aren't polygons")
    n_parts, n_points = np.frombuffer(data, "<i4", 2, at + 36).tolist()
    starts = np.frombuffer(data, "<i4", n_parts, at + 44).tolist()
    points = np.frombuffer(data, "<f8", 2 * n_points, at + 44 + 4 * n_parts).reshape(-1, 2).tolist()
    return [[{"x": x, "y": y} for x, y in points[a:b]] for a, b in zip(starts, [*starts[1:], n_points], strict=True)]


def read_shapes(spark: SparkSession, path: str, run: int = RUN) -> DataFrame:
    """(record, rings) of a shapefile's polygons, numbered from 0; path names the .shp, its .shx lies beside it.

    Runs of records are cut out by the index where the file is read, and spread over all tasks.
    """
    base = path.rsplit(".", 1)[0]
    files = spark.read.format("binaryFile").load([f"{base}.shp", f"{base}.shx"])
    index, shapes = (F.first(F.when(F.lower("path").endswith(end), F.col("content")), ignorenulls=True) for end in (".shx", ".shp"))
    both = files.groupBy(F.lit(0).alias("_")).agg(index.alias("index"), shapes.alias("shapes"))
    n = F.floor((F.length("index") - HEADER) / ENTRY)
    runs = both.where(n > 0).withColumn("n", n).withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(run).cast("long"))))
    last = F.least(F.col("first") + run, F.col("n")) - 1
    entry = lambda k: HEADER + 1 + ENTRY * k
    begin = 2 * _whole(F.col("index"), entry(F.col("first")).cast("int"))
    until = 2 * (_whole(F.col("index"), entry(last).cast("int")) + _whole(F.col("index"), (entry(last) + 4).cast("int"))) + 8
    cut = runs.select("first", begin.alias("begin"), until.alias("until"), F.substring(F.col("index"), entry(F.col("first")).cast("int"), (ENTRY * (last - F.col("first") + 1)).cast("int")).alias("entries"), "shapes")
    cut = cut.select("first", "begin", "entries", F.substring("shapes", (F.col("begin") + 1).cast("int"), (F.col("until") - F.col("begin")).cast("int")).alias("bytes"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
        for batch in batches:
            for r in batch.to_pylist():
                at = 2 * np.frombuffer(r["entries"], ">u4")[::2].astype(np.int64) - r["begin"] + 8
                rings = [_decoded(r["bytes"], a) for a in at.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(range(r["first"], r["first"] + len(rings)), pa.int64()), pa.array(rings, kind)], ["record", "rings"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return cut.repartition(parts, "first").mapInArrow(decode, f"record long, rings {RINGS}")


def read_shapefile(spark: SparkSession, path: str, encoding: str = "utf-8", run: int = RUN) -> DataFrame:
    """The attributes of a shapefile's .dbf as text, with rings, matched by the number of the record; deleted records are left out."""
    base = path.rsplit(".", 1)[0]
    attributes = read_dbf(spark, f"{base}.dbf", encoding, record="_record")
    return attributes.join(read_shapes(spark, path, run).withColumnRenamed("record", "_record"), "_record").drop("_record")
