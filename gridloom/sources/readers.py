"""Readers: raw and wide load, weather, census folders, geometry, buildings; all to long or standard tables."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.columns import identifier, number, rename_first_present
from gridloom.functions.geometry import from_geojson
from gridloom.operators.buildings import HEIGHTS, NUMBERS, TEXTS, standardize_buildings
from gridloom.operators.timeseries import local_of
from gridloom.sources.features import read_features

# The zone and column names of the source files.
ZONE = "America/Toronto"
RAW = ("CP3", "DateIntervalUTC", "kWh")
TIMES = ["dt_local", "date_time_local", "datetime", "timestamp", "time"]
DA_ALIASES = ["DAUID", "DAUID21", "GEO UID", "GEO_UID"]
FSA_ALIASES = ["FSA", "CFSAUID", "GEO UID"]


def _checked(df: DataFrame, parsed: str, source: str) -> DataFrame:
    """df whose parsed column raises, when read, if its source had a value that gave none."""
    bad = F.col(parsed).isNull() & F.col(source).isNotNull()
    message = F.concat(F.lit(f"cannot read {source}: "), F.col(source).cast("string"))
    return df.withColumn(parsed, F.when(bad, F.raise_error(message).cast(df.schema[parsed].dataType)).otherwise(F.col(parsed)))


def long_from_raw(raw: DataFrame, zone: str = ZONE) -> DataFrame:
    """(code, ts, kwh, utc) from CP3, DateIntervalUTC (UTC), kWh; rows of one code and instant are summed.

    ts is the local time, for grouping by day, hour and month; it occurs twice at the autumn change. utc is the
    instant, without zone, which orders the series. A row without kWh is an error.
    """
    at = F.try_to_timestamp(F.col("DateIntervalUTC").cast("string")).cast("timestamp_ntz")
    rows = raw.select(identifier("CP3").alias("code"), "DateIntervalUTC", "kWh", at.alias("utc"), number(F.col("kWh").cast("string")).alias("kwh_"))
    rows = _checked(_checked(rows, "utc", "DateIntervalUTC"), "kwh_", "kWh")
    given = F.when(F.col("kwh_").isNull(), F.raise_error(F.lit("cannot read kWh: a row has none")).cast("double")).otherwise(F.col("kwh_"))
    summed = rows.groupBy("code", "utc").agg(F.sum(given).alias("kwh"))
    return summed.select("code", local_of(F.col("utc"), zone).alias("ts"), "kwh", "utc")


def long_from_wide(wide: DataFrame, index: str | None = None, utc: bool = False, zone: str = ZONE) -> DataFrame:
    """(code, ts, kwh) from a time column and one column per area; text that isn't a number becomes null."""
    at = index or next((c for c in TIMES if c in wide.columns), wide.columns[0])
    ts = F.try_to_timestamp(F.col(at).cast("string"))
    ts = F.from_utc_timestamp(ts, zone) if utc else ts
    codes = [c for c in wide.columns if c != at]
    values = [number(F.col(f"`{c}`").cast("string")).alias(c) for c in codes]
    rows = wide.select(ts.cast("timestamp_ntz").alias("ts"), *values)
    return rows.unpivot(["ts"], [f"`{c}`" for c in codes], "code", "kwh").select("code", "ts", "kwh")


def read_load_wide(spark: SparkSession, path: str, file_format: str = "parquet", index: str | None = None, utc: bool = False) -> DataFrame:
    if file_format not in ("parquet", "csv"):
        raise ValueError("file_format must be 'parquet' or 'csv'")
    df = spark.read.parquet(path) if file_format == "parquet" else spark.read.csv(path, header=True)
    return long_from_wide(df, index, utc)


def read_load(spark: SparkSession, path: str, zone: str = ZONE) -> DataFrame:
    """Raw rows where the raw columns are there, else a wide table."""
    df = spark.read.parquet(path)
    return long_from_raw(df, zone) if set(RAW) <= set(df.columns) else long_from_wide(df, zone=zone)


def clean_weather(df: DataFrame) -> DataFrame:
    """(ts, temperature) of the rows where both can be read."""
    ts = F.try_to_timestamp(F.col("date_time_local").cast("string")).cast("timestamp_ntz")
    return df.select(ts.alias("ts"), number(F.col("temperature").cast("string")).alias("temperature")).na.drop()


def read_weather(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """(city, ts, temperature) from a CSV per city; the temperature column is the one so named, else the first whose name has the word."""
    parts = []
    for city, path in paths.items():
        df = spark.read.csv(path, header=True)
        if "temperature" not in df.columns:
            df = rename_first_present(df, "temperature", [c for c in df.columns if "temperature" in c.lower()])
        if not {"date_time_local", "temperature"} <= set(df.columns):
            raise KeyError(f"no time or temperature column in {path}")
        parts.append(clean_weather(df).select(F.lit(city).alias("city"), "ts", "temperature"))
    return reduce(DataFrame.unionByName, parts)


def census_names(lines: Sequence[str]) -> list[str]:
    """Names of a census description with lines such as ``COL3 - name``, by column number."""
    found = [m for m in (re.match(r"\s*COL(\d+)\s*-\s*(.*\S)", line) for line in lines) if m]
    return [m[2] for m in sorted(found, key=lambda m: int(m[1]))]


def read_census(spark: SparkSession, folders: Sequence[str], aliases: Sequence[str] = FSA_ALIASES, key: str = "code") -> DataFrame:
    """Wide census: each folder has a CSV and a TXT that names its columns; tables are joined on the key.

    A column that two tables have is taken from the first.
    """
    out = None
    for folder in folders:
        names = census_names([r[0] for r in spark.read.text(f"{folder}/*.txt").collect()])
        df = spark.read.csv(f"{folder}/*.csv", header=True)
        if set(df.columns) <= {f"COL{k}" for k in range(len(names))}:
            df = df.toDF(*[names[int(c[3:])] for c in df.columns])
        elif len(names) == len(df.columns):
            df = df.toDF(*names)
        df = rename_first_present(df, key, aliases)
        if key not in df.columns:
            raise KeyError(f"none of {list(aliases)} in {folder}")
        df = df.withColumn(key, identifier(key))
        if out is None:
            out = df
        else:
            out = out.join(df.drop(*[c for c in df.columns if c != key and c in out.columns]), key, "full")
    return out


def census_long(wide: DataFrame, key: str = "code") -> DataFrame:
    """(key, feature, value): every other column as a number, null where it isn't one."""
    features = [c for c in wide.columns if c != key]
    values = [number(F.col(f"`{c}`").cast("string")).alias(c) for c in features]
    return wide.select(key, *values).unpivot([key], [f"`{c}`" for c in features], "feature", "value")


def first_census_row(census: DataFrame, key: str = "code", order: str | None = None) -> DataFrame:
    """One row per key: the first by order, or by its place in the files that census reads."""
    place = F.col(order) if order else F.monotonically_increasing_id()
    rest = [c for c in census.columns if c != key]
    first = F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), "_at").alias("_row")
    return census.withColumn("_at", place).groupBy(key).agg(first).select(key, "_row.*").select(*[F.col(f"`{c}`") for c in census.columns])


def read_geometry(spark: SparkSession, paths: Mapping[str, str], aliases: Sequence[str] = FSA_ALIASES, strict: bool = True) -> DataFrame:
    """(city, code, rings) from a GeoJSON file per city; with strict=False a file that is missing is left out."""
    parts = []
    for city, path in paths.items():
        jvm = spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
            if strict:
                raise FileNotFoundError(path)
            continue
        keys = [F.get_json_object("p", f"$['{a}']") for a in aliases]
        flat = read_features(spark, path).select(F.col("properties").alias("p"), F.col("geometry").alias("g"))
        parts.append(flat.select(F.lit(city).alias("city"), F.trim(F.coalesce(*keys)).alias("code"), from_geojson("g").alias("rings")))
    if not parts:
        raise FileNotFoundError("no geometry file")
    return reduce(DataFrame.unionByName, parts)


def _features(spark: SparkSession, path: str, id_col: str) -> DataFrame:
    """Rings and the source columns of standard buildings from GeoJSON with a fixed schema; sources of one standard column are
    merged into the first, as some names differ in case only."""
    rows = read_features(spark, path, "map<string,string>")
    p = F.col("properties")
    merged = {names[0]: F.coalesce(*[number(p[n]) for n in names]) for names in [*NUMBERS.values(), HEIGHTS]}
    merged |= {names[0]: F.coalesce(*[p[n] for n in names]) for names in TEXTS.values()}
    merged |= {n: p[n] for n in (id_col, "Z_Max", "Z_Min")}
    return rows.select(*[c.alias(n) for n, c in merged.items()], from_geojson("geometry").alias("rings"))


def dbf_fields(head: bytes) -> tuple[list[tuple[str, int, int]], int, int]:
    """(name, offset, width) of each field of a dBASE file's header, and the sizes of header and record."""
    size, width = struct.unpack_from("<HH", head, 8)
    fields, at = [], 1
    for place in range(32, size - 1, 32):
        if head[place] == 0x0D:
            break
        fields.append((head[place : place + 11].split(b"\0")[0].decode("latin-1"), at, head[place + 16]))
        at += head[place + 16]
    return fields, size, width


def read_dbf(spark: SparkSession, path: str, encoding: str = "utf-8", record: str | None = None) -> DataFrame:
    """The attribute table of a shapefile, all columns as text, empty ones null, deleted records left out; record names a column for their numbers, from 0. A file is one task's work."""
    files = spark.read.format("binaryFile").load(path).select("content")
    fields, _, _ = dbf_fields(bytes(files.select(F.substring("content", 1, 65535)).first()[0]))
    names = [n for n, *_ in fields]

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column(0):
                data = cell.as_buffer()
                head = data.slice(0, min(len(data), 65535)).to_pybytes()
                own, size, width = dbf_fields(head)
                n = min(struct.unpack_from("<I", head, 4)[0], (len(data) - size) // width)
                for a in range(0, n, 10_000):
                    block = data.slice(size + a * width, min(10_000, n - a) * width).to_pybytes()
                    kept = [k for k in range(0, len(block), width) if block[k : k + 1] != b"*"]
                    rows = [block[k : k + width] for k in kept]
                    columns = [[r[at : at + w].decode(encoding, "replace").strip(" \0") or None for r in rows] for _, at, w in own]
                    numbers = [pa.array([a + k // width for k in kept], pa.int64())] if record else []
                    yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.string()) for c in columns], *numbers], [*names, *[record] * bool(record)])

    return files.mapInArrow(records, ", ".join([*[f"`{n}` string" for n in names], *[f"`{record}` long"] * bool(record)]))


def read_buildings(spark: SparkSession, path: str, id_col: str = "ID_UEV") -> DataFrame:
    """Standard building table from Parquet, CSV, GeoJSON properties or a shapefile's attributes; other formats are an error."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix == "parquet":
        df = spark.read.parquet(path)
    elif suffix == "csv":
        df = spark.read.csv(path, header=True)
    elif suffix in ("geojson", "json"):
        df = _features(spark, path, id_col).drop("rings")
    elif suffix in ("shp", "dbf"):
        df = read_dbf(spark, path.rsplit(".", 1)[0] + ".dbf")
    else:
        raise ValueError(f"unsupported building format .{suffix}")
    return standardize_buildings(df, id_col)


def read_building_geometry(spark: SparkSession, path: str, id_col: str = "ID_UEV") -> DataFrame:
    """Standard building table with rings, from GeoJSON or a shapefile; other formats are an error."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix == "shp":
        from gridloom.sources.shapefile import read_shapefile  # it reads attributes by this module

        return standardize_buildings(read_shapefile(spark, path), id_col)
    if suffix not in ("geojson", "json"):
        raise ValueError("building geometry must be GeoJSON or a shapefile")
    return standardize_buildings(_features(spark, path, id_col), id_col)


def inspect_tables(tables: Mapping[str, DataFrame]) -> dict[str, int]:
    """Rows of each table."""
    return {name: df.count() for name, df in tables.items()}


def inspect_paths(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """(name, path, exists, kind, n_files, n_bytes) of files and folders; kind is file, dir or missing."""
    rows, conf = [], spark._jsc.hadoopConfiguration()
    for name, path in paths.items():
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = target.getFileSystem(conf)
        if not fs.exists(target):
            rows.append((name, path, False, "missing", 0, 0))
            continue
        found = fs.getContentSummary(target)
        kind = "dir" if fs.getFileStatus(target).isDirectory() else "file"
        rows.append((name, path, True, kind, found.getFileCount(), found.getLength()))
    return spark.createDataFrame(rows, "name string, path string, exists boolean, kind string, n_files long, n_bytes long")
