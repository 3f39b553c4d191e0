"""A project's inputs as one catalog."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.config import Paths
from gridloom.operators.catalog import Catalog, build_catalog
from gridloom.sources import readers


def load_project(spark: SparkSession, paths: Paths, buildings: DataFrame | None = None) -> Catalog:
    """Load, weather, census and geometry of areas, and of small areas where given, assembled lazily."""
    loads = [readers.read_load(spark, paths.load).withColumn("unit", F.lit("fsa"))]
    areas = [readers.read_geometry(spark, paths.geometry).withColumn("unit", F.lit("fsa"))]
    facts = [readers.census_long(readers.read_census(spark, paths.census))] if paths.census else []
    if paths.da_load:
        loads.append(readers.read_load(spark, paths.da_load).withColumn("unit", F.lit("da")))
    if paths.da_geometry:
        small = readers.read_geometry(spark, paths.da_geometry, readers.DA_ALIASES, strict=False)
        areas.append(small.withColumn("unit", F.lit("da")))
    if paths.da_census:
        facts.append(readers.census_long(readers.read_census(spark, paths.da_census, readers.DA_ALIASES)))
    census = reduce(DataFrame.unionByName, facts) if facts else spark.createDataFrame([], "code string, feature string, value double")
    weather = readers.read_weather(spark, paths.weather)
    return build_catalog(reduce(DataFrame.unionByName, areas), reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), loads), weather, census, buildings)
