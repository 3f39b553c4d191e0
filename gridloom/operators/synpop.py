"""Hand-over to and from a synthetic population: input by small area, manifest, summary, merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.columns import number

PEOPLE = "population_2021"


def synpop_input(small: DataFrame, nearest: DataFrame, population: DataFrame, city: str, crs: str | None = None) -> DataFrame:
    """Per small area: population, the three nearest units, and which inputs it has.

    small (code, has_geometry), nearest (code, nearest), population (code, population) with a row for areas in the census.
    """
    known = population.select("code", number(F.col("population").cast("string")).alias(PEOPLE), F.lit(True).alias("_c"))
    joined = small.join(nearest, "code", "left").join(known, "code", "left")
    return joined.select(
        F.lit(city).alias("city_name"),
        F.col("code").alias("da_code"),
        PEOPLE,
        *[F.get("nearest", F.lit(k)).alias(f"nearest_fsa_{k + 1}") for k in range(3)],
        F.coalesce("_c", F.lit(False)).alias("has_census"),
        "has_geometry",
        F.lit(crs).cast("string").alias("city_crs"),
    )


def synpop_manifest(table: DataFrame, n_fsas: int, n_buildings: int) -> DataFrame:
    """One row: counts, the sum of populations (null if all are) and the sorted codes, of which there is one per small area."""
    return table.agg(
        F.first("city_name").alias("city_name"),
        F.first("city_crs").alias("city_crs"),
        F.lit(n_fsas).cast("long").alias("n_fsas"),
        F.count(F.lit(1)).alias("n_das"),
        F.lit(n_buildings).cast("long").alias("n_buildings"),
        F.count_if("has_census").alias("n_das_with_census"),
        F.count_if("has_geometry").alias("n_das_with_geometry"),
        F.sum(PEOPLE).alias("population_2021_sum"),
        F.array_sort(F.collect_list("da_code")).alias("da_codes"),
    )


def summarize_synpop(people: DataFrame, area: str = "area", household: str = "HID") -> DataFrame:
    """(da_code, n_individuals_syn, n_households_syn): persons and distinct households, without null and -1; no household column, no count."""
    if area not in people.columns:
        raise KeyError(f"no area column {area}")
    out = [F.count(F.lit(1)).alias("n_individuals_syn")]
    if household in people.columns:
        out.append(F.count_distinct(F.when(F.col(household) != -1, F.col(household))).alias("n_households_syn"))
    return people.groupBy(F.trim(F.col(area).cast("string")).alias("da_code")).agg(*out)


def merge_synpop(table: DataFrame, summary: DataFrame, key: str = "da_code") -> DataFrame:
    for df in (table, summary):
        if key not in df.columns:
            raise KeyError(f"no column {key}")
    return table.join(summary, key, "left")
