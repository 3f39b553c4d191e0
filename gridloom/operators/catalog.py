"""Cities as catalogs of tables, and the pipelines over them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.anomalies import treat_anomalies
from gridloom.operators.census import POPULATION, impute_by_census
from gridloom.operators.prism import prism_table
from gridloom.operators.quality import preprocess_load
from gridloom.operators.short_term import short_term_table
from gridloom.operators.spatial import assign_units, nearest_units, with_centroid
from gridloom.operators.timeseries import local_of
from gridloom.operators.weather_model import expand_by_population, normalize_by_weather, per_capita
from gridloom.storage import stored


@dataclass(frozen=True)
class Catalog:
    """Lazy tables keyed by city and code; areas (city, unit, code, rings, cx, cy), load (unit, code, ts, kwh), weather (city, ts, temperature), census (code, feature, value)."""

    areas: DataFrame
    load: DataFrame
    weather: DataFrame
    census: DataFrame
    nearest: DataFrame | None = None
    buildings: DataFrame | None = None

    def codes(self, unit: str = "fsa") -> DataFrame:
        return units_of(self.areas, unit).select("code").distinct().orderBy("code")

    def area(self, code: str, unit: str = "fsa") -> DataFrame:
        found = units_of(self.areas, unit).where(F.col("code") == code)
        if not found.limit(1).count():
            raise KeyError(code)
        return found


def units_of(df: DataFrame, unit: str) -> DataFrame:
    if unit not in ("fsa", "da"):
        raise ValueError("unit must be 'fsa' or 'da'")
    return df.where(F.col("unit") == unit)


def selected(df: DataFrame, codes, key: str = "code") -> DataFrame:
    """Rows of a code or of several; KeyError for one that df hasn't."""
    wanted = list(dict.fromkeys([codes] if isinstance(codes, str) else codes))
    have = {r[0] for r in df.where(F.col(key).isin(wanted)).select(key).distinct().collect()}
    if missing := [c for c in wanted if c not in have]:
        raise KeyError(missing)
    return df.where(F.col(key).isin(wanted))


def build_catalog(
    areas: DataFrame, load: DataFrame, weather: DataFrame, census: DataFrame, buildings: DataFrame | None = None, cell: float = 1000.0, k: int = 3
) -> Catalog:
    """Areas that have load (small areas only if there is any small-area load), nearest units and building codes.

    A code that two cities have stays with the first.
    """
    first = Window.partitionBy("unit", "code").orderBy("city")
    once = areas.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    placed = once if {"cx", "cy"} <= set(once.columns) else with_centroid(once)
    have = load.select("unit", "code").distinct()
    large = units_of(placed, "fsa").join(have, ["unit", "code"], "left_semi")
    small = units_of(placed, "da")
    if units_of(have, "da").limit(1).count():
        small = small.join(have, ["unit", "code"], "left_semi")
    if buildings is not None:
        buildings = assign_units(assign_units(buildings, large, "fsa_code", cell), small, "da_code", cell)
    return Catalog(large.unionByName(small), load, weather, census, nearest_units(small, large, k), buildings)


def city_of(areas: DataFrame, key: str = "code") -> DataFrame:
    """(key, city): the first city in order of each area."""
    return areas.groupBy(key).agg(F.min("city").alias("city"))


def people_of(census: DataFrame, feature: str = POPULATION, key: str = "code") -> DataFrame:
    """(key, population) from the census feature of that name; of several values of an area the least. ValueError if no row has it."""
    own = census.where(F.col("feature") == feature)
    if not own.limit(1).count():
        raise ValueError(f"the census has no feature {feature!r}")
    return own.groupBy(key).agg(F.min("value").alias("population"))


def city_tables(catalog: Catalog, unit: str = "fsa", winter_only: bool = True, population: str = POPULATION) -> tuple[DataFrame, DataFrame]:
    """(prism, short_term) of the areas of a unit, per head, each area on the weather of its own city."""
    load = units_of(catalog.load, unit).select("code", "ts", "kwh").join(city_of(units_of(catalog.areas, unit)), "code")
    people, weather = people_of(catalog.census, population), catalog.weather.select("city", "ts", "temperature")
    return prism_table(load, weather, people, city="city"), short_term_table(load, weather, people, winter_only, city="city")


def complete(
    treated: DataFrame, weather: DataFrame, census: DataFrame, areas: DataFrame, people: DataFrame, population_scaling: bool = True, imputation: dict | None = None, zone: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(load, imputation report): treated load normalised for weather, taken per head (stored), completed by imputation, expanded again.

    If weather and areas have a city, an area meets its own city's weather, and load of areas that no city has is left out.
    With a zone treated is in UTC and weather local there; what comes back is local.
    """
    city = "city" if "city" in weather.columns and "city" in areas.columns else None
    if city:
        treated = treated.join(city_of(areas), "code")
    normal = normalize_by_weather(treated, weather, city=city, zone=zone).select("code", "ts", "kwh")
    if zone:
        normal = normal.withColumn("ts", local_of(F.col("ts"), zone))
    heads = stored(per_capita(normal, people, strict=False), "heads")
    filled, imputed = impute_by_census(heads, census, areas, population_scaling=population_scaling, **imputation or {})
    return expand_by_population(filled, people), imputed


def rebuild(
    load: DataFrame,
    weather: DataFrame,
    census: DataFrame,
    areas: DataFrame,
    population_scaling: bool = True,
    preprocess: dict | None = None,
    treatment: dict | None = None,
    imputation: dict | None = None,
    zone: str | None = None,
    population: str = POPULATION,
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(load, qc, treatment report, imputation report): clean, treat anomalies, normalise for weather, impute per head, expand.

    Weather and areas by city are used by city (as in complete). population is the census feature that heads are counted by.
    With a zone the series are those of load's column utc until they are imputed, so a clock change neither
    doubles nor skips an hour; without one ts must not repeat.
    Each step that later ones read more than once is stored in the shared folder, so nothing runs twice.
    As per-head series are imputed with population scaling and then multiplied by population, an
    imputed area's population counts twice; population_scaling=False leaves the first out.
    """
    load = load.select("code", F.col("utc").alias("ts"), "kwh") if zone else load
    clean, qc = preprocess_load(load, **preprocess or {})
    treated, report = treat_anomalies(clean, **treatment or {})
    people = people_of(census, population)
    out, imputed = complete(treated, weather, census, areas, people, population_scaling, {"population": population} | (imputation or {}), zone)
    return out, qc, report, imputed
