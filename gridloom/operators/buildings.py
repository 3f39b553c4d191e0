"""Building tables: standard columns, duplicate collapse, source merge, energy-model hand-over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.columns import first_numeric, first_present, identifier, number, whole_number

# Source columns of each standard column in order of preference, the note and the default
# coordinate system of the hand-over table.
NUMBERS = {
    "year_built": ["ANNEE_CONS"],
    "num_dwellings": ["NOMBRE_LOG"],
    "stories": ["ETAGE_HORS", "FloorNu_RawTax"],
    "footprint_area": ["Area", "AREA_NEW", "Shape_Area"],
    "total_floor_area": ["TotalFloorArea", "area"],
    "volume": ["Volume", "BuildingVolume"],
}
TEXTS = {"building_type": ["LIBELLE_UT", "g_usag_pre"], "building_category": ["BuildingCategory", "CATEGORIE_"]}
HEIGHTS = ["Hieght_LiD", "citygml_me"]
WHOLE = {"year_built", "num_dwellings", "stories"}
STANDARD = ["building_id", "building_type", "building_category", "year_built", "num_dwellings", "stories", "footprint_area", "total_floor_area", "volume", "height_m"]
NOTES = (
    "Geometry and metadata are HUB-ready; observed electricity remains mostly area-level unless "
    "building electricity is attached."
)
DEFAULT_CRS = "EPSG:2950"


def _exact(df: DataFrame, names: list[str]) -> list[str]:
    return [c for c in names if c in df.columns]


def standardize_buildings(df: DataFrame, id_col: str = "ID_UEV") -> DataFrame:
    """df with the STANDARD columns, each from the first source column that has a usable value in the row."""
    if id_col not in df.columns:
        raise KeyError(f"no building id column {id_col} in {df.columns}")
    out = {id_col: identifier(F.col(id_col)), "building_id": identifier(F.col(id_col))}
    for name, sources in NUMBERS.items():
        x = first_numeric(df, _exact(df, sources))
        out[name] = whole_number(x) if name in WHOLE else x
    for name, sources in TEXTS.items():
        out[name] = first_present(df, sources).cast("string")
    ends = [number(c) if c in df.columns else F.lit(None).cast("double") for c in ("Z_Max", "Z_Min")]
    out["height_m"] = F.coalesce(ends[0] - ends[1], first_numeric(df, HEIGHTS))
    return df.withColumns(out)


def collapse_buildings(df: DataFrame, id_col: str = "building_id", order: str | None = None) -> DataFrame:
    """One row per id: in each column the first value that isn't null, in the order of a column (else of all columns' values)."""
    rest = [c for c in df.columns if c not in (id_col, order)]
    place = F.col(order) if order else F.struct(*rest)
    firsts = [F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), place)).alias(c) for c in rest]
    return df.groupBy(id_col).agg(*firsts).select(*[c for c in df.columns if c != order])


def combine_buildings(
    inventory: DataFrame, primary: DataFrame, secondary: DataFrame | None = None, id_col: str = "building_id", geometry: str = "geometry"
) -> DataFrame:
    """All buildings of the sources, each cell from the first that has it: inventory, primary, secondary; geometry from primary first."""
    sources = [s for s in (inventory, primary, secondary) if s is not None]
    names = list(dict.fromkeys(c for s in sources for c in s.columns if c != id_col))
    out = sources[0].select(id_col, *[F.col(c).alias(f"_0_{c}") for c in sources[0].columns if c != id_col])
    for k, s in enumerate(sources[1:], 1):
        out = out.join(s.select(id_col, *[F.col(c).alias(f"_{k}_{c}") for c in s.columns if c != id_col]), id_col, "full")
    cells = []
    for c in names:
        order = [1, 0, 2] if c == geometry else [0, 1, 2]
        own = [F.col(f"_{k}_{c}") for k in order if k < len(sources) and c in sources[k].columns]
        cells.append(F.coalesce(*own).alias(c))
    return out.select(id_col, *cells)


def prefixed_map(df: DataFrame, prefix: str) -> Column:
    """Map of the columns that begin with prefix (without it), nulls left out."""
    own = [c for c in df.columns if c.startswith(prefix)]
    if not own:
        return F.create_map().cast("map<string,string>")
    pairs = [x for c in own for x in (F.lit(c[len(prefix) :]), F.col(c).cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def attribute_maps(df: DataFrame, known: list[str]) -> DataFrame:
    """df's known columns with aliases and provenance (columns alias_*, provenance_*) and metadata (all others, nulls included)."""
    rest = [c for c in df.columns if c not in known and not c.startswith(("alias_", "provenance_"))]
    pairs = [x for c in rest for x in (F.lit(c), F.col(c).cast("string"))]
    metadata = F.create_map(*pairs) if rest else F.create_map().cast("map<string,string>")
    return df.select(*known, prefixed_map(df, "alias_").alias("aliases"), prefixed_map(df, "provenance_").alias("provenance"), metadata.alias("metadata"))


def _sorted_json(column: str) -> Column:
    ordered = F.map_from_entries(F.array_sort(F.map_entries(column)))
    return F.when(F.size(column) > 0, F.to_json(ordered, {"ignoreNullFields": "false"}))


def hub_building_table(
    buildings: DataFrame, city: str, crs: str | None = None, alias_keys: list[str] | None = None, with_load: DataFrame | None = None
) -> DataFrame:
    """The hand-over table: renamed attributes, storey height, fallback unit, maps as JSON with sorted keys.

    with_load: building_id of buildings that have their own electricity.
    """
    meta = F.col("metadata")
    joined = buildings
    level = F.lit("area_or_metadata_only")
    if with_load is not None:
        joined = buildings.join(with_load.select("building_id").distinct().withColumn("_own", F.lit(True)), "building_id", "left")
        level = F.when(F.col("_own"), "building").otherwise(level)
    unit = F.when(F.col("da_code").isNotNull(), "da").when(F.col("fsa_code").isNotNull(), "fsa")
    out = joined.select(
        F.col("building_id").alias("id"),
        "building_id",
        F.col("year_built").alias("year_of_construction"),
        F.coalesce(meta["CODE_UTILI"], meta["function_code"], F.col("building_type")).alias("function"),
        "building_type",
        "building_category",
        F.col("stories").alias("storeys_above_ground"),
        (F.col("height_m") / F.nullif("stories", F.lit(0))).alias("storey_height_m"),
        "height_m",
        "footprint_area",
        "total_floor_area",
        "volume",
        "num_dwellings",
        F.coalesce(meta["energy_system_archetype"], meta["systems_archetype_name"]).alias("energy_system_archetype"),
        "fsa_code",
        "da_code",
        unit.alias("fallback_unit_type"),
        F.coalesce("da_code", "fsa_code").alias("fallback_unit_code"),
        level.alias("energy_data_level"),
        F.lit(city).alias("city_name"),
        F.lit(crs).cast("string").alias("city_crs"),
        *[_sorted_json(c).alias(f"{c}_json") for c in ("aliases", "provenance", "metadata")],
        F.lit(NOTES).alias("hub_ready_notes"),
        F.lit(crs or DEFAULT_CRS).alias("hub_city_crs"),
        *[F.col("aliases")[k].alias(f"alias_{k}") for k in alias_keys or []],
    )
    return out


def sample_rows(df: DataFrame, id_col: str, fraction: float | None = None, n: int | None = None, seed: int = 42) -> DataFrame:
    """Exactly n rows, or a fraction of them (one at least), by the order of a seeded hash; all rows if neither is given."""
    if fraction is not None and n is not None:
        raise ValueError("give a fraction or a number, not both")
    if fraction is None and n is None:
        return df
    size = n if n is not None else max(1, round(df.count() * fraction))
    return df.orderBy(F.xxhash64(F.lit(seed), id_col), id_col).limit(size)
