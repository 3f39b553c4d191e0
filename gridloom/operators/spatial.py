"""Proximity and containment between units.

A unit's rings are looked up by the cells of a grid that its box covers, so points meet only units
near them; of these the ones whose box holds the point (or meets its own) are tested exactly. Points at one place,
and units of one shape, are looked up once. The nearest units are searched on a grid too: a point looks at
the cells around its own, and only if those can't hold its nearest at cells four times as large. No
point meets all units.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.geometry import RINGS, all_edges, box, centroid, distance, edges_contain, edges_meet, edges_of
from gridloom.storage import stored

#: How much larger cells are in the next round of a search.
GROWTH = 4
#: Units of a cell in the first round, about; more of them make fewer rounds and more distances.
PER_CELL = 16


def with_centroid(units: DataFrame, rings: str = "rings") -> DataFrame:
    """units with cx and cy."""
    c = centroid(F.col(rings))
    return units.withColumn("_c", c).withColumns({"cx": F.col("_c.x"), "cy": F.col("_c.y")}).drop("_c")


def dissolve(areas: DataFrame, by: list[str], rings: str = "rings") -> DataFrame:
    """One row per group: all its rings, and parts, the polygons they come from.

    A point is in the union if `contains_any` finds it in a part (many points: `points_in_parts`); the rings alone count
    by odd and even, which is the union only where areas don't overlap. Shared borders aren't removed.
    """
    have = areas.where(F.col(rings).isNotNull())
    return have.groupBy(*by).agg(F.collect_list(rings).alias("parts")).select(*by, F.flatten("parts").alias(rings), "parts")


def outline(areas: DataFrame, by: list[str], rings: str = "rings") -> DataFrame:
    """(by, rings): per group the border around its areas, the edges that two of them share taken out.

    Areas must meet corner to corner and not overlap, as those of one map do; edges are matched by their exact
    coordinates, whichever way they run. A group's remaining edges are one task's work.
    """
    ring = F.explode(rings)
    edges = areas.where(F.col(rings).isNotNull()).select(*by, ring.alias("r")).select(*by, F.explode(edges_of(F.col("r"))).alias("e"))
    ends = edges.select(*by, F.least("e.a", "e.b").alias("a"), F.greatest("e.a", "e.b").alias("b")).where("a <> b")
    single = ends.groupBy(*by, "a", "b").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1")
    flat = single.select(*by, F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by_"))

    def chained(pdf: pd.DataFrame) -> pd.DataFrame:
        meets: dict[tuple, list[int]] = {}
        pairs = [((r[0], r[1]), (r[2], r[3])) for r in pdf[["ax", "ay", "bx", "by_"]].to_numpy().tolist()]
        for k, pair in enumerate(pairs):
            for p in pair:
                meets.setdefault(p, []).append(k)
        used, out = [False] * len(pairs), []
        for k in range(len(pairs)):
            if used[k]:
                continue
            used[k] = True
            first, at = pairs[k]
            ring = [first]
            while at != first:  # every corner has an even number of edges, so a walk comes back
                ring.append(at)
                step = next(j for j in meets[at] if not used[j])
                used[step] = True
                at = pairs[step][1] if pairs[step][0] == at else pairs[step][0]
            out.append([{"x": x, "y": y} for x, y in ring])
        return pdf[by].iloc[:1].assign(**{rings: [out]})

    kinds = ", ".join(f"{c} {areas.schema[c].dataType.simpleString()}" for c in by)
    return flat.groupBy(*by).applyInPandas(chained, f"{kinds}, {rings} {RINGS}")


def _nearest(points: DataFrame, units: DataFrame, k: int, key: str) -> DataFrame:
    """(key, unit, d): the k units (unit, ux, uy) nearest to each point (key, cx, cy), all if there are fewer; ties by unit.

    Cells hold about k units (PER_CELL at least) at first. All units within a cell's side of a point are in the nine cells
    around it, so a point whose k-th of these is as near as that is done; the others go on with larger cells.
    """
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("ux", "uy") for f in (F.min, F.max)]
    far = [f(c).alias(f"{f.__name__}_{c}") for c in ("cx", "cy") for f in (F.min, F.max)]
    u, p = units.agg(F.count(F.lit(1)).alias("n"), *ends).first(), points.agg(F.count(F.lit(1)).alias("n"), *far).first()
    if not u["n"] or not p["n"]:
        return points.select(key).limit(0).join(units.select("unit", F.lit(0.0).alias("d")))
    wide = max(u["max_ux"] - u["min_ux"], u["max_uy"] - u["min_uy"])
    all_wide = max(max(u["max_u" + c], p["max_c" + c]) - min(u["min_u" + c], p["min_c" + c]) for c in "xy")
    side = max(wide / max(1.0, (u["n"] / max(k, PER_CELL)) ** 0.5), all_wide * 1e-6) or 1.0
    done, rest = [], points.select(key, "cx", "cy")
    while True:
        last = side > all_wide
        found = stored(_around(rest, units, side, k, key), "nearest")
        settled = found.groupBy(key).agg(F.max("place").alias("n"), F.max("d").alias("worst")).where((F.col("n") >= min(k, u["n"])) & (F.col("worst") <= side))
        done.append(found.select(key, "unit", "d") if last else found.join(settled.select(key), key, "left_semi").select(key, "unit", "d"))
        if last:
            break
        rest = stored(rest.join(settled.select(key), key, "left_anti"), "rest")
        if not rest.limit(1).count():
            break
        side *= GROWTH
    return reduce(DataFrame.unionByName, done)


def _around(points: DataFrame, units: DataFrame, side: float, k: int, key: str) -> DataFrame:
    """(key, unit, d, place): the k nearest units in the nine cells of that side around each point."""

    def cell(c: Column) -> Column:
        return F.floor(c / F.lit(side))

    steps = F.array(*map(F.lit, (-1, 0, 1)))
    asks = points.withColumn("gx", F.explode(F.transform(steps, lambda s: cell(F.col("cx")) + s)))
    asks = asks.withColumn("gy", F.explode(F.transform(steps, lambda s: cell(F.col("cy")) + s)))
    has = units.select("unit", "ux", "uy", cell(F.col("ux")).alias("gx"), cell(F.col("uy")).alias("gy"))
    d = distance(F.col("cx"), F.col("cy"), F.col("ux"), F.col("uy"))
    pairs = asks.join(has, ["gx", "gy"]).select(key, "unit", d.alias("d"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("d", "unit"))
    return pairs.withColumn("place", place).where(F.col("place") <= k)


def nearest_units(small: DataFrame, units: DataFrame, k: int | None = 3, key: str = "code") -> DataFrame:
    """(key, nearest): codes of the k units of least centroid distance, ties by code; k=None for all, which pairs every two.

    A small unit without a place has an empty list; units without a place don't count.
    """
    have = F.col("cx").isNotNull() & F.col("cy").isNotNull()
    other = units.where(have).select(F.col(key).alias("unit"), F.col("cx").alias("ux"), F.col("cy").alias("uy"))
    placed = small.where(have).select(key, "cx", "cy")
    pairs = _nearest(placed, other, k or max(1, other.count()), key)
    lists = pairs.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "unit"))), lambda s: s["unit"]).alias("nearest"))
    return small.select(key).join(lists, key, "left").withColumn("nearest", F.coalesce("nearest", F.array().cast("array<string>")))


def candidates(points: DataFrame, units: DataFrame, cell: float, id_col: str = "building_id", key: str = "code") -> DataFrame:
    """(id, key) of units that contain the point (cx, cy) or, if points have rings, intersect them, by an equi-join on grid cells and an exact test."""
    covered = _covered(units.select(key, "rings"), cell)
    here = points.where(F.col("cx").isNotNull() & F.col("cy").isNotNull()).select(id_col, "cx", "cy", F.floor(F.col("cx") / cell).alias("gx"), F.floor(F.col("cy") / cell).alias("gy"))
    in_box = F.col("cx").between(F.col("_b.min_x"), F.col("_b.max_x")) & F.col("cy").between(F.col("_b.min_y"), F.col("_b.max_y"))
    inside = here.join(covered, ["gx", "gy"]).where(in_box).where(edges_contain(F.col("edges"), F.col("cx"), F.col("cy"))).select(id_col, key)
    if "rings" not in points.columns:
        return inside
    placed = points.where(F.col("cx").isNotNull() & F.col("cy").isNotNull()).select(id_col, "rings")
    shapes = _covered(placed, cell).withColumnsRenamed({c: f"_{c}" for c in ("edges", "low_x", "low_y", "_b")})
    # Of the cells that both boxes cover, the first stands for the pair.
    once = (F.col("gx") == F.greatest("low_x", "_low_x")) & (F.col("gy") == F.greatest("low_y", "_low_y"))
    meet = reduce(and_, [(F.col(f"_b.min_{c}") <= F.col(f"__b.max_{c}")) & (F.col(f"__b.min_{c}") <= F.col(f"_b.max_{c}")) for c in "xy"])
    touched = shapes.join(covered, ["gx", "gy"]).where(once & meet).where(edges_meet(F.col("_edges"), F.col("edges"))).select(id_col, key)
    return inside.unionByName(touched).distinct()


def points_in_parts(points: DataFrame, whole: DataFrame, by: list[str], cell: float = 1000.0, id_col: str = "building_id") -> DataFrame:
    """(by, id), once each: which points are in which of dissolve's groups, as contains_any tells, found by the grid cells of its parts.

    Points of one place are looked up once.
    """
    here = points.where(F.col("cx").isNotNull() & F.col("cy").isNotNull()).select("cx", "cy", id_col)
    places = stored(here.groupBy("cx", "cy").agg(F.min(id_col).alias("_at")), "places")
    parts = whole.select(F.struct(*by).alias("_by"), F.explode("parts").alias("rings"))
    found = stored(candidates(places, parts, cell, "_at", "_by").distinct(), "in_parts")
    groups = places.join(found, "_at").groupBy("cx", "cy").agg(F.collect_list("_by").alias("_all"))
    return here.join(groups, ["cx", "cy"]).select(id_col, F.explode("_all").alias("_by")).select("_by.*", id_col).distinct()


def _covered(shapes: DataFrame, cell: float) -> DataFrame:
    """shapes, their rings as edges, once for each grid cell (gx, gy) that the box (_b) of their rings covers, with its lowest cell."""
    cells = shapes.where(F.col("rings").isNotNull()).withColumn("_b", box(F.col("rings"))).withColumn("edges", all_edges(F.col("rings"))).drop("rings")
    ends = {f"{k}_{c}": F.floor(F.col(f"_b.{m}_{c}") / cell) for k, m in (("low", "min"), ("high", "max")) for c in "xy"}
    span = cells.withColumns(ends).withColumn("gx", F.explode(F.sequence("low_x", "high_x")))
    return span.withColumn("gy", F.explode(F.sequence("low_y", "high_y"))).drop("high_x", "high_y")


def assign_units(
    points: DataFrame, units: DataFrame, out: str, cell: float = 1000.0, overwrite: bool = False, id_col: str = "building_id", key: str = "code"
) -> DataFrame:
    """points with out: of the units that hold the point, or intersect its rings if points have them, the one of nearest centroid; the nearest of all if none does.

    Ties go to the lower code, so of units with the same rings and centroid only the lowest code is looked at; points
    with the same place and rings get the same, found once. Codes already there stay unless overwrite; points without a place get none.
    """
    have = F.col("cx").isNotNull() & F.col("cy").isNotNull()
    old = F.col(out) if out in points.columns else F.lit(None).cast("string")
    todo = points.where(have) if overwrite or out not in points.columns else points.where(have & old.isNull())
    place = ["cx", "cy", *(["rings"] if "rings" in points.columns else [])]
    todo = stored(todo.groupBy(*place).agg(F.min(id_col).alias(id_col)), "places")
    units = stored(units.where(have).groupBy("cx", "cy", "rings").agg(F.min(key).alias(key)), "shapes")
    centre = units.select(F.col(key).alias("unit"), F.col("cx").alias("ux"), F.col("cy").alias("uy"))
    far = distance(F.col("cx"), F.col("cy"), F.col("ux"), F.col("uy"))
    inside = candidates(todo, units, cell, id_col, key).withColumnRenamed(key, "unit")
    held = todo.select(id_col, "cx", "cy").join(inside, id_col).join(centre, "unit").groupBy(id_col).agg(F.min_by("unit", F.struct(far, F.col("unit"))).alias("_in"))
    held = stored(held, "held")
    missing = todo.select(id_col, "cx", "cy").join(held, id_col, "left_anti")
    near = _nearest(missing, centre, 1, id_col).select(id_col, F.col("unit").alias("_in"))
    found = todo.join(held.unionByName(near), id_col).select(*[F.col(c).alias(f"_{c}") for c in place], "_in")
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in place])
    new = F.coalesce(F.col("_in"), old) if overwrite else F.coalesce(old, F.col("_in"))
    return points.join(found, same, "left").withColumn(out, new).drop("_in", *[f"_{c}" for c in place])
