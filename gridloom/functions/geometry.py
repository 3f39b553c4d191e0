"""Planar geometry on rings (arrays of (x, y) structs) with built-in functions only.

A polygon is an array of rings; a point is inside if it is in an odd number of them, so holes count.
"""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

RINGS = "array<array<struct<x:double,y:double>>>"


def edges_of(ring: Column) -> Column:
    """(a, b) for each pair of neighbouring corners, the last with the first."""
    again = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.arrays_zip(ring.alias("a"), again.alias("b"))


def _sum(array: Column, f) -> Column:
    return F.aggregate(F.transform(array, f), F.lit(0.0), lambda s, x: s + x)


def area(rings: Column) -> Column:
    """Twice the signed area of all rings, by the shoelace formula, halved."""
    cross = lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]
    return _sum(rings, lambda r: _sum(edges_of(r), cross)) / 2


def centroid(rings: Column) -> Column:
    """(x, y) of the centre of area; the mean of the corners where the area is 0."""
    cross = lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]
    total = area(rings)
    points = F.flatten(rings)

    def along(c: str) -> Column:
        moment = _sum(rings, lambda r: _sum(edges_of(r), lambda e: (e["a"][c] + e["b"][c]) * cross(e)))
        mean = _sum(points, lambda p: p[c]) / F.nullif(F.size(points), F.lit(0))
        return F.when(total != 0, moment / (6 * total)).otherwise(mean)

    return F.struct(along("x").alias("x"), along("y").alias("y"))


def box(rings: Column) -> Column:
    points = F.flatten(rings)
    along = {"x": F.transform(points, lambda p: p["x"]), "y": F.transform(points, lambda p: p["y"])}
    ends = [f(v).alias(f"{k}_{c}") for k, f in (("min", F.array_min), ("max", F.array_max)) for c, v in along.items()]
    return F.struct(*ends)


def all_edges(rings: Column) -> Column:
    """Edges of all rings. What tests a shape many times has them as a column, made once."""
    return F.flatten(F.transform(rings, edges_of))


def contains(rings: Column, x: Column, y: Column) -> Column:
    """Whether a ray from the point crosses the rings an odd number of times, or the point is on an edge."""
    return edges_contain(all_edges(rings), x, y)


def edges_contain(edges: Column, x: Column, y: Column) -> Column:
    """contains for the edges of the rings."""

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        spans = (a["y"] > y) != (b["y"] > y)
        rise = F.when(spans, b["y"] - a["y"]).otherwise(1.0)
        return (spans & (x < (b["x"] - a["x"]) * (y - a["y"]) / rise + a["x"])).cast("int")

    def holds(e: Column) -> Column:
        a, b = e["a"], e["b"]
        straight = (b["x"] - a["x"]) * (y - a["y"]) == (b["y"] - a["y"]) * (x - a["x"])
        return straight & x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))

    total = F.aggregate(edges, F.lit(0), lambda s, e: s + crosses(e))
    return (total % 2 == 1) | F.exists(edges, holds)


def contains_any(parts: Column, x: Column, y: Column) -> Column:
    """Whether one of several polygons (arrays of rings) contains the point, so overlaps count once."""
    return F.exists(parts, lambda rings: contains(rings, x, y))


def intersects(a: Column, b: Column) -> Column:
    """Whether two polygons share a point: a corner of one is in the other, or two edges cross."""
    return edges_meet(all_edges(a), all_edges(b))


def edges_meet(a: Column, b: Column) -> Column:
    """intersects for the edges of the polygons, whose starts are their corners."""

    def side(e: Column, p: Column) -> Column:
        return F.signum((e["b"]["x"] - e["a"]["x"]) * (p["y"] - e["a"]["y"]) - (e["b"]["y"] - e["a"]["y"]) * (p["x"] - e["a"]["x"]))

    def cross(e: Column, f: Column) -> Column:
        return (side(e, f["a"]) * side(e, f["b"]) < 0) & (side(f, e["a"]) * side(f, e["b"]) < 0)

    def corner(one: Column, other: Column) -> Column:
        return F.exists(one, lambda e: edges_contain(other, e["a"]["x"], e["a"]["y"]))

    return corner(a, b) | corner(b, a) | F.exists(a, lambda e: F.exists(b, lambda f: cross(e, f)))


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def _rings_of(data) -> list | None:
    """Rings of a WKB point, polygon or multipolygon (two or more dimensions; the first two are kept)."""
    if data is None:
        return None
    try:
        data, at = bytes.fromhex(data.strip()) if isinstance(data, str) else bytes(data), 0
    except ValueError:
        return None

    def read(order: str, form: str):
        nonlocal at
        size = struct.calcsize(order + form)
        at += size
        return struct.unpack_from(order + form, data, at - size)

    def shape() -> list:
        order = "<" if read("<", "B")[0] else ">"
        kind = read(order, "I")[0]
        if kind & 0x20000000:
            read(order, "I")
        dims = 2 + bool(kind & 0x80000000) + bool(kind & 0x40000000)
        kind &= 0x0FFFFFFF
        dims, kind = max(dims, 2 + (kind // 1000 in (1, 2)) + 2 * (kind // 1000 == 3)), kind % 1000

        def corners(n: int) -> list:
            flat = read(order, f"{n * dims}d")
            return [{"x": flat[i], "y": flat[i + 1]} for i in range(0, n * dims, dims)]

        if kind == 1:
            return [corners(1)]
        if kind == 3:
            return [corners(read(order, "I")[0]) for _ in range(read(order, "I")[0])]
        if kind == 6:
            return [ring for _ in range(read(order, "I")[0]) for ring in shape()]
        raise ValueError(f"WKB type {kind}")

    try:
        return shape()
    except (ValueError, struct.error):
        return None


def parse_wkb(column: Column | str) -> Column:
    """Rings of WKB bytes or hexadecimal text, by Arrow batches; null where it can't be read."""

    @F.pandas_udf(RINGS)
    def parse(data: pd.Series) -> pd.Series:
        return data.map(_rings_of)

    return parse(column)


def from_geojson(geometry: str) -> Column:
    """Rings of a GeoJSON geometry column (type, coordinates as JSON text): Point, Polygon, MultiPolygon."""
    kind, text = F.col(f"{geometry}.type"), F.col(f"{geometry}.coordinates")
    pair = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    point = F.array(F.array(pair(F.from_json(text, "array<double>"))))
    polygon = F.transform(F.from_json(text, "array<array<array<double>>>"), lambda r: F.transform(r, pair))
    many = F.transform(F.flatten(F.from_json(text, "array<array<array<array<double>>>>")), lambda r: F.transform(r, pair))
    return F.when(kind == "Point", point).when(kind == "Polygon", polygon).when(kind == "MultiPolygon", many)
