"""Transverse Mercator to longitude and latitude with built-in functions (Krueger's series, exact to about a millimetre)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The GRS80 ellipsoid; central meridian, scale, false easting and northing of known systems.
SEMI_MAJOR, INVERSE_FLATTENING = 6378137.0, 298.257222101
SYSTEMS = {
    "EPSG:2950": (-73.5, 0.9999, 304800.0, 0.0),
    "EPSG:32188": (-73.5, 0.9999, 304800.0, 0.0),
    "EPSG:32618": (-75.0, 0.9996, 500000.0, 0.0),
}
GEOGRAPHIC = "EPSG:4326"


def series() -> tuple[float, list[float], list[float]]:
    """The rectifying radius and the coefficients of both series, from the third flattening n."""
    f = 1 / INVERSE_FLATTENING
    n = f / (2 - f)
    radius = SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    inward = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    upward = [2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15]
    return radius, inward, upward


def _scaled(x: Column, y: Column, system: str) -> tuple[Column, Column]:
    if system not in SYSTEMS:
        raise ValueError(f"no reprojection from {system}")
    _, scale, east, north = SYSTEMS[system]
    radius = series()[0]
    return (y - F.lit(north)) / (scale * radius), (x - F.lit(east)) / (scale * radius)


def _corrected(xi: Column, eta: Column) -> tuple[Column, Column]:
    a, b = xi, eta
    for j, c in enumerate(series()[1], 1):
        a = a - c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        b = b - c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    return a, b


def _conformal(a: Column, b: Column, system: str) -> tuple[Column, Column]:
    """Longitude in degrees, and the conformal latitude."""
    return F.lit(SYSTEMS[system][0]) + F.degrees(F.atan2(F.sinh(b), F.cos(a))), F.asin(F.sin(a) / F.cosh(b))


def _latitude(conformal: Column) -> Column:
    latitude = conformal
    for j, c in enumerate(series()[2], 1):
        latitude = latitude + c * F.sin(2 * j * conformal)
    return F.degrees(latitude)


def to_geographic(x: Column, y: Column, system: str) -> tuple[Column, Column]:
    """(longitude, latitude) in degrees of a point in one of SYSTEMS."""
    longitude, conformal = _conformal(*_corrected(*_scaled(x, y, system)), system)
    return longitude, _latitude(conformal)


def ring_to_geographic(ring: Column, system: str) -> Column:
    """to_geographic for an array of (x, y), one pass for each step: in a single one Spark makes what a step needs twice from the start again."""

    def step(array: Column, f) -> Column:
        def moved(p: Column) -> Column:
            x, y = f(p["x"], p["y"])
            return F.struct(x.alias("x"), y.alias("y"))

        return F.transform(array, moved)

    corrected = step(step(ring, lambda x, y: _scaled(x, y, system)), _corrected)
    return step(step(corrected, lambda a, b: _conformal(a, b, system)), lambda x, y: (x, _latitude(y)))
