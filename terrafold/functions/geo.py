"""Places: coordinates, boxes, distances, datum. All are Catalyst expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import scope
from .values import finite, number

# The ellipsoid and series coefficients of the shifted datum.
AXIS = 6378245.0
ECCENTRICITY = 0.00669342162296594323
LAT_SERIES = (-100, 2, 3, 0.0, 0.2, 0.1, 0.2)
LNG_SERIES = (300, 1, 2, 0.1, 0.0, 0.1, 0.1)


def located(lat: Column, lng: Column) -> Column:
    return finite(lat).isNotNull() & finite(lng).isNotNull()


def inside(lat: Column, lng: Column, box: tuple[float, float, float, float]) -> Column:
    """Within (west, south, east, north), borders included."""
    w, s, e, n = box
    return located(lat, lng) & lng.between(w, e) & lat.between(s, n)


def rectangle(a: tuple[float, float], b: tuple[float, float]) -> tuple[float, float, float, float]:
    """The box between two corners (lng, lat), dragged in any direction."""
    return min(a[0], b[0]), min(a[1], b[1]), max(a[0], b[0]), max(a[1], b[1])


def bounds(lat: Column, lng: Column) -> list[Column]:
    """Aggregates: the box of the located rows, null if there is none."""
    ok = located(lat, lng)
    x, y = F.when(ok, lng), F.when(ok, lat)
    return [F.min(x).alias("west"), F.min(y).alias("south"), F.max(x).alias("east"), F.max(y).alias("north")]


def distance_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle metres, rounded to even halves."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lng2) - F.radians(lng1)) / 2), 2)
    return F.bround(F.lit(2.0 * scope.EARTH_RADIUS_M) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))).cast("long")


def _wave(x: Column, *terms: tuple[float, float]) -> Column:
    return sum((a * F.sin(x * (math.pi * k)) for a, k in terms[1:]), terms[0][0] * F.sin(x * (math.pi * terms[0][1]))) * 2 / 3


def _series(c: tuple, x: Column, y: Column) -> Column:
    return c[0] + c[1] * x + c[2] * y + c[3] * x * x + c[4] * y * y + c[5] * x * y + c[6] * F.sqrt(F.abs(x))


def shifted_to_wgs84(lng: Column, lat: Column) -> Column:
    """Approximate inverse of the shifted datum: a struct (lng, lat)."""
    x, y = lng - 105, lat - 35
    north = _series(LAT_SERIES, x, y) + _wave(x, (20, 6), (20, 2)) + _wave(y, (20, 1), (40, 1 / 3)) + _wave(y, (160, 1 / 12), (320, 1 / 30))
    east = _series(LNG_SERIES, x, y) + _wave(x, (20, 6), (20, 2)) + _wave(x, (20, 1), (40, 1 / 3)) + _wave(x, (150, 1 / 12), (300, 1 / 30))
    r = lat * (math.pi / 180)
    m = 1 - ECCENTRICITY * F.pow(F.sin(r), 2)
    per_lat = AXIS * (1 - ECCENTRICITY) / (m * F.sqrt(m)) * math.pi
    per_lng = AXIS / F.sqrt(m) * F.cos(r) * math.pi
    return F.struct((lng - east * 180 / per_lng).alias("lng"), (lat - north * 180 / per_lat).alias("lat"))


def portal_point(lng: Column, lat: Column) -> Column:
    """A portal's pin in WGS84; null if either coordinate is blank or no number."""
    x, y = number(lng), number(lat)
    return F.when(x.isNotNull() & y.isNotNull(), shifted_to_wgs84(x, y))


def feature(lat: Column, lng: Column, **properties: Column) -> Column:
    """A located place as a GeoJSON point feature; null where it is not located."""
    point = F.struct(F.lit("Point").alias("type"), F.array(lng, lat).alias("coordinates"))
    whole = F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*[c.alias(k) for k, c in properties.items()]).alias("properties"))
    return F.when(located(lat, lng), F.to_json(whole, {"ignoreNullFields": "false"}))


def least_text_size(style, least: float = 12):
    """A map style's text size with every output at least this: zoom expressions stay on top, their outputs are clamped."""
    if style is None:
        return least
    if isinstance(style, (int, float)):
        return max(least, style)
    outputs = {"interpolate": 4, "interpolate-hcl": 4, "interpolate-lab": 4, "step": 2}.get(style[0]) if isinstance(style, list) and style else None
    if outputs is None:
        return ["max", least, style]
    return [least_text_size(x, least) if k >= outputs and k % 2 == 0 else x for k, x in enumerate(style)]
