"""Planar geometry and the Irish transverse Mercator projection as Column expressions.

A geometry is ``array<array<struct<x double, y double>>>``: rings of a polygon, or parts of a
line; a point is a struct. No geometry library and no Python at run time.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitelens.functions.constants import ITM


def _krueger() -> tuple[float, float, list[float], float]:
    """Eccentricity, rectifying radius, series coefficients and the origin's northing."""
    f = ITM["f"]
    n = f / (2 - f)
    radius = ITM["a"] / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    ]
    e = math.sqrt(f * (2 - f))
    s = math.sin(math.radians(ITM["lat0"]))
    t = math.sinh(math.atanh(s) - e * math.atanh(e * s))
    xi = math.atan(t)
    origin = xi + sum(a * math.sin(2 * (k + 1) * xi) for k, a in enumerate(alpha))
    return e, radius, alpha, origin


def to_itm(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Easting and northing of WGS84 degrees (Krüger series to the fourth order)."""
    e, radius, alpha, origin = _krueger()
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - F.lit(e) * F.atanh(F.lit(e) * s))
    dl = F.radians(lon - F.lit(ITM["lon0"]))
    xi, eta = F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(F.lit(1.0) + t * t))
    east, north = eta, xi
    for k, a in enumerate(alpha):
        m = 2.0 * (k + 1)
        east = east + F.lit(a) * F.cos(F.lit(m) * xi) * F.sinh(F.lit(m) * eta)
        north = north + F.lit(a) * F.sin(F.lit(m) * xi) * F.cosh(F.lit(m) * eta)
    scale = F.lit(ITM["k0"] * radius)
    return F.lit(ITM["fe"]) + scale * east, F.lit(ITM["fn"]) + scale * (north - F.lit(origin))


def valid_wgs84(lat: Column, lon: Column) -> Column:
    return lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon) & lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0)


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def length(dx: Column, dy: Column) -> Column:
    """Length of a vector; equal sums of squares give equal lengths, which ``hypot`` does not promise."""
    return F.sqrt(dx * dx + dy * dy)


def rounded(length: Column, digits: int) -> Column:
    """``F.round`` of a length to 0 or more ``digits``, whose decimal arithmetic is needed near the middle between two results, and for large values, only."""
    scaled = length * 10.0**digits + 0.5
    exact = (F.abs(scaled - F.rint(scaled)) < 1e-4) | (scaled > 1e9) | (length < 0)
    return F.when(exact, F.round(length, digits)).otherwise(F.floor(scaled) / 10.0**digits)


def square(x: Column, y: Column, half: Column) -> Column:
    """Rings of the axis-parallel square round a centre."""
    corners = [(-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1)]
    return F.array(F.array(*[point(x + half * a, y + half * b) for a, b in corners]))


def edges(rings: Column) -> Column:
    """``array<struct<a, b>>`` of all segments of all rings or parts."""
    return F.flatten(
        F.transform(
            F.filter(rings, lambda r: F.size(r) >= 2),
            lambda r: F.transform(F.sequence(F.lit(1), F.size(r) - 1), lambda i: F.struct(F.element_at(r, i).alias("a"), F.element_at(r, i + 1).alias("b"))),
        )
    )


def on_boundary(rings: Column, x: Column, y: Column) -> Column:
    def on(s: Column) -> Column:
        ax, ay, bx, by = s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"]
        return ((bx - ax) * (y - ay) == (by - ay) * (x - ax)) & x.between(F.least(ax, bx), F.greatest(ax, bx)) & y.between(F.least(ay, by), F.greatest(ay, by))

    return F.exists(edges(rings), on)


def covers(rings: Column, x: Column, y: Column) -> Column:
    """Whether a polygon holds the point; its boundary counts, holes do not (even-odd rule)."""

    def crosses(s: Column) -> Column:
        ax, ay, bx, by = s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"]
        spans = (ay > y) != (by > y)
        return spans & (x < (bx - ax) * (y - ay) / F.when(by == ay, F.lit(None)).otherwise(by - ay) + ax)

    odd = F.size(F.filter(edges(rings), crosses)) % 2 == 1
    return F.coalesce(rings.isNotNull() & (F.size(rings) > 0) & (odd | on_boundary(rings, x, y)), F.lit(False))


def outer_rings(rings: Column) -> Column:
    """How many rings begin inside an even number of the others; the rest are holes."""

    def depth(r: Column, i: Column) -> Column:
        start = F.element_at(r, 1)
        around = F.filter(rings, lambda o, j: (j != i) & (F.size(r) > 0) & covers(F.array(o), start["x"], start["y"]))
        return F.size(around)

    return F.size(F.filter(F.transform(rings, depth), lambda n: n % 2 == 0))


def area(rings: Column) -> Column:
    """Area inside an odd number of the rings, which may touch but do not cross."""

    def twice(r: Column) -> Column:
        crossed = F.transform(F.sequence(F.lit(1), F.size(r) - 1), lambda i: F.element_at(r, i)["x"] * F.element_at(r, i + 1)["y"] - F.element_at(r, i + 1)["x"] * F.element_at(r, i)["y"])
        return F.abs(F.aggregate(crossed, F.lit(0.0), lambda s, v: s + v))

    def depth(r: Column, i: Column) -> Column:
        # The middle of an edge, as rings may touch in their corners.
        a, b = F.element_at(r, 1), F.element_at(r, 2)
        around = F.filter(rings, lambda o, j: (j != i) & covers(F.array(o), (a["x"] + b["x"]) / 2, (a["y"] + b["y"]) / 2))
        return F.size(around)

    signed = F.transform(rings, lambda r, i: F.when(depth(r, i) % 2 == 0, twice(r)).otherwise(-twice(r)))
    return F.aggregate(signed, F.lit(0.0), lambda s, v: s + v) / 2


def segment_distance(rings: Column, x: Column, y: Column) -> Column:
    """Least distance from the point to any segment; null for an empty geometry."""

    def away(s: Column) -> Column:
        ax, ay = s["a"]["x"], s["a"]["y"]
        dx, dy = s["b"]["x"] - ax, s["b"]["y"] - ay
        squared = dx * dx + dy * dy
        t = F.when(squared == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((x - ax) * dx + (y - ay) * dy) / squared)))
        return length(x - (ax + t * dx), y - (ay + t * dy))

    return F.array_min(F.transform(edges(rings), away))


def polygon_distance(rings: Column, x: Column, y: Column) -> Column:
    """Planar distance to a polygon, 0 inside."""
    return F.when(covers(rings, x, y), F.lit(0.0)).otherwise(segment_distance(rings, x, y))


def bounds(rings: Column) -> tuple[Column, Column, Column, Column]:
    """xmin, ymin, xmax, ymax of a geometry."""
    flat = F.flatten(rings)
    xs, ys = F.transform(flat, lambda p: p["x"]), F.transform(flat, lambda p: p["y"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def is_box(rings: Column, xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Whether a polygon is the axis-parallel rectangle of its bounds, which then covers just what they hold."""
    ring = F.element_at(rings, 1)
    corner = lambda p: ((p["x"] == xmin) | (p["x"] == xmax)) & ((p["y"] == ymin) | (p["y"] == ymax))
    sides = [(F.element_at(ring, i)["x"] == F.element_at(ring, i + 1)["x"]) != (F.element_at(ring, i)["y"] == F.element_at(ring, i + 1)["y"]) for i in range(1, 5)]
    four = F.when((F.size(rings) == 1) & (F.size(ring) == 5), (F.size(F.array_distinct(ring)) == 4) & (F.element_at(ring, 1) == F.element_at(ring, 5)) & F.forall(ring, corner) & sides[0] & sides[1] & sides[2] & sides[3])
    return F.coalesce(F.when(F.size(rings) > 0, four), F.lit(False))


def is_valid_ring_set(rings: Column) -> Column:
    """Each ring has four points at least, is closed, has finite coordinates and no edge that crosses another."""

    def closed(r: Column) -> Column:
        return (F.size(r) >= 4) & (F.element_at(r, 1) == F.element_at(r, -1)) & F.forall(r, lambda p: ~F.isnan(p["x"]) & ~F.isnan(p["y"]))

    def side(p: Column, q: Column, r: Column) -> Column:
        return F.signum((q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"]))

    def crossing(s: Column, t: Column) -> Column:
        return (side(s["a"], s["b"], t["a"]) * side(s["a"], s["b"], t["b"]) < 0) & (side(t["a"], t["b"], s["a"]) * side(t["a"], t["b"], s["b"]) < 0)

    own = edges(rings)
    return F.coalesce((F.size(rings) > 0) & F.forall(rings, closed) & ~F.exists(own, lambda s: F.exists(own, lambda t: crossing(s, t))), F.lit(False))


def cell(value: Column, size: float) -> Column:
    """Index of the grid cell of a coordinate."""
    return F.floor(value / F.lit(float(size))).cast("long")
