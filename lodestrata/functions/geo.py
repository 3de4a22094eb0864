"""Planar and spherical geometry as Column expressions. Polygons are arrays of structs ``x, y``."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_MILES = 3958.7613
# WGS84.
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257223563


def haversine_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_MILES * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def utm(lat: Column, lon: Column, zone: int) -> tuple[Column, Column]:
    """Easting and northing of the northern hemisphere in a UTM zone (series in the third flattening)."""
    n = FLATTENING / (2 - FLATTENING)
    a = SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - (6 * zone - 183))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, c in enumerate(alpha, 1):
        east = east + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500_000 + 0.9996 * a * east, 0.9996 * a * north


def lambert(lat: Column, lon: Column, lat1: float, lat2: float, lat0: float, lon0: float, radius: float = SEMI_MAJOR, flattening: float = FLATTENING) -> tuple[Column, Column]:
    """Easting and northing of a Lambert conformal conic with two standard parallels, from ``lat0, lon0``; no flattening gives the sphere's."""
    e = math.sqrt(flattening * (2 - flattening))
    phi1, phi2, phi0 = (math.radians(p) for p in (lat1, lat2, lat0))
    m = lambda p: math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)
    t = lambda p: math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)
    n = math.sin(phi1) if lat1 == lat2 else math.log(m(phi1) / m(phi2)) / math.log(t(phi1) / t(phi2))
    reach = radius * m(phi1) / (n * t(phi1) ** n)
    phi = F.radians(lat)
    here = F.tan(math.pi / 4 - phi / 2) / F.pow((1 - e * F.sin(phi)) / (1 + e * F.sin(phi)), F.lit(e / 2))
    rho, theta = reach * F.pow(here, F.lit(n)), n * F.radians(lon - lon0)
    return rho * F.sin(theta), reach * t(phi0) ** n - rho * F.cos(theta)


def affine(x: Column, y: Column, a: tuple[float, float, float], b: tuple[float, float, float]) -> tuple[Column, Column]:
    """``a0 + a1 x + a2 y`` and ``b0 + b1 x + b2 y``."""
    return a[0] + a[1] * x + a[2] * y, b[0] + b[1] * x + b[2] * y


def box_area(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    return F.greatest(F.lit(0.0), xmax - xmin) * F.greatest(F.lit(0.0), ymax - ymin)


def box_overlap(a: str, b: str) -> tuple[Column, Column, Column]:
    """Shared area of the boxes with columns ``{a}xmin`` … and ``{b}xmin`` …, over the smaller one and over the union."""
    c = lambda side, k: F.col(f"{side}{k}")
    shared = box_area(F.greatest(c(a, "xmin"), c(b, "xmin")), F.greatest(c(a, "ymin"), c(b, "ymin")), F.least(c(a, "xmax"), c(b, "xmax")), F.least(c(a, "ymax"), c(b, "ymax")))
    one, two = (box_area(*[c(s, k) for k in ("xmin", "ymin", "xmax", "ymax")]) for s in (a, b))
    smaller, union = F.least(one, two), one + two - shared
    return shared, F.when(smaller > 0, shared / smaller).otherwise(0.0), F.when(union > 0, shared / union).otherwise(0.0)


def edges_of(ring: Column) -> Column:
    """Pairs of neighbours of a ring, the last point to the first included."""
    return F.zip_with(ring, F.concat(F.slice(ring, 2, F.greatest(F.lit(0), F.size(ring) - 1)), F.slice(ring, 1, 1)), lambda p, q: F.struct(p.alias("p"), q.alias("q")))


def odd_crossings(x: Column, y: Column, edges: Column) -> Column:
    """Whether an odd number of edges ``p, q`` runs by on the right of a point."""

    def crosses(e):
        p, q = e["p"], e["q"]
        return ((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / F.nullif(q["y"] - p["y"], F.lit(0.0)) + p["x"])

    return F.size(F.filter(edges, lambda e: F.coalesce(crosses(e), F.lit(False)))) % 2 == 1


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point is inside a ring, by the parity of crossings to its right."""
    return odd_crossings(x, y, edges_of(ring))


def in_rings(x: Column, y: Column, rings: Column) -> Column:
    """Whether a point is inside a polygon or MultiPolygon given by all its rings: an odd number of them holds it, so holes count out."""
    return F.size(F.filter(rings, lambda ring: in_ring(x, y, ring))) % 2 == 1


def ring_area(ring: Column) -> Column:
    return F.abs(F.aggregate(edges_of(ring), F.lit(0.0), lambda a, e: a + e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"])) / 2


def line_length(line: Column) -> Column:
    steps = F.zip_with(F.slice(line, 1, F.greatest(F.lit(0), F.size(line) - 1)), F.slice(line, 2, F.greatest(F.lit(0), F.size(line) - 1)), lambda p, q: distance(p["x"], p["y"], q["x"], q["y"]))
    return F.aggregate(steps, F.lit(0.0), lambda a, d: a + d)


def segment_distance(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance from a point to a segment; a segment without length is its point."""
    dx, dy = x2 - x1, y2 - y1
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(((x - x1) * dx + (y - y1) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))))
    return distance(x, y, x1 + t * dx, y1 + t * dy)


def chaikin(line: Column) -> Column:
    """One round of corner cutting; the ends stay."""
    heads, tails = F.slice(line, 1, F.greatest(F.lit(0), F.size(line) - 1)), F.slice(line, 2, F.greatest(F.lit(0), F.size(line) - 1))
    at = lambda p, q, w: F.struct((p["x"] * (1 - w) + q["x"] * w).alias("x"), (p["y"] * (1 - w) + q["y"] * w).alias("y"))
    cut = F.flatten(F.zip_with(heads, tails, lambda p, q: F.array(at(p, q, 0.25), at(p, q, 0.75))))
    return F.when(F.size(line) > 2, F.concat(F.slice(line, 1, 1), F.slice(cut, 2, F.size(cut) - 2), F.slice(line, -1, 1))).otherwise(line)


def wind_from(u: Column, v: Column) -> Column:
    """Direction in degrees that the wind (u east, v north) comes from."""
    return F.pmod(F.degrees(F.atan2(u, v)) + 180, F.lit(360.0))


def rotate(u: Column, v: Column, degrees: Column) -> tuple[Column, Column]:
    a = F.radians(degrees)
    return u * F.cos(a) + v * F.sin(a), v * F.cos(a) - u * F.sin(a)
