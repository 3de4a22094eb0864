"""Lines and rings as Column expressions. A line is an array of structs ``x, y`` of doubles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import distance, edges_of, in_ring, ring_area

POINT = "struct<x:double,y:double>"


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def segments(line: Column) -> Column:
    """Neighbouring points as structs ``p, q``."""
    most = F.greatest(F.lit(0), F.size(line) - 1)
    return F.zip_with(F.slice(line, F.lit(1), most), F.slice(line, F.lit(2), most), lambda p, q: F.struct(p.alias("p"), q.alias("q")))


def _length(s: Column) -> Column:
    return distance(s["p"]["x"], s["p"]["y"], s["q"]["x"], s["q"]["y"])


def along(line: Column) -> Column:
    """Length of the line up to each of its points."""
    return F.aggregate(segments(line), F.array(F.lit(0.0)), lambda a, s: F.array_append(a, F.element_at(a, -1) + _length(s)))


def locate(line: Column, x: Column, y: Column) -> Column:
    """The nearest place of a line to a point: ``fraction`` of the line before it, ``x``, ``y`` and ``distance``. Of equal places the first."""
    start = F.struct(F.lit(None).cast("double").alias("distance"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), F.lit(0.0).alias("before"), F.lit(0.0).alias("total"))

    def step(a, s):
        p, q, long = s["p"], s["q"], _length(s)
        dx, dy = q["x"] - p["x"], q["y"] - p["y"]
        t = F.coalesce(((x - p["x"]) * dx + (y - p["y"]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
        near_x, near_y = p["x"] + t * dx, p["y"] + t * dy
        d = distance(x, y, near_x, near_y)
        nearer = a["distance"].isNull() | (d < a["distance"])
        pick = lambda new, old: F.when(nearer, new).otherwise(old)
        return F.struct(
            pick(d, a["distance"]).alias("distance"), pick(near_x, a["x"]).alias("x"), pick(near_y, a["y"]).alias("y"),
            pick(a["total"] + t * long, a["before"]).alias("before"), (a["total"] + long).alias("total"),
        )

    def finish(a):
        return F.struct(F.when(a["total"] > 0, a["before"] / a["total"]).otherwise(0.0).alias("fraction"), a["x"].alias("x"), a["y"].alias("y"), a["distance"].alias("distance"))

    return F.aggregate(segments(line), start, step, finish)


def interpolate(line: Column, fraction: Column) -> Column:
    """The point at a fraction of a line's length."""
    return _bound(along(line), lambda lengths: _interpolate(line, lengths, fraction))


def _interpolate(line: Column, lengths: Column, fraction: Column) -> Column:
    target = fraction * F.element_at(lengths, -1)
    cuts = F.zip_with(segments(line), F.slice(lengths, F.lit(1), F.greatest(F.lit(0), F.size(line) - 1)), lambda s, before: F.struct(s["p"].alias("p"), s["q"].alias("q"), before.alias("before"), _length(s).alias("long")))
    return _bound(F.get(F.filter(cuts, lambda c: c["before"] + c["long"] >= target), F.lit(0)), lambda at: _on_segment(line, at, target))


def _on_segment(line: Column, at: Column, target: Column) -> Column:
    t = F.coalesce((target - at["before"]) / F.nullif(at["long"], F.lit(0.0)), F.lit(0.0))
    found = point(at["p"]["x"] + t * (at["q"]["x"] - at["p"]["x"]), at["p"]["y"] + t * (at["q"]["y"] - at["p"]["y"]))
    return F.when(at.isNull(), F.element_at(line, -1)).otherwise(found)


def substring(line: Column, low: Column, high: Column) -> Column:
    """The part of a line between two fractions of its length."""
    return _bound(along(line), lambda lengths: _substring(line, lengths, low, high))


def _substring(line: Column, lengths: Column, low: Column, high: Column) -> Column:
    total = F.element_at(lengths, -1)
    placed = F.zip_with(line, lengths, lambda p, before: F.struct(p.alias("p"), before.alias("before")))
    middle = F.transform(F.filter(placed, lambda v: (v["before"] > low * total) & (v["before"] < high * total)), lambda v: v["p"])
    return F.concat(F.array(_interpolate(line, lengths, low)), middle, F.array(_interpolate(line, lengths, high)))


def hausdorff(a: Column, b: Column) -> Column:
    """Discrete Hausdorff distance: how far the farthest point of either line is from the other's points."""
    reach = lambda one, two: F.array_max(F.transform(one, lambda p: F.array_min(F.transform(two, lambda q: distance(p["x"], p["y"], q["x"], q["y"])))))
    return F.greatest(reach(a, b), reach(b, a))


def snap(line: Column, targets: Column, tolerance: float) -> Column:
    """Points of a line moved to the nearest of ``targets`` where one is within the tolerance."""

    def moved(p):
        near = F.array_min(F.transform(targets, lambda t: F.struct(distance(p["x"], p["y"], t["x"], t["y"]).alias("d"), t["x"].alias("x"), t["y"].alias("y"))))
        return F.when(near["d"] <= tolerance, point(near["x"], near["y"])).otherwise(point(p["x"], p["y"]))

    return F.transform(line, moved)


def translate(line: Column, dx: Column | float, dy: Column | float) -> Column:
    return F.transform(line, lambda p: point(p["x"] + dx, p["y"] + dy))


def scale(line: Column, sx: Column | float, sy: Column | float) -> Column:
    return F.transform(line, lambda p: point(p["x"] * sx, p["y"] * sy))


def set_point(line: Column, place: int, new: Column) -> Column:
    """A line with the point at ``place`` (from 0, or from -1 at its end) replaced."""
    at = F.lit(place) if place >= 0 else F.size(line) + place
    return F.transform(line, lambda p, k: F.when(k == at, new).otherwise(p))


def is_closed(line: Column) -> Column:
    first, last = F.element_at(line, 1), F.element_at(line, -1)
    return (first["x"] == last["x"]) & (first["y"] == last["y"])


def boundary(ring: Column) -> Column:
    """The closed line around a ring."""
    return F.when(is_closed(ring), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))


def _side(a: Column, b: Column, c: Column) -> Column:
    return F.signum((b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"]))


def _meet(s: Column, t: Column) -> Column:
    """Whether segments cross or touch."""
    a, b, c, d = s["p"], s["q"], t["p"], t["q"]
    inside = lambda p, q, r: (_side(p, q, r) == 0) & r["x"].between(F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"])) & r["y"].between(F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"]))
    crossing = (_side(a, b, c) != _side(a, b, d)) & (_side(c, d, a) != _side(c, d, b))
    return crossing | inside(a, b, c) | inside(a, b, d) | inside(c, d, a) | inside(c, d, b)


def is_simple(line: Column) -> Column:
    """Whether no two segments meet but at the point that neighbours share, or where a closed line ends."""
    parts = F.transform(segments(line), lambda s, k: F.struct(s["p"].alias("p"), s["q"].alias("q"), k.alias("k")))
    last = F.size(line) - 2
    apart = lambda s, t: (t["k"] > s["k"] + 1) & ~(is_closed(line) & (s["k"] == 0) & (t["k"] == last))
    back = lambda s: (s["q"]["x"] - s["p"]["x"], s["q"]["y"] - s["p"]["y"])

    def folds(s, t):
        (ax, ay), (bx, by) = back(s), back(t)
        return (t["k"] == s["k"] + 1) & (ax * by - ay * bx == 0) & (ax * bx + ay * by < 0)

    return ~F.exists(parts, lambda s: F.exists(parts, lambda t: (apart(s, t) & _meet(s, t)) | folds(s, t)))


def _farthest(x: list[float], y: list[float], a: int, b: int) -> tuple[float, int]:
    dx, dy = x[b] - x[a], y[b] - y[a]
    square = dx * dx + dy * dy
    best = (-1.0, a)
    for k in range(a + 1, b):
        t = min(1.0, max(0.0, ((x[k] - x[a]) * dx + (y[k] - y[a]) * dy) / square)) if square else 0.0
        best = max(best, ((x[k] - x[a] - t * dx) ** 2 + (y[k] - y[a] - t * dy) ** 2, -k))
    return best[0], abs(best[1])


def simplify(line: Column, tolerance: float) -> Column:
    """Douglas-Peucker: the ends and the points that hold the line within ``tolerance``. Recursive, so it runs on Arrow batches."""

    @F.pandas_udf(f"array<{POINT}>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for xs, ys in batches:
            yield pd.Series([None if x is None else kept(list(x), list(y)) for x, y in zip(xs, ys)])

    def kept(x: list[float], y: list[float]) -> list[dict]:
        stay, spans = {0, len(x) - 1} if x else set(), [(0, len(x) - 1)]
        while spans:
            a, b = spans.pop()
            far, k = _farthest(x, y, a, b) if b - a > 1 else (-1.0, a)
            if far > tolerance * tolerance:
                stay.add(k)
                spans += [(a, k), (k, b)]
        return [{"x": x[k], "y": y[k]} for k in sorted(stay)]

    return run(F.transform(line, lambda p: p["x"]), F.transform(line, lambda p: p["y"]))


def envelope(line: Column, margin: float = 0.0) -> Column:
    """Bounding box, ``margin`` wider on each side."""
    of = lambda k: F.transform(line, lambda p: p[k])
    return F.struct((F.array_min(of("x")) - margin).alias("xmin"), (F.array_min(of("y")) - margin).alias("ymin"), (F.array_max(of("x")) + margin).alias("xmax"), (F.array_max(of("y")) + margin).alias("ymax"))


def centroid(ring: Column) -> Column:
    """Centre of a ring's area; the first point where it has none."""
    zero = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("twice"))

    def step(a, e):
        p, q = e["p"], e["q"]
        w = p["x"] * q["y"] - q["x"] * p["y"]
        return F.struct((a["x"] + (p["x"] + q["x"]) * w).alias("x"), (a["y"] + (p["y"] + q["y"]) * w).alias("y"), (a["twice"] + w).alias("twice"))

    mean = lambda a, k: a[k] / F.nullif(3 * a["twice"], F.lit(0.0))
    found = F.aggregate(edges_of(ring), zero, step, lambda a: F.struct(mean(a, "x").alias("x"), mean(a, "y").alias("y")))
    return _bound(found, lambda c: F.when(c["x"].isNotNull(), c).otherwise(F.element_at(ring, 1)))


def point_on_surface(ring: Column) -> Column:
    """A point inside a ring: the middle of its widest stretch at half height."""
    box = envelope(ring)
    # Half height may run through a corner, so the two heights nearest to it are parted.
    ys = F.transform(ring, lambda p: p["y"])
    half = (box["ymin"] + box["ymax"]) / 2
    level = _bound(half, lambda h: (F.array_min(F.filter(ys, lambda v: v > h)) + F.array_max(F.filter(ys, lambda v: v <= h))) / 2)
    return _bound(level, lambda y: _widest(ring, y))


def _widest(ring: Column, level: Column) -> Column:
    crossed = F.filter(edges_of(ring), lambda e: (e["p"]["y"] > level) != (e["q"]["y"] > level))
    xs = F.array_sort(F.transform(crossed, lambda e: e["p"]["x"] + (level - e["p"]["y"]) / F.nullif(e["q"]["y"] - e["p"]["y"], F.lit(0.0)) * (e["q"]["x"] - e["p"]["x"])))

    def stretches(x):
        most = F.greatest(F.lit(0), F.size(x) - 1)
        return F.zip_with(F.slice(x, F.lit(1), most), F.slice(x, F.lit(2), most), lambda a, b: F.struct((b - a).alias("w"), ((a + b) / 2).alias("x")))

    inside = F.array_max(F.filter(_bound(xs, stretches), lambda s: in_ring(s["x"], level, ring)))
    return _bound(inside, lambda w: F.when(w.isNotNull(), point(w["x"], level)).otherwise(F.element_at(ring, 1)))


def clip_to_box(ring: Column, xmin: float, ymin: float, xmax: float, ymax: float) -> Column:
    """The part of a ring inside a box, cut side by side (exact for convex rings)."""
    for key, limit, sign in (("x", xmin, 1), ("x", xmax, -1), ("y", ymin, 1), ("y", ymax, -1)):
        ring = _cut(ring, key, limit, sign)
    return ring


def _cut(ring: Column, key: str, limit: float, sign: int) -> Column:
    inside = lambda p: sign * (p[key] - limit) >= 0

    def kept(e):
        p, q = e["p"], e["q"]
        t = (F.lit(float(limit)) - p[key]) / F.nullif(q[key] - p[key], F.lit(0.0))
        crossing = point(p["x"] + t * (q["x"] - p["x"]), p["y"] + t * (q["y"] - p["y"]))
        return F.when(inside(p) & inside(q), F.array(q)).when(inside(p), F.array(crossing)).when(inside(q), F.array(crossing, q)).otherwise(F.array().cast(f"array<{POINT}>"))

    return _bound(ring, lambda r: F.flatten(F.transform(edges_of(r), kept)))


def ring_share(ring: Column, xmin: float, ymin: float, xmax: float, ymax: float) -> Column:
    """Share of a ring's area inside a box."""
    whole, inside = ring_area(ring), _bound(clip_to_box(ring, xmin, ymin, xmax, ymax), ring_area)
    return F.when(whole > 0, inside / whole).otherwise(0.0)


def as_text(line: Column) -> Column:
    """Well-known text of a line."""
    return F.concat(F.lit("LINESTRING("), F.array_join(F.transform(line, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ","), F.lit(")"))


def as_geojson(line: Column) -> Column:
    return F.to_json(F.struct(F.lit("LineString").alias("type"), F.transform(line, lambda p: F.array(p["x"], p["y"])).alias("coordinates")))


def from_geojson(text: Column) -> Column:
    """The line of a GeoJSON LineString; null for anything else."""
    read = F.from_json(text, "type string, coordinates array<array<double>>")
    return F.when(read["type"] == "LineString", F.transform(read["coordinates"], lambda c: point(F.get(c, F.lit(0)), F.get(c, F.lit(1)))))


def _toward(p: Column, s: Column) -> Column:
    """The way from a point to the nearest place of a segment: ``d``, ``p``, ``q``."""
    a, b = s["p"], s["q"]
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    t = F.coalesce(((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))
    return _bound(F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)), lambda u: _bound(point(a["x"] + u * dx, a["y"] + u * dy), lambda q: F.struct(distance(p["x"], p["y"], q["x"], q["y"]).alias("d"), point(p["x"], p["y"]).alias("p"), q.alias("q"))))


def _crossing(s: Column, t: Column) -> Column:
    """The place where two segments cross or touch, as a way of no length; null where they do not, or lie on one line."""
    rx, ry, sx, sy = s["q"]["x"] - s["p"]["x"], s["q"]["y"] - s["p"]["y"], t["q"]["x"] - t["p"]["x"], t["q"]["y"] - t["p"]["y"]
    dx, dy = t["p"]["x"] - s["p"]["x"], t["p"]["y"] - s["p"]["y"]
    across = F.nullif(rx * sy - ry * sx, F.lit(0.0))
    u, v = (dx * sy - dy * sx) / across, (dx * ry - dy * rx) / across
    at = point(s["p"]["x"] + u * rx, s["p"]["y"] + u * ry)
    return F.when(u.between(0, 1) & v.between(0, 1), F.struct(F.lit(0.0).alias("d"), at.alias("p"), at.alias("q")))


def shortest(a: Column, b: Column) -> Column:
    """The shortest line from one line to another, of two points; of equally short ones the least. Null where either has no segment."""
    over = lambda one, two, use: F.flatten(F.transform(one, lambda x: F.transform(two, lambda y: use(x, y))))
    back = lambda way: F.struct(way["d"].alias("d"), way["q"].alias("p"), way["p"].alias("q"))
    there = over(a, segments(b), _toward)
    ways = F.concat(there, F.transform(over(b, segments(a), _toward), back), F.array_compact(over(segments(a), segments(b), _crossing)))
    return F.when((F.size(a) > 1) & (F.size(b) > 1), _bound(F.array_min(ways), lambda w: F.array(w["p"], w["q"])))
