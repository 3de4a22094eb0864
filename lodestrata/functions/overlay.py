"""Areas and lengths that shapes share, as Column expressions.

A shape is an array of rings (arrays of ``x, y``): outer rings run one way round and holes the other, as in GeoJSON.
The work of a row grows with the product of the two shapes' numbers of edges; bring pairs together by ``box_join`` first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geo
from .lines import _bound, segments


def ring_edges(rings: Column) -> Column:
    """All edges ``p, q`` of all rings."""
    return F.flatten(F.transform(rings, geo.edges_of))


def shape_area(rings: Column) -> Column:
    """Area of the outer rings without that of the holes."""
    crossed = F.transform(ring_edges(rings), lambda e: e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"])
    return F.abs(F.aggregate(crossed, F.lit(0.0), lambda a, v: a + v)) / 2


def _height(e: Column, x: Column) -> Column:
    p, q = e["p"], e["q"]
    return p["y"] + (q["y"] - p["y"]) * (x - p["x"]) / (q["x"] - p["x"])


def _under_both(m: Column) -> Column:
    """Area under the lower one of two edges over the stretch that they share."""
    d0, d1 = m["a0"] - m["b0"], m["a1"] - m["b1"]
    low0, low1 = F.least(m["a0"], m["b0"]), F.least(m["a1"], m["b1"])
    t = d0 / (d0 - d1)
    meet = m["a0"] + t * (m["a1"] - m["a0"])
    return m["sign"] * m["width"] * F.when(d0 * d1 < 0, (t * (low0 + meet) + (1 - t) * (meet + low1)) / 2).otherwise((low0 + low1) / 2)


def shared_area(a: Column, b: Column) -> Column:
    """Area that two shapes share, concave ones, holes and parts included.

    What lies under a shape's edges, with the sign of their direction, adds up to the shape; so what lies under an edge
    of each, over all pairs of edges, adds up to what they share.
    """
    sloped = lambda rings: F.filter(ring_edges(rings), lambda e: e["p"]["x"] != e["q"]["x"])
    left, right = (lambda e: F.least(e["p"]["x"], e["q"]["x"])), (lambda e: F.greatest(e["p"]["x"], e["q"]["x"]))
    sign = lambda e: F.signum(e["q"]["x"] - e["p"]["x"])
    span = lambda e, f: F.struct(e.alias("e"), f.alias("f"), F.greatest(left(e), left(f)).alias("lo"), F.least(right(e), right(f)).alias("hi"))
    pairs = _bound(sloped(b), lambda others: F.flatten(F.transform(sloped(a), lambda e: F.filter(F.transform(others, lambda f: span(e, f)), lambda m: m["lo"] < m["hi"]))))
    ends = F.transform(
        pairs,
        lambda m: F.struct(
            (sign(m["e"]) * sign(m["f"])).alias("sign"), (m["hi"] - m["lo"]).alias("width"),
            _height(m["e"], m["lo"]).alias("a0"), _height(m["e"], m["hi"]).alias("a1"), _height(m["f"], m["lo"]).alias("b0"), _height(m["f"], m["hi"]).alias("b1"),
        ),
    )
    return F.abs(F.aggregate(ends, F.lit(0.0), lambda total, m: total + _under_both(m)))


def shared_length(line: Column, rings: Column) -> Column:
    """Length of a line inside a shape: each segment is cut where it crosses an edge, and its pieces count by their middles."""

    def cut_at(s: Column, e: Column) -> Column:
        rx, ry = s["q"]["x"] - s["p"]["x"], s["q"]["y"] - s["p"]["y"]
        ex, ey = e["q"]["x"] - e["p"]["x"], e["q"]["y"] - e["p"]["y"]
        dx, dy = e["p"]["x"] - s["p"]["x"], e["p"]["y"] - s["p"]["y"]
        across = F.nullif(rx * ey - ry * ex, F.lit(0.0))
        t, u = (dx * ey - dy * ex) / across, (dx * ry - dy * rx) / across
        return F.when((t > 0) & (t < 1) & (u >= 0) & (u <= 1), t)

    def inside(s: Column, cuts: Column) -> Column:
        pieces = F.zip_with(F.slice(cuts, 1, F.size(cuts) - 1), F.slice(cuts, 2, F.size(cuts) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        middle = lambda w, c: s["p"][c] + (w["a"] + w["b"]) / 2 * (s["q"][c] - s["p"][c])
        kept = F.filter(pieces, lambda w: geo.in_rings(middle(w, "x"), middle(w, "y"), rings))
        return F.aggregate(kept, F.lit(0.0), lambda total, w: total + w["b"] - w["a"]) * geo.distance(s["p"]["x"], s["p"]["y"], s["q"]["x"], s["q"]["y"])

    cuts = lambda s: F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.array_compact(F.transform(ring_edges(rings), lambda e: cut_at(s, e))))))
    return F.aggregate(F.transform(segments(line), lambda s: _bound(cuts(s), lambda c: inside(s, c))), F.lit(0.0), lambda total, v: total + v)
