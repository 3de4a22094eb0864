"""Networks of lines: noding, merging into long lines, clusters, and classes of a track by what it runs along.

Nodes are structs ``x, y``; two ends meet where these are equal, so coordinates are rounded to a tolerance first
(``noded`` does). Nothing gathers a network or a line in one task: segments meet in cells, components and places along
lines come in doubling steps.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import geo

from .graph import connected_components
from .relational import checkpointed, islands
from .spatial import apart, box_join


def rounded(p: Column, tolerance: float) -> Column:
    at = lambda c: (F.round(p[c] / tolerance) * tolerance + F.lit(0.0)).alias(c)
    return F.struct(at("x"), at("y"))


def parts_of(lines: DataFrame, id_col: str, line_col: str) -> DataFrame:
    """``id, part, a, b``: the segments of lines (arrays of points), those without length left out."""
    line = F.col(line_col)
    pairs = F.arrays_zip(F.slice(line, 1, F.greatest(F.lit(0), F.size(line) - 1)).alias("a"), F.slice(line, 2, F.greatest(F.lit(0), F.size(line) - 1)).alias("b"))
    found = lines.where(F.size(line) > 1).select(F.col(id_col).alias("id"), F.posexplode(pairs).alias("part", "s"))
    return found.select("id", "part", F.col("s.a").alias("a"), F.col("s.b").alias("b")).where("a <> b")


def _boxed(parts: DataFrame, name: str, margin: float = 0.0, keys: Sequence[str] = ()) -> DataFrame:
    low = lambda c: F.least(F.col(f"a.{c}"), F.col(f"b.{c}")) - margin
    high = lambda c: F.greatest(F.col(f"a.{c}"), F.col(f"b.{c}")) + margin
    return parts.select(*keys, *[F.col(c).alias(f"{name}_{c}") for c in parts.columns if c not in keys], low("x").alias(f"{name}xmin"), low("y").alias(f"{name}ymin"), high("x").alias(f"{name}xmax"), high("y").alias(f"{name}ymax"))


def _once_along_axes(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Segments with those parallel to an axis cut at the ends of others on their own line; what several of these cover is there once.

    So lines that lie on each other many times are few when pairs are made. A line's ends are summed by place first and then
    run through in order, with the number of segments under way.
    """
    level, upright = F.col("a.y") == F.col("b.y"), F.col("a.x") == F.col("b.x")
    straight = parts.where(level | upright).withColumn("__level", level)
    along = lambda p: F.when(F.col("__level"), F.col(f"{p}.x")).otherwise(F.col(f"{p}.y"))
    across = F.when(F.col("__level"), F.col("a.y")).otherwise(F.col("a.x"))
    ends = F.array(F.struct(F.least(along("a"), along("b")).alias("at"), F.lit(1).alias("n")), F.struct(F.greatest(along("a"), along("b")).alias("at"), F.lit(-1).alias("n")))
    line = [*keys, "__level", "__across"]
    places = straight.withColumn("__across", across).select(*line, F.inline(ends)).groupBy(*line, "at").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*line).orderBy("at")
    under = places.select(*line, "at", F.lead("at").over(w).alias("to"), F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("n")).where("n > 0 and to is not null")
    spot = lambda c: F.struct(F.when(F.col("__level"), F.col(c)).otherwise(F.col("__across")).alias("x"), F.when(F.col("__level"), F.col("__across")).otherwise(F.col(c)).alias("y"))
    return parts.where(~(level | upright)).select(*keys, "a", "b").unionByName(under.select(*keys, spot("at").alias("a"), spot("to").alias("b")))


def noded(parts: DataFrame, size: float, tolerance: float = 1e-6, keys: Sequence[str] = ()) -> DataFrame:
    """Segments ``a, b`` of ``parts`` cut wherever two of them (of equal ``keys``) cross or touch, rounded to ``tolerance``, each once.

    Segments meet in cells of ``size``. Of two that lie on one line the ends of each cut the other.
    """
    parts = parts.select(*keys, rounded(F.col("a"), tolerance).alias("a"), rounded(F.col("b"), tolerance).alias("b")).where("a <> b").distinct()
    parts = checkpointed(_once_along_axes(parts, keys))
    pairs = box_join(_boxed(parts, "m", keys=keys), _boxed(parts, "o", keys=keys), "m", "o", size, keys).where("m_a <> o_a or m_b <> o_b")
    c = F.col
    rx, ry = c("m_b.x") - c("m_a.x"), c("m_b.y") - c("m_a.y")
    sx, sy = c("o_b.x") - c("o_a.x"), c("o_b.y") - c("o_a.y")
    dx, dy = c("o_a.x") - c("m_a.x"), c("o_a.y") - c("m_a.y")
    across, long, far = rx * sy - ry * sx, rx * rx + ry * ry, sx * sx + sy * sy
    level = F.abs(across) <= 1e-12 * F.sqrt(long * far)
    t, u = (dx * sy - dy * sx) / F.nullif(across, F.lit(0.0)), (dx * ry - dy * rx) / F.nullif(across, F.lit(0.0))
    slack = tolerance / F.sqrt(far)
    crossing = F.when(~level & u.between(-slack, 1 + slack), t)
    # Ends of the other segment that lie on this one.
    on = lambda px, py: F.when(F.abs((px - c("m_a.x")) * ry - (py - c("m_a.y")) * rx) <= tolerance * F.sqrt(long), ((px - c("m_a.x")) * rx + (py - c("m_a.y")) * ry) / long)
    found = (crossing, on(c("o_a.x"), c("o_a.y")), on(c("o_b.x"), c("o_b.y")))
    # Most pairs only meet at their ends, so an array is made for those alone that are cut, and apart from the join, whose loop stays small.
    inside = reduce(lambda x, y: x | y, [F.coalesce((f > 0) & (f < 1), F.lit(False)) for f in found])
    cuts = apart(pairs).select(*keys, "m_a", "m_b", F.explode(F.when(inside, F.array(*found))).alias("t")).where("t > 0 and t < 1")
    whole = parts.select(*keys, c("a").alias("m_a"), c("b").alias("m_b"), F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("t"))
    at = F.struct((c("m_a.x") + c("t") * rx).alias("x"), (c("m_a.y") + c("t") * ry).alias("y"))
    point = F.when(c("t") == 0, c("m_a")).when(c("t") == 1, c("m_b")).otherwise(rounded(at, tolerance))
    placed = cuts.unionByName(whole).withColumn("p", point).groupBy(*keys, "m_a", "m_b").agg(F.array_sort(F.collect_list(F.struct("t", "p"))).alias("stops"))
    stops = F.transform("stops", lambda s: s["p"])
    pieces = placed.select(*keys, F.explode(F.arrays_zip(F.slice(stops, 1, F.size(stops) - 1).alias("p"), F.slice(stops, 2, F.size(stops) - 1).alias("q"))).alias("s"))
    return pieces.select(*keys, F.least("s.p", "s.q").alias("a"), F.greatest("s.p", "s.q").alias("b")).where("a <> b").distinct()


def clusters(parts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``parts`` (``a, b``) with ``cluster``: the least node of those that hang together, by ``keys``."""
    node = lambda k: F.struct(*keys, F.col(k).alias("at"))
    parts = checkpointed(parts)
    linked = connected_components(parts.select(node("a").alias("a"), node("b").alias("b")))
    return parts.withColumn("__a", node("a")).join(linked, F.col("__a") == F.col("node")).select(*parts.columns, F.col("component.at").alias("cluster"))


def merged(parts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Long lines of segments ``a, b``: ``line, place, node`` by ``keys``, each segment once.

    Lines run through nodes at which two segments end, and stop at others; a ring starts and ends at its least node. An
    open line starts at its lesser end, a ring toward the lesser of its neighbours. ``line`` is a number made of its
    first two nodes. Of segments that repeat, each counts.
    """
    segments = checkpointed(parts.select(*keys, "a", "b").where("a <> b").withColumn("seg", F.monotonically_increasing_id()))
    half = lambda tail, head, side: segments.select(F.struct("seg", F.lit(side).alias("side")).alias("half"), F.struct("seg", F.lit(1 - side).alias("side")).alias("back"), F.struct(*keys, F.col(tail).alias("at")).alias("tail"), F.struct(*keys, F.col(head).alias("at")).alias("head"))
    halves = checkpointed(half("a", "b", 0).unionByName(half("b", "a", 1)))
    two = halves.groupBy("tail").agg(F.count("*").alias("n"), F.min("half").alias("one"), F.max("half").alias("other")).where("n = 2")
    through = checkpointed(two.select(F.col("tail").alias("node"), "one", "other"))
    # Segments that meet at nodes of two; of those without an end, the least node is made one.
    chains = connected_components(halves.select(F.col("half.seg").alias("a"), F.col("half.seg").alias("b")).unionByName(through.select(F.col("one.seg").alias("a"), F.col("other.seg").alias("b"))).distinct())
    tails = halves.join(chains.select(F.col("node").alias("seg"), "component"), F.col("half.seg") == F.col("seg")).join(through.select(F.col("node").alias("tail"), F.lit(True).alias("inner")), "tail", "left")
    opened = tails.groupBy("component").agg(F.min("tail").alias("least"), F.count_if(F.col("inner").isNull()).alias("ends"))
    rings = opened.where("ends = 0").select(F.col("least").alias("node"))
    through = through.join(rings, "node", "left_anti")
    onward = through.select(F.explode(F.array(F.struct(F.col("one").alias("back"), F.col("other").alias("next")), F.struct(F.col("other").alias("back"), F.col("one").alias("next")))).alias("p")).select("p.*")
    # What arrives at a node as ``back`` reversed goes on as ``next``.
    state = checkpointed(halves.join(onward, "back", "left").select("half", "tail", "head", F.col("next").alias("up"), F.lit(1).cast("long").alias("left"), F.col("half").alias("last")))
    while not state.where("up is not null").isEmpty():
        further = state.select(F.col("half").alias("mid"), F.col("up").alias("beyond"), F.col("left").alias("more"), F.col("last").alias("end"))
        on = state.join(further, F.col("up") == F.col("mid"), "left")
        state = checkpointed(on.select("half", "tail", "head", F.col("beyond").alias("up"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left"), F.coalesce("end", "last").alias("last")))
    # A way from end to end is named by its last half and starts at the half with most left; each line has two, of which one is kept.
    ways = state.groupBy("last").agg(F.max("left").alias("long"), F.max_by(F.struct("tail", "head", "half"), "left").alias("start"))
    pair = F.struct(F.least("last.seg", "start.half.seg"), F.greatest("last.seg", "start.half.seg"))
    kept = ways.groupBy(pair.alias("pair")).agg(F.min(F.struct("start", "last", "long")).alias("w")).select("w.*")
    numbered = checkpointed(kept.select("last", "long", "start", F.xxhash64("start.tail", "start.head").alias("line")))
    on_way = state.join(numbered.select("last", "long", "line"), "last")
    stops = on_way.select(F.col("head.*"), "line", (F.col("long") - F.col("left") + 1).alias("place"))
    begins = numbered.select(F.col("start.tail.*"), "line", F.lit(0).cast("long").alias("place"))
    return begins.unionByName(stops).select(*keys, "line", F.col("place").cast("int").alias("place"), F.col("at").alias("node"))


def along_network(tracks: DataFrame, network: DataFrame, key: str, order: Sequence[str], radius: float, within: Sequence[float] = ()) -> tuple[DataFrame, DataFrame]:
    """A track's segments classed by how far their middles are from a network, and what each track comes to.

    ``tracks``: points ``x, y`` by ``key`` in ``order``; ``network``: segments ``a, b``. Segments without length are left
    out. The first frame has runs of one class in order, merged: ``key, run, class`` (``overlap`` up to ``radius``, else
    ``novel``), ``line`` and ``length``. The second has, for each ``key``, ``total``, the length and percent of what lies
    within each of ``within`` and ``radius``, and of the rest.
    """
    w = Window.partitionBy(key).orderBy(*order)
    point = F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    steps = tracks.select(key, F.lag(point).over(w).alias("a"), point.alias("b"), F.row_number().over(w).alias("idx")).where("a is not null and a <> b")
    steps = checkpointed(steps)
    # Equal middles, and equal segments of the network, are compared once.
    steps = steps.withColumns({"px": (F.col("a.x") + F.col("b.x")) / 2, "py": (F.col("a.y") + F.col("b.y")) / 2})
    middle = checkpointed(steps.select("px", "py").distinct())
    boxed = middle.select("*", *[F.col(p).alias(f"p{c}{e}") for p, c in (("px", "x"), ("py", "y")) for e in ("min", "max")])
    reach = max([radius, *within])
    near = box_join(boxed, _boxed(checkpointed(network.select("a", "b").distinct()), "n", reach), "p", "n", 4 * reach)
    away = geo.segment_distance(F.col("px"), F.col("py"), F.col("n_a.x"), F.col("n_a.y"), F.col("n_b.x"), F.col("n_b.y"))
    nearest = near.groupBy("px", "py").agg(F.min(away).alias("away"))
    length = geo.distance(F.col("a.x"), F.col("a.y"), F.col("b.x"), F.col("b.y"))
    classed = checkpointed(steps.join(nearest, ["px", "py"], "left").drop("px", "py").withColumns({"class": F.when(F.col("away") <= radius, "overlap").otherwise("novel"), "length": length}))
    ordered = F.array_sort(F.collect_list(F.struct("idx", "a", "b")))
    runs = islands(classed, [key], ["idx"], "class", "run").groupBy(key, "run", "class").agg(ordered.alias("s"), F.sum("length").alias("length"))
    # A run is one line where its segments follow on each other; a point that repeats leaves no gap.
    line = F.concat(F.array(F.get("s", F.lit(0))["a"]), F.transform("s", lambda x: x["b"]))
    sums = [F.sum("length").alias("total"), *[F.sum(F.when(F.col("away") <= d, F.col("length")).otherwise(0.0)).alias(f"within_{d:g}") for d in (*within, radius)]]
    totals = classed.groupBy(key).agg(*sums)
    percent = lambda x: F.round(100 * x / F.col("total"), 1)
    shares = [percent(F.col(f"within_{d:g}")).alias(f"within_{d:g}_pct") for d in (*within, radius)]
    new = F.col("total") - F.col(f"within_{radius:g}")
    return runs.select(key, "run", "class", line.alias("line"), "length"), totals.select(key, "total", *[f"within_{d:g}" for d in (*within, radius)], *shares, new.alias("new"), percent(new).alias("new_pct"))
