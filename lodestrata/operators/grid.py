"""Grids as rows ``grid_id, row, col, value``: neighbourhoods, slopes, forms, patches, zonal statistics.

A neighbourhood is not a self-join: each cell sends its value to the cells around it, and what a cell receives is
aggregated. So the work is cells times neighbours, spread by cell, and partly summed before it is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.overlay import ring_edges

from . import network, terrain
from .ranks import percentiles, with_keys
from .relational import broadcast_if_small

CELL = ["grid_id", "row", "col"]
EIGHT = [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1) if (r, c) != (0, 0)]
FOUR = [(-1, 0), (0, -1), (0, 1), (1, 0)]


def disc(radius: float, cell: float = 1.0, centre: bool = True) -> list[tuple[int, int]]:
    n = int(radius // cell)
    return [(r, c) for r in range(-n, n + 1) for c in range(-n, n + 1) if math.hypot(r, c) * cell <= radius and (centre or (r, c) != (0, 0))]


def sample_grid(bounds: DataFrame, n: int, pad: float = 0.0) -> DataFrame:
    """``n`` by ``n`` points over each row's ``xmin, ymin, xmax, ymax``, padded by a share of its size."""
    low = lambda k: F.col(f"{k}min") - pad * (F.col(f"{k}max") - F.col(f"{k}min"))
    step = lambda k: (F.col(f"{k}max") - F.col(f"{k}min")) * (1 + 2 * pad) / (n - 1)
    axis = lambda: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    grid = bounds.withColumn("row", axis()).withColumn("col", axis())
    return grid.select("grid_id", "row", "col", (low("x") + F.col("col") * step("x")).alias("x"), (low("y") + F.col("row") * step("y")).alias("y"))


#: Points to a side of a sampled parcel and the share of its box that is added on each side.
SAMPLES, PADDING = 61, 0.08
#: Points that one task samples, about.
POINTS = 500_000


def sample_shapes(shapes: DataFrame, rings: str, n: int = SAMPLES, pad: float = PADDING) -> DataFrame:
    """``grid_id, row, col, x, y, inside``: ``n`` by ``n`` points over the padded box of each shape (an array of rings), rows to the north.

    ``inside`` is whether a point lies in an odd number of the rings. Null and empty shapes have no points.
    """
    corners = F.flatten(rings)
    end = lambda f, c: f(F.transform(corners, lambda p: p[c]))
    known = shapes.where(F.size(corners) > 0).withColumns({f"__{c}{k}": end(f, c) for c in "xy" for k, f in ((0, F.array_min), (1, F.array_max))})
    low = lambda c: F.col(f"__{c}0") - (F.col(f"__{c}1") - F.col(f"__{c}0")) * pad
    high = lambda c: F.col(f"__{c}1") + (F.col(f"__{c}1") - F.col(f"__{c}0")) * pad
    axis = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # A few shapes are some bytes in one file and many points, so rows of points are dealt, by how many these are.
    tasks = max(1, min(20_000, known.count() * n * n // POINTS))
    laid = known.withColumn("row", axis).withColumn("y", low("y") + (high("y") - low("y")) * F.col("row") / (n - 1))
    laid = laid.repartition(tasks, "grid_id", "row") if tasks > 1 else laid
    # Where edges cross the height of a row, once for its points; those to the right of a point tell whether it is inside.
    crossed = F.filter(ring_edges(F.col(rings)), lambda e: (e["p"]["y"] > F.col("y")) != (e["q"]["y"] > F.col("y")))
    over = F.transform(crossed, lambda e: (e["q"]["x"] - e["p"]["x"]) * (F.col("y") - e["p"]["y"]) / F.nullif(e["q"]["y"] - e["p"]["y"], F.lit(0.0)) + e["p"]["x"])
    spots = laid.withColumn("__over", over).select("grid_id", "row", "y", "__over", F.struct(low("x").alias("low"), (high("x") - low("x")).alias("span")).alias("__x")).withColumn("col", axis)
    spots = spots.select("grid_id", "row", "col", (F.col("__x.low") + F.col("__x.span") * F.col("col") / (n - 1)).alias("x"), "y", "__over")
    return spots.select("grid_id", "row", "col", "x", "y", (F.size(F.filter("__over", lambda v: F.col("x") < v)) % 2 == 1).alias("inside"))


def scatter(grid: DataFrame, offsets: Sequence[tuple[int, int]], *columns: str) -> DataFrame:
    """Rows of the cell at ``dr, dc`` from which ``columns`` come: the cell that receives, where from, and the values."""
    steps = F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in offsets])
    sent = grid.select(*CELL, *columns, F.inline(steps))
    return sent.select("grid_id", (F.col("row") - F.col("dr")).alias("row"), (F.col("col") - F.col("dc")).alias("col"), "dr", "dc", *columns)


def focal(grid: DataFrame, offsets: Sequence[tuple[int, int]], *aggregates: Column, columns: Sequence[str] = ("value",)) -> DataFrame:
    """``grid`` with aggregates over each cell's neighbourhood; cells outside the grid take no part."""
    received = scatter(grid, offsets, *columns).groupBy(*CELL).agg(*aggregates)
    return grid.join(received, CELL, "left")


def at_offset(dr: int, dc: int, column: str = "value") -> Column:
    return F.max(F.when((F.col("dr") == dr) & (F.col("dc") == dc), F.col(column)))


def slope_percent(grid: DataFrame, cell: float = 1.0) -> DataFrame:
    """Slope by central differences; null where one of the four neighbours is missing."""
    near = focal(grid, FOUR, at_offset(-1, 0).alias("__n"), at_offset(1, 0).alias("__s"), at_offset(0, -1).alias("__w"), at_offset(0, 1).alias("__e"))
    dx, dy = (F.col("__e") - F.col("__w")) / (2 * cell), (F.col("__s") - F.col("__n")) / (2 * cell)
    return near.withColumn("slope", 100 * F.sqrt(dx * dx + dy * dy)).drop("__n", "__s", "__w", "__e")


def d8(grid: DataFrame, cell: float = 1.0) -> DataFrame:
    """The neighbour with the steepest fall, of equal ones the first in row order; null for a sink."""
    received = scatter(grid, EIGHT, "value").withColumnRenamed("value", "near")
    both = received.join(grid.select(*CELL, "value"), CELL)
    fall = (F.col("value") - F.col("near")) / (cell * F.sqrt((F.abs("dr") + F.abs("dc")).cast("double")))
    best = both.where("near < value").groupBy(*CELL).agg(F.max_by(F.struct("dr", "dc"), F.struct(F.round(fall, 9), -F.col("dr"), -F.col("dc"))).alias("d"))
    return grid.join(best, CELL, "left").select(*grid.columns, F.col("d.dr").alias("dr"), F.col("d.dc").alias("dc"))


def focal_mean(grid: DataFrame, radius: float, cell: float = 1.0, least: int = 5) -> DataFrame:
    """Mean and relief of a circular window with at least ``least`` cells."""
    enough = lambda x: F.when(F.count("*") >= least, x)
    return focal(grid, disc(radius, cell), enough(F.avg("value")).alias("focal_mean"), enough(F.max("value") - F.min("value")).alias("relief"), columns=("value",))


def position_index(grid: DataFrame, radius: float, into: str, cell: float = 1.0) -> DataFrame:
    """Height over the window's mean, as a z-score over its grid."""
    with_mean = focal_mean(grid, radius, cell)
    stats = with_mean.groupBy("grid_id").agg(F.avg(F.col("value") - F.col("focal_mean")).alias("__m"), F.stddev_pop(F.col("value") - F.col("focal_mean")).alias("__s"))
    scored = with_mean.join(stats, "grid_id").withColumn(into, F.when(F.col("__s") > 0, (F.col("value") - F.col("focal_mean") - F.col("__m")) / F.col("__s")))
    return scored.drop("__m", "__s", "focal_mean", "relief")


def landform(fine: Column, coarse: Column, slope: Column, steep: float = 15.0) -> Column:
    """Code of a cell: saddle 4, bench 5, ridge 2, draw 3, slope break 6, else 1, the first that holds."""
    saddle = (F.abs(fine) < 0.5) & (F.abs(coarse) < 0.5) & (slope < steep / 3)
    bench = (F.abs(fine) < 0.5) & (slope < steep / 2) & (coarse.between(0.5, 1.0))
    return F.when(saddle, 4).when(bench, 5).when(fine >= 1, 2).when(fine <= -1, 3).when(F.abs(fine - coarse) >= 1, 6).otherwise(1)


def contour_segments(grid: DataFrame, level: float) -> DataFrame:
    """Marching squares: the case of each square of four cells that the level crosses, and its number of segments (2 for a saddle)."""
    corners = focal(grid, [(0, 1), (1, 0), (1, 1)], at_offset(0, 1).alias("e"), at_offset(1, 0).alias("s"), at_offset(1, 1).alias("se"))
    above = lambda c: (F.col(c) >= level).cast("int")
    case = above("value") * 8 + above("e") * 4 + above("se") * 2 + above("s")
    squares = corners.where("e is not null and s is not null and se is not null").withColumn("case", case)
    return squares.where(~F.col("case").isin(0, 15)).withColumn("n_segments", F.when(F.col("case").isin(5, 10), 2).otherwise(1)).select(*CELL, "case", "n_segments")


def contour_interval(relief: Column) -> Column:
    return F.when(relief > 220, 20).otherwise(10)


def contours(grid: DataFrame) -> DataFrame:
    """Contour segments ``grid_id, row, col, level, major, segment, r1, c1, r2, c2`` of every level by each grid's relief.

    Levels are multiples of the interval, every 50 is major. A level crosses the side of a square where one end is
    below it and the other is not; the crossing point is interpolated. A square with four crossings is resolved by
    its centre: from that level up the first and last two sides are joined, below it the outer and inner ones.
    """
    extent = grid.groupBy("grid_id").agg(contour_interval(F.max("value") - F.min("value")).cast("double").alias("step"))
    corners = focal(grid.select(*CELL, "value"), [(0, 1), (1, 1), (1, 0)], at_offset(0, 1).alias("se"), at_offset(1, 1).alias("ne"), at_offset(1, 0).alias("nw"))
    squares = corners.where("value is not null and se is not null and ne is not null and nw is not null").join(extent, "grid_id")
    low, high = F.floor(F.least("value", "se", "ne", "nw") / F.col("step")) + 1, F.floor(F.greatest("value", "se", "ne", "nw") / F.col("step"))
    crossed = squares.where(low <= high).withColumn("level", F.explode(F.sequence(low, high))).withColumn("level", F.col("level") * F.col("step"))
    ends = [("value", 0, 0), ("se", 0, 1), ("ne", 1, 1), ("nw", 1, 0)]
    points = []
    for (a, ar, ac), (b, br, bc) in zip(ends, [*ends[1:], ends[0]]):
        t = (F.col("level") - F.col(a)) / (F.col(b) - F.col(a))
        point = F.struct((F.col("row") + ar + (br - ar) * t).alias("r"), (F.col("col") + ac + (bc - ac) * t).alias("c"))
        points.append(F.when((F.col(a) < F.col("level")) != (F.col(b) < F.col("level")), point))
    centre = (F.col("value") + F.col("se") + F.col("ne") + F.col("nw")) / 4
    pair = lambda x, y: F.struct(x.alias("a"), y.alias("b"))
    side = [F.col("p")[k] for k in range(4)]
    saddle = F.when(centre >= F.col("level"), F.array(pair(side[0], side[1]), pair(side[2], side[3]))).otherwise(F.array(pair(side[0], side[3]), pair(side[1], side[2])))
    met = F.array_compact("p")
    joined = F.when(F.size(met) == 4, saddle).otherwise(F.array(pair(F.get(met, F.lit(0)), F.get(met, F.lit(1)))))
    found = crossed.withColumn("p", F.array(*points)).select(*CELL, "level", F.posexplode(joined).alias("segment", "s"))
    ends_ = [F.round(F.col(f"s.{e}.{x}"), 9).alias(f"{x}{k}") for k, e in ((1, "a"), (2, "b")) for x in "rc"]
    return found.select(*CELL, "level", (F.col("level") % 50 == 0).alias("major"), "segment", *ends_)


def contour_lines(segments: DataFrame) -> DataFrame:
    """Lines ``grid_id, level, line, place, r, c`` of the segments of ``contours``, from end to end or around; a line stops where more than two meet."""
    node = lambda k: F.struct(F.round(f"r{k}", 6).alias("r"), F.round(f"c{k}", 6).alias("c"))
    parts = segments.select("grid_id", F.col("level").cast("long").alias("level"), node(1).alias("a"), node(2).alias("b"))
    return network.merged(parts, ["grid_id", "level"]).select("grid_id", "level", "line", "place", "node.r", "node.c")


def edges(grid: DataFrame, column: str = "class") -> DataFrame:
    """Classes of the cells on both sides of every inner edge, each edge once."""
    pairs = scatter(grid, [(0, 1), (1, 0)], column).withColumnRenamed(column, "other")
    return pairs.join(grid.select(*CELL, column), CELL).select("grid_id", "row", "col", F.col(column).alias("one"), "other")


def class_adjacency(grid: DataFrame, column: str = "class") -> DataFrame:
    return edges(grid, column).groupBy("grid_id", F.least("one", "other").alias("a"), F.greatest("one", "other").alias("b")).agg(F.count("*").alias("n_edges"))


def edge_density(grid: DataFrame, column: str = "class") -> DataFrame:
    return edges(grid, column).groupBy("grid_id").agg(F.count_if(F.col("one") != F.col("other")).alias("n_unlike"), F.count("*").alias("n_edges"), F.round(F.count_if(F.col("one") != F.col("other")) / F.count("*"), 6).alias("density"))


def patches(grid: DataFrame, column: str = "class", offsets: Sequence[tuple[int, int]] = tuple(EIGHT), tile: int = terrain.TILE) -> DataFrame:
    """``grid`` with ``patch``: the least (row, col) of the connected cells of equal class, over the borders of tiles too."""
    return terrain.patches(grid, column, offsets, tile)


def distance_to_segments(grid: DataFrame, segments: DataFrame, x: Column, y: Column) -> DataFrame:
    """Least distance from each cell to ``segments`` (x1, y1, x2, y2), a small table."""
    from lodestrata.functions.geo import segment_distance

    pairs = grid.crossJoin(broadcast_if_small(segments, 10_000))
    return pairs.groupBy(*CELL).agg(F.min(segment_distance(x, y, F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))).alias("distance"))


def nearest_class(grid: DataFrame, anchors: DataFrame, radius: float, wanted, cell: float = 1.0) -> DataFrame:
    """Distance from each anchor (grid_id, row, col) to the nearest cell of a class; beyond ``radius`` only the bound is known."""
    sent = anchors.select(*CELL, F.inline(F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in disc(radius, cell)])))
    looked = sent.select("grid_id", F.col("row").alias("arow"), F.col("col").alias("acol"), (F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col"), (F.sqrt((F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc")).cast("double")) * cell).alias("d"))
    found = looked.join(grid.select(*CELL, "class"), CELL, "left").groupBy("grid_id", "arow", "acol").agg(F.min(F.when(F.col("class") == wanted, F.col("d"))).alias("distance"))
    return found.select("grid_id", F.col("arow").alias("row"), F.col("acol").alias("col"), "distance", F.when(F.col("distance").isNull(), F.lit(float(radius))).alias("distance_lower_bound"))


def focal_share(grid: DataFrame, radius: float, wanted, cell: float = 1.0) -> DataFrame:
    return focal(grid, disc(radius, cell), F.avg((F.col("class") == wanted).cast("double")).alias("share"), columns=("class",))


def zonal(pixels: DataFrame, zone: str, qa_mask: int) -> DataFrame:
    """Vegetation indices of each zone over pixels whose quality bits are clear: means, medians and the valid share."""
    clear = F.col("qa").bitwiseAND(F.lit(qa_mask)) == 0
    ndvi = (F.col("nir") - F.col("red")) / F.nullif(F.col("nir") + F.col("red"), F.lit(0.0))
    evi = 2.5 * (F.col("nir") - F.col("red")) / F.nullif(F.col("nir") + 6 * F.col("red") - 7.5 * F.col("blue") + 1, F.lit(0.0))
    marked = pixels.select(zone, clear.alias("clear"), F.when(clear, ndvi).alias("ndvi"), F.when(clear, evi).alias("evi"))
    middle = percentiles(marked, [zone], "ndvi", {"ndvi_median": 0.5}).select(zone, F.round("ndvi_median", 6).alias("ndvi_median"))
    sums = marked.groupBy(zone).agg(
        F.count("*").alias("n"), F.round(F.count_if("clear") / F.count("*"), 6).alias("valid_fraction"), F.round(F.avg("ndvi"), 6).alias("ndvi_mean"), F.round(F.avg("evi"), 6).alias("evi_mean")
    )
    return with_keys(sums, middle, [zone], "left")


def coverage(samples: DataFrame, keys: Sequence[str], value: str, least: float = 0.70) -> DataFrame:
    """Share of samples with a value, and whether it is enough to go on."""
    return samples.groupBy(*keys).agg(F.round(F.count(value) / F.count("*"), 6).alias("coverage"), (F.count(value) >= least * F.count("*")).alias("sufficient"))


def bilinear(points: DataFrame, grid: DataFrame, x: str, y: str) -> DataFrame:
    """Value at each point from the four cells around it; null where one is missing."""
    r0, c0 = F.floor(F.col(y)), F.floor(F.col(x))
    fy, fx = F.col(y) - r0, F.col(x) - c0
    corner = F.array(*[F.struct(F.lit(r).alias("__r"), F.lit(c).alias("__c")) for r in (0, 1) for c in (0, 1)])
    near = points.select("*", F.inline(corner)).withColumn("row", r0 + F.col("__r")).withColumn("col", c0 + F.col("__c"))
    weight = F.when(F.col("__r") == 1, fy).otherwise(1 - fy) * F.when(F.col("__c") == 1, fx).otherwise(1 - fx)
    joined = near.withColumn("__w", weight).join(grid.select(*CELL, "value"), CELL, "left")
    return joined.groupBy(*points.columns).agg(F.when(F.count("value") == 4, F.sum(F.col("value") * F.col("__w"))).alias("value"))


def windowed_texture(grid: DataFrame, half: int) -> DataFrame:
    """Mean and deviation of square windows from running sums along rows, then along columns."""
    along = lambda key, order: Window.partitionBy("grid_id", key).orderBy(order).rangeBetween(-half, half)
    rows = grid.withColumns({"__s": F.sum("value").over(along("row", "col")), "__q": F.sum(F.col("value") * F.col("value")).over(along("row", "col")), "__n": F.count("value").over(along("row", "col"))})
    sums = rows.withColumns({k: F.sum(k).over(along("col", "row")) for k in ("__s", "__q", "__n")})
    mean = F.col("__s") / F.col("__n")
    return sums.select(*CELL, mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("__q") / F.col("__n") - mean * mean)).alias("std"))


def ground_surface(points: DataFrame, cell: float, reach: int, ground_class: int = 2) -> DataFrame:
    """Mean height of ground points by cell; empty cells with other points take the inverse-distance mean of cells within ``reach``."""
    at = lambda k: F.floor(F.col(k) / cell).alias("row" if k == "y" else "col")
    cells = points.groupBy("grid_id", at("y"), at("x")).agg(F.avg(F.when(F.col("classification") == ground_class, F.col("z"))).alias("value"), F.count("*").alias("n"))
    weight = 1 / F.nullif((F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc")).cast("double"), F.lit(0.0))
    idw = F.sum(F.col("value") * weight) / F.sum(F.when(F.col("value").isNotNull(), weight))
    filled = focal(cells, disc(reach, centre=False), idw.alias("__idw"), columns=("value",))
    return filled.select(*CELL, "n", F.coalesce("value", "__idw").alias("ground"), F.col("value").isNull().alias("filled"))


def height_bands(points: DataFrame, ground: DataFrame, cell: float, bands: Sequence[float]) -> DataFrame:
    """Counts of points by height over ground, and the share of each band."""
    at = points.withColumn("row", F.floor(F.col("y") / cell)).withColumn("col", F.floor(F.col("x") / cell)).join(ground.select(*CELL, "ground"), CELL)
    height = F.col("z") - F.col("ground")
    band = F.lit(0)
    for k, low in enumerate(bands, 1):
        band = F.when(height >= low, k).otherwise(band)
    counted = at.where("ground is not null").groupBy("grid_id", band.alias("band")).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("grid_id")), 6))


def tile_owner(points: DataFrame, keys: Sequence[str], tile: str) -> DataFrame:
    """Points that several tiles hold, once, with the first tile by name."""
    return points.groupBy(*keys).agg(F.min(tile).alias(tile), F.count("*").alias("n_copies"))


def plane_fit(df: DataFrame, keys: Sequence[str], x: str, y: str, z: str) -> DataFrame:
    """Least-squares plane ``z = a + b x + c y`` by the normal equations of centred sums; null where it is not determined."""
    means = df.groupBy(*keys).agg(*[F.avg(c).alias(f"__m{k}") for k, c in zip("xyz", (x, y, z))])
    dev = df.join(means, list(keys)).select(*keys, *[(F.col(c) - F.col(f"__m{k}")).alias(f"__{k}") for k, c in zip("xyz", (x, y, z))], "__mx", "__my", "__mz")
    s = lambda a, b: F.sum(F.col(f"__{a}") * F.col(f"__{b}"))
    sums = dev.groupBy(*keys).agg(s("x", "x").alias("xx"), s("x", "y").alias("xy"), s("y", "y").alias("yy"), s("x", "z").alias("xz"), s("y", "z").alias("yz"), *[F.first(f"__m{k}").alias(f"m{k}") for k in "xyz"])
    det = F.nullif(F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy"), F.lit(0.0))
    b = (F.col("xz") * F.col("yy") - F.col("yz") * F.col("xy")) / det
    c = (F.col("yz") * F.col("xx") - F.col("xz") * F.col("xy")) / det
    return sums.select(*keys, (F.col("mz") - b * F.col("mx") - c * F.col("my")).alias("a"), b.alias("b"), c.alias("c"))


def flood(grid: DataFrame, seeds: DataFrame, barrier: str) -> DataFrame:
    """Cells without a barrier that a seed reaches over the four neighbours."""
    joined = patches(grid.where(~F.col(barrier)).withColumn("__free", F.lit(1)), "__free", FOUR)
    lit = joined.join(seeds.select(*CELL), CELL, "left_semi").select("grid_id", "patch").distinct()
    return joined.join(lit, ["grid_id", "patch"], "left_semi").select(*CELL)


def barrier_buffer(grid: DataFrame, origins: DataFrame, barrier: str, radius: float, cell: float = 1.0) -> DataFrame:
    """``id, grid_id, row, col``: cells within ``radius`` of an origin (``id, grid_id, row, col``) that hang together with it without a barrier.

    A buffer, less the barriers, of which the part that touches the origin stays. An origin on a barrier has no cells. One
    origin's buffer is a group, so groups are bounded by ``radius``.
    """
    steps = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in disc(radius, cell)])
    spread = origins.select(F.col("id").cast("long").alias("id"), *CELL).withColumn("__at", F.explode(steps))
    around = spread.select("id", "grid_id", (F.col("row") + F.col("__at.r")).alias("row"), (F.col("col") + F.col("__at.c")).alias("col"))
    free = around.join(grid.where(~F.coalesce(F.col(barrier), F.lit(False))).select(*CELL), CELL)
    joined = patches(free.select(F.col("id").alias("grid_id"), "row", "col", F.lit(1).alias("__free")), "__free", FOUR).withColumnRenamed("grid_id", "id")
    own = joined.join(origins.select(F.col("id").cast("long").alias("id"), "row", "col", "grid_id"), ["id", "row", "col"]).select("id", "grid_id", "patch")
    return joined.join(own, ["id", "patch"]).select("id", *CELL)
