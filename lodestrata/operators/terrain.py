"""Terrain over tiles: depression filling, flow, horizons, visibility and patches that do not stop at a tile's border.

A grid is cut into square tiles, one tile a task's group; what neighbouring tiles have to tell each other is small:

* Filling. A cell is filled to the lowest pass on its way out, and passes along a least spanning tree are the lowest. Each
  tile sends up the tree that its border cells leave of its own, regions of ``JOINED`` by ``JOINED`` tiles join those over
  their inner borders and send up what their own borders leave, until one region is the grid. Going down, each
  region tells its parts the levels on their borders, and each tile is flooded from there. A group holds a tile, or borders:
  the last one about 32 times the square root of the grid's cells.
* Directions. Water goes to the steepest lower neighbour on the filled surface; on flats to a neighbour one step nearer to
  where the flat drains. Steps are counted tile by tile with a strip of one cell from the neighbours, again until none
  changes, so rounds are the tiles that a flat crosses.
* Accumulation. A tile knows where what enters at its border leaves it. Cells that leave tiles make a forest in which
  sums go up in doubling steps; then each tile adds what enters.
* Horizons and sight lines look only so far, so a tile gets the strip of its neighbours within reach.
* Patches. Tiles label their own; labels that meet at borders are joined as connected components.

Grids are rows ``grid_id, row, col, value``, one for each cell; a cell that is missing or has no value lets water out.
All results are the same for any size of tiles.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import connected_components, summed_down, summed_up
from .kernels import AROUND, gathered
from .relational import checkpointed, top_n

TILE = 256
JOINED = 4
CELL = ["grid_id", "row", "col"]
TILES = ["grid_id", "tr", "tc"]
_OUT = -1


def tiled(grid: DataFrame, tile: int) -> DataFrame:
    return grid.withColumns({"tr": F.floor(F.col("row") / tile), "tc": F.floor(F.col("col") / tile)})


def on_border(tile: int) -> Column:
    """Whether a cell lies on the border of its tile."""
    edge = lambda c: F.pmod(F.col(c), F.lit(tile)).isin(0, tile - 1)
    return edge("row") | edge("col")


def with_strip(grid: DataFrame, tile: int, reach: int) -> DataFrame:
    """``grid`` with every cell sent to each tile that it lies in or within ``reach`` cells of; ``own`` tells the first."""
    spans = {k: F.explode(F.sequence(F.floor((F.col(c) - reach) / tile), F.floor((F.col(c) + reach) / tile))) for k, c in (("tr", "row"), ("tc", "col"))}
    sent = grid.withColumn("tr", spans["tr"]).withColumn("tc", spans["tc"])
    return sent.withColumn("own", (F.col("tr") == F.floor(F.col("row") / tile)) & (F.col("tc") == F.floor(F.col("col") / tile)))


def matrix(pdf: pd.DataFrame, column: str, pad: int = 0, kind: type = float, none=np.nan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cells of ``pdf`` as a matrix, ``none`` where there are none, with ``pad`` cells around, and the place of each row in it."""
    r, c = pdf.row.to_numpy() - int(pdf.row.min()) + pad, pdf.col.to_numpy() - int(pdf.col.min()) + pad
    out = np.full((int(r.max()) + pad + 1, int(c.max()) + pad + 1), none, kind)
    out[r, c] = pdf[column].to_numpy()
    return out, r, c


def apart(df: DataFrame) -> DataFrame:
    """``df`` with columns of its own, for a cogroup with a frame that it comes from."""
    return df.toDF(*[f"__{c}" for c in df.columns]).toDF(*df.columns)


# --- filling ---


def spanning(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Places of the edges of a least spanning forest over nodes 0, 1, …; of equal edges the first are taken."""
    root = list(range(int(max(a.max(initial=-1), b.max(initial=-1))) + 1))
    kept = []
    for k in np.argsort(w, kind="stable").tolist():
        x, y = int(a[k]), int(b[k])
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        while root[y] != y:
            root[y] = root[root[y]]
            y = root[y]
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append(k)
    return np.array(kept, np.int64)


def passes(a: np.ndarray, b: np.ndarray, w: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges that leave the lowest pass between any two of the nodes ``keep`` as it is, few beyond their number.

    Of a least spanning tree, branches without such a node are cut off and nodes in the middle of a way are left out.
    """
    kept = spanning(a, b, w)
    near: dict[int, dict[int, float]] = {}
    for x, y, v in zip(a[kept].tolist(), b[kept].tolist(), w[kept].tolist()):
        near.setdefault(x, {})[y] = v
        near.setdefault(y, {})[x] = v
    stay = set(keep.tolist())
    todo = [x for x in near if len(near[x]) <= 2 and x not in stay]
    while todo:
        x = todo.pop()
        if x in stay or x not in near or len(near[x]) > 2:
            continue
        ends = list(near.pop(x).items())
        for y, _ in ends:
            del near[y][x]
        if len(ends) == 2:
            (y, v), (z, u) = ends
            near[y][z] = near[z][y] = max(u, v)
        todo += [y for y, _ in ends if len(near[y]) <= 2]
    found = [(x, y, v) for x, to in near.items() for y, v in to.items() if x < y]
    x, y, v = zip(*found) if found else ((), (), ())
    return np.array(x, np.int64), np.array(y, np.int64), np.array(v, float)


def levels_out(a: np.ndarray, b: np.ndarray, w: np.ndarray, out: int, n: int) -> np.ndarray:
    """The lowest pass from each node to node ``out``."""
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for x, y, v in zip(a.tolist(), b.tolist(), w.tolist()):
        near[x].append((y, v))
        near[y].append((x, v))
    level, heap = [math.inf] * n, [(-math.inf, out)]
    level[out] = -math.inf
    while heap:
        at, x = heapq.heappop(heap)
        if at > level[x]:
            continue
        for y, v in near[x]:
            if max(at, v) < level[y]:
                level[y] = max(at, v)
                heapq.heappush(heap, (level[y], y))
    return np.array(level)


def _neighbours(height: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat places of neighbouring cells with values, each pair once, and the level of the pass between them."""
    rows, cols = height.shape
    index = np.arange(rows * cols).reshape(rows, cols)
    found = []
    for i, j in AROUND[4:]:
        here = (slice(0, rows - i), slice(max(0, -j), cols - max(0, j)))
        there = (slice(i, rows), slice(max(0, j), cols - max(0, -j)))
        over = np.maximum(height[here], height[there]).ravel()
        ok = ~np.isnan(over)
        found.append((index[here].ravel()[ok], index[there].ravel()[ok], over[ok]))
    return tuple(np.concatenate(x) for x in zip(*found))


_GRAPH = "grid_id long, tr long, tc long, a long, b long, w double"


def _graph_rows(key: tuple, node: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, rim: np.ndarray, height: np.ndarray) -> pd.DataFrame:
    """Edges ``a, b, w`` and, with ``a = b``, the nodes on the border with their heights; ``node`` names places."""
    ends = np.concatenate([a, rim]), np.concatenate([b, rim])
    return pd.DataFrame({"grid_id": key[0], "tr": key[1], "tc": key[2], "a": node[ends[0]], "b": node[ends[1]], "w": np.concatenate([w, height])})


def open_cells(grid: DataFrame) -> DataFrame:
    """``grid`` with ``open``: whether a cell lets water out, as one of its eight neighbours is missing."""
    steps = F.array(*[F.struct(F.lit(r).alias("__r"), F.lit(c).alias("__c")) for r, c in AROUND])
    there = grid.where("value is not null and not isnan(value)")
    near = there.select(*CELL, F.inline(steps)).select("grid_id", (F.col("row") + F.col("__r")).alias("row"), (F.col("col") + F.col("__c")).alias("col"))
    return there.join(near.groupBy(*CELL).count(), CELL, "left").select(*grid.columns, (F.coalesce("count", F.lit(0)) < 8).alias("open"))


def fill(grid: DataFrame, tile: int = TILE, joined: int = JOINED) -> DataFrame:
    """``grid_id, row, col, value, open, filled``: every pit raised to its lowest way out."""
    known = grid.select("grid_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("value").cast("double").alias("value"))
    cells = checkpointed(tiled(open_cells(known), tile))
    extent = cells.agg(*[f(c).alias(f"{n}{c}") for c in ("row", "col", "tr", "tc") for n, f in (("low", F.min), ("high", F.max))]).first()
    if extent["lowrow"] is None:
        return cells.select(*CELL, "value", "open", F.col("value").alias("filled"))
    r0, c0, span = extent["lowrow"], extent["lowcol"], extent["highcol"] - extent["lowcol"] + 1
    # Tiles are counted from the first one, so that regions close over the whole grid.
    place = {"tr": F.col("tr") - extent["lowtr"], "tc": F.col("tc") - extent["lowtc"]}
    cells = cells.withColumns(place)
    top, levels = max(extent["hightr"] - extent["lowtr"], extent["hightc"] - extent["lowtc"]) + 1, 0
    while top > 1:
        top, levels = -(-top // joined), levels + 1
    first_row, first_col = extent["lowtr"] * tile, extent["lowtc"] * tile

    def rim_of(rows: np.ndarray, cols: np.ndarray, level: int) -> np.ndarray:
        size = tile * joined**level
        return ((rows - first_row) % size == 0) | ((rows - first_row) % size == size - 1) | ((cols - first_col) % size == 0) | ((cols - first_col) % size == size - 1)

    def lowest(pdf: pd.DataFrame) -> pd.DataFrame:
        height, r, c = matrix(pdf, "value")
        a, b, w = _neighbours(height)
        at = r * height.shape[1] + c
        free = pdf.open.to_numpy(bool)
        node = np.full(height.size + 1, _OUT)
        node[at] = (pdf.row.to_numpy() - r0) * span + pdf.col.to_numpy() - c0
        out = height.size
        a, b, w = np.concatenate([a, at[free]]), np.concatenate([b, np.full(free.sum(), out)]), np.concatenate([w, pdf.value.to_numpy()[free]])
        rim = at[rim_of(pdf.row.to_numpy(), pdf.col.to_numpy(), 0)]
        a, b, w = passes(a, b, w, np.append(rim, out))
        return _graph_rows((pdf.grid_id.iloc[0], pdf.tr.iloc[0], pdf.tc.iloc[0]), node, a, b, w, rim, height.ravel()[rim])

    def joint(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The nodes of a region, its edges as places, those over inner borders too, and which nodes are cells on borders of its parts, with their heights."""
        names = np.unique(np.append(pdf[["a", "b"]].to_numpy().ravel(), _OUT))
        a, b, w = np.searchsorted(names, pdf.a.to_numpy()), np.searchsorted(names, pdf.b.to_numpy()), pdf.w.to_numpy()
        on_rim = a == b
        rim, height = a[on_rim], w[on_rim]
        high = dict(zip(names[rim].tolist(), height.tolist()))
        part = dict(zip(names[rim].tolist(), zip(pdf.tr[on_rim].tolist(), pdf.tc[on_rim].tolist())))
        extra = []
        for x, z in high.items():
            for i, j in AROUND[4:]:
                if 0 <= x % span + j < span and (y := x + i * span + j) in high and part[y] != part[x]:
                    extra.append((x, y, max(z, high[y])))
        x, y, v = (np.array(e) for e in zip(*extra)) if extra else (np.zeros(0, np.int64),) * 3
        a, b, w = np.concatenate([a[~on_rim], np.searchsorted(names, x)]), np.concatenate([b[~on_rim], np.searchsorted(names, y)]), np.concatenate([w[~on_rim], v])
        return names, a, b, w.astype(float), rim, height

    def upwards(level: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            names, a, b, w, rim, height = joint(pdf)
            outer = rim_of(names[rim] // span + r0, names[rim] % span + c0, level)
            a, b, w = passes(a, b, w, np.append(rim[outer], np.searchsorted(names, _OUT)))
            return _graph_rows((pdf.grid_id.iloc[0], pdf.tr.iloc[0] // joined, pdf.tc.iloc[0] // joined), names, a, b, w, rim[outer], height[outer])

        return run

    parts = lambda x: [F.col("grid_id"), F.floor(F.col("tr") / x).alias("pr"), F.floor(F.col("tc") / x).alias("pc")]
    graphs = [checkpointed(cells.groupBy(*TILES).applyInPandas(lowest, _GRAPH))] if levels else []
    for level in range(1, levels):
        graphs.append(checkpointed(graphs[-1].groupBy(*parts(joined)).applyInPandas(upwards(level), _GRAPH)))

    known_levels = "grid_id long, tr long, tc long, node long, level double"

    def downwards(graph: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        if graph.empty:
            return pd.DataFrame(columns=["grid_id", "tr", "tc", "node", "level"])
        names, a, b, w, rim, _ = joint(graph)
        out = int(np.searchsorted(names, _OUT))
        told = np.searchsorted(names, above.node.to_numpy())
        found = levels_out(np.concatenate([a, told]), np.concatenate([b, np.full(len(told), out)]), np.concatenate([w, above.level.to_numpy()]), out, len(names))
        own = graph[graph.a == graph.b]
        return pd.DataFrame({"grid_id": own.grid_id, "tr": own.tr, "tc": own.tc, "node": own.a, "level": found[np.searchsorted(names, own.a.to_numpy())]})

    above = cells.sparkSession.createDataFrame([], known_levels)
    for graph in reversed(graphs):
        regions = above.select("grid_id", F.col("tr").alias("pr"), F.col("tc").alias("pc"), "node", "level")
        met = graph.groupBy(*parts(joined)).cogroup(regions.groupBy("grid_id", "pr", "pc"))
        above = checkpointed(met.applyInPandas(downwards, known_levels))

    def flooded(pdf: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty:
            return pd.DataFrame(columns=[*CELL, "value", "open", "filled"])
        height, r, c = matrix(pdf, "value", 1)
        level = np.where(np.isnan(height), np.nan, np.inf)
        free = pdf.open.to_numpy(bool)
        level[r[free], c[free]] = height[r[free], c[free]]
        if len(told):
            y, x = told.node.to_numpy() // span + r0 - int(pdf.row.min()) + 1, told.node.to_numpy() % span + c0 - int(pdf.col.min()) + 1
            level[y, x] = np.minimum(level[y, x], told.level.to_numpy())
        heap = [(level[y, x], y, x) for y, x in zip(r.tolist(), c.tolist()) if level[y, x] < math.inf]
        heapq.heapify(heap)
        while heap:
            at, y, x = heapq.heappop(heap)
            if at > level[y, x]:
                continue
            for i, j in AROUND:
                new = max(at, height[y + i, x + j])
                if new < level[y + i, x + j]:
                    level[y + i, x + j] = new
                    heapq.heappush(heap, (new, y + i, x + j))
        return pdf[[*CELL, "value", "open"]].assign(filled=level[r, c])

    return cells.groupBy(*TILES).cogroup(above.groupBy(*TILES)).applyInPandas(flooded, "grid_id long, row long, col long, value double, open boolean, filled double")


# --- directions and accumulation ---


def _steepest(level: np.ndarray, r: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number in ``AROUND`` of the steepest lower neighbour of each place, of equal ones the first, or -1; and the fall. ``level`` is padded."""
    best, to = np.zeros(len(r)), np.full(len(r), -1)
    for k, (i, j) in enumerate(AROUND):
        fall = (level[r, c] - level[r + i, c + j]) / math.hypot(i, j)
        better = fall > best
        best[better], to[better] = fall[better], k
    return to, best


def directions(filled: DataFrame, tile: int = TILE) -> DataFrame:
    """``grid_id, row, col, filled, to``: where the water of each cell of ``fill`` goes, as a number in ``AROUND``; null where it leaves the grid.

    Open cells without a lower neighbour let it out. Other cells without one are flats: they send it one step nearer to
    a cell of the same level that drains, to the first in ``AROUND`` of equally near ones.
    """
    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        level, r, c = matrix(pdf, "filled", 1)
        drains = pdf.open.to_numpy(bool)
        to, _ = _steepest(level, r, c)
        flat = ~drains & (to < 0)
        is_flat = np.zeros(level.shape, bool)
        is_flat[r[flat], c[flat]] = True
        # Cells beside a flat cell of their level count for it, on either side of a tile's border.
        beside = np.zeros(len(pdf), bool)
        for i, j in AROUND:
            beside |= (level[r + i, c + j] == level[r, c]) & is_flat[r + i, c + j]
        own = pdf.own.to_numpy(bool)
        out = pdf.loc[own, [*CELL, "filled"]].assign(to=to[own], flat=flat[own], beside=beside[own])
        return out

    # With two cells around a tile, the flats one cell around it are known.
    sent = with_strip(filled.select(*CELL, "filled", "open"), tile, 2)
    marked = checkpointed(sent.groupBy(*TILES).applyInPandas(first, "grid_id long, row long, col long, filled double, to int, flat boolean, beside boolean"))
    flats = tiled(marked.where("flat or beside").select(*CELL, "filled", F.when(~F.col("flat"), F.lit(0)).cast("long").alias("steps")), tile)

    def counted(pdf: pd.DataFrame, strip: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty:
            return pd.DataFrame(columns=[*CELL, "filled", "steps"])
        both = pd.concat([pdf[[*CELL, "filled", "steps"]], strip[[*CELL, "filled", "steps"]]]) if len(strip) else pdf
        at = dict(zip(zip(both.row.tolist(), both.col.tolist()), both.filled.tolist()))
        steps = {k: s for k, s in zip(zip(both.row.tolist(), both.col.tolist()), both.steps.tolist()) if s == s and s is not None}
        heap = [(s, k) for k, s in steps.items()]
        heapq.heapify(heap)
        while heap:
            s, k = heapq.heappop(heap)
            if s > steps[k]:
                continue
            for i, j in AROUND:
                near = (k[0] + i, k[1] + j)
                if at.get(near) == at[k] and s + 1 < steps.get(near, math.inf):
                    steps[near] = s + 1
                    heapq.heappush(heap, (s + 1, near))
        got = [steps.get(k) for k in zip(pdf.row.tolist(), pdf.col.tolist())]
        return pdf[[*CELL, "filled"]].assign(steps=pd.array(got, "Int64"))

    found, before = flats, None
    while True:
        edge = with_strip(found.where(on_border(tile) & F.col("steps").isNotNull()).select(*CELL, "filled", "steps"), tile, 1).where("not own").drop("own")
        met = flats.groupBy(*TILES).cogroup(apart(edge).groupBy(*TILES)).applyInPandas(counted, "grid_id long, row long, col long, filled double, steps long")
        found = checkpointed(tiled(met, tile))
        # Steps at borders only fall, so equal counts and sums mean that none has changed.
        now = found.where(on_border(tile)).agg(F.count("steps").alias("n"), F.sum("steps").alias("sum")).first()
        if now == before:
            break
        before = now

    def downhill(pdf: pd.DataFrame) -> pd.DataFrame:
        level, r, c = matrix(pdf, "filled", 1)
        steps, _, _ = matrix(pdf, "steps", 1)
        to = np.full(len(pdf), -1)
        for k, (i, j) in reversed(list(enumerate(AROUND))):
            nearer = (level[r + i, c + j] == level[r, c]) & (steps[r + i, c + j] == steps[r, c] - 1)
            to[nearer] = k
        own = pdf.own.to_numpy(bool)
        return pdf.loc[own, CELL].assign(over=to[own])

    sent = with_strip(found.select(*CELL, "filled", "steps"), tile, 1)
    over = sent.groupBy(*TILES).applyInPandas(downhill, "grid_id long, row long, col long, over int")
    joined = marked.join(over, CELL, "left").withColumn("to", F.when(F.col("flat"), F.col("over")).otherwise(F.col("to")))
    return checkpointed(joined.select(*CELL, "filled", F.when(F.col("to") >= 0, F.col("to")).alias("to")))


def _within(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each cell of a tile, the row of ``pdf`` that its water goes to, -1 if none of this tile; and the row and column it goes to."""
    place = dict(zip(zip(pdf.row.tolist(), pdf.col.tolist()), range(len(pdf))))
    step = np.array([*AROUND, (0, 0)])[pdf.to.fillna(len(AROUND)).to_numpy(int)]
    r, c = pdf.row.to_numpy() + step[:, 0], pdf.col.to_numpy() + step[:, 1]
    goes = pdf.to.notna().to_numpy()
    to = np.array([place.get(k, -1) if g else -1 for k, g in zip(zip(r.tolist(), c.tolist()), goes.tolist())], np.int64)
    return to, r, c


def _last(to: np.ndarray) -> np.ndarray:
    """The last place on each way, by doubling."""
    last = np.where(to < 0, np.arange(len(to)), to)
    while True:
        further = last[last]
        if (further == last).all():
            return last
        last = further


def accumulate(ways: DataFrame, weight: str, tile: int = TILE) -> DataFrame:
    """``grid_id, row, col, total``: the ``weight`` (whole numbers) of all cells whose way (``to``, as ``directions`` gives it) comes by a cell, its own included."""
    cells = checkpointed(tiled(ways.select(*CELL, F.col("to").cast("int").alias("to"), F.col(weight).cast("long").alias("weight")), tile))

    def exits(pdf: pd.DataFrame) -> pd.DataFrame:
        to, r, c = _within(pdf)
        total, last = gathered(to, pdf.weight.to_numpy()), _last(to)
        leaves = (to < 0) & pdf.to.notna().to_numpy()
        # A way in from the border of the tile, and the exit that it comes to.
        rim = pdf.row.mod(tile).isin([0, tile - 1]).to_numpy() | pdf.col.mod(tile).isin([0, tile - 1]).to_numpy()
        out = [pdf.loc[leaves, CELL].assign(to_row=r[leaves], to_col=c[leaves], sum=total[leaves], exit=True)]
        through = rim & leaves[last]
        end = last[through]
        out.append(pdf.loc[through, CELL].assign(to_row=pdf.row.to_numpy()[end], to_col=pdf.col.to_numpy()[end], sum=0, exit=False))
        return pd.concat(out)

    found = checkpointed(cells.groupBy(*TILES).applyInPandas(exits, "grid_id long, row long, col long, to_row long, to_col long, sum long, exit boolean"))
    name = lambda r, c: F.struct(F.col("grid_id"), F.col(r).alias("row"), F.col(c).alias("col"))
    through = found.where("not exit").select(name("row", "col").alias("enters"), name("to_row", "to_col").alias("up"))
    leaving = found.where("exit").select(name("row", "col").alias("node"), name("to_row", "to_col").alias("enters"), "sum")
    forest = checkpointed(leaving.join(through, "enters", "left"))
    inflow = summed_up(forest.select("node", "up", "sum"), "sum").join(forest.select("node", "enters"), "node").groupBy("enters").agg(F.sum("sum").alias("inflow"))
    inflow = inflow.select("enters.*", "inflow")

    def finished(pdf: pd.DataFrame) -> pd.DataFrame:
        to, _, _ = _within(pdf)
        return pdf[CELL].assign(total=gathered(to, pdf.weight.to_numpy()))

    loaded = cells.join(inflow, CELL, "left").withColumn("weight", F.col("weight") + F.coalesce("inflow", F.lit(0))).drop("inflow")
    return loaded.groupBy(*TILES).applyInPandas(finished, "grid_id long, row long, col long, total long")


def flow_accumulation(grid: DataFrame, tile: int = TILE) -> DataFrame:
    """``grid_id, row, col, cells``: cells that drain through each cell of the filled surface, itself included."""
    return accumulate(directions(fill(grid, tile), tile).withColumn("one", F.lit(1)), "one", tile).withColumnRenamed("total", "cells")


def flow_paths(grid: DataFrame, least_cells: int, most_paths: int = 12, tile: int = TILE) -> DataFrame:
    """Paths down from the heads of streams of ``least_cells`` or more: ``grid_id, path, step, row, col``, the ``most_paths`` longest of a grid.

    Of equally long ones the first head in row order comes first. Lengths are added over the tiles that a path crosses, in
    doubling steps; only the paths that are returned are walked, a tile a round.
    """
    ways = directions(fill(grid, tile), tile).select(*CELL, "to")
    total = accumulate(ways.withColumn("one", F.lit(1)), "one", tile)
    step = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in AROUND])
    to = F.get(step, F.col("to"))
    onward = ways.where("to is not null").select(*CELL, (F.col("row") + to["r"]).alias("to_row"), (F.col("col") + to["c"]).alias("to_col"))
    streams = checkpointed(total.where(F.col("total") >= least_cells).select(*CELL))
    fed = onward.join(streams, CELL, "left_semi").select("grid_id", F.col("to_row").alias("row"), F.col("to_col").alias("col")).distinct()
    heads = streams.join(fed, CELL, "left_anti").withColumn("head", F.lit(True))
    cells = checkpointed(tiled(ways.join(heads, CELL, "left"), tile))

    def measured(pdf: pd.DataFrame) -> pd.DataFrame:
        """For each head, and each cell at the border of the tile, the exit that it comes to and the cells up to there."""
        to, r, c = _within(pdf)
        last, far = _last(to), np.where(to >= 0, 1, 0)
        jump = to.copy()
        while (jump >= 0).any():
            on = jump >= 0
            far[on], jump[on] = far[on] + far[jump[on]], jump[jump[on]]
        leaves = (to < 0) & pdf.to.notna().to_numpy()
        rim = pdf.row.mod(tile).isin([0, tile - 1]).to_numpy() | pdf.col.mod(tile).isin([0, tile - 1]).to_numpy()
        asked = pdf["head"].notna().to_numpy() | rim
        exits = leaves[last]
        out = pdf.loc[asked, [*CELL, "head"]].assign(cells=far[asked] + 1)
        for name, values in (("at_row", pdf.row.to_numpy()[last]), ("at_col", pdf.col.to_numpy()[last]), ("to_row", r[last]), ("to_col", c[last])):
            out[name] = pd.array(np.where(exits, values, 0)[asked], "Int64")
            out.loc[~exits[asked], name] = pd.NA
        return out

    kinds = "grid_id long, row long, col long, head boolean, cells long, at_row long, at_col long, to_row long, to_col long"
    local = checkpointed(cells.groupBy(*TILES).applyInPandas(measured, kinds))
    name = lambda r, c: F.when(F.col(r).isNotNull(), F.struct(F.col("grid_id"), F.col(r).alias("row"), F.col(c).alias("col")))
    through = local.select(name("row", "col").alias("enters"), name("at_row", "at_col").alias("up"), "cells")
    leaving = local.where("at_row is not null").select(name("at_row", "at_col").alias("node"), name("to_row", "to_col").alias("enters")).distinct()
    beyond = summed_down(leaving.join(through, "enters").select("node", "up", "cells"), "cells").withColumnRenamed("cells", "beyond")
    lengths = local.where("head").withColumn("node", name("at_row", "at_col")).join(beyond, "node", "left").select(*CELL, (F.col("cells") + F.coalesce("beyond", F.lit(0))).alias("cells"))
    chosen = top_n(lengths, ["grid_id"], [F.desc("cells"), F.asc("row"), F.asc("col")], most_paths)
    front = checkpointed(chosen.select(*CELL, (F.col("rank") - 1).alias("path"), F.lit(0).alias("step")))
    walk = "grid_id long, path int, step int, row long, col long, on boolean"

    def walked(pdf: pd.DataFrame, heads: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(pdf) and len(heads):
            to, r, c = _within(pdf)
            goes = pdf.to.notna().to_numpy()
            place = dict(zip(zip(pdf.row.tolist(), pdf.col.tolist()), range(len(pdf))))
            for y, x, path, k in zip(heads.row.tolist(), heads.col.tolist(), heads.path.tolist(), heads.step.tolist()):
                at = place[y, x]
                while at >= 0:
                    out.append((pdf.grid_id.iloc[0], path, k, pdf.row.iloc[at], pdf.col.iloc[at], False))
                    last, at, k = at, to[at], k + 1
                if goes[last]:
                    out.append((pdf.grid_id.iloc[0], path, k, r[last], c[last], True))
        return pd.DataFrame(out, columns=["grid_id", "path", "step", "row", "col", "on"])

    found = None
    while not front.isEmpty():
        here = tiled(front, tile)
        crossed = cells.join(here.select(*[F.col(t).alias(f"__{t}") for t in TILES]).distinct(), [F.col(t) == F.col(f"__{t}") for t in TILES], "left_semi")
        part = checkpointed(crossed.groupBy(*TILES).cogroup(apart(here).groupBy(*TILES)).applyInPandas(walked, walk))
        done = part.where("not on").drop("on")
        found = done if found is None else found.unionByName(done)
        front = part.where("on").select(*CELL, "path", "step")
    return cells.sparkSession.createDataFrame([], "grid_id long, path int, step int, row long, col long") if found is None else found


#: Names of the eight sectors from north, clockwise.
SECTORS = ["north", "northeast", "east", "southeast", "south", "southwest", "west", "northwest"]


def sector(dr: Column, dc: Column, middle: float = 0.12) -> Column:
    """Direction of a place by its offset from the centre in parts of the grid's extent; rows grow to the north."""
    eighth = F.pmod(F.floor(F.pmod(F.degrees(F.atan2(dc, dr)), F.lit(360.0)) / 45 + 0.5), F.lit(8)).cast("int")
    return F.when((F.abs(dr) < middle) & (F.abs(dc) < middle), "central").otherwise(F.get(F.array(*[F.lit(s) for s in SECTORS]), eighth))


def anatomy(grid: DataFrame, near: int = 2, tile: int = TILE) -> DataFrame:
    """Outlets, highest and lowest place of the cells marked ``inside``: ``grid_id, kind, direction, row, col, cells, percent``.

    Water of an inside cell leaves at the first cell outside on its way over the filled surface; cells that leave at
    places within ``near`` rows and columns of each other make one outlet, named by the place that takes most (of equal
    ones the first in row order). ``kind`` is ``outlet``, ``high`` or ``low``; ``percent`` is of the inside cells.
    """
    marks = grid.where("value is not null and not isnan(value)").select(*CELL, F.col("value").cast("double").alias("value"), F.coalesce("inside", F.lit(False)).alias("inside"))
    ways = directions(fill(grid, tile), tile).join(marks, CELL).select(*CELL, F.when(F.col("inside"), F.col("to")).alias("to"), F.col("inside").cast("long").alias("one"))
    leaves = accumulate(ways, "one", tile).join(marks.where("not inside"), CELL).where("total > 0").select(*CELL, F.col("total").alias("cells"))
    leaves = checkpointed(leaves.select(F.struct(*CELL).alias("place"), "cells"))
    around = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in range(-near, near + 1) for c in range(-near, near + 1)])
    beside = leaves.select("place", F.explode(around).alias("d")).select(F.col("place").alias("a"), F.struct(F.col("place.grid_id").alias("grid_id"), (F.col("place.row") + F.col("d.r")).alias("row"), (F.col("place.col") + F.col("d.c")).alias("col")).alias("b"))
    links = beside.join(leaves.select(F.col("place").alias("b")), "b").select("a", "b")
    joined = leaves.join(connected_components(links), F.col("place") == F.col("node"))
    first = lambda order: F.struct(order, -F.col("place.row"), -F.col("place.col"))
    outlets = joined.groupBy("component").agg(F.max_by("place", first(F.col("cells"))).alias("place"), F.sum("cells").alias("cells")).select(F.lit("outlet").alias("kind"), "place", "cells")
    inside = marks.where("inside").withColumn("place", F.struct(*CELL))
    ends = [inside.groupBy("grid_id").agg(F.max_by("place", first(order)).alias("place")).select(F.lit(kind).alias("kind"), "place", F.lit(1).cast("long").alias("cells")) for kind, order in (("high", F.col("value")), ("low", -F.col("value")))]
    found = outlets.unionByName(ends[0]).unionByName(ends[1]).select("kind", "place.*", "cells")
    extent = marks.groupBy("grid_id").agg(F.min("row").alias("r0"), F.min("col").alias("c0"), F.max("row").alias("r1"), F.max("col").alias("c1"), F.count_if("inside").alias("n"))
    share = lambda x, low, high: (F.col(x) - F.col(low) - (F.col(high) - F.col(low)) / 2) / F.greatest(F.lit(1), F.col(high) - F.col(low))
    return found.join(extent, "grid_id").select("grid_id", "kind", sector(share("row", "r0", "r1"), share("col", "c0", "c1")).alias("direction"), "row", "col", "cells", (100 * F.col("cells") / F.col("n")).alias("percent"))


# --- sight ---


def _along(at: np.ndarray, rows: np.ndarray, cols: np.ndarray, dr: float, dc: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in a matrix of the cells ``dr, dc`` away; halves are rounded by the grid's own rows and columns (``at``), not the tile's."""
    return np.rint(at[:, 0] + dr).astype(int) - at[:, 0] + rows, np.rint(at[:, 1] + dc).astype(int) - at[:, 1] + cols


def visible_distance(grid: DataFrame, heights: Sequence[float], reaches: Sequence[int], tile: int = TILE) -> DataFrame:
    """Share of 16 rays along which a target at ground height is seen, by eye height and distance in cells, for every cell.

    A ray counts where all its cells are there; null where none does.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        most, own = max(reaches), pdf.own.to_numpy(bool)
        if not own.any():
            return pd.DataFrame(columns=[*CELL, "eye", "reach", "visible"])
        ground, rows, cols = matrix(pdf, "value", most)
        rows, cols, at = rows[own], cols[own], pdf.loc[own, ["row", "col"]].to_numpy()
        out = []
        for eye in heights:
            cast, seen = {r: np.zeros(len(rows)) for r in reaches}, {r: np.zeros(len(rows)) for r in reaches}
            for angle in np.arange(16) * np.pi / 8:
                steepest, there = np.full(len(rows), -np.inf), np.ones(len(rows), bool)
                for d in range(1, most + 1):
                    y, x = _along(at, rows, cols, d * np.sin(angle), d * np.cos(angle))
                    end = (ground[y, x] - ground[rows, cols] - eye) / d
                    there &= ~np.isnan(end)
                    if d in cast:
                        cast[d] += there
                        seen[d] += there & (end >= steepest)
                    steepest = np.fmax(steepest, end)
            for reach in reaches:
                share = np.divide(seen[reach], cast[reach], out=np.full(len(rows), np.nan), where=cast[reach] > 0)
                out.append(pdf.loc[own, CELL].assign(eye=float(eye), reach=reach, visible=share))
        return pd.concat(out)

    sent = with_strip(grid.select(*CELL, F.col("value").cast("double").alias("value")), tile, max(reaches))
    found = sent.groupBy(*TILES).applyInPandas(run, "grid_id long, row long, col long, eye double, reach int, visible double")
    return found.withColumn("visible", F.nanvl("visible", F.lit(None)))


def horizon(grid: DataFrame, sectors: int, reach: int, cell: float, tile: int = TILE) -> DataFrame:
    """Horizon angle in degrees by sector (from north, clockwise) within ``reach`` cells, as an array for each cell."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.own.to_numpy(bool)
        if not own.any():
            return pd.DataFrame(columns=[*CELL, "horizon"])
        ground, rows, cols = matrix(pdf, "value", reach)
        rows, cols, at = rows[own], cols[own], pdf.loc[own, ["row", "col"]].to_numpy()
        angles = np.zeros((len(rows), sectors))
        for k in range(sectors):
            turn = 2 * np.pi * k / sectors
            for d in range(1, reach + 1):
                y, x = _along(at, rows, cols, -d * np.cos(turn), d * np.sin(turn))
                angles[:, k] = np.fmax(angles[:, k], np.degrees(np.arctan2(ground[y, x] - ground[rows, cols], d * cell)))
        return pdf.loc[own, CELL].assign(horizon=list(angles))

    sent = with_strip(grid.select(*CELL, F.col("value").cast("double").alias("value")), tile, reach)
    return sent.groupBy(*TILES).applyInPandas(run, "grid_id long, row long, col long, horizon array<double>")


# --- patches ---


def patches(grid: DataFrame, column: str, offsets: Sequence[tuple[int, int]], tile: int = TILE) -> DataFrame:
    """``grid`` with ``patch``: the least (row, col) of the connected cells of equal class; nulls are one class."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "col"])
        kind = dict(zip(zip(pdf.row.tolist(), pdf.col.tolist()), [None if pd.isna(x) else x for x in pdf["kind"].tolist()]))
        label: dict[tuple, tuple] = {}
        for start in kind:
            if start in label:
                continue
            label[start], todo = start, [start]
            while todo:
                r, c = todo.pop()
                for dr, dc in offsets:
                    near = (r + dr, c + dc)
                    if near in kind and near not in label and kind[near] == kind[start]:
                        label[near] = start
                        todo.append(near)
        first = [label[k] for k in zip(pdf.row.tolist(), pdf.col.tolist())]
        return pdf[CELL].assign(lr=[f[0] for f in first], lc=[f[1] for f in first])

    own = tiled(grid.select("grid_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col(column).alias("kind")), tile)
    found = own.groupBy(*TILES).applyInPandas(run, "grid_id long, row long, col long, lr long, lc long")
    labelled = checkpointed(own.join(found, CELL).select(*CELL, "tr", "tc", "kind", F.struct("grid_id", F.col("lr").alias("row"), F.col("lc").alias("col")).alias("label")))
    edge = labelled.where(on_border(tile))
    steps = F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in offsets])
    sent = edge.select(F.col("label").alias("a"), F.col("kind").alias("one"), F.col("tr").alias("ar"), F.col("tc").alias("ac"), "grid_id", "row", "col", F.explode(steps).alias("d"))
    sent = sent.select("a", "one", "ar", "ac", "grid_id", (F.col("row") + F.col("d.dr")).alias("row"), (F.col("col") + F.col("d.dc")).alias("col"))
    there = edge.select(*CELL, F.col("label").alias("b"), F.col("kind").alias("other"), "tr", "tc")
    links = sent.join(there, CELL).where(F.col("one").eqNullSafe(F.col("other")) & ((F.col("ar") != F.col("tr")) | (F.col("ac") != F.col("tc")))).select("a", "b").distinct()
    joined = labelled.join(connected_components(links), F.col("label") == F.col("node"), "left")
    least = joined.select(*CELL, F.coalesce("component", "label").alias("of")).select(*CELL, F.struct(F.col("of.row").alias("row"), F.col("of.col").alias("col")).alias("patch"))
    return grid.join(least, CELL)
