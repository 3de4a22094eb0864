"""Kernels that SQL cannot express, against plain versions over the whole table."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import grid as G
from lodestrata.operators import terrain as T
from lodestrata.plans import catalog, q_grid

AROUND = [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1) if r or c]


def grids(rows, value="value"):
    out = collections.defaultdict(dict)
    for r in rows:
        out[r["grid_id"]][r["row"], r["col"]] = r[value]
    return out


@pytest.fixture(scope="module")
def heights(spark, sf_dir):
    return grids(q_grid.heights(spark, sf_dir).collect())


def test_contour_lines_use_every_segment_once(spark, sf_dir):
    rough = q_grid.tiles(spark, sf_dir).withColumn("value", F.pmod(F.xxhash64("row", "col"), F.lit(97)).cast("double"))
    segments = G.contours(rough).collect()
    key = lambda r, c: (round(r, 6), round(c, 6))
    want = collections.Counter()
    for s in segments:
        a, b = key(s["r1"], s["c1"]), key(s["r2"], s["c2"])
        if a != b:
            want[s["grid_id"], int(s["level"]), frozenset((a, b))] += 1
    lines, found = collections.defaultdict(dict), collections.Counter()
    for r in G.contour_lines(G.contours(rough)).collect():
        lines[r["grid_id"], r["level"], r["line"]][r["place"]] = key(r["r"], r["c"])
    degree = collections.Counter()
    for (grid, level, pair), n in want.items():
        for p in pair:
            degree[grid, level, p] += n
    for (grid, level, _), at in lines.items():
        line = [at[k] for k in range(len(at))]
        for p, q in zip(line, line[1:]):
            found[grid, level, frozenset((p, q))] += 1
        assert line[0] == line[-1] or degree[grid, level, line[0]] != 2 != degree[grid, level, line[-1]]
        assert all(degree[grid, level, p] == 2 for p in line[1:-1])
    assert found == want and len(segments) > 100
    for s in segments:
        assert all(-1e-9 <= s[f"{x}{k}"] - s[of] <= 1 + 1e-9 for x, of in (("r", "row"), ("c", "col")) for k in (1, 2))


def plain_routes(height):
    """Filled heights by repeated relaxation, and that every way to ``to`` leads down or along a flat to the rim."""
    rim = {k for k in height if any((k[0] + i, k[1] + j) not in height for i, j in AROUND)}
    filled = {k: height[k] if k in rim else math.inf for k in height}
    changed = True
    while changed:
        changed = False
        for k in height:
            low = min([filled[k[0] + i, k[1] + j] for i, j in AROUND if (k[0] + i, k[1] + j) in filled] or [math.inf])
            new = max(height[k], low)
            if k not in rim and new < filled[k]:
                filled[k] = new
                changed = True
    return filled, rim


def test_water_leaves_by_the_filled_surface(spark, sf_dir, heights):
    cells = grids(catalog.queries()["X08_flow_accumulation"](spark, sf_dir).collect(), "cells")
    anatomy = collections.defaultdict(list)
    for r in catalog.queries()["X09_terrain_anatomy"](spark, sf_dir).collect():
        anatomy[r["grid_id"]].append(r)
    paths = collections.defaultdict(dict)
    for r in catalog.queries()["X10_flow_paths"](spark, sf_dir).collect():
        paths[r["grid_id"], r["path"]][r["step"]] = (r["row"], r["col"])
    ways = {(r["grid_id"], (r["row"], r["col"])): (r["filled"], r["to"]) for r in T.directions(T.fill(q_grid.heights(spark, sf_dir))).collect()}
    for g, height in heights.items():
        filled, rim = plain_routes(height)
        below = {}
        for a in height:
            level, to = ways[g, a]
            assert level == filled[a]
            near = {(a[0] + i, a[1] + j): (filled[a] - filled[a[0] + i, a[1] + j]) / math.hypot(i, j) for i, j in AROUND if (a[0] + i, a[1] + j) in filled}
            steepest = max(near.values())
            if to is None:
                assert a in rim and steepest <= 0
            else:
                below[a] = (a[0] + AROUND[to][0], a[1] + AROUND[to][1])
                assert near[below[a]] == steepest if steepest > 0 else near[below[a]] == 0
        want = collections.Counter()
        for a in height:
            seen = set()
            while a is not None:
                assert a not in seen
                seen.add(a)
                want[a] += 1
                a = below.get(a)
        assert dict(want) == cells[g]
        inside = {k for k in height if 3 <= k[0] <= 16 and 2 <= k[1] <= 15}
        exits = collections.Counter()
        for a in inside:
            while a is not None and a in inside:
                a = below.get(a)
            exits[a] += a is not None
        exits.pop(None, None)
        label = {k: k for k in exits}
        for _ in exits:
            for a in exits:
                label[a] = min(label[b] for b in exits if max(abs(a[0] - b[0]), abs(a[1] - b[1])) <= 2)
        groups = collections.defaultdict(list)
        for a, b in label.items():
            groups[b].append(a)
        outlets = {(min(m, key=lambda k: (-exits[k], k)), sum(exits[k] for k in m)) for m in groups.values()}
        found = {((r["row"], r["col"]), r["cells"]) for r in anatomy[g] if r["kind"] == "outlet"}
        assert found == outlets
        for r in anatomy[g]:
            assert r["percent"] == pytest.approx(100 * r["cells"] / len(inside))
            if r["kind"] != "outlet":
                pick = max if r["kind"] == "high" else min
                assert height[r["row"], r["col"]] == pick(height[k] for k in inside)
        heads = [a for a in height if cells[g][a] >= 3 and not any(below.get(b) == a and cells[g][b] >= 3 for b in height)]
        walked = []
        for a in heads:
            walked.append([a])
            while walked[-1][-1] in below:
                walked[-1].append(below[walked[-1][-1]])
        walked.sort(key=lambda p: (-len(p), p[0]))
        assert [[paths[g, n][k] for k in range(len(paths[g, n]))] for n in range(min(12, len(walked)))] == walked[:12]


def test_sectors(spark):
    at = lambda x: spark.range(1).select(T.sector(F.lit(float(x[0])), F.lit(float(x[1])))).first()[0]
    assert [at(x) for x in ((0, 0), (0.5, 0), (0.3, 0.3), (0, 0.5), (-0.5, 0), (0, -0.4), (0.3, -0.3))] == ["central", "north", "northeast", "east", "south", "west", "northwest"]


def test_horizon_and_visibility(spark, sf_dir, heights):
    horizon = grids(catalog.queries()["X19_horizon"](spark, sf_dir).collect(), "horizon")
    for g, height in heights.items():
        for (r, c), z in height.items():
            for k in range(24):
                turn, best = 2 * math.pi * k / 24, 0.0
                for d in range(1, 7):
                    at = (round(r - d * math.cos(turn)), round(c + d * math.sin(turn)))
                    if at in height:
                        best = max(best, math.degrees(math.atan2(height[at] - z, d * 10.0)))
                assert horizon[g][r, c][k] == pytest.approx(best, abs=1e-9)
    for row in catalog.queries()["X22_visibility"](spark, sf_dir).collect():
        height, r, c = heights[row["grid_id"]], row["row"], row["col"]
        cast = seen = 0
        for k in range(16):
            ray = [(round(r + d * math.sin(k * math.pi / 8)), round(c + d * math.cos(k * math.pi / 8))) for d in range(1, row["reach"] + 1)]
            if all(a in height for a in ray):
                slopes = [(height[a] - height[r, c] - row["eye"]) / d for d, a in enumerate(ray, 1)]
                cast, seen = cast + 1, seen + (slopes[-1] >= max(slopes[:-1], default=-math.inf))
        assert row["visible"] == (pytest.approx(seen / cast) if cast else None)


def test_exposure_adds_up_a_day(spark, sf_dir, heights):
    """A few cells, with the sun of the tested position function and a plain integral over the day."""
    from lodestrata.functions import solar

    at = F.explode(F.sequence(F.lit("2024-06-21 00:00:00").cast("timestamp_ntz"), F.lit("2024-06-21 23:45:00").cast("timestamp_ntz"), F.expr("interval 15 minutes")))
    sun = [tuple(r) for r in spark.range(1).select(at.alias("at")).select(*solar.position(F.col("at"), F.lit(40.0), F.lit(-86.0))).collect()]
    for row in catalog.queries()["X20_X21_exposure"](spark, sf_dir).collect()[:60]:
        height, r, c = heights[row["grid_id"]], row["row"], row["col"]
        angles = []
        for k in range(24):
            turn = 2 * math.pi * k / 24
            near = [(d, (round(r - d * math.cos(turn)), round(c + d * math.sin(turn)))) for d in range(1, 5)]
            angles.append(max([0.0, *(math.degrees(math.atan2(height[a] - height[r, c], d * 10.0)) for d, a in near if a in height)]))
        total = 0.0
        for zenith, azimuth in sun:
            low, share = int(azimuth // 15), azimuth % 15 / 15
            if zenith < 90 and 90 - zenith > angles[low % 24] * (1 - share) + angles[(low + 1) % 24] * share:
                z, s = math.radians(zenith), math.radians(20)
                total += max(0.0, math.cos(z) * math.cos(s) + math.sin(z) * math.sin(s) * math.cos(math.radians(azimuth - c % 4 * 90))) * 0.8 * 0.9
        assert row["sun_hours"] == pytest.approx(total / 4, abs=1e-5)


def plain_tree(rows, depth, least, cuts=9):
    """Leaves (bounds by feature, n, mean) of a least-squares tree, by trying every cut of every feature."""
    features = len(rows[0]) - 1
    spread = lambda part: sum((r[-1] - sum(q[-1] for q in part) / len(part)) ** 2 for r in part) if len(part) < 2 else float(np.var([r[-1] for r in part])) * len(part)
    best = None
    if depth and len(rows) >= 2 * least:
        for f in range(features):
            ordered = sorted(r[f] for r in rows)
            for cut in sorted({ordered[(len(ordered) - 1) * k // (cuts + 1)] for k in range(1, cuts + 1)}):
                low, high = [r for r in rows if r[f] <= cut], [r for r in rows if r[f] > cut]
                if len(low) >= least and len(high) >= least:
                    cost = spread(low) + spread(high)
                    if best is None or cost < best[0] - 1e-9:
                        best = (cost, low, high)
    if best is None or best[0] >= spread(rows) - 1e-9:
        return [(len(rows), sum(r[-1] for r in rows) / len(rows))]
    return plain_tree(best[1], depth - 1, least, cuts) + plain_tree(best[2], depth - 1, least, cuts)


def test_regression_tree(spark, sf_dir):
    found, rows = collections.defaultdict(list), collections.defaultdict(list)
    for r in catalog.queries()["R26_regression_tree"](spark, sf_dir).collect():
        found[r[0]].append((r["n"], round(r["mean"], 3)))
    for r in spark.read.parquet(f"{sf_dir}/customer.parquet").collect():
        rows[r["c_mktsegment"]].append((r["c_nationkey"], r["c_custkey"], r["c_acctbal"]))
    assert found.keys() == rows.keys()
    for key, part in rows.items():
        got, want = sorted(found[key]), sorted(plain_tree(part, 3, 20))
        assert [n for n, _ in got] == [n for n, _ in want]
        assert [m for _, m in got] == pytest.approx([m for _, m in want], abs=0.01)


def test_permutation_null(spark, sf_dir):
    """The correlation of block means by hand, and its place among plain shuffles of runs of blocks."""
    blocks = collections.defaultdict(list)
    for r in spark.read.parquet(f"{sf_dir}/part.parquet").collect():
        blocks[r["p_partkey"] // 20].append((r["p_size"], r["p_retailprice"]))
    x, y = (np.array([np.mean([v[k] for v in blocks[b]]) for b in sorted(blocks)]) for k in (0, 1))
    truth = float(np.corrcoef(x, y)[0, 1])
    for r in catalog.queries()["R27_permutation_null"](spark, sf_dir).collect():
        assert r["r"] == pytest.approx(truth)
        draw, beyond = np.random.default_rng(5), 0
        for _ in range(2000):
            runs = [y[k : k + r["scale"]] for k in range(0, len(y), r["scale"])]
            shuffled = np.concatenate([runs[k] for k in draw.permutation(len(runs))])
            beyond += abs(np.corrcoef(x, shuffled)[0, 1]) >= abs(truth) - 1e-12
        share = beyond / 2000
        assert abs(r["p"] - share) <= 5 * math.sqrt(max(share * (1 - share), 0.01) / 100)


def plain_generator(seed):
    while True:
        seed = (seed ^ seed << 13) & 0xFFFFFFFF
        seed ^= seed >> 17
        seed = (seed ^ seed << 5) & 0xFFFFFFFF
        yield seed / 2**32


def test_patch_null(spark, sf_dir):
    """Statistics of every dealing by hand, with hash and generator written out."""
    masks = collections.defaultdict(dict)
    for r in q_grid.tiles(spark, sf_dir).collect():
        masks[r["grid_id"]][r["row"], r["col"]] = r["class"] == 2

    def shares(mask):
        left, sizes = {k for k, on in mask.items() if on}, []
        while left:
            front, n = [left.pop()], 0
            while front:
                r, c = front.pop()
                n += 1
                for i, j in AROUND:
                    if (r + i, c + j) in left:
                        left.remove((r + i, c + j))
                        front.append((r + i, c + j))
            sizes.append(n)
        return sum(n for n in sizes if n > 1) / sum(sizes), max(sizes)

    found = {(r["grid_id"], r["block"], r["statistic"]): r for r in catalog.queries()["R27_patch_null"](spark, sf_dir).collect()}
    assert len(found) == 6 * len(masks)
    for g, mask in masks.items():
        rows, cols = max(k[0] for k in mask) + 1, max(k[1] for k in mask) + 1
        for block in (3, 4, 6):
            seed = 2166136261
            for letter in f"parts|{g}|block={block}":
                seed = (seed ^ ord(letter)) * 16777619 % 2**32
            draw, null = plain_generator(seed), []
            for _ in range(99):
                kinds = {}
                for r in range(0, rows, block):
                    for c in range(0, cols, block):
                        kinds.setdefault((min(block, cols - c), min(block, rows - r)), []).append((r, c))
                moved = {}
                for (w, h), places in kinds.items():
                    order = list(range(len(places)))
                    for k in reversed(range(1, len(order))):
                        swap = math.floor(next(draw) * (k + 1))
                        order[k], order[swap] = order[swap], order[k]
                    for (r, c), k in zip(places, order):
                        moved |= {(r + i, c + j): mask.get((places[k][0] + i, places[k][1] + j), False) for i in range(h) for j in range(w)}
                null.append(shares(moved))
            for k, name in enumerate(("multi_cell_fraction", "largest_patch")):
                row, values = found[g, block, name], [x[k] for x in null]
                assert row["observed"] == pytest.approx(shares(mask)[k])
                assert (row["null_mean"], row["null_p95"]) == (pytest.approx(np.mean(values)), pytest.approx(np.quantile(values, 0.95)))
                assert row["p"] == pytest.approx((sum(v >= shares(mask)[k] for v in values) + 1) / 100)
