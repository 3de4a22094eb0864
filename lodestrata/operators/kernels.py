"""Sequential kernels, one group (a grid, an iteration) at a time inside ``applyInPandas``.

Each has an inner order that set operations cannot express. A group is one grid tile or one fitted model's
sample; groups are spread over the cluster, and tiles bound their size.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import running, with_keys
from .relational import broadcast_if_small, checkpointed

AROUND = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]


def gathered(to: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """What flows through each cell: its own weight and that of all above it."""
    total, waiting = weight.copy(), np.zeros(len(to), np.int64)
    np.add.at(waiting, to[to >= 0], 1)
    ready = np.flatnonzero(waiting == 0).tolist()
    while ready:
        k = ready.pop()
        below = to[k]
        if below >= 0:
            total[below] += total[k]
            waiting[below] -= 1
            if not waiting[below]:
                ready.append(below)
    return total


def regression_tree(df: DataFrame, key: str, features: Sequence[str], target: str, depth: int = 4, least: int = 100, cuts: int = 9, small: int | None = None) -> DataFrame:
    """Leaves of a least-squares tree for each key: ``rule, n, mean``; thresholds are values at equal ranks of the node.

    All nodes of a level grow at once. Values are counted by (node, feature, value) with their sums of the target, and
    running totals of these give what each cut would leave on its lower side, so no node's rows are gathered. Of cuts that
    are equally good to one in 10^10 of the node's spread, the first by feature and value is taken. Rows with a null take
    no part, a null key is a key.
    """
    known = df.where(" and ".join(f"`{c}` is not null" for c in (*features, target))).select(key, *[F.col(c).cast("double").alias(c) for c in features], F.col(target).cast("double").alias("__y"))
    centres = known.groupBy(key).agg(F.avg("__y").alias("__centre"))
    # Sums of squares about the key's mean keep their digits.
    rows = checkpointed(with_keys(known, centres, [key]).withColumn("__y", F.col("__y") - F.col("__centre")).withColumn("__node", F.lit(1).cast("long")))
    nodes = centres.select(key, F.lit(1).cast("long").alias("__node"), F.lit("").alias("rule"))
    leaves = None
    moments = [F.count("*").alias("__c"), F.sum("__y").alias("__s"), F.sum(F.col("__y") * F.col("__y")).alias("__q")]
    spread = lambda n, s, q: q - s * s / n
    for level in range(depth + 1):
        sums = checkpointed(rows.groupBy(key, "__node").agg(F.count("*").alias("n"), F.sum("__y").alias("s"), F.sum(F.col("__y") * F.col("__y")).alias("q")))
        at = [key, "__node"]
        if level < depth:
            long = rows.select(*at, F.posexplode(F.array(*features)).alias("__f", "__x"), "__y").groupBy(*at, "__f", "__x").agg(*moments)
            run = running(long, [*at, "__f"], ["__x"], {"__c": "__n", "__s": "__t", "__q": "__u"}, small)
            placed = with_keys(run, sums, at)
            rank = F.array(*[F.floor((F.col("n") - 1) * k / (cuts + 1)) for k in range(1, cuts + 1)])
            is_cut = F.exists(rank, lambda r: (r >= F.col("__n") - F.col("__c")) & (r < F.col("__n")))
            cost = spread(F.col("__n"), F.col("__t"), F.col("__u")) + spread(F.col("n") - F.col("__n"), F.col("s") - F.col("__t"), F.col("q") - F.col("__u"))
            whole = spread(F.col("n"), F.col("s"), F.col("q"))
            tried = placed.where(is_cut & (F.col("__n") >= least) & (F.col("n") - F.col("__n") >= least)).withColumn("__share", F.round(cost / F.nullif(whole, F.lit(0.0)), 10))
            best = tried.where("__share < 1").groupBy(*at).agg(F.min(F.struct("__share", "__f", "__x")).alias("__best"))
            split = checkpointed(best.select(*at, F.col("__best.__f").alias("__cut_f"), F.col("__best.__x").alias("__cut_x")))
        else:
            split = sums.limit(0).select(*at, F.lit(0).alias("__cut_f"), F.lit(0.0).alias("__cut_x"))
        grown = with_keys(sums, nodes, at)
        grown = checkpointed(with_keys(grown, split, at, "left"))
        done = with_keys(grown.where("__cut_f is null"), centres, [key]).select(key, F.when(F.col("rule") == "", "all").otherwise(F.col("rule")).alias("rule"), "n", (F.col("s") / F.col("n") + F.col("__centre")).alias("mean"))
        leaves = done if leaves is None else leaves.unionByName(done)
        going = grown.where("__cut_f is not null")
        if level == depth or going.isEmpty():
            return leaves
        name = F.get(F.array(*[F.lit(f) for f in features]), F.col("__cut_f"))
        side = lambda sign: F.concat(F.col("rule"), F.when(F.col("rule") == "", "").otherwise(" and "), name, F.lit(f" {sign} "), F.format_string("%s", F.col("__cut_x")))
        both = F.array(F.struct((F.col("__node") * 2).alias("node"), side("<=").alias("rule")), F.struct((F.col("__node") * 2 + 1).alias("node"), side(">").alias("rule")))
        nodes = checkpointed(going.select(key, F.explode(both).alias("c")).select(key, F.col("c.node").alias("__node"), F.col("c.rule").alias("rule")))
        split = going.select(*at, "__cut_f", "__cut_x")
        value = F.get(F.array(*features), F.col("__cut_f"))
        moved = with_keys(rows, broadcast_if_small(split), at)
        rows = checkpointed(moved.withColumn("__node", F.col("__node") * 2 + F.when(value <= F.col("__cut_x"), 0).otherwise(1)).select(*rows.columns))
    return leaves


def quadratic(df: DataFrame, features: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """``df`` with the squares and products of ``features``, and the names of all of them."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i:]]
    return df.withColumns({f"{a}*{b}": F.col(a).cast("double") * F.col(b) for a, b in pairs}), [*features, *(f"{a}*{b}" for a, b in pairs)]


def ridge(df: DataFrame, features: Sequence[str], target: str, penalty: float, folds: str | None = None) -> dict:
    """Standardised ridge coefficients, and with ``folds`` the error on each left-out fold.

    The cluster adds up counts, sums and products, one row a fold; the driver solves systems of the size of
    ``features``.
    """
    columns = [*features, target]
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    c = [F.col(x).cast("double") for x in columns]
    known = df.where(" and ".join(f"`{x}` is not null" for x in columns))
    sums = known.groupBy(F.col(folds) if folds else F.lit("all")).agg(F.count("*"), *[F.sum(x) for x in c], *[F.sum(c[i] * c[j]) for i, j in pairs]).collect()
    parts = {r[0]: np.array([float(v) for v in r[1:]]) for r in sums}

    def moments(total: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        k = len(columns)
        products = np.zeros((k, k))
        for (i, j), v in zip(pairs, total[1 + k :]):
            products[i, j] = products[j, i] = v
        return total[0], total[1 : 1 + k] / total[0], products / total[0]

    def solve(total: np.ndarray) -> tuple[np.ndarray, float]:
        n, mean, product = moments(total)
        cov = product - np.outer(mean, mean)
        scale = np.sqrt(np.maximum(np.diag(cov), 1e-300))
        corr = cov / np.outer(scale, scale)
        beta = np.linalg.solve(corr[:-1, :-1] + penalty / n * np.eye(len(features)), corr[:-1, -1])
        raw = beta * scale[-1] / scale[:-1]
        return raw, float(mean[-1] - raw @ mean[:-1])

    whole = sum(parts.values())
    raw, intercept = solve(whole)
    out = {"coefficients": dict(zip(features, raw.tolist())), "intercept": intercept, "n": int(whole[0])}
    if folds:
        out["fold_mse"], out["fold_coefficients"] = {}, {}
        for fold, part in parts.items():
            b, a = solve(whole - part)
            out["fold_coefficients"][fold] = b.tolist()
            _, mean, product = moments(part)
            w = np.r_[-b, 1.0]
            out["fold_mse"][fold] = float(w @ product @ w - 2 * a * (w @ mean) + a * a)
    return out


def permutation_null(df: DataFrame, x: str, y: str, block: str, scales: Sequence[int], iterations: int = 99, seed: int = 1, small: int | None = None) -> DataFrame:
    """``scale, r, p``: correlation of block means against block means shuffled as runs of ``scale`` blocks.

    Runs take each other's places by the rank of a hash of (seed, scale, iteration, run), whole ones among themselves; a
    shorter last one stays. Correlations come from sums of products over the joined blocks, so no group holds the blocks.
    """
    means = df.groupBy(block).agg(F.avg(x).alias("x"), F.avg(y).alias("y"))
    numbered = running(means.withColumn("one", F.lit(1).cast("long")), [], [block], {"one": "place"}, small)
    blocks = checkpointed(numbered.select((F.col("place") - 1).alias("place"), "x", "y"))
    whole = blocks.agg(F.count("*").alias("n"), F.corr("x", "y").alias("r"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy")).first()
    spark, n = df.sparkSession, whole["n"]
    if not n or not whole["sx"] or not whole["sy"]:
        return spark.createDataFrame([], "scale int, r double, p double")
    tried = F.explode(F.array(*[F.lit(s) for s in scales]))
    runs = blocks.select("place", tried.alias("scale")).where(F.col("place") % F.col("scale") == 0).select("scale", F.floor(F.col("place") / F.col("scale")).alias("run"), (F.col("place") + F.col("scale") <= n).alias("full"))
    drawn = runs.withColumn("iteration", F.explode(F.sequence(F.lit(1), F.lit(iterations)))).withColumn("draw", F.when(F.col("full"), F.xxhash64(F.lit(seed), "scale", "iteration", "run")).otherwise((1 << 63) - 1)).withColumn("one", F.lit(1).cast("long"))
    # The run whose draw has rank k goes where run k was; the short one has the last rank and place.
    ranked = running(drawn, ["scale", "iteration"], ["draw", "run"], {"one": "rank"}, small)
    dealt = ranked.select("scale", "iteration", "run", (F.col("rank") - 1).alias("to"))
    here = blocks.select("place", "y", tried.alias("scale")).withColumn("run", F.floor(F.col("place") / F.col("scale")))
    moved = here.join(dealt, ["scale", "run"]).select("scale", "iteration", (F.col("to") * F.col("scale") + F.col("place") % F.col("scale")).alias("place"), "y")
    products = moved.join(blocks.select("place", "x"), "place").groupBy("scale", "iteration").agg(F.sum((F.col("x") - whole["mx"]) * (F.col("y") - whole["my"])).alias("xy"))
    r0 = whole["r"]
    beyond = F.count_if(F.abs(F.col("xy") / (n * whole["sx"] * whole["sy"])) >= abs(r0) - 1e-12)
    return products.groupBy("scale").agg(F.lit(r0).alias("r"), ((beyond + 1) / (F.count("*") + 1)).alias("p"))


#: Offset and prime of the 32-bit FNV-1a hash, and the state in place of zero.
FNV_OFFSET, FNV_PRIME, NO_STATE = 2166136261, 16777619, 0x9E3779B9


def seed_of(text: str) -> int:
    """FNV-1a over the UTF-16 units of a text, which are its code points but for rare signs."""
    units = np.frombuffer(text.encode("utf-16-le"), "<u2").tolist()
    value = FNV_OFFSET
    for u in units:
        value = (value ^ u) * FNV_PRIME & 0xFFFFFFFF
    return value or NO_STATE


def draws(seed: int):
    """Numbers from 0 up to 1 of the 32-bit xorshift generator with shifts 13, 17, 5."""
    x = seed or NO_STATE
    while True:
        x ^= x << 13 & 0xFFFFFFFF
        x ^= x >> 17
        x ^= x << 5 & 0xFFFFFFFF
        yield x / 4294967296


def _patch_shares(mask: np.ndarray) -> tuple[float, int]:
    """Of the marked cells the share in patches (of eight neighbours) of two or more, and the cells of the largest patch."""
    todo = set(map(tuple, np.argwhere(mask).tolist()))
    cells, many, largest = len(todo), 0, 0
    while todo:
        front, size = [todo.pop()], 0
        while front:
            r, c = front.pop()
            size += 1
            near = [(r + i, c + j) for i, j in AROUND if (r + i, c + j) in todo]
            todo.difference_update(near)
            front += near
        many, largest = many + size * (size > 1), max(largest, size)
    return (many / cells if cells else float("nan")), largest


def _dealt(mask: np.ndarray, block: int, random) -> np.ndarray:
    """``mask`` with its blocks in drawn places; blocks of one shape change places among themselves, shapes in the order in which they are met."""
    shapes: dict[tuple[int, int], list[tuple[slice, slice]]] = {}
    for r in range(0, mask.shape[0], block):
        for c in range(0, mask.shape[1], block):
            part = (slice(r, min(r + block, mask.shape[0])), slice(c, min(c + block, mask.shape[1])))
            shapes.setdefault((part[1].stop - c, part[0].stop - r), []).append(part)
    out = np.zeros_like(mask)
    for places in shapes.values():
        source = list(places)
        for k in range(len(source) - 1, 0, -1):
            swap = int(next(random) * (k + 1))
            source[k], source[swap] = source[swap], source[k]
        for there, here in zip(places, source):
            out[there] = mask[here]
    return out


def patch_null(grid: DataFrame, marked: Column, blocks: Sequence[int] = (3, 4, 6), iterations: int = 99, seed: str = "") -> DataFrame:
    """How patchy the marked cells of each grid are against grids whose square blocks are dealt anew: ``grid_id, block, statistic, observed, null_mean, null_p95, p``.

    Statistics are ``multi_cell_fraction`` and ``largest_patch``. The generator is seeded by ``seed``, grid and block size, so
    a grid has the same null wherever it is computed. A (grid, block size) is a group: one property's raster, whose cells the
    draws of one sequence move.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = pdf.row.to_numpy() - pdf.row.min(), pdf.col.to_numpy() - pdf.col.min()
        mask = np.zeros((int(r.max()) + 1, int(c.max()) + 1), bool)
        mask[r, c] = pdf.marked.to_numpy(bool)
        block, grid_id = int(pdf.block.iloc[0]), int(pdf.grid_id.iloc[0])
        random = draws(seed_of(f"{seed}{grid_id}|block={block}"))
        truth = _patch_shares(mask)
        null = np.array([_patch_shares(_dealt(mask, block, random)) for _ in range(iterations)], float).reshape(iterations, 2)
        out = []
        for k, name in enumerate(("multi_cell_fraction", "largest_patch")):
            found = np.sort(null[:, k][~np.isnan(null[:, k])])
            some = len(found) > 0
            out.append((grid_id, block, name, None if np.isnan(truth[k]) else float(truth[k]), float(found.mean()) if some else None, float(np.quantile(found, 0.95)) if some else None, float(((found >= truth[k]).sum() + 1) / (iterations + 1))))
        return pd.DataFrame(out, columns=["grid_id", "block", "statistic", "observed", "null_mean", "null_p95", "p"])

    cells = grid.select("grid_id", "row", "col", F.coalesce(marked, F.lit(False)).alias("marked"), F.explode(F.array(*[F.lit(b) for b in blocks])).alias("block"))
    return cells.groupBy("grid_id", "block").applyInPandas(run, "grid_id long, block int, statistic string, observed double, null_mean double, null_p95 double, p double")
