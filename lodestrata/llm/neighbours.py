"""Approximate nearest neighbours by collision counting on sorted projections, around the query.

Equal vectors are one entry of the index, with the least ids that hold it. Entries stay in blocks of up to ``BLOCK``; a
block projects its vectors on ``PROJECTIONS`` random lines and keeps, for each line, the projections in order. A query
opens on each line a window about its own projection and counts in how many windows a vector stands. Windows of radius R
reach ``WIDTH / 2 * R`` to both sides. Two vectors R apart share one with the probability that a normal deviate is within
``WIDTH / 2``, so a vector at distance R or less reaches ``threshold()`` collisions nearly always; such vectors are
verified by their exact distance. Virtual rehashing widens the windows by ``GROWTH`` and counts only what is new, until the
kth distance found is within R.

First every query is searched in the block it stands in, which bounds its kth distance. Then groups of queries of at most
``GROUP_BYTES`` go out to all blocks, whose radii end at that bound or at the best kth distance of the task; index
blocks never move. All vectors are indexed, and nothing is fitted. Distances are exact, so errors are missing neighbours
only.

Defined results: vectors that are null, empty or zero, or hold a null or non-finite component, take no part, nor do rows
with a null id; vectors of different lengths are not compared; rows that repeat an id are each a candidate and each a
query, and only a query's own row is not a candidate of it; fewer than k candidates are all returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import partitions_for, release, remove, stored, table, text_batches
from .vectors import finite, matrices, with_facts

PROJECTIONS = 64
WIDTH = 2.0
GROWTH = 1.3
BLOCK = 4096
GROUP_BYTES = 32 << 20
SEED = 13
#: Collisions asked for lie this many deviations under their mean for a vector at distance R.
MARGIN = 1.9
#: The first windows of a query hold about this share of a block.
START = 1 / 8


def threshold(lines: int = PROJECTIONS) -> int:
    p = 2 * NormalDist().cdf(WIDTH / 2) - 1
    return max(1, math.floor(lines * p - MARGIN * math.sqrt(lines * p * (1 - p))))


def directions(width: int) -> np.ndarray:
    return np.random.default_rng([SEED, width]).standard_normal((width, PROJECTIONS))


class Block:
    """Vectors of one length with their sorted projections. Lines lie one after another in ``line``, each in a range of its own."""

    def __init__(self, vectors: np.ndarray, line: np.ndarray, perm: np.ndarray, ids: np.ndarray, held: np.ndarray):
        self.vectors, self.line, self.perm, self.ids, self.held = vectors, line, perm, ids, held
        self.first_id = np.cumsum(held) - held
        n = len(vectors)
        self.low = line[np.arange(PROJECTIONS) * n] if n else np.zeros(PROJECTIONS)
        self.high = line[np.arange(1, PROJECTIONS + 1) * n - 1] if n else np.zeros(PROJECTIONS)
        span = float((self.high - self.low).max(initial=0)) + 1
        self.shift = np.arange(PROJECTIONS) * 4 * span - self.low
        self.reach = 1.5 * span
        self.stacked = (line.reshape(PROJECTIONS, n) + self.shift[:, None]).ravel()

    def window(self, at: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
        """First and last place, for each line, of what stands within ``half`` of ``at``."""
        n = len(self.vectors)
        base = np.arange(PROJECTIONS) * n
        edge = lambda x: np.clip(x, self.low - self.reach, self.high + self.reach) + self.shift
        low = np.searchsorted(self.stacked, edge(at - half), "left")
        high = np.searchsorted(self.stacked, edge(at + half), "right")
        return np.clip(low, base, base + n), np.clip(high, base, base + n)

    def start(self, at: np.ndarray) -> float:
        """Radius at which the windows about ``at`` hold a share ``START`` of the block, on the middle line."""
        n = len(self.vectors)
        k = max(1, int(n * START / 2))
        base = np.arange(PROJECTIONS) * n
        place, _ = self.window(at, 0.0)
        left, right = self.line[np.maximum(place - k, base)], self.line[np.minimum(place + k, base + n - 1)]
        return 2 * float(np.median(np.maximum(np.abs(at - left), np.abs(right - at)))) / WIDTH

    def search(self, query: np.ndarray, at: np.ndarray, bound: float, most: int) -> list[tuple[float, int]]:
        """The ``most`` least (distance, id) found; none beyond ``bound`` is looked for. ``at``: the query's projections."""
        n = len(self.vectors)
        counts, seen = np.zeros(n, np.int64), np.zeros(n, bool)
        places, away = np.zeros(0, np.int64), np.zeros(0)
        lowest = highest = self.window(at, 0.0)[0]
        radius = min(bound, max(self.start(at), bound / GROWTH**3 if math.isfinite(bound) else 0.0, 1e-300))
        need = threshold()
        while True:
            low, high = self.window(at, WIDTH / 2 * radius)
            low, high = np.minimum(low, lowest), np.maximum(high, highest)
            begins, ends = np.concatenate([low, highest]), np.concatenate([lowest, high])
            size = ends - begins
            new = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - begins, size)
            counts += np.bincount(self.perm[new], minlength=n)
            lowest, highest = low, high
            fresh = np.flatnonzero((counts >= need) & ~seen)
            seen[fresh] = True
            difference = self.vectors[fresh].astype(np.float64) - query
            places = np.concatenate([places, fresh])
            away = np.concatenate([away, np.sqrt(np.einsum("nd,nd->n", difference, difference))])
            kth = self.kth(places, away, most)
            if radius >= min(bound, kth) or int((high - low).sum()) == n * PROJECTIONS:
                break
            radius = min(bound, radius * GROWTH)
        within = away <= min(bound, kth)
        rows = places[within]
        ids = self.ids[np.arange(self.held[rows].sum()) - np.repeat(np.cumsum(self.held[rows]) - self.held[rows] - self.first_id[rows], self.held[rows])]
        return sorted(zip(np.repeat(away[within], self.held[rows]).tolist(), ids.tolist()))[:most]

    def kth(self, places: np.ndarray, away: np.ndarray, most: int) -> float:
        held = self.held[places]
        if held.sum() < most:
            return math.inf
        order = np.argsort(away)
        return float(away[order][np.searchsorted(np.cumsum(held[order]), most)])


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id, v`` of the rows that take part."""
    x = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    return x.where(F.col("id").isNotNull() & finite(F.col("v")) & F.exists("v", lambda c: c != 0))


def entries(vectors: DataFrame, asked: Column, most: int) -> DataFrame:
    """``v, ids, n_asked`` of each different vector: its ``most`` least ids and how many queries hold it.

    Batches keep the least ids of a vector first, so a vector that very many rows hold is not gathered.
    """
    kind = vectors.schema["v"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, queries, column = np.asarray(batch.column(0)), np.asarray(batch.column(2).cast(pa.int64())), batch.column(1)
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for rows, x in matrices(column).values():
                _, first, which = np.unique(np.ascontiguousarray(x + 0.0).view(np.dtype((np.void, 8 * x.shape[1]))).ravel(), return_index=True, return_inverse=True)
                order = np.lexsort((ids[rows], which))
                rank = np.arange(len(rows)) - np.searchsorted(which[order], which[order])
                kept = order[rank < most]
                lists = np.split(ids[rows][kept], np.cumsum(np.bincount(which[kept]))[:-1])
                out += zip(rows[first], lists, np.bincount(which, weights=queries[rows]).astype(np.int64))
            if out:
                first, lists, n = zip(*out)
                yield pa.RecordBatch.from_arrays([column.take(pa.array(first)), pa.array([x.tolist() for x in lists], pa.list_(pa.int64())), pa.array(n, pa.int64())], names=["v", "ids", "n_asked"])

    few = vectors.select("id", "v", asked.alias("asked")).mapInArrow(run, f"v {kind}, ids array<long>, n_asked long")
    return few.groupBy("v").agg(F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, most).alias("ids"), F.sum("n_asked").alias("n_asked"))


def indexed(found: DataFrame) -> DataFrame:
    """Blocks of ``entries`` of one length with their sorted projections, a row each. ``key`` is the number of a block's first vector."""

    def laid(rows: list[tuple[np.ndarray, list[np.ndarray], np.ndarray]], key: int) -> pa.RecordBatch:
        x = np.concatenate([r[0] for r in rows])
        lists = [ids for r in rows for ids in r[1]]
        at = (x @ directions(x.shape[1])).T
        order = np.argsort(at, axis=1, kind="stable")
        n = len(x)
        short = x.astype(np.float32)
        kept = short if (short == x).all() else x
        arrays = {"vectors": kept, "line": np.take_along_axis(at, order, axis=1), "perm": order.astype(np.int32), "ids": np.concatenate(lists), "held": np.array([len(i) for i in lists], np.int64), "asked": np.concatenate([r[2] for r in rows])}
        return pa.RecordBatch.from_pydict({"key": pa.array([key], pa.int64()), "width": pa.array([x.shape[1]], pa.int64()), **{k: pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for k, a in arrays.items()}})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, asked = batch.column(1).to_pylist(), np.asarray(batch.column(2))
            for width, (rows, x) in matrices(batch.column(0)).items():
                for a in range(0, len(rows), BLOCK):
                    part = rows[a : a + BLOCK]
                    held = waiting.setdefault(width, [])
                    if held and sum(len(h[0]) for h in held) + len(part) > BLOCK:
                        yield laid(waiting.pop(width), key)
                        key += BLOCK
                        held = waiting.setdefault(width, [])
                    held.append((x[a : a + BLOCK], [np.array(ids[r], np.int64) for r in part], asked[part]))
        for held in waiting.values():
            yield laid(held, key)
            key += BLOCK
        release()

    return found.mapInArrow(run, "key long, width long, vectors binary, line binary, perm binary, ids binary, held binary, asked binary")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, Block, np.ndarray]]:
    """Key, length of vectors, block, and how many queries hold each vector."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
            held = np.frombuffer(row["held"], np.int64)
            vectors = np.frombuffer(row["vectors"], np.float32 if len(row["vectors"]) == 4 * len(held) * row["width"] else np.float64)
            block = Block(vectors.reshape(len(held), row["width"]), np.frombuffer(row["line"], np.float64), np.frombuffer(row["perm"], np.int32), np.frombuffer(row["ids"], np.int64), held)
            yield row["key"], row["width"], block, np.frombuffer(row["asked"], np.int64)
            release()


_HITS = "key long, distance double, id long"


def _hits(found: dict[int, list[tuple[float, int]]]) -> Iterator[pa.RecordBatch]:
    flat = [(key, *hit) for key, hits in found.items() for hit in hits]
    for a in range(0, len(flat), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*flat[a : a + (1 << 16)]), (pa.int64(), pa.float64(), pa.int64()))], names=["key", "distance", "id"])


def bounded(index: DataFrame, most: int) -> DataFrame:
    """``key, v, bound`` of the vectors that are asked for, searched in their own blocks: the kth distance found there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, width, block, asked in _blocks(batches):
            rows = np.flatnonzero(asked)
            queries = block.vectors[rows].astype(np.float64)
            hits = [block.search(q, at, math.inf, most) for q, at in zip(queries, queries @ directions(width))]
            bounds = [h[-1][0] if len(h) == most else math.inf for h in hits]
            if len(rows):
                yield pa.RecordBatch.from_pydict({"key": pa.array(key + rows), "v": pa.array(list(queries), pa.list_(pa.float64())), "bound": pa.array(bounds, pa.float64())})

    return index.mapInArrow(run, "key long, v array<double>, bound double")


def met(index: DataFrame, queries: list, most: int) -> tuple[DataFrame, str]:
    """``key, distance, id``: for one group of queries, the best of every task over its blocks, as a table, and its path."""
    held: dict[int, tuple[list[int], np.ndarray, list[float]]] = {}
    for width in {len(q["v"]) for q in queries}:
        own = [q for q in queries if len(q["v"]) == width]
        held[width] = ([q["key"] for q in own], np.array([q["v"] for q in own]), [q["bound"] for q in own])
    sent = index.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[float, int]]] = {}
        for _, width, block, _ in _blocks(batches):
            if width in sent.value:
                keys, vectors, bounds = sent.value[width]
                for key, q, at, bound in zip(keys, vectors, vectors @ directions(width), bounds):
                    so_far = best.get(key, [])
                    if len(so_far) == most:
                        bound = min(bound, so_far[-1][0])
                    if hits := block.search(q, at, bound, most):
                        best[key] = sorted(so_far + hits)[:most]
        yield from _hits(best)

    out = stored(index.mapInArrow(run, _HITS))
    sent.destroy()
    return out


def nearest(vectors: DataFrame, asked: Column, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of the rows (``id, v``, of ``usable``) for which ``asked`` holds."""
    spark = vectors.sparkSession
    text_batches(spark)
    most = k + 1
    classes, of_classes = stored(entries(vectors, asked, most))
    index, of_index = stored(indexed(classes.repartition(partitions_for(classes, 16 << 20))))
    queries, of_queries = stored(bounded(index, most))
    paths = [of_classes, of_index, of_queries]
    size = queries.agg(F.count("*").alias("n"), F.sum(F.size("v").cast("long") * 8 + 64).alias("bytes")).first()
    groups = -(-(size["bytes"] or 0) // GROUP_BYTES)
    found = spark.createDataFrame([], _HITS)
    for g in range(groups):
        own = queries.where(F.pmod(F.xxhash64("key"), F.lit(groups)) == g).collect()
        part, path = met(index, own, most)
        paths.append(path)
        found = found.unionByName(part)
    best = lambda hits: F.slice(F.sort_array(hits), 1, most)
    # Lists are cut in two steps, so that what a query gets from very many tasks is not gathered at once.
    some = found.groupBy("key", F.pmod(F.xxhash64("id"), F.lit(32)).alias("salt")).agg(best(F.collect_list(F.struct("distance", "id"))).alias("hits"))
    ranked = some.groupBy("key").agg(best(F.flatten(F.collect_list("hits"))).alias("hits"))
    kind = vectors.schema["v"].dataType.simpleString()
    facts = queries.select("key", F.col("v").cast(kind).alias("v")).join(ranked, "key", "left").join(classes.where("n_asked > 0"), "v").select("v", F.coalesce("hits", F.array().cast("array<struct<distance:double,id:bigint>>")).alias("hits"), "n_asked")
    known, _ = stored(facts)
    for path in paths:
        remove(spark, path)
    rows = with_facts(vectors.where(asked), known, "v", "n_asked")
    own = F.array_position("hits", F.struct(F.lit(0.0).alias("distance"), F.col("id"))).cast("int")
    others = F.when(own > 0, F.concat(F.slice("hits", F.lit(1), own - 1), F.slice("hits", own + 1, F.lit(most)))).otherwise(F.col("hits"))
    each = rows.select(F.col("id").alias("query_id"), F.posexplode(F.slice(others, 1, k)).alias("place", "hit"))
    return each.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), F.col("hit.distance").alias("score"))


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(usable(table(spark, sf_dir, "embeddings")), F.col("id") % 100 == 0)
