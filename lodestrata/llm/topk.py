"""Exact top-k inner-product search by distributed histogram selection.

Candidates are packed in blocks of ``CANDIDATE_BLOCK`` that stay where they are; queries go out to them in groups of at most
``GROUP_BYTES``. The first pass scores everything and counts scores in bins; the counts of all blocks give, for each query, the
bin that holds its kth score. The next pass splits that bin, until a bin is one score wide. The last pass lets through
the scores above the kth value and, of those equal to it, the smallest ids.

What leaves a block is little. One block in ``FLOOR_SHARE`` is scored beforehand where there are that many, and a query's
kth bin among these is a floor under its kth bin of all: no bin below it goes out, nor below a block's own kth. So the sums
are whole global histograms from the bin looked for up. A block's bins also tell its best score, so later passes
leave out the blocks that have none in or above the kth bin: a query meets few blocks again, and a block is copied
once for each ``QUERY_BLOCK`` queries that still need it.

Scores are whole numbers: component x counts as floor(256 * x). Blocks multiply in double precision where that
is exact, else in integers.

Defined results: vectors that are null or hold a null or non-finite component take no part, nor do rows with a null
id; vectors of different lengths are not compared; rows that repeat an id are each a candidate and each a query of its
own, and only a query's own row is not a candidate of it; fewer than k candidates are all returned; scores beyond the
64-bit range count as its ends.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import cut, release, remove, stored, table, text_batches

SCALE = 256
QUERY_BLOCK = 2048
CANDIDATE_BLOCK = 8192
GROUP_BYTES = 32 << 20
FLOOR_SHARE = 16
BIN_BITS = 12
_CHUNK = 256
_LOW = np.iinfo(np.int64).min


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id, v`` (array of double) of the rows that take part, computed once, with a number ``row`` that tells rows apart."""
    x = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return cut(x.where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite).withColumn("row", F.monotonically_increasing_id()))


def _by_length(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Row numbers and scaled vectors for each length."""
    column = column.combine_chunks()
    lengths = np.asarray(column.value_lengths())
    values = np.floor(SCALE * np.asarray(column.flatten(), dtype=np.float64))
    begins = np.cumsum(lengths) - lengths
    return {int(n): (rows := np.flatnonzero(lengths == n), values[begins[rows][:, None] + np.arange(n)]) for n in np.unique(lengths)}


def _product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if bound < 2**53:
        return (q @ c.T).astype(np.int64)
    if bound < 2**62:
        return q.astype(np.int64) @ c.astype(np.int64).T
    whole = [[int(x) for x in r] for r in q], [[int(x) for x in r] for r in c]
    return np.array([[min(max(sum(a * b for a, b in zip(r, s)), _LOW + 1), -_LOW - 1) for s in whole[1]] for r in whole[0]], dtype=np.int64)


class Block:
    """Candidates of one length in ascending order of their ids."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows, self.values = ids[order], rows[order], values[order]

    def scored(self, own: np.ndarray, vectors: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """For some queries at a time: which, scores, and whether each pair counts."""
        for a in range(0, len(own), _CHUNK):
            part = slice(a, a + _CHUNK)
            yield part, _product(vectors[part], self.values), own[part][:, None] != self.rows[None, :]


def packed(candidates: DataFrame) -> DataFrame:
    """Blocks of candidates of one length, a row each."""

    def laid(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]], key: int) -> pa.RecordBatch:
        ids, rows, values = (np.concatenate(x) for x in zip(*held))
        arrays = {"ids": ids, "rows": rows, "vectors": values}
        return pa.RecordBatch.from_pydict({"block": pa.array([key], pa.int64()), "width": pa.array([values.shape[1]], pa.int64()), **{k: pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for k, a in arrays.items()}})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}
        key = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, rows = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for width, (where, values) in _by_length(pa.chunked_array([batch.column(2)])).items():
                while len(where):
                    held = waiting.setdefault(width, [])
                    room = CANDIDATE_BLOCK - sum(len(h[0]) for h in held)
                    held.append((ids[where[:room]], rows[where[:room]], values[:room]))
                    where, values = where[room:], values[room:]
                    if sum(len(h[0]) for h in held) == CANDIDATE_BLOCK:
                        yield laid(waiting.pop(width), key)
                        key += 1
        for held in waiting.values():
            yield laid(held, key)
            key += 1
        release()

    return candidates.select("id", "row", "v").mapInArrow(run, "block long, width long, ids binary, rows binary, vectors binary")


def _unpacked(row: dict) -> Block:
    ids, rows = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["rows"], np.int64)
    return Block(ids, rows, np.frombuffer(row["vectors"], np.float64).reshape(len(ids), row["width"]))


_BINS = "query long, block long, bin long, n long"


def _counted(block: Block, name: int, k: int, shift: int, query: np.ndarray, own: np.ndarray, vectors: np.ndarray, low: np.ndarray, wide: np.ndarray, floor: np.ndarray) -> pa.RecordBatch:
    """Bins (``score >> shift``) of each query's scores inside its range, from its floor and the block's own kth best up, with counts."""
    out_q, out_bin = [], []
    for part, scores, counts in block.scored(own, vectors):
        if (wide[part] < 64).any():
            span = wide[part][:, None]
            counts &= np.where(span < 64, (scores >> np.minimum(span, 63)) == low[part][:, None], True)
        bins = np.where(counts, scores >> shift, _LOW)
        most = min(k, bins.shape[1])
        least = np.maximum(np.partition(bins, bins.shape[1] - most, axis=1)[:, bins.shape[1] - most], floor[part])
        at, place = np.nonzero((bins != _LOW) & (bins >= least[:, None]))
        out_q.append(query[part][at])
        out_bin.append(bins[at, place])
    q, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_q, out_bin))
    pairs, n = np.unique(np.stack([q, b], axis=1), axis=0, return_counts=True) if len(q) else (np.zeros((0, 2), np.int64), np.zeros(0, np.int64))
    return pa.RecordBatch.from_pydict({"query": pa.array(pairs[:, 0]), "block": pa.array(np.full(len(n), name)), "bin": pa.array(pairs[:, 1]), "n": pa.array(n.astype(np.int64))})


def _all_counted(blocks: DataFrame, queries: DataFrame, floors: DataFrame | None, k: int, shift: int, paths: list[str]) -> DataFrame:
    """Bins of all queries in all ``blocks``; queries go out in groups, and what comes back is stored (under ``paths``)."""
    size = queries.agg(F.count("*").alias("n"), F.sum(F.size("v").cast("long") * 8 + 32).alias("bytes")).first()
    groups = -(-(size["bytes"] or 0) // GROUP_BYTES)
    known = queries.withColumn("floor", F.lit(_LOW + 1)) if floors is None else queries.join(floors, "query", "left").withColumn("floor", F.coalesce("floor", F.lit(_LOW + 1)))
    found = blocks.sparkSession.createDataFrame([], _BINS)
    for g in range(groups):
        held: dict[int, tuple[np.ndarray, ...]] = {}
        own = known.where(F.pmod(F.xxhash64("query"), F.lit(groups)) == g).select("query", "row", "floor", "v").toArrow()
        for width, (rows, vectors) in _by_length(own.column("v")).items() if own.num_rows else ():
            held[width] = (*(np.asarray(own.column(c))[rows] for c in ("query", "row", "floor")), vectors)
        sent = blocks.sparkSession.sparkContext.broadcast(held)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    if row["width"] in sent.value:  # only queries of one length meet
                        query, number, floor, vectors = sent.value[row["width"]]
                        none = np.zeros(len(query), np.int64)
                        yield _counted(_unpacked(row), row["block"], k, shift, query, number, vectors, none, none + 64, floor)
                        release()

        part, path = stored(blocks.mapInArrow(run, _BINS))
        sent.destroy()
        paths.append(path)
        found = found.unionByName(part)
    return found


def _again(blocks: DataFrame, queries: DataFrame, state: DataFrame, pairs: DataFrame, run, schema: str) -> DataFrame:
    """``run`` over each block that ``pairs`` (``query, block``) name and the queries, with their state, that name it, ``QUERY_BLOCK`` or so at a time."""
    needed = pairs.groupBy("block").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("copies"))
    copies = blocks.join(needed, "block").select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).drop("copies")
    asked = pairs.join(needed, "block").withColumn("copy", F.pmod(F.xxhash64("query"), F.col("copies")) + 1).drop("copies").join(queries.join(state, "query"), "query")

    def one(block: pa.Table, mine: pa.Table) -> pa.Table:
        out = []
        if block.num_rows and mine.num_rows:
            row = block.to_pylist()[0]
            of_width = _by_length(mine.column("v"))
            if row["width"] in of_width:
                where, vectors = of_width[row["width"]]
                columns = {c: np.asarray(mine.column(c))[where] for c in ("query", "id", "row", "low", "wide", "need")}
                out.append(run(_unpacked(row), row["block"], columns, vectors))
        return pa.Table.from_batches(out) if out else empty

    empty = pa.table({column.split()[0]: pa.array([], pa.int64()) for column in schema.split(", ")})
    return copies.groupBy("block", "copy").cogroup(asked.groupBy("block", "copy")).applyInArrow(one, schema)


def _select(block: Block, name: int, columns: dict[str, np.ndarray], vectors: np.ndarray) -> pa.RecordBatch:
    """Pairs above the kth score (``low``), and of those equal to it the smallest ids."""
    out = []
    for part, scores, counts in block.scored(columns["row"], vectors):
        level = columns["low"][part][:, None]
        tied = counts & (scores == level)
        take = counts & (scores > level) | tied & (np.cumsum(tied, axis=1) <= columns["need"][part][:, None])
        at, place = np.nonzero(take)
        out.append((columns["query"][part][at], columns["id"][part][at], block.ids[place], scores[at, place]))
    found = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 4
    return pa.RecordBatch.from_pydict(dict(zip(("query", "query_id", "vec_id", "score"), map(pa.array, found))))


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` best candidates. Both: rows of one ``usable`` table, so
    that ``row`` tells a query's own row."""
    spark = queries.sparkSession
    text_batches(spark)
    # Both may come from one table: columns get names of their own, so that the two sides can be told apart.
    candidates = candidates.toDF(*[f"_{c}" for c in candidates.columns]).select(*[F.col(f"_{c}").alias(c) for c in candidates.columns])
    asked = cut(queries.select(F.monotonically_increasing_id().alias("query"), "id", "row", "v"))
    largest = F.transform("v", lambda c: F.abs(c))
    extent = candidates.agg(F.count("*").alias("n"), F.max(F.array_max(largest)).alias("x"), F.max(F.size("v")).alias("size")).first()
    most = asked.agg(F.count("*").alias("n"), F.max(F.array_max(largest)).alias("x")).first()
    if not extent["n"] or not most["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    bits = min(63, 1 + math.ceil(math.log2(max(2.0, (SCALE * (extent["x"] or 0) + 1) * (SCALE * (most["x"] or 0) + 1) * extent["size"]))))
    blocks, path = stored(packed(candidates))
    paths = [path]

    # A query's state: its kth score lies in bin ``low`` of width 2**wide, and is the ``need``-th best there.
    begun = asked.select("query", F.lit(0).cast("long").alias("low"), F.lit(64).cast("long").alias("wide"), F.lit(k).cast("long").alias("need"))
    shift = max(0, bits - BIN_BITS)
    floors = None
    if blocks.count() >= FLOOR_SHARE:
        first = blocks.where(F.pmod(F.xxhash64("block"), F.lit(FLOOR_SHARE)) == 0)
        among = _located(_all_counted(first, asked, None, k, shift, paths), begun, shift, enough=True)
        floors = cut(among.select("query", F.col("low").alias("floor")))
    bins = _all_counted(blocks, asked, floors, k, shift, paths)
    state = cut(_located(bins, begun, shift))
    pairs = _surviving(bins, state)
    while shift:
        shift = max(0, shift - BIN_BITS)

        def count(block: Block, name: int, columns: dict[str, np.ndarray], vectors: np.ndarray, shift: int = shift) -> pa.RecordBatch:
            return _counted(block, name, k, shift, columns["query"], columns["row"], vectors, columns["low"], columns["wide"], np.full(len(vectors), _LOW + 1))

        above = pairs.where("surely").select("query", "block", "surely")
        bins, path = stored(_again(blocks, asked, state, pairs.where("held").select("query", "block"), count, _BINS))
        paths.append(path)
        state = cut(_located(bins, state, shift))
        again = _surviving(bins, state)
        pairs = cut(again.unionByName(above.withColumn("held", F.lit(False))).groupBy("query", "block").agg(F.max("surely").alias("surely"), F.max("held").alias("held")))
    found = _again(blocks, asked, state, pairs.select("query", "block"), _select, "query long, query_id long, vec_id long, score long")
    ranked = found.groupBy("query", "query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id", "score"))), 1, k).alias("best"))
    each = ranked.select("query_id", F.posexplode("best").alias("place", "b")).select("query_id", (F.col("place") + 1).cast("int").alias("rank"), "b.vec_id", "b.score")
    result, _ = stored(each)
    for path in paths:
        remove(spark, path)
    return result


def _surviving(bins: DataFrame, state: DataFrame) -> DataFrame:
    """``query, block, surely, held``: blocks with scores above the query's bin, and blocks with scores in it."""
    known = bins.join(state.select("query", "low"), "query").where("bin >= low")
    return cut(known.groupBy("query", "block").agg(F.max(F.col("bin") > F.col("low")).alias("surely"), F.max(F.col("bin") == F.col("low")).alias("held")))


def _located(bins: DataFrame, state: DataFrame, shift: int, enough: bool = False) -> DataFrame:
    """The bin with each query's ``need``-th score from the top, and the rank wanted inside it.

    The ranks looked for end where scores do, so a query with fewer candidates than k comes down to its lowest score; with
    ``enough`` such queries are left out.
    """
    counted = bins.groupBy("query", "bin").agg(F.sum("n").alias("n"))
    ordered = counted.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("bin", "n")), asc=False).alias("bins")).join(state, "query")
    total = F.aggregate("bins", F.lit(0).cast("long"), lambda a, b: a + b["n"])
    start = F.struct(F.lit(0).cast("long").alias("above"), F.lit(None).cast("long").alias("low"), F.lit(0).cast("long").alias("need"))

    def step(a, b):
        reached = a["low"].isNull() & (a["above"] + b["n"] >= F.col("wanted"))
        return F.struct(
            F.when(a["low"].isNull() & ~reached, a["above"] + b["n"]).otherwise(a["above"]).alias("above"),
            F.when(reached, b["bin"]).otherwise(a["low"]).alias("low"),
            F.when(reached, F.col("wanted") - a["above"]).otherwise(a["need"]).alias("need"),
        )

    if enough:
        ordered = ordered.where(total >= F.col("need"))
    wanted = ordered.withColumn("wanted", F.least("need", total))
    at = wanted.select("query", F.aggregate("bins", start, step).alias("at"))
    return at.select("query", F.col("at.low").alias("low"), F.lit(shift).cast("long").alias("wide"), F.col("at.need").alias("need"))


def op4_exact_topk(spark, sf_dir: str) -> DataFrame:
    vectors = usable(table(spark, sf_dir, "embeddings"))
    return top_k(vectors.where(F.col("id") % 50 == 0), vectors)
