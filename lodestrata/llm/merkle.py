"""Merkle manifest of a dataset, with inclusion proofs by octopus multiproofs.

Rows are leaves of a tree for each group (a source), and the groups' subroots are leaves of the tree above. Leaves are
range-partitioned in the order of (group, id) and keep their places in a checkpoint, so that a partition is a run of
neighbouring leaves, however large a group is.

* A partition derives all nodes that lie wholly inside it, and hands out those whose parent does not. Parents over
  several partitions are made of these, level by level; a group of such a step is at most ``FANOUT`` nodes.
* For the proofs of its leaves a partition works out by places alone which nodes it is missing: at each level those
  beside its run that complete the first and the last group of siblings, at most ``2 * FANOUT`` a level. It fetches their
  digests once, derives the shared interior nodes, and expands the proof of every leaf locally.

Only the first and the last group of a partition can reach beyond it, so the plan of all partitions is a few numbers
for each; the driver adds these up.

Defined results: null values are ``-`` in a leaf; null groups are one group, the first; null ids come first in their
group, equal ids in the order of their leaves; equal rows are each a leaf. A group of one leaf has that leaf as its
subroot and an empty proof there, one group alone has its subroot as the root. No rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import cut, release, remove, stored, table

FANOUT = 16
TAMPER = 5
LEAVES = 1 << 17


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def counted(value: Column) -> Column:
    """A value as its byte count, a colon and itself; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[counted(v) for v in values]), 256)


class Run(NamedTuple):
    """What a partition holds: its first and last group by number, where its first leaf stands in its group, for both groups how many leaves it holds and how many there are, and the number of all groups."""

    pid: int
    group: int
    last: int
    offset: int
    first_rows: int
    first_size: int
    last_rows: int
    last_size: int
    groups: int


def placed(leaves: DataFrame) -> DataFrame:
    """``leaves`` (``grp, id, leaf, other``) in the order of (grp, id, leaf), dealt evenly, with their partition ``pid`` and a rising ``place``."""
    spark = leaves.sparkSession
    known, path = stored(leaves)
    parts = max(spark.sparkContext.defaultParallelism, -(-known.count() // LEAVES))
    # Equal rows are told apart by a number of their own, so that no partition gets all copies of one.
    told = known.withColumn("__n", F.xxhash64(F.monotonically_increasing_id()))
    by = ["grp", "id", "leaf", "__n"]
    kept = cut(told.repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("__n"))
    remove(spark, path)
    return kept.select("*", F.spark_partition_id().alias("pid"), F.monotonically_increasing_id().alias("place"))


def layout(leaves: DataFrame) -> list[Run]:
    """What each partition holds. The driver has a few numbers for each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, first, last, kinds, sizes = None, None, None, 0, [0, 0]
        for batch in batches:
            for p, g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not kinds:
                    pid, first = p, g
                if not kinds or g != last:
                    kinds, last, sizes[1] = kinds + 1, g, 0
                sizes[0] += kinds == 1
                sizes[1] += 1
        if kinds:
            yield pa.RecordBatch.from_pydict({"pid": pa.array([pid], pa.int32()), "first": pa.array([first], pa.string()), "last": pa.array([last], pa.string()), "kinds": [kinds], "n_first": [sizes[0]], "n_last": [sizes[1]]})

    found = leaves.select("pid", "grp").mapInArrow(run, "pid int, first string, last string, kinds long, n_first long, n_last long").collect()
    total: dict[int, int] = {}
    held, group, before = [], -1, object()
    for r in sorted(found, key=lambda r: r["pid"]):
        first = group if r["first"] == before else group + 1
        group, before = first + r["kinds"] - 1, r["last"]
        held.append((r["pid"], first, group, total.get(first, 0), r["n_first"], r["n_last"]))
        total[first] = total.get(first, 0) + r["n_first"]
        if group > first:
            total[group] = r["n_last"]
    return [Run(p, first, last, offset, a, total[first], b, total[last], group + 1) for p, first, last, offset, a, b in held]


def missing(begin: int, end: int, size: int) -> Iterator[tuple[int, int]]:
    """Level and index of the nodes that the proofs of leaves ``begin`` to ``end`` of ``size`` need besides what these derive."""
    level = 0
    while size > 1:
        low, high = begin // FANOUT * FANOUT, min(size, -(-end // FANOUT) * FANOUT)
        yield from ((level, k) for k in (*range(low, begin), *range(end, high)))
        begin, end, size, level = begin // FANOUT, -(-end // FANOUT), -(-size // FANOUT), level + 1


def parents(nodes: Sequence[str]) -> list[str]:
    return [sha("".join(nodes[k : k + FANOUT])) for k in range(0, len(nodes), FANOUT)]


def outer(nodes: list[str], begin: int, size: int) -> Iterator[tuple[int, int, int, str]]:
    """Level size, level, index and digest of the nodes over a run of leaves whose parents the run does not hold whole; a root is one of them."""
    level = 0
    while True:
        end = begin + len(nodes)
        low = -(-begin // FANOUT) * FANOUT
        high = end if end == size else end // FANOUT * FANOUT
        if size == 1 or high <= low:
            yield from ((size, level, begin + k, n) for k, n in enumerate(nodes))
            return
        yield from ((size, level, k, nodes[k - begin]) for k in (*range(begin, low), *range(high, end)))
        nodes, begin, size, level = parents(nodes[low - begin : high - begin]), low // FANOUT, -(-size // FANOUT), level + 1


def _groups(run: Run, keys: list) -> Iterator[tuple[int, int, int, int, int]]:
    """For each group of a partition's rows: its number, its size, the place of its first leaf here, and where it begins and ends among the rows."""
    bounds = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
    for n, (a, b) in enumerate(zip(bounds, bounds[1:])):
        size = run.first_size if n == 0 else run.last_size if b == len(keys) else b - a
        yield run.group + n, size, 0 if n else run.offset, a, b


def pieces(leaves: DataFrame, runs: dict[int, Run]) -> DataFrame:
    """``grp, size, level, idx, digest`` of the nodes that partitions hand out; ``size`` is that of the node's level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            rows = pa.Table.from_batches(held)
            digests, mine = rows.column("leaf").to_pylist(), runs[rows.column("pid")[0].as_py()]
            out = [(g, *node) for g, size, offset, a, b in _groups(mine, rows.column("grp").to_pylist()) for node in outer(digests[a:b], offset, size)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["grp", "size", "level", "idx", "digest"])
            release()

    return leaves.select("pid", "grp", "leaf").mapInArrow(run, "grp long, size long, level long, idx long, digest string")


def nodes_over(handed: DataFrame, largest: int, paths: list[str]) -> DataFrame:
    """``handed`` with the nodes above that are made of them, in trees of up to ``largest`` leaves; tables go under ``paths``."""
    level, found = 0, handed
    above = handed.limit(0)
    in_order = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "digest"))), lambda n: n["digest"]), "")
    while largest > 1:
        here = above.unionByName(handed.where(F.col("level") == level)).where("size > 1")
        made = here.groupBy("grp", F.floor(F.col("idx") / FANOUT).alias("idx"), F.ceil(F.col("size") / FANOUT).alias("size")).agg(F.sha2(in_order, 256).alias("digest"))
        level, largest = level + 1, -(-largest // FANOUT)
        above, path = stored(made.select("grp", "size", F.lit(level).cast("long").alias("level"), "idx", "digest"))
        paths.append(path)
        found = found.unionByName(above)
    return found


def wanted(spark: SparkSession, runs: list[Run]) -> DataFrame:
    """``pid, grp, level, idx`` of the nodes that partitions fetch; the tree over the groups is number -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in (Run(**row) for row in batch.to_pylist()):
                asked = [(r.group, r.offset, r.offset + r.first_rows, r.first_size), (-1, r.group, r.last + 1, r.groups)]
                if r.last > r.group:
                    asked.append((r.last, 0, r.last_rows, r.last_size))
                out += [(r.pid, g, *node) for g, begin, end, size in asked for node in missing(begin, end, size)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["pid", "grp", "level", "idx"])

    frame = spark.createDataFrame(runs, "pid int, group long, last long, offset long, first_rows long, first_size long, last_rows long, last_size long, groups long")
    return frame.mapInArrow(run, "pid int, grp long, level long, idx long")


class Levels:
    """The nodes from a run of leaves up to the root, with what is missing filled in: what proofs are expanded from."""

    def __init__(self, nodes: list[str], begin: int, size: int, fetched: dict[tuple[int, int], str]):
        self.levels, self.size, level = [], size, 0
        while size > 1:
            end = begin + len(nodes)
            low, high = begin // FANOUT * FANOUT, min(size, -(-end // FANOUT) * FANOUT)
            nodes = [*(fetched[level, k] for k in range(low, begin)), *nodes, *(fetched[level, k] for k in range(end, high))]
            self.levels.append((low, nodes))
            nodes, begin, size, level = parents(nodes), low // FANOUT, -(-size // FANOUT), level + 1
        self.root = nodes[0]
        self._above: dict[tuple[int, int], list[tuple[str, str]]] = {}

    def sides(self, level: int, idx: int) -> tuple[str, str]:
        """Digests of the siblings to the left and to the right of a node."""
        low, nodes = self.levels[level]
        first = idx // FANOUT * FANOUT - low
        return "".join(nodes[first : idx - low]), "".join(nodes[idx - low + 1 : first + FANOUT])

    def way(self, idx: int, level: int = 0) -> list[tuple[str, str]]:
        """``sides`` of a node and of all above it; those above leaves are worked out once."""
        if level == len(self.levels):
            return []
        if level and (level, idx) in self._above:
            return self._above[level, idx]
        found = [self.sides(level, idx), *self.way(idx // FANOUT, level + 1)]
        if level:
            self._above[level, idx] = found
        return found


def folded(digest: str, way: list[tuple[str, str]]) -> str:
    for left, right in way:
        digest = sha(f"{left}{digest}{right}")
    return digest


def prove(leaves: DataFrame, fetched: DataFrame, runs: dict[int, Run]) -> DataFrame:
    """``id, leaf, subroot, root, proof, folded`` of every leaf, each partition with the nodes it fetched."""

    def run(mine: pa.Table, nodes: pa.Table) -> pa.Table:
        rows = mine.sort_by("place")
        ids, own, other = rows.column("id"), rows.column("leaf").to_pylist(), rows.column("other").to_pylist()
        known: dict[int, dict[tuple[int, int], str]] = {}
        for g, level, idx, digest in zip(*(nodes.column(c).to_pylist() for c in ("grp", "level", "idx", "digest"))):
            known.setdefault(g, {})[level, idx] = digest
        here = runs[rows.column("pid")[0].as_py()]
        inside = [(g, Levels(own[a:b], offset, size, known.get(g, {})), offset, a, b) for g, size, offset, a, b in _groups(here, rows.column("grp").to_pylist())]
        over = Levels([tree.root for _, tree, *_ in inside], here.group, here.groups, known.get(-1, {}))
        subroots, proofs, ends = [], [], []
        for g, tree, offset, a, b in inside:
            top = over.way(g)
            rest = "".join(left + right for left, right in top)
            subroots += [tree.root] * (b - a)
            for k in range(a, b):
                way = tree.way(offset + k - a)
                proofs.append(sha("".join(left + right for left, right in way) + rest))
                ends.append(folded(folded(other[k] or own[k], way), top))
        return pa.table({"id": ids, "leaf": pa.array(own), "subroot": pa.array(subroots), "root": pa.array([over.root] * len(own)), "proof": pa.array(proofs), "folded": pa.array(ends)})

    kept = leaves.select("pid", "place", "grp", "id", "leaf", "other")
    return kept.groupBy("pid").cogroup(fetched.groupBy("pid")).applyInArrow(run, "id long, leaf string, subroot string, root string, proof string, folded string")


def manifest(leaves: DataFrame) -> DataFrame:
    """``id, leaf, subroot, root, proof, folded`` of ``leaves`` (``grp string, id long, leaf, other``).

    ``proof`` is the digest of all siblings from the leaf to the root. ``folded`` is the root that ``other``, where there
    is one, or ``leaf`` gives with these siblings.
    """
    spark = leaves.sparkSession
    rows = placed(leaves)
    held = layout(rows)
    if not held:
        return spark.createDataFrame([], "id long, leaf string, subroot string, root string, proof string, folded string")
    runs, groups = {r.pid: r for r in held}, held[0].groups
    handed, path = stored(pieces(rows, runs))
    paths = [path]
    largest = max(max(r.first_size, r.last_size) for r in held)
    inside = nodes_over(handed, largest, paths)
    over = inside.where("size = 1").select(F.lit(-1).cast("long").alias("grp"), F.lit(groups).cast("long").alias("size"), F.lit(0).cast("long").alias("level"), F.col("grp").alias("idx"), "digest")
    over, path = stored(over)
    nodes = inside.unionByName(nodes_over(over, groups, paths)).select("grp", "level", "idx", "digest")
    fetched, _ = stored(wanted(spark, held).join(nodes, ["grp", "level", "idx"]))
    for done in [path, *paths]:
        remove(spark, done)
    return prove(rows, fetched, runs)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    shown = [doc_id, F.col("source"), F.col("lang"), F.col("n_chars").cast("long")]
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    tampered = F.when(F.crc32(doc_id.cast("string")) % TAMPER == 0, leaf([*shown, F.translate(text, upper, upper.lower())]))
    leaves = docs.select(F.col("source").cast("string").alias("grp"), doc_id.alias("id"), leaf([*shown, text]).alias("leaf"), tampered.alias("other"))
    found = manifest(leaves)
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))
