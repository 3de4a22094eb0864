"""SimHash near-duplicates by a segment-popcount embedding.

The bits of a 64-bit fingerprint are taken four at a time as squares of two by two, whose rows and columns are segments
of two bits. A fingerprint is mapped to the bit counts of its segments, and since every bit is in two of them, the
Manhattan distance of two such vectors is at most twice the Hamming distance of the fingerprints. The grid of count
vectors is joined in range: fingerprints at Hamming distance 4 or less differ by 2 or less in the lower half, or by 1
or less in the upper half.

* lower half: every fingerprint enters its own cell and the 32 cells one bit away, so two at distance 2 share one;
* upper half: a difference of one bit changes one square, so every fingerprint enters 8 cells, each without one square.

The fingerprints of a cell are then verified exactly. Of random pairs, about 4 in 10 million share a cell.

Cells are compared in blocks of ``BLOCK`` members, one pair of blocks a group, so that no task holds a whole
hot cell; a group gives a spanning forest of its links, not its pairs. Equal fingerprints are collapsed before.
Components carry the smallest id with their label, so that no step gathers a component by its key.

Defined results: a null or wordless text has fingerprint zero and is linked like any other; a row with null id
has a fingerprint and a null component and links nothing; rows that repeat an id are all returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components, forest
from .session import cut, shuffle_partitions, stored, table, text_batches
from .textblocks import column_bytes

SHINGLE_WORDS = 4
SEED = 42
MAX_BITS = 4
BLOCK = 2048
CELLS = 41

_LOW_OF_PAIRS = 0x55555555
_LOW_OF_SQUARES = 0x11111111


def fingerprint(text: bytes, width: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Signed 64-bit SimHash of the word shingles of UTF-8 ``text``."""
    norm = b" ".join(text.lower().split())
    if not norm:
        return 0
    gaps = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
    digest = xxhash.xxh64_digest
    if len(gaps) < width:
        digests = digest(norm, seed)
    else:
        starts = [0, *(gaps + 1).tolist()]
        ends = [*gaps[width - 1 :].tolist(), len(norm)]
        digests = b"".join([digest(norm[a:b], seed) for a, b in zip(starts, ends)])
    n = len(digests) // 8
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = np.frombuffer(digests, np.uint8, min(8 << 16, len(digests) - 8 * at), 8 * at).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id`` and ``fp`` (signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            raw, at = data.tobytes(), offsets.tolist()
            found = [fingerprint(raw[a:b], width) for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    text_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def embedding(half: Column) -> Column:
    """Bit counts (0, 1 or 2, two bits each) of the 32 segments of a half of a fingerprint: rows, then columns of squares."""
    at = lambda k, mask: F.shiftrightunsigned(half, k).bitwiseAND(F.lit(mask).cast("long"))
    rows = at(0, _LOW_OF_PAIRS) + at(1, _LOW_OF_PAIRS)
    left, right = at(0, _LOW_OF_SQUARES) + at(2, _LOW_OF_SQUARES), at(1, _LOW_OF_SQUARES) + at(3, _LOW_OF_SQUARES)
    return rows.bitwiseOR(F.shiftleft(left + F.shiftleft(right, 2), 32))


def cells(fps: DataFrame) -> DataFrame:
    """Every ``fp`` with the keys of its ``CELLS`` grid cells."""
    k, one = F.col("k"), F.lit(1).cast("long")
    lower, upper = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    moved = F.when(k == 0, lower).when(k < 33, lower.bitwiseXOR(F.call_function("shiftleft", one, k - 1)))
    square = F.call_function("shiftleft", F.lit(15).cast("long"), 4 * (k - 33))
    value = moved.otherwise(upper.bitwiseAND(F.bitwise_not(square)))
    placed = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(CELLS - 1))).alias("k"))
    return placed.select("fp", F.xxhash64(embedding(value), F.greatest(k, F.lit(32))).alias("cell"))


def _links_of_groups(max_bits: int):
    """Links inside each (cell, i, j) group of sorted rows ``cell, i, j, side, fp``; a group may span batches."""

    def links(fp: np.ndarray, side: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
        left, right = (fp, fp) if same else (fp[side == 0], fp[side == 1])
        out_a, out_b = [], []
        step = max(1, (1 << 20) // max(1, len(right)))
        for k in range(0, len(left), step):
            near = np.bitwise_count((left[k : k + step, None] ^ right[None, :]).view(np.uint64)) <= max_bits
            a, b = np.nonzero(near)
            out_a.append(left[k + a])
            out_b.append(right[b])
        a, b = (np.concatenate(x) if x else fp[:0] for x in (out_a, out_b))
        keep = a != b
        return forest(a[keep], b[keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def solve(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not len(rows):
                return
            new = np.flatnonzero(np.r_[True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1)])
            sizes = np.diff(np.r_[new, len(rows)])
            group = np.repeat(np.arange(len(new)), sizes)
            fp, found_a, found_b = rows[:, 4], [], []
            small = (sizes <= 16)[group] & (rows[:, 1] == rows[:, 2])
            for lag in range(1, 16):
                if lag >= len(rows):
                    break
                both = (group[lag:] == group[:-lag]) & small[lag:]
                a, b = fp[:-lag][both], fp[lag:][both]
                near = (np.bitwise_count((a ^ b).view(np.uint64)) <= max_bits) & (a != b)
                found_a.append(a[near])
                found_b.append(b[near])
            for g in np.flatnonzero((sizes > 16) | (rows[new, 1] != rows[new, 2])):
                part = rows[new[g] : new[g] + sizes[g]]
                a, b = links(np.ascontiguousarray(part[:, 4]), part[:, 3], bool(part[0, 1] == part[0, 2]))
                found_a.append(a)
                found_b.append(b)
            a, b = (np.concatenate(x) if x else fp[:0] for x in (found_a, found_b))
            if len(a):
                a, b = forest(a, b)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            rows = np.stack([np.asarray(c).astype(np.int64) for c in batch.columns], axis=1)
            held.append(rows)
            if (rows[0, :3] == rows[-1, :3]).all() and (held[0][0, :3] == rows[-1, :3]).all():
                continue
            whole = np.concatenate(held)
            last = len(whole) - int((whole[:, :3] == whole[-1, :3]).all(axis=1)[::-1].argmin())
            yield from solve(whole[:last])
            held = [whole[last:]]
        if held:
            yield from solve(np.concatenate(held))

    return run


def links(fps: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """Links ``a, b`` that connect what fingerprints at ``max_bits`` (at most 4) or fewer bits connect. ``fps``: distinct ``fp``."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError("the grid finds distances up to 4")
    n = shuffle_partitions(fps.sparkSession)
    # By a hash of the hash: Spark would leave out a deal by ``fp``, by which distinct rows already are in few partitions.
    placed = cells(fps.repartition(n, F.xxhash64("fp")))
    hot = placed.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > block)
    blocks = F.coalesce(F.ceil(F.col("n") / block), F.lit(1)).cast("int").alias("blocks")
    member = placed.join(hot, "cell", "left").select("cell", "fp", blocks)
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    member = member.select("cell", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    member = member.select("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "fp")
    dealt = member.repartition(n, "cell", "i", "j").sortWithinPartitions("cell", "i", "j", "side")
    return dealt.mapInArrow(_links_of_groups(max_bits), "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, fp, component_id`` of every row: the smallest id reachable over links of ``max_bits`` or fewer bits."""
    marked = cut(fingerprints(docs, id_col, text_col))
    classes = marked.where(F.col("doc_id").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    classes, _ = stored(classes)
    linked = connected_components(links(classes.select("fp"), max_bits), classes.select(F.col("fp").alias("node"), F.col("first_id").alias("value")))
    named = classes.join(linked, classes["fp"] == linked["node"], "left").select("fp", F.coalesce("least", "first_id").alias("component_id"))
    # A table, so that the join meets a plain exchange on both sides and a fingerprint that very many rows share is split.
    named, _ = stored(named)
    return marked.join(named, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose id is the smallest of its component. Rows with a null id stay.

    Where rows repeat an id that stays, all of them stay.
    """
    groups = simhash_groups(docs, id_col, text_col)
    kept = groups.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("__kept_id")).distinct()
    named = docs.join(kept, F.col(id_col).cast("long") == F.col("__kept_id"), "left_semi")
    return named.unionByName(docs.where(F.col(id_col).isNull()))


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    found = simhash_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
