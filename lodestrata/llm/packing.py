"""Best-fit packing planned on the histogram of lengths.

Texts are tokenised once into pieces of at most ``CAPACITY`` tokens. The plan sees only how many pieces each
length has, never the pieces: best-fit decreasing runs over counts, whole groups of equal sequences at a time, and
gives slot ranges ``(length, first rank, end rank, first sequence, offset)``. Pieces are then ranked within their
length and take the slot of their rank. Ranks are made inside (length, salt) groups, so that a common length is
not one group.

Counts and plan have at most one row per length and per pair of lengths, so the driver and the broadcast hold
what is bounded by the capacity alone.

Defined results: a null or empty text is one piece that holds the end token only; a null id is packed like any
other; rows that repeat an id are each packed; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import cut, release, shuffle_partitions, table, text_batches
from .textblocks import column_bytes

CAPACITY = 2048
END_ID = 0
TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
SPECIAL = b"<|endoftext|>"


@lru_cache(maxsize=1)
def _whole(tokenizer: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer)


@lru_cache(maxsize=1)
def _fast(ranks: str):
    """The tokenizer's vocabulary and pattern in a faster library.

    Both give the same ids for every text without a special token (tests compare them); texts that hold one go
    to the tokenizer itself, which is loaded only then.
    """
    import tiktoken

    pairs = (line.split() for line in open(ranks, "rb"))
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})


def encode(raw: bytes, tokenizer: str | None = None, ranks: str | None = None) -> list[int]:
    text = raw.decode("utf-8", "replace")
    if SPECIAL in raw:
        return _whole(tokenizer or public_tokenizers.path(TOKENIZER)).encode(text, add_special_tokens=False).ids
    return _fast(ranks or public_tokenizers.path(RANKS)).encode_ordinary(text)


def _pieces(capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            at = offsets.tolist()
            row, piece, start, length, crc, kept = [], [], [], [], [], []
            for r, (a, b) in enumerate(zip(at, at[1:])):
                ids = encode(data[a:b].tobytes()) if b > a else []
                ids.append(END_ID)
                ids = np.array(ids, dtype="<u4")
                first = len(ids) % capacity or capacity
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                for k, (x, y) in enumerate(zip(cuts, cuts[1:])):
                    row.append(r)
                    piece.append(k)
                    start.append(x)
                    length.append(y - x)
                    crc.append(zlib.crc32(ids[x:y]))
                    if with_ids:
                        kept.append(ids[x:y].astype(np.int32))
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            release()
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces ``doc_id, piece, start, length, ids_crc32`` (and ``ids``); of a cut document only the first may be short."""
    text_batches(docs.sparkSession)
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(_pieces(capacity, with_ids), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Slot ranges ``(length, first rank, end rank, first sequence, offset)`` of best-fit decreasing.

    A piece of rank r takes sequence ``first sequence + r - first rank``. Sequences with equal room are held as
    ranges of numbers, and ranges are filled from those with the least room that suffices.
    """
    slots: list[tuple[int, int, int, int, int]] = []
    rooms: list[int] = []
    open_: dict[int, list[tuple[int, int]]] = {}
    opened = 0

    def leave(room: int, first: int, n: int) -> None:
        if room:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            k = bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                first, n = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    del rooms[k]
                take = min(n, left)
                slots.append((length, rank, rank + take, first, capacity - room))
                leave(room - length, first, take)
                if take < n:
                    leave(room, first + take, n - take)
                rank, left = rank + take, left - take
                continue
            deep = min(capacity // length, left)
            n = left // deep
            for j in range(deep):
                slots.append((length, rank, rank + n, opened, j * length))
                rank += n
            leave(capacity - deep * length, opened, n)
            opened, left = opened + n, left - deep * n
    return slots


def pack(pieces: DataFrame, capacity: int = CAPACITY, salts: int | None = None) -> DataFrame:
    """``pieces`` (with ``doc_id, piece, length, ids_crc32``) and the ``sequence_id`` and ``offset`` of each.

    ``pieces`` is read twice and must not change between: pass a written or checkpointed table.
    """
    spark = pieces.sparkSession
    salts = salts or shuffle_partitions(spark)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = spark.createDataFrame(plan(counts, capacity), "slot_length long, first_rank long, end_rank long, first_sequence long, offset long")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("place", F.row_number().over(within).cast("long")).join(begins, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("begin") + F.col("place") - 1)
    fits = (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("end_rank"))
    placed = ranked.join(F.broadcast(slots), fits)
    return placed.select(*[F.col(c) for c in pieces.columns], (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"), "offset")


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return pack(cut(token_pieces(table(spark, sf_dir, "documents"))))
