"""Substring dedup by Rabin-Karp hashes of every fixed-length word window.

1. Each task hashes all windows of its documents. Of the windows it has met in several documents it passes on
   the one of the smallest id and marks the others removed at once, so a passage that half the table holds
   costs each task one entry. Entries go out packed by bucket, 8 bytes a window.
2. One group per bucket finds for each hash the smallest id and gives, for every other document, the hashes
   that it must lose, packed by bucket of the document.
3. One group per bucket of documents brings texts (zstd-packed for the shuffle) and removals together, merges
   covered windows into maximal word intervals and cuts them out.

There are as many partitions of hashes and of documents as the size of the table asks for (``partitions_for``), each
with ``BUCKETS_PER_PARTITION`` buckets of hashes and one slot of documents, so that a group stays at megabytes at any
size of the table. A window is known by a 64-bit hash within a bucket chosen by an independent second hash. The buckets
grow with the data: a table of n windows of about 8 bytes has n / 250,000 of them, so the windows that two different
texts are expected to share by chance are n * n / 2**65 / (n / 250,000), less than one for 10**14 windows (at 100 TB
there are about 2 * 10**13). Texts are not compared again.

Defined results: a null or empty text has no words and is kept as it is; a row with a null id has nothing
removed and removes nothing; rows that repeat an id are one document to each other (no smaller id), each is
returned. Columns in ``carry`` come through unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import partitions_for, release, table, text_batches
from .textblocks import blocks, column_bytes, mix, span_hashes, window_hashes, word_spans

WINDOW = 50
BUCKETS_PER_PARTITION = 4
FLUSH_WINDOWS = 600_000

_PACKED = "bucket int, kind int, ids binary, counts binary, data binary"


def _slot(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32)


def _doc_slot(ids: np.ndarray, n: int) -> np.ndarray:
    return _slot(mix(ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), n)


def _runs(values: np.ndarray) -> np.ndarray:
    new = values[1:] != values[:-1]
    return np.flatnonzero(np.r_[True, new.any(axis=1) if values.ndim > 1 else new])


def _pack(kind: int, bucket: np.ndarray, ids: np.ndarray, data: np.ndarray) -> Iterator[tuple]:
    """Rows of ``_PACKED`` from entries in ascending order of id. An id is a number or a row of numbers."""
    order = np.argsort(bucket, kind="stable")
    bucket, ids, data = bucket[order], ids[order], data[order]
    begins = _runs(bucket) if len(bucket) else []
    for a, b in zip(begins, [*begins[1:], len(bucket)]):
        at = _runs(ids[a:b])
        counts = np.diff(np.r_[at, b - a]).astype(np.int32)
        yield int(bucket[a]), kind, ids[a:b][at].tobytes(), counts.tobytes(), data[a:b].tobytes()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["bucket", "kind", "ids", "counts", "data"])


def _mark(text) -> int:
    """Signed 64-bit hash that tells the texts of one id apart."""
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def merged(starts: np.ndarray, width: int) -> np.ndarray:
    """Maximal intervals (n, 2) of words that windows at ascending ``starts`` cover."""
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    new = np.flatnonzero(np.r_[True, starts[1:] > starts[:-1] + width])
    return np.stack([starts[new], np.r_[starts[new[1:] - 1], starts[-1]] + width], axis=1)


def _windows(buckets: int, slots: int, width: int, flush: int):
    def settle(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        """Entries of one flush: (ids, hash, second hash, first word, hash of the text) per window."""
        ids, h, g, at, mark = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(ids, kind="stable")
        order = order[np.argsort(h[order], kind="stable")]
        hs, gs, by = h[order], g[order], ids[order]
        first = np.r_[True, (hs[1:] != hs[:-1]) | (gs[1:] != gs[:-1])]
        group = np.cumsum(first) - 1
        lost = by > by[np.flatnonzero(first)][group]
        keep = np.sort(order[first])
        if len(ids) > 1 and (ids[1:] < ids[:-1]).any():
            keep = keep[np.argsort(ids[keep], kind="stable")]
        rows = list(_pack(0, _slot(g[keep], buckets), ids[keep], h[keep]))
        gone = order[lost]
        gone = gone[np.lexsort((at[gone], mark[gone], ids[gone]))]
        # Places hold for one text, and rows that repeat an id may have several.
        whose = np.stack([ids[gone], mark[gone]], axis=1)
        rows += _pack(1, _doc_slot(ids[gone], slots), whose, at[gone].astype(np.int64))
        release()
        if rows:
            yield _batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            ids = batch.column(0)
            known = np.asarray(ids.is_valid())
            ids = np.asarray(ids.fill_null(0))
            for a, b, data, offsets in blocks(batch.column(1)):
                starts, ends, first_words = word_spans(data, offsets)
                words = span_hashes(data, starts, ends)
                h, at, counts = window_hashes(words, first_words, width, 0)
                if not len(h):
                    continue
                g = window_hashes(words, first_words, width, 1)[0]
                row = np.repeat(np.arange(b - a), counts)
                use = known[a:b][row]
                mark = np.array([_mark(data[x:y]) for x, y in zip(offsets[:-1], offsets[1:])])
                held.append((ids[a:b][row][use], h[use], g[use], (at - first_words[:-1][row])[use].astype(np.int32), mark[row][use]))
                n += len(held[-1][0])
                if n >= flush:
                    yield from settle(held)
                    held, n = [], 0
        if n:
            yield from settle(held)

    return run


def _judge(slots: int):
    """Kind 0 entries of one bucket of hashes to the entries that other documents than the first must lose."""

    def run(t: pa.Table) -> pa.Table:
        ids, hashes = [], []
        for i, c, d in zip(*(t.column(x).to_pylist() for x in ("ids", "counts", "data"))):
            ids.append(np.repeat(np.frombuffer(i, np.int64), np.frombuffer(c, np.int32)))
            hashes.append(np.frombuffer(d, np.uint64))
        ids, hashes = np.concatenate(ids), np.concatenate(hashes)
        order = np.argsort(hashes, kind="stable")
        ids, hashes = ids[order], hashes[order]
        begins = _runs(hashes)
        least = np.minimum.reduceat(ids, begins)
        lost = ids > np.repeat(least, np.diff(np.r_[begins, len(ids)]))
        ids, hashes = ids[lost], hashes[lost]
        order = np.argsort(ids, kind="stable")
        rows = list(_pack(0, _doc_slot(ids[order], slots), ids[order], hashes[order]))
        release()
        return pa.Table.from_batches([_batch(rows)] if rows else [], schema=pa.schema(list(zip(["bucket", "kind", "ids", "counts", "data"], (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())))))

    return run


def _zip_texts(slots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids = batch.column(0)
            data, offsets = column_bytes(batch.column(1))
            raw, at = data.tobytes(), offsets.tolist()
            spread = np.where(np.asarray(ids.is_valid()), np.asarray(ids.fill_null(0)), np.arange(len(ids)) + len(raw))
            there = batch.column(1).is_valid().to_pylist()
            packed = pa.array([packer.compress(raw[a:b]) if ok else None for a, b, ok in zip(at, at[1:], there)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(_doc_slot(spread, slots)), ids, packed, *batch.columns[2:]], names=["slot", "doc_id", "packed", *batch.schema.names[2:]])

    return run


def _cut_out(width: int):
    def run(docs: pa.Table, removals: pa.Table) -> pa.Table:
        hashes: dict[int, list] = {}
        begins: dict[tuple[int, int], list] = {}
        for kind, i, c, d in zip(*(removals.column(x).to_pylist() for x in ("kind", "ids", "counts", "data"))):
            into, values = (begins, np.frombuffer(d, np.int64)) if kind else (hashes, np.frombuffer(d, np.uint64))
            ends = np.cumsum(np.frombuffer(c, np.int32))
            whose = np.frombuffer(i, np.int64)
            for one, b, n in zip(map(tuple, whose.reshape(-1, 2).tolist()) if kind else whose.tolist(), ends.tolist(), np.frombuffer(c, np.int32).tolist()):
                into.setdefault(one, []).append(values[b - n : b])
        unpack = zstandard.ZstdDecompressor().decompress
        n_words, spans, kept = [], [], []
        for one, packed in zip(docs.column("doc_id").to_pylist(), docs.column("packed").to_pylist()):
            raw = unpack(packed) if packed is not None else b""
            words = raw.split()
            lost = hashes.get(one, []) if one is not None else []
            lost_at = begins.get((one, _mark(raw)), []) if one is not None else []
            n_words.append(len(words))
            if not lost and not lost_at:
                spans.append([])
                kept.append(raw if packed is not None else None)
                continue
            gone = np.zeros(max(0, len(words) - width + 1), dtype=bool)
            if lost:
                data = np.frombuffer(raw, np.uint8)
                starts, ends, first_words = word_spans(data, np.array([0, len(data)]))
                h = window_hashes(span_hashes(data, starts, ends), first_words, width, 0)[0]
                gone |= np.isin(h, np.concatenate(lost))
            for at in lost_at:
                gone[at] = True
            found = merged(np.flatnonzero(gone), width).tolist()
            left, rest = [], 0
            for a, b in found:
                left += words[rest:a]
                rest = b
            left += words[rest:]
            spans.append([{"start": a, "end": b} for a, b in found])
            kept.append(b" ".join(left))
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        columns = [docs.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary()).cast(pa.string())]
        names = ["doc_id", "n_words", "removed", "kept_text"]
        if "carried" in docs.schema.names:
            columns.append(docs.column("carried"))
            names.append("carried")
        return pa.Table.from_arrays(columns, names=names)

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, carry: list[str] | None = None) -> DataFrame:
    """Cut every word covered by a window that also starts in a document with a smaller id.

    Returns ``doc_id, n_words, removed`` (maximal word intervals, end exclusive), ``kept_text`` and, with
    ``carry``, a struct ``carried`` of these columns. A text that loses nothing is kept as it is; else the kept
    words are joined by one space.
    """
    text_batches(docs.sparkSession)
    named = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")]
    slots = partitions_for(docs.select(*named))
    buckets = BUCKETS_PER_PARTITION * slots
    entries = docs.select(*named).mapInArrow(_windows(buckets, slots, window, FLUSH_WINDOWS), _PACKED)
    # Both kinds leave one pass over the texts: kind 1 is already judged and meets the rest in the second deal.
    judged = entries.repartition(slots, "bucket").groupBy("kind", "bucket").applyInArrow(_either(_judge(slots)), _PACKED)
    fields = [T.StructField("slot", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("packed", T.BinaryType())]
    out = [T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType())]
    out += T._parse_datatype_string("removed array<struct<start:bigint,end:bigint>>, kept_text string").fields
    if carry is not None:
        named.append(F.struct(*[F.col(c) for c in carry]).alias("carried"))
        carried = docs.select(named[-1]).schema["carried"]
        fields.append(carried)
        out.append(carried)
    texts = docs.select(*named).mapInArrow(_zip_texts(slots), T.StructType(fields))
    both = texts.repartition(slots, "slot").groupBy("slot").cogroup(judged.repartition(slots, "bucket").groupBy("bucket"))
    return both.applyInArrow(_cut_out(window), T.StructType(out))


def _either(judge):
    def run(t: pa.Table) -> pa.Table:
        return t if t.column("kind")[0].as_py() else judge(t)

    return run


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    found = substring_dedup(table(spark, sf_dir, "documents"))
    lost = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    # A text that lost nothing is unchanged, so its words are joined here.
    joined = F.trim(F.regexp_replace("kept_text", r"[\x20\x09-\x0D]+", " "))
    kept = F.when(F.size("removed") > 0, F.col("kept_text")).otherwise(joined)
    return found.select("doc_id", "n_words", lost.alias("n_removed"), F.sha2(F.coalesce(kept, F.lit("")).cast("binary"), 256).alias("kept_sha256"))
