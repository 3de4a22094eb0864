"""Words and rolling hashes of whole Arrow string columns, a block of rows at a time.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``. All of these are ASCII, so words of UTF-8 bytes are
the words of the text. Rows go through in blocks of about ``BLOCK_BYTES`` (a longer text is a block of its
own), which bounds the memory of the numpy temporaries whatever the batch size is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on unsigned 64-bit integers."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown as needed."""

    def __init__(self, base: int):
        self.base, self.inverse_base = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up, self.down = (self._grow(b, size) for b in (self.base, self.inverse_base))
        return self.up[:n], self.down[:n]

    @staticmethod
    def _grow(base: int, size: int) -> np.ndarray:
        out, filled = np.ones(size, dtype=np.uint64), 1
        while filled < size:
            step = np.uint64(pow(base, filled, 1 << 64))
            take = min(filled, size - filled)
            out[filled : filled + take] = out[:take] * step
            filled += take
        return out


_BYTE_POWERS = Powers(0x9E3779B97F4A7C15)
_WORD_POWERS = (Powers(0xD6E8FEB86659FD93), Powers(0xA0761D6478BD642F))
_BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and the offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.large_binary() if pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type) else pa.binary()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(wide) if column.type != wide else column
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    kind = np.int64 if wide == pa.large_binary() else np.int32
    offsets = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows that hold about ``block_bytes``."""
    data, offsets = column_bytes(column)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        end = int(np.searchsorted(offsets, offsets[first] + block_bytes, side="right")) - 1
        end = min(max(end, first + 1), rows)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes, and the index of each row's first word (with a final count).

    ``inside``: for each byte value whether words hold it, where words are other than the usual ones.
    """
    inside = ~_SEPARATOR[data] if inside is None else inside[data]
    n = len(data)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    starts_of_rows = offsets[:-1]
    before[starts_of_rows[starts_of_rows < n]] = False
    after[starts_of_rows[starts_of_rows > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans in ascending order, by prefix sums of a polynomial over coded bytes."""
    if len(data) > BLOCK_BYTES and len(starts) > 1:
        # A stretch at a time: the sums take several times the memory of the bytes.
        cuts = np.unique(np.searchsorted(starts, np.arange(0, len(data), BLOCK_BYTES)))
        parts = []
        for a, b in zip(cuts, [*cuts[1:], len(starts)]):
            if b > a:
                low = starts[a]
                parts.append(_span_hashes(data[low : ends[b - 1]], starts[a:b] - low, ends[a:b] - low))
        return np.concatenate(parts)
    return _span_hashes(data, starts, ends)


def _span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _BYTE_POWERS(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_CODES[data] * up[: len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64))


def window_hashes(words: np.ndarray, first_words: np.ndarray, width: int, which: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of every window of ``width`` words that lies inside one row.

    Returns the hashes, the index of each window's first word, and the number of windows of each row.
    """
    counts = np.maximum(np.diff(first_words) - width + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    begins = np.cumsum(counts) - counts
    at = np.arange(len(rows)) - begins[rows] + first_words[:-1][rows]
    up, down = _WORD_POWERS[which](len(words) + 1)
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mix((sums[at + width] - sums[at]) * down[at]), at, counts
