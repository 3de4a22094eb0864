"""Quality rules as a bitmask ledger.

One pass measures every text; each rule is evaluated once on the measurements and sets one bit of
``failed_bits`` where it fails. A policy is a version name and a mask of the rules that reject. Applying another
policy, or asking what a rule costs, is bit arithmetic on the stored ledger and reads no text again.

Defined results: a null or empty text measures zero everywhere and fails ``few_words``; rows with null or
repeated ids get a ledger row each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import table, text_batches
from .textblocks import blocks, mix, span_hashes, window_hashes, word_spans

REPEAT_WINDOW = 8
SYMBOLS = "#*$%&|<>"

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letter_words", "longest_word", "n_ellipsis_lines", "n_bullet_lines"]


@dataclass(frozen=True)
class Rule:
    """Fails where ``fails`` holds; ``bit`` is its place in the ledger and never changes."""

    bit: int
    name: str
    fails: str


#: Ratios are compared as whole numbers, so a ledger is the same on every platform.
RULES = [
    Rule(0, "few_words", "n_words < 20"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "short_words", "word_chars < 2 * n_words"),
    Rule(3, "long_words", "word_chars > 25 * n_words"),
    Rule(4, "symbols", "n_symbols > n_words"),
    Rule(5, "repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule(6, "few_letters", "100 * n_letter_words < 50 * n_words"),
    Rule(7, "ellipsis_lines", "100 * n_ellipsis_lines > 50 * n_lines"),
    Rule(8, "bullet_lines", "100 * n_bullet_lines > 95 * n_lines"),
    Rule(9, "huge_word", "longest_word > 1000"),
]


def mask(*names: str) -> int:
    known = {r.name: 1 << r.bit for r in RULES}
    return sum(known[n] for n in names)


BASE = mask("few_words", "repeated_words")

#: Versioned policies: the rules that reject under each.
POLICIES = {
    "base": BASE,
    "v1": BASE | mask("short_words", "long_words", "symbols", "few_letters", "huge_word"),
    "v2": mask(*(r.name for r in RULES)),
}
CURRENT = "v1"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_START = np.ones(256, bool)  # bytes that begin a code point
_START[0x80:0xC0] = False
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.array([chr(k).isalpha() for k in range(0x110000)])


def letter_starts(data: np.ndarray) -> np.ndarray:
    """For each byte whether a letter begins there; bytes that are no UTF-8 begin none."""
    out = _ASCII_LETTER[data]
    if (data > 127).any():
        points = np.frombuffer(data.tobytes().decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)
        wide = np.where(points < 0x80, 1, np.where(points < 0x800, 2, np.where(points < 0x10000, 3, 4)))
        wide[(points >= 0xDC80) & (points <= 0xDCFF)] = 1  # a byte that is no UTF-8
        starts = np.cumsum(wide) - wide
        out[starts] = _letters()[points]
    return out



def _total(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def _keyed(h: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return mix(h + rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def measure_block(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The measurements of each row of a block."""
    rows = len(offsets) - 1
    starts, ends, first_words = word_spans(data, offsets)
    n_words = np.diff(first_words)
    word_row = np.repeat(np.arange(rows), n_words)
    points = _total(_START[data])
    lengths = points[ends] - points[starts]
    out = {"n_words": n_words, "word_chars": np.bincount(word_row, lengths, rows).astype(np.int64)}
    out["n_symbols"] = np.diff(_total(_SYMBOL[data])[offsets])
    letters = _total(letter_starts(data))
    out["n_letter_words"] = np.bincount(word_row[letters[ends] > letters[starts]], minlength=rows)
    longest = np.zeros(rows, np.int64)
    np.maximum.at(longest, word_row, lengths)
    out["longest_word"] = longest

    breaks = np.flatnonzero(data == 10)
    begin = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    end = np.sort(np.concatenate([breaks, offsets[1:]]), kind="stable")
    # A row's first line begins at its offset and its last one ends at the next: both lists pair up in order.
    first = np.searchsorted(starts, begin)
    used = np.searchsorted(starts, end) > first
    begin, end, first = begin[used], end[used], first[used]
    line_row = np.searchsorted(offsets, begin, side="right") - 1
    out["n_lines"] = np.bincount(line_row, minlength=rows)
    keys = _keyed(span_hashes(data, begin, end), line_row)
    unique = line_row[np.unique(keys, return_index=True)[1]]
    out["n_dup_lines"] = out["n_lines"] - np.bincount(unique, minlength=rows)
    last = ends[np.searchsorted(starts, end) - 1]
    padded = np.concatenate([np.zeros(3, np.uint8), data])
    tail = np.stack([padded[last + k] for k in range(3)], axis=1) if len(last) else np.zeros((0, 3), np.uint8)
    dots = (tail == 46).all(axis=1) | (tail == [0xE2, 0x80, 0xA6]).all(axis=1)
    out["n_ellipsis_lines"] = np.bincount(line_row[dots], minlength=rows)
    head = data[starts[first]] if len(first) else np.zeros(0, np.uint8)
    out["n_bullet_lines"] = np.bincount(line_row[(head == 45) | (head == 42)], minlength=rows)

    h, at, counts = window_hashes(span_hashes(data, starts, ends), first_words, REPEAT_WINDOW)
    keys = _keyed(h, np.repeat(np.arange(rows), counts))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    again = order[np.r_[False, same] | np.r_[same, False]] if len(keys) else order
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, at[again], 1)
    np.add.at(cover, at[again] + REPEAT_WINDOW, -1)
    out["n_repeat_words"] = np.bincount(word_row[np.cumsum(cover[:-1]) > 0], minlength=rows)
    return out


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [measure_block(data, offsets) for _, _, data, offsets in blocks(batch.column(1))]
        columns = [pa.array(np.concatenate([f[m] for f in found]) if found else np.zeros(0), pa.int64()) for m in MEASURES]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *MEASURES])


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the measurements, and ``failed_bits`` (long): bit k is set where rule k fails."""
    text_batches(docs.sparkSession)
    schema = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)
    measured = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_measure, schema)
    bits = F.lit(0).cast("long")
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("failed_bits", bits)


def fails(policy: str = CURRENT) -> Column:
    return F.col("failed_bits").bitwiseAND(F.lit(POLICIES[policy]).cast("long")) != 0


def ablation(book: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Per rule of a policy: documents it fails, documents it alone fails (kept without it), and documents kept.

    The ledger is first counted by its bits, so what is exploded by rule has one row for each set of bits.
    """
    chosen = F.col("failed_bits").bitwiseAND(F.lit(POLICIES[policy]).cast("long"))
    counted = book.groupBy(chosen.alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in RULES if POLICIES[policy] >> r.bit & 1])
    each = counted.select("bits", "n", F.explode(rules).alias("r"))
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    alone = F.col("bits") == F.col("r.bit")
    total = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(F.lit(0).cast("long")))
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        total(hit).alias("n_failed"), total(alone).alias("n_failed_alone"), total(F.col("bits") == 0).alias("n_kept"), total((F.col("bits") == 0) | alone).alias("n_kept_without")
    )


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    book = ledger(table(spark, sf_dir, "documents"))
    base = F.col("failed_bits").bitwiseAND(F.lit(BASE).cast("long")) != 0
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~fails()).alias("kept"), "failed_bits")
