"""Language ID by segmentation-marginalised unigrams.

A language is a distribution over the pieces of a fixed public vocabulary. The probability of a word is the sum
over all its segmentations into pieces, by the forward algorithm; a text scores the sum of its words' logarithms.
The distributions are fitted by expectation-maximisation: forward and backward sums give each piece's expected
count. A byte that no piece covers has the small probability ``FALLBACK``, so every word has a segmentation.

Words are runs of ASCII letters and non-ASCII bytes of the lower-cased text. Equal words of a block are scored
once, and words of one length go through the lattice together; runs over ``LONGEST`` bytes go singly.

Fitting reads about ``SAMPLE_DOCS`` documents per language, chosen by a hash of the id; scoring reads everything.
The fitted model has one probability per language and piece, a size that does not grow with the corpus.

Defined results: ``und`` with score 0 for a text that is null or has no letter, and for every text where there
was nothing to learn from; ``held_out`` is false for a null id, and such rows are not learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import cut, release, shuffle_partitions, table, text_batches
from .textblocks import blocks, span_hashes, word_spans
from .trie import ByteTrie, log_sums, sentence_pieces

VOCABULARY = "piece_bpe_32k.model"
SAMPLE_DOCS = 2000
ROUNDS = 2
FALLBACK = 1e-7
SMOOTHING = 0.1
LONGEST = 48
BLOCK_BYTES = 2 << 20

#: Scores are kept near 1 by this factor for each byte, taken out of the logarithm at the end.
_TILT = float(np.exp(2.2))

_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


@lru_cache(maxsize=2)
def _trie(path: str) -> ByteTrie:
    pieces = sentence_pieces(path)
    trie = ByteTrie(pieces)
    trie.piece[0] = -1
    trie.widths = np.array([len(p) for p in pieces])
    return trie


def start(path: str) -> np.ndarray:
    """Piece probabilities before fitting, by rank in the vocabulary; one row."""
    pieces = sentence_pieces(path)
    p = np.array([1.0 / (k + 100) if w else 0.0 for k, w in enumerate(pieces)])
    return (p / p.sum())[None, :]


def _unique_words(data: np.ndarray, offsets: np.ndarray):
    """Spans of the distinct words of a block, the word number of each occurrence and the occurrences' row bounds."""
    starts, ends, first_words = word_spans(data, offsets, _LETTERS)
    _, first, inverse = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    return starts[first], ends[first], inverse, first_words


def _lattice(trie: ByteTrie, words: np.ndarray):
    """Edges (start, end, row numbers, pieces) of words of equal length, in order of start."""
    rows, length = words.shape
    for i in range(length):
        alive = np.arange(rows)
        node = np.zeros(rows, np.int32)
        for j in range(i, length):
            node = trie.step(node, words[alive, j])
            on = node >= 0
            if not on.all():
                alive, node = alive[on], node[on]
            if not len(alive):
                break
            piece = trie.piece[node]
            hit = piece >= 0
            if hit.any():
                yield i, j + 1, alive[hit], piece[hit]
        yield i, i + 1, None, None


def _forward(trie: ByteTrie, words: np.ndarray, scaled: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Forward sums (position, row, model); ``scaled``: probability of piece and model times the tilt of its bytes."""
    rows, length = words.shape
    alpha = np.zeros((length + 1, rows, scaled.shape[1]))
    alpha[0] = 1
    for i, j, at, piece in _lattice(trie, words):
        if at is None:
            alpha[j] += alpha[i] * (FALLBACK * _TILT)
        else:
            alpha[j, at] += alpha[i, at] * scaled[piece]
        if keep is not None:
            keep.append((i, j, at, piece))
    return alpha


#: Words times languages that are summed at a time.
SUMS = 1 << 15


def _by_length(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int = 1 << 13):
    """(word numbers, bytes with a leading space) of words of one length up to ``LONGEST`` at a time."""
    lengths = ends - starts
    order = np.argsort(lengths, kind="stable")
    begins = np.searchsorted(lengths[order], np.arange(1, LONGEST + 2))
    for length in range(1, LONGEST + 1):
        for a in range(begins[length - 1], begins[length], most):
            which = order[a : min(a + most, begins[length])]
            words = np.full((len(which), length + 1), 32, np.uint8)
            words[:, 1:] = data[starts[which][:, None] + np.arange(length)]
            yield which, words


def _long(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(word number, bytes with a leading space) of each word over ``LONGEST``."""
    for k in np.flatnonzero(ends - starts > LONGEST).tolist():
        yield k, np.r_[np.uint8(32), data[starts[k] : ends[k]]]


def word_scores(path: str, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, probabilities: np.ndarray) -> np.ndarray:
    """Log-probability of each word (row) under each model (column)."""
    trie = _trie(path)
    scaled = np.ascontiguousarray((probabilities * _TILT ** trie.widths).T)
    out = np.empty((len(starts), len(probabilities)))
    # Sums are kept by position, word and language: fewer words at a time where there are more languages.
    for which, words in _by_length(data, starts, ends, max(64, SUMS // len(probabilities))):
        out[which] = np.log(_forward(trie, words, scaled)[-1]) - words.shape[1] * np.log(_TILT)
    with_byte = np.vstack([scaled, np.full(scaled.shape[1], FALLBACK * _TILT)])
    for k, word in _long(data, starts, ends):
        for *_, sums in log_sums(trie, word, with_byte):
            out[k] = sums[-1] - len(word) * np.log(_TILT)
    return out


def expected_counts(path: str, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, times: np.ndarray, probabilities: np.ndarray) -> np.ndarray:
    """Expected count of each piece over all segmentations of the words, each taken ``times``; one model."""
    trie = _trie(path)
    scaled = (probabilities * _TILT**trie.widths)[:, None]
    counts = np.zeros(len(probabilities))
    for which, words in _by_length(data, starts, ends, 1 << 11):
        edges: list = []
        alpha = _forward(trie, words, scaled, edges)[:, :, 0]
        beta = np.zeros_like(alpha)
        beta[-1] = times[which] / alpha[-1]
        for i, j, at, piece in reversed(edges):
            if at is None:
                beta[i] += beta[j] * (FALLBACK * _TILT)
            else:
                share = scaled[piece, 0] * beta[j, at]
                beta[i, at] += share
                counts += np.bincount(piece, share * alpha[i, at], len(counts))
    with_byte = np.vstack([scaled, [[FALLBACK * _TILT]]])
    for k, word in _long(data, starts, ends):
        stretches = list(log_sums(trie, word, with_byte))
        sums = np.r_[0.0, *[s[-1][:, 0] for s in stretches]]
        reached = [0.0] * len(word) + [float(times[k])]  # expected times that a piece ends there
        for low, high, begin, first, piece, _ in reversed(stretches):
            width = np.diff(begin)
            share = np.exp(sums[first] - np.repeat(sums[low + 1 : high + 1], width)) * with_byte[piece, 0]
            shares, firsts, at = share.tolist(), first.tolist(), begin.tolist()
            for j in range(high, low, -1):
                for a in range(at[j - low - 1], at[j - low]):
                    reached[firsts[a]] += reached[j] * shares[a]
            share *= np.repeat(reached[low + 1 : high + 1], width)
            counts += np.bincount(piece[piece >= 0], share[piece >= 0], len(counts))
    return counts


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _counter(path: str, langs: list[str], model: np.ndarray):
    place = {lang: k for k, lang in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), model.shape[1]))
        for batch in batches:
            of = np.array([place.get(x, -1) for x in batch.column(0).to_pylist()])
            for k in np.unique(of[of >= 0]):
                for _, _, data, offsets in blocks(pc.utf8_lower(batch.column(1).filter(pa.array(of == k))), BLOCK_BYTES):
                    starts, ends, inverse, _ = _unique_words(data, offsets)
                    times = np.bincount(inverse, minlength=len(starts))
                    total[k] += expected_counts(path, data, starts, ends, times, model[k if len(model) > 1 else 0])
            release()
        k, piece = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(piece, pa.int32()), pa.array(total[k, piece])], names=["k", "piece", "n"])

    return run


def fit(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, rounds: int = ROUNDS, vocabulary: str = VOCABULARY) -> tuple[list[str], np.ndarray]:
    """Languages and their piece probabilities, from about ``sample_docs`` documents of each language."""
    path = public_tokenizers.path(vocabulary)
    text_batches(docs.sparkSession)
    known = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    sizes = known.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).orderBy("lang").collect()
    if not sizes:
        return [], np.zeros((0, len(sentence_pieces(path))))
    langs = [r["lang"] for r in sizes]
    share = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, sample_docs / r["n"])))])
    draw = F.pmod(F.xxhash64(F.lit("language sample"), F.col(id_col)), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.where(draw < share[F.col(lang_col)]).select(F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text"))
    chosen = cut(chosen.repartition(shuffle_partitions(docs.sparkSession)))
    model = start(path)
    live = (model[0] > 0).astype(float)
    for _ in range(rounds):
        counted = chosen.mapInArrow(_counter(path, langs, model), "k int, piece int, n double").groupBy("k", "piece").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros((len(langs), model.shape[1]))
        counts[counted["k"], counted["piece"]] = counted["n"]
        counts += SMOOTHING * live
        model = counts / counts.sum(axis=1, keepdims=True)
    return langs, model


def _has_letter(raw: bytes, ascii_letter: bool) -> bool:
    return ascii_letter or any(c.isalpha() for c in raw.decode("utf-8", "replace") if c > "\x7f")


def _scorer(path: str, langs: list[str], model: np.ndarray, text_in_carried: int | None):
    """The text is the third column, or the field of that number in ``carried``, which then is the third."""
    own = text_in_carried is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter = _LETTERS & (np.arange(256) < 128)
        for batch in batches:
            best, score = [], []
            text = batch.column(2) if own else pc.struct_field(batch.column(2), [text_in_carried]).cast(pa.string())
            for _, _, data, offsets in blocks(pc.utf8_lower(text), BLOCK_BYTES):
                starts, ends, inverse, first_words = _unique_words(data, offsets)
                rows = len(offsets) - 1
                plain = np.diff(np.r_[0, np.cumsum(letter[data])][offsets]) > 0
                total = np.zeros((rows, len(langs)))
                if len(langs) and len(starts):
                    each = word_scores(path, data, starts, ends, model)
                    row = np.repeat(np.arange(rows), np.diff(first_words))
                    for k in range(len(langs)):
                        total[:, k] = np.bincount(row, each[inverse, k], rows)
                for r in range(rows):
                    if not len(langs) or first_words[r] == first_words[r + 1] or not _has_letter(data[offsets[r] : offsets[r + 1]].tobytes(), bool(plain[r])):
                        best.append("und")
                        score.append(0.0)
                    else:
                        k = int(total[r].argmax())
                        best.append(langs[k])
                        score.append(float(1 / np.exp(total[r] - total[r, k]).sum()))
            columns = [batch.column(0), batch.column(1), pa.array(best, pa.string()), pa.array(score, pa.float64()), *batch.columns[2:][own:]]
            release()
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "lang_pred", "score", *batch.schema.names[2:][own:]])

    return run


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, carry: list[str] | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row; the score is the posterior under equal priors.

    With ``carry``, a struct ``carried`` of these columns comes along, whatever their names.
    """
    text_batches(docs.sparkSession)
    chosen = [F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out")]
    out = T._parse_datatype_string("doc_id long, held_out boolean, lang_pred string, score double").fields
    in_carried = carry.index(text_col) if carry is not None and text_col in carry else None
    if in_carried is None:
        chosen.append(F.col(text_col).cast("string").alias("text"))
    if carry is not None:
        chosen.append(F.struct(*[F.col(c) for c in carry]).alias("carried"))
        out.append(docs.select(chosen[-1]).schema["carried"])
    return docs.select(*chosen).mapInArrow(_scorer(public_tokenizers.path(vocabulary), *model, in_carried), T.StructType(out))


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))
