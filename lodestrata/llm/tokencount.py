"""Token counts by a linear longest-match automaton.

Greedy word-piece cutting takes the longest vocabulary piece at each place of a word. The automaton is the trie of
the vocabulary in which every node has a failure link and the number of pieces that following it completes; both
are computed once. Walking a word then only adds numbers, visits each byte once in the mean, and builds no piece.

The vocabulary marks pieces that end a word, so the last byte of a word is a symbol of its own. Every byte is a
piece in both forms, so every word can be cut. Words are runs of bytes outside ``[\\x20\\x09-\\x0D]`` of the
lower-cased text.

Equal words of a block are walked once, those of one length together; longer ones than ``LONGEST`` bytes singly.

Defined results: a null or empty text has no words and no tokens; rows with null or repeated ids get a result each.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import table, text_batches
from .textblocks import blocks, span_hashes, word_spans

VOCABULARY = "word_bpe_49k.json"
WORD_END = "</w>"
LONGEST = 64
BLOCK_BYTES = 2 << 20


def byte_alphabet() -> dict[str, int]:
    """The byte of each character that byte-level vocabularies write: printable Latin-1 stands for itself, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def vocabulary(path: str) -> set[tuple[bytes, bool]]:
    """(bytes, whether the piece ends a word) of each piece; special tokens are left out."""
    whole = json.load(open(path, encoding="utf-8"))
    special = {t["content"] for t in whole.get("added_tokens", ())}
    letters, found = byte_alphabet(), set()
    for token in whole["model"]["vocab"]:
        if token not in special:
            end = token.endswith(WORD_END) and token != WORD_END
            found.add((bytes(letters[c] for c in (token[: -len(WORD_END)] if end else token)), end))
    return found


class LongestMatch:
    """``step`` (node, byte), ``last`` (the step by a word's last byte), ``fail`` and ``pops`` by node."""

    def __init__(self, pieces: set[tuple[bytes, bool]]):
        children: list[dict[int, int]] = [{}]
        is_piece = [False]
        for word, end in pieces:
            node = 0
            symbols = [*word[:-1], word[-1] + 256 * end]
            for s in symbols:
                nxt = children[node].get(s)
                if nxt is None:
                    nxt = children[node][s] = len(children)
                    children.append({})
                    is_piece.append(False)
                node = nxt
            is_piece[node] = True
        if any(b + 256 * end not in children[0] or not is_piece[children[0][b + 256 * end]] for b in range(256) for end in (0, 1)):
            raise ValueError("the vocabulary lacks single bytes")
        n = len(children)
        fail, pops = [-1] * n, [0] * n
        todo = deque([0])
        while todo:
            u = todo.popleft()
            for s, v in children[u].items():
                if is_piece[v]:
                    fail[v], pops[v] = 0, 1
                else:
                    z, count = fail[u], pops[u]
                    while z >= 0 and s not in children[z]:
                        z, count = fail[z], count + pops[z]
                    fail[v], pops[v] = (children[z][s] if z >= 0 else -1), count
                todo.append(v)
        self.step = np.full((n, 256), -1, np.int32)
        ends: list[tuple[int, int]] = []
        for u, kids in enumerate(children):
            for s, v in kids.items():
                if s < 256:
                    self.step[u, s] = v
                else:
                    ends.append((u * 256 + s - 256, v))
        ends.sort()
        self.end_keys, self.end_nodes = (np.array(x, np.int64) for x in zip(*ends))
        self.fail, self.pops = np.array(fail, np.int32), np.array(pops, np.int64)
        # What leaving a node at the end of a word adds in all.
        self.rest = self.pops.copy()
        u = self.fail.copy()
        while (u > 0).any():
            on = u > 0
            self.rest[on] += self.pops[u[on]]
            u[on] = self.fail[u[on]]

    def last(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        key = node.astype(np.int64) * 256 + byte
        at = np.minimum(np.searchsorted(self.end_keys, key), len(self.end_keys) - 1)
        return np.where(self.end_keys[at] == key, self.end_nodes[at], -1)

    def count(self, words: np.ndarray) -> np.ndarray:
        """Pieces of each row of ``words`` (bytes of words of one length)."""
        rows, length = words.shape
        node, total = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        for k in range(length):
            byte = words[:, k]
            move = self.last if k == length - 1 else lambda u, b: self.step[u, b]
            nxt = move(node, byte).astype(np.int64)
            stuck = np.flatnonzero(nxt < 0)
            while len(stuck):
                u = node[stuck]
                total[stuck] += self.pops[u]
                node[stuck] = self.fail[u]
                nxt[stuck] = move(node[stuck], byte[stuck])
                stuck = stuck[nxt[stuck] < 0]
            node = nxt
        return total + self.rest[node]

    def count_one(self, word: bytes) -> int:
        step, fail, pops = memoryview(self.step), memoryview(self.fail), memoryview(self.pops)
        node = total = 0
        for byte in word[:-1]:
            while (nxt := step[node, byte]) < 0:
                total += pops[node]
                node = fail[node]
            node = nxt
        one = np.array([word[-1]])
        while (nxt := int(self.last(np.array([node]), one)[0])) < 0:
            total += pops[node]
            node = fail[node]
        return total + int(self.rest[nxt])


@lru_cache(maxsize=2)
def automaton(path: str) -> LongestMatch:
    return LongestMatch(vocabulary(path))


def word_counts(machine: LongestMatch, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    lengths = ends - starts
    out = np.zeros(len(starts), np.int64)
    order = np.argsort(lengths, kind="stable")
    begins = np.searchsorted(lengths[order], np.arange(1, LONGEST + 2))
    for length in range(1, LONGEST + 1):
        which = order[begins[length - 1] : begins[length]]
        if len(which):
            out[which] = machine.count(data[starts[which][:, None] + np.arange(length)])
    for k in order[begins[LONGEST] :]:
        out[k] = machine.count_one(data[starts[k] : ends[k]].tobytes())
    return out


def _counter(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(path)
        for batch in batches:
            n_words, n_tokens = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, _, data, offsets in blocks(batch.column(1), BLOCK_BYTES):
                starts, ends, first_words = word_spans(data, offsets)
                _, first, inverse = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
                each = word_counts(machine, data, starts[first], ends[first])
                n_words.append(np.diff(first_words))
                n_tokens.append(np.diff(np.r_[0, np.cumsum(each[inverse])][first_words]))
            columns = [batch.column(0), pa.array(np.concatenate(n_words), pa.int64()), pa.array(np.concatenate(n_tokens), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_tokens"])

    return run


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str | None = None) -> DataFrame:
    """``doc_id, n_words, n_tokens`` of every row."""
    path = vocabulary_path or public_tokenizers.path(VOCABULARY)
    text_batches(docs.sparkSession)
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lower(F.col(text_col).cast("string")).alias("text"))
    return chosen.mapInArrow(_counter(path), "doc_id long, n_words long, n_tokens long")


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
