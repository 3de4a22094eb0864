"""Vocabularies as byte tries that numpy walks for many words at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import exp, log

import numpy as np

SPACE = b" "
STRETCH = 1 << 16


class ByteTrie:
    """Nodes are numbered with the leaves last; ``piece`` has the piece that ends at a node (-1: none)."""

    def __init__(self, pieces: list[bytes]):
        self.longest = max(map(len, pieces), default=0)
        children: list[dict[int, int]] = [{}]
        piece = [-1]
        for k, p in enumerate(pieces):
            node = 0
            for b in p:
                nxt = children[node].get(b)
                if nxt is None:
                    nxt = children[node][b] = len(children)
                    children.append({})
                    piece.append(-1)
                node = nxt
            piece[node] = k
        inner = [n for n, kids in enumerate(children) if kids]
        place = np.empty(len(children), np.int32)
        place[inner] = np.arange(len(inner))
        place[[n for n, kids in enumerate(children) if not kids]] = np.arange(len(inner), len(children))
        # One row for all leaves, from which nothing leads on.
        self._rows = np.full((len(inner) + 1, 256), -1, dtype=np.int32)
        for row, n in enumerate(inner):
            self._rows[row, list(children[n])] = place[list(children[n].values())]
        self._leaves = len(inner)
        self.piece = np.empty(len(children), np.int32)
        self.piece[place] = piece

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Child of each node by a byte, -1 where there is none."""
        return self._rows[np.minimum(node, self._leaves), byte]


def arcs(trie: ByteTrie, word: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Arcs of the lattice of one word of any length, a stretch of ends at a time: (low, high, begin, starts, pieces).

    Those that end at ``low + 1 + k`` are at ``begin[k]`` to ``begin[k + 1]``, by start; piece -1 is the single byte.
    """
    for low in range(0, len(word), STRETCH):
        high = min(len(word), low + STRETCH)
        alive = np.arange(max(0, low - trie.longest + 1), high)
        node, width = np.zeros(len(alive), np.int32), 0
        starts, ends, pieces = [], [], []
        while len(alive):
            node = trie.step(node, word[alive + width])
            width += 1
            on = node >= 0
            alive, node = alive[on], node[on]
            piece = trie.piece[node]
            hit = (piece >= 0) & (alive + width > low)
            starts.append(alive[hit])
            ends.append(alive[hit] + width)
            pieces.append(piece[hit])
            on = alive + width < high
            alive, node = alive[on], node[on]
        start, end = np.concatenate([*starts, np.arange(low, high)]), np.concatenate([*ends, np.arange(low + 1, high + 1)])
        piece = np.concatenate([*pieces, np.full(high - low, -1, np.int32)])
        order = np.lexsort((start, end))
        yield low, high, np.searchsorted(end[order], np.arange(low + 1, high + 2)), start[order], piece[order]


def log_sums(trie: ByteTrie, word: np.ndarray, scaled: np.ndarray) -> Iterator[tuple]:
    """``arcs`` with the logarithms of the forward sums at ``low + 1`` to ``high`` (position, model).

    ``scaled`` has a weight by piece and model, that of a single byte last. Only a window as long as the longest piece
    is kept from one stretch to the next.
    """
    window, base = [[0.0] for _ in range(scaled.shape[1])], 0
    for low, high, begin, starts, pieces in arcs(trie, word):
        first, begins = (starts - base).tolist(), begin.tolist()
        out = np.empty((high - low, scaled.shape[1]))
        for m, sums in enumerate(window):
            weight = scaled[pieces, m].tolist()
            for a, b in zip(begins, begins[1:]):
                last, total = sums[-1], 0.0
                for k in range(a, b):
                    total += exp(sums[first[k]] - last) * weight[k]
                sums.append(last + log(total))
            out[:, m] = sums[low - high :]
            del sums[: max(0, high - trie.longest + 1) - base]
        base = max(base, high - trie.longest + 1)
        yield low, high, begin, starts, pieces, out


@lru_cache(maxsize=4)
def sentence_pieces(path: str) -> list[bytes]:
    """Pieces of a SentencePiece model in order of id, the word mark as a space; control and byte pieces are empty."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = lambda i: not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    return [model.id_to_piece(i).replace("▁", " ").encode() if plain(i) else b"" for i in range(model.get_piece_size())]
