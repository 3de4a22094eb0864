"""SentencePiece sampling without replacement, and decoding.

A text gets a space in front and is cut before every line feed and every run of spaces. No piece of the vocabulary holds
a space after another byte or a line feed (checked when it is loaded), so none goes over a cut, and the lattice of the
text is the product of the lattices of its units: their segmentations into vocabulary pieces and single bytes. A segmentation's probability is the product of its
pieces', normalised over the lattice.

Sampling is a perturbed A-star search. The perturbed score of a set of segmentations (the largest log-probability
plus Gumbel noise in it) is a Gumbel variable placed at the set's log-mass, so it can be drawn before the set is
searched, and serves as an exact bound. The set with the largest score gives the next sample: its pieces are
drawn backwards through forward sums. What is left of the set is split by the first unit that differs, every part
gets its own score below the set's, and the search goes on. The k results are distinct and distributed as k draws
without replacement. The score left over after k gives each sample's inclusion score
``log(1 - exp(-exp(log_prob - left)))``.

All noise comes from a hash of the row key and the place, so a row's samples do not depend on its neighbours.

Defined results: a null or empty text has one segmentation, the empty one, with inclusion score 0; a text with
fewer than k segmentations gives all; rows with a null id share one key, rows that repeat an id their noise. What is
left of a unit's probability is added up from the alternatives where a difference would lose digits, so none is too
small to be drawn. Units of up to ``LONGEST`` bytes go through the lattice by length, longer ones singly and whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import table, text_batches
from .textblocks import blocks, mix, span_hashes
from .trie import ByteTrie, log_sums, sentence_pieces

VOCABULARY = "piece_bpe_32k.model"
SAMPLES = 4
FALLBACK = 1e-7
#: Below this part of a unit's probability, what is left is added up from the alternatives, not subtracted.
SUBTRACT = 1e-6
LONGEST = 48
#: Bytes of a block: samples do not depend on it, but lattices of few words cost as much as those of many.
BLOCK_BYTES = 6 << 20

WORD = (1 << 64) - 1

_TILT = float(np.exp(2.2))


class Vocabulary:
    """Pieces as bytes, their scaled probabilities (by rank, to the power ``sharpness``) and the ids of single bytes."""

    def __init__(self, path: str, sharpness: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = sentence_pieces(path)
        if any(b"\n" in w or b" " in w.lstrip(b" ") for w in pieces):
            raise ValueError("the vocabulary has pieces that go over a cut")
        self.trie = ByteTrie(pieces)
        self.trie.piece[0] = -1
        p = np.array([(k + 100.0) ** -sharpness if w else 0.0 for k, w in enumerate(pieces)])
        widths = np.array([len(w) for w in pieces])
        self.scaled = p / p.sum() * _TILT**widths
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.scaled[self.byte_ids] = FALLBACK * _TILT
        self.log_scaled = np.log(np.where(self.scaled > 0, self.scaled, 1.0))
        self.widths = np.maximum(widths, 1)
        self.bytes = list(pieces)
        for b, k in enumerate(self.byte_ids):
            self.bytes[k] = bytes([b])


@lru_cache(maxsize=2)
def vocabulary(path: str, sharpness: float) -> Vocabulary:
    return Vocabulary(path, sharpness)


class Lattice:
    """Lattices of words of one length: forward sums (position, word) and, by end, the arcs (start, pieces, weights).

    ``shares`` has, by end, what each arc adds to the sum there.
    """

    def __init__(self, v: Vocabulary, words: np.ndarray):
        rows, self.length = words.shape
        self.log_scaled = v.log_scaled
        self._options: dict[tuple[int, int], list] = {}
        self.arcs: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(self.length + 1)]
        for i in range(self.length):
            alive, node = np.arange(rows), np.zeros(rows, np.int32)
            for j in range(i, self.length):
                node = v.trie.step(node, words[alive, j])
                on = node >= 0
                alive, node = alive[on], node[on]
                if not len(alive):
                    break
                piece = v.trie.piece[node]
                hit = piece >= 0
                if hit.any():
                    ids, weight = np.full(rows, -1, np.int32), np.zeros(rows)
                    ids[alive[hit]] = piece[hit]
                    weight[alive[hit]] = v.scaled[piece[hit]]
                    self.arcs[j + 1].append((i, ids, weight))
            self.arcs[i + 1].append((i, v.byte_ids[words[:, i]], np.full(rows, FALLBACK * _TILT)))
        self.sums = np.zeros((self.length + 1, rows))
        self.sums[0] = 1
        self.shares: list[list[np.ndarray]] = [[] for _ in range(self.length + 1)]
        for j in range(1, self.length + 1):
            self.arcs[j].sort(key=lambda a: a[0])  # long pieces first: they carry most of the mass
            for i, _, weight in self.arcs[j]:
                self.shares[j].append(self.sums[i] * weight)
                self.sums[j] += self.shares[j][-1]
        self.logs = -np.log(self.sums[self.length])
        #: Words with more than one segmentation.
        self.many = sum((weight > 0).astype(np.int32) for arcs in self.arcs for _, _, weight in arcs) > self.length

    def options(self, word: int, j: int) -> list[tuple[int, int, float]]:
        """Arcs that end at ``j``: start, piece and share of what is there."""
        found = self._options.get((word, j))
        if found is None:
            total = self.sums[j, word]
            found = [(i, int(ids[word]), float(self.sums[i, word] * w / total)) for i, ids, weight in self.arcs[j] if (w := weight[word])]
            self._options[word, j] = found
        return found

    def log_prob(self, word: int, pieces: np.ndarray) -> float:
        out, at = -float(np.log(self.sums[self.length, word])), 0
        for j in np.flatnonzero(pieces >= 0).tolist():
            out += float(np.log(next(w[word] for i, ids, w in self.arcs[j] if i == at and ids[word] == pieces[j])))
            at = j
        return out

    def events(self, word: np.ndarray, seed: np.ndarray) -> tuple[list[tuple], np.ndarray, np.ndarray]:
        """A segmentation for each entry of ``word``: events (entries, pieces of each that come later, pieces, end), numbers of pieces and log-probabilities."""
        n = len(word)
        log_prob, counts, found = self.logs[word], np.zeros(n, np.int32), []
        ahead: list[list[np.ndarray]] = [[] for _ in range(self.length)] + [[np.arange(n)]]
        for j in range(self.length, 0, -1):
            if not ahead[j]:
                continue
            here = ahead[j][0] if len(ahead[j]) == 1 else np.concatenate(ahead[j])
            w = word[here]
            left = uniform(seed[here] + np.uint64(j)) * self.sums[j][w]
            for k, (i, ids, _) in enumerate(self.arcs[j]):
                share = self.shares[j][k][w]
                done = share > 0
                if k < len(self.arcs[j]) - 1:
                    done &= left < share
                if not done.any():
                    left = left - share
                    continue
                who, what = here[done], ids[w[done]]
                log_prob[who] += self.log_scaled[what]
                place = counts[who]
                counts[who] = place + 1
                found.append((who, place, what, j))
                if i:
                    ahead[i].append(who)
                if len(who) == len(here):
                    break
                keep = ~done
                here, w, left = here[keep], w[keep], left[keep] - share[keep]
        return found, counts, log_prob

    def draw(self, word: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same with pieces by their end (-1: none)."""
        return by_ends(self, word, seed)


class LongLattice:
    """``Lattice`` of one unit of any length: arcs by end in flat arrays, forward sums as logarithms."""

    def __init__(self, v: Vocabulary, word: np.ndarray):
        self.length, self.scaled = len(word), v.scaled
        starts, ids, widths, sums = [], [], [], [[0.0]]
        with_byte = np.r_[v.scaled, FALLBACK * _TILT][:, None]
        for _, _, begin, first, piece, logs in log_sums(v.trie, word, with_byte):
            starts.append(first.astype(np.int32))
            ids.append(np.where(piece < 0, v.byte_ids[word[first]], piece).astype(np.int32))
            widths.append(np.diff(begin))
            sums.append(logs[:, 0])
        self.starts, self.ids, self.sums = np.concatenate(starts), np.concatenate(ids), np.concatenate(sums)
        self.begin = np.r_[0, 0, np.cumsum(np.concatenate(widths))]
        self.many = np.array([len(self.ids) > self.length])

    def options(self, word: int, j: int) -> list[tuple[int, int, float]]:
        here = slice(self.begin[j], self.begin[j + 1])
        start, ids = self.starts[here], self.ids[here]
        return list(zip(start.tolist(), ids.tolist(), (np.exp(self.sums[start] - self.sums[j]) * self.scaled[ids]).tolist()))

    def log_prob(self, word: int, pieces: np.ndarray) -> float:
        return float(np.log(self.scaled[pieces[pieces >= 0]]).sum() - self.sums[-1])

    def events(self, word: np.ndarray, seed: np.ndarray) -> tuple[list[tuple], np.ndarray, np.ndarray]:
        found, counts, log_prob = [], np.zeros(len(word), np.int32), np.full(len(word), -self.sums[-1])
        for r in range(len(word)):
            noise, j = uniform(seed[r] + np.arange(self.length + 1, dtype=np.uint64)), self.length
            ids, ends = [], []
            while j:
                arcs = self.options(0, j)
                left, k = float(noise[j]) * sum(a[2] for a in arcs), 0
                while k < len(arcs) - 1 and left >= arcs[k][2]:
                    left -= arcs[k][2]
                    k += 1
                ids.append(arcs[k][1])
                ends.append(j)
                j = arcs[k][0]
            counts[r] = len(ids)
            found.append((np.full(len(ids), r), np.arange(len(ids)), np.array(ids, np.int32), np.array(ends)))
            log_prob[r] += np.log(self.scaled[ids[::-1]]).sum()
        return found, counts, log_prob

    def draw(self, word: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return by_ends(self, word, seed)


def by_ends(lattice: Lattice | LongLattice, word: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segmentations as a matrix of pieces by their end (-1: none), and their log-probabilities."""
    pieces = np.full((len(word), lattice.length + 1), -1, np.int32)
    found, _, log_prob = lattice.events(word, seed)
    for who, _, ids, end in found:
        pieces[who, end] = ids
    return pieces, log_prob


class Others:
    """The segmentations of one word of a lattice that are none of ``excluded`` (pieces by end).

    States are (end, excluded ones that agree from there on). Each has its arcs and the part of the mass of the
    prefixes up to there that no excluded one takes, a sum of positive terms.
    """

    def __init__(self, lattice: Lattice | LongLattice, word: int, excluded: list[np.ndarray]):
        self.lattice, self.word = lattice, word
        self.start = (lattice.length, tuple(range(len(excluded))))
        self.arcs: dict[tuple, list[tuple]] = {}
        todo = [self.start]
        while todo:
            state = todo.pop()
            j, live = state
            found = []
            for i, piece, share in lattice.options(word, j):
                same = tuple(e for e in live if excluded[e][j] == piece)
                found.append((i, piece, share, same))
                if same and i:
                    todo.append((i, same))
            self.arcs[state] = found
        self.part: dict[tuple, float] = {}
        for state in sorted(self.arcs):
            self.part[state] = sum(share * self._part(i, same) for i, _, share, same in self.arcs[state])

    def _part(self, i: int, same: tuple) -> float:
        return 1.0 if not same else self.part[i, same] if i else 0.0

    def left(self) -> float:
        """The probability of all of them."""
        return self.part[self.start]

    def draw(self, seed: np.uint64) -> tuple[np.ndarray, float]:
        """One of them, by its share of what is left: pieces by end, and its log-probability."""
        found = np.full(self.lattice.length + 1, -1, np.int32)
        j, live = self.start
        while j:
            arcs = self.arcs[j, live] if live else [(*a, ()) for a in self.lattice.options(self.word, j)]
            weights = [share * self._part(i, same) for i, _, share, same in arcs]
            left = uniform_of(int(seed) + j) * sum(weights)
            chosen = weights.index(max(weights))
            for k, weight in enumerate(weights):
                if weight > 0:
                    chosen = k
                    if left < weight:
                        break
                left -= weight
            found[j] = arcs[chosen][1]
            j, live = arcs[chosen][0], arcs[chosen][3]
        return found, self.lattice.log_prob(self.word, found)


def uniform(seed: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit seeds."""
    return ((mix(seed + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def uniform_of(seed: int) -> float:
    """``uniform`` of one seed, without arrays."""
    h = (seed + 0x9E3779B97F4A7C15) & WORD
    h = ((h ^ h >> 30) * 0xBF58476D1CE4E5B9) & WORD
    h = ((h ^ h >> 27) * 0x94D049BB133111EB) & WORD
    return (((h ^ h >> 31) >> 11) + 0.5) / (1 << 53)


def gumbel_below(seed: np.ndarray, place: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Gumbel variables placed at ``place``, each given that it is below ``bound``."""
    g = place - np.log(-np.log(uniform(seed)))
    return -np.logaddexp(-g, -bound)


class Block:
    """The samples of a block of rows."""

    def __init__(self, v: Vocabulary, data: np.ndarray, offsets: np.ndarray, keys: np.ndarray):
        self.widths = v.widths
        full = np.flatnonzero(np.diff(offsets) > 0)
        self.rows, self.keys = len(offsets) - 1, keys
        text = np.insert(data, offsets[:-1][full], 32)
        bounds = offsets + np.r_[0, np.cumsum(np.diff(offsets) > 0)]
        cut = (text == 10) | (text == 32) & (np.r_[np.uint8(0), text[:-1]] != 32)
        cut[bounds[:-1][full]] = True
        starts = np.flatnonzero(cut)
        ends = np.r_[starts[1:], len(text)] if len(starts) else starts
        self.first = np.searchsorted(starts, bounds)
        self.row = np.repeat(np.arange(self.rows), np.diff(self.first))
        self.place = np.arange(len(starts)) - self.first[:-1][self.row]
        _, first, inverse = np.unique(span_hashes(text, starts, ends), return_index=True, return_inverse=True)
        lengths = (ends - starts)[first]
        order = np.argsort(lengths, kind="stable")
        self.lattices: list[Lattice | LongLattice] = []
        self.lattice_of, self.word_of = np.zeros(len(first), np.int32), np.zeros(len(first), np.int64)
        begins = np.searchsorted(lengths[order], np.arange(1, LONGEST + 2))
        for length in range(1, LONGEST + 1):
            for a in range(begins[length - 1], begins[length], 1 << 14):
                which = order[a : min(a + (1 << 14), begins[length])]
                self.lattice_of[which], self.word_of[which] = len(self.lattices), np.arange(len(which))
                self.lattices.append(Lattice(v, text[starts[first][which][:, None] + np.arange(length)]))
        for k in order[begins[LONGEST] :].tolist():
            self.lattice_of[k] = len(self.lattices)
            self.lattices.append(LongLattice(v, text[starts[first[k]] : starts[first[k]] + lengths[k]]))
        self.unit_lattice, self.unit_word = self.lattice_of[inverse], self.word_of[inverse]
        begins = np.cumsum([0, *(len(x.many) for x in self.lattices)])
        many = np.concatenate([np.zeros(0, bool), *(x.many for x in self.lattices)])
        self.different = begins[self.unit_lattice] + self.unit_word
        self.many = many[self.different]
        self._whole = np.full(len(many), np.nan)  # what is left of different units where one piece is all of them
        self._known: dict[tuple, float] = {}  # what is left of equal segmentations of equal units
        self._excluded: dict[int, list[np.ndarray]] = {}  # of the unit where the last sample of a row differs
        self.seeds = mix(keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))

    def draw(self, units: np.ndarray, turn: int, counts: np.ndarray, log_prob: np.ndarray) -> list[tuple]:
        """Fresh segmentations of ``units``: events (units, pieces of each that come later, pieces); numbers of pieces and log-probabilities are put in place."""
        by = units[np.argsort(self.unit_lattice[units], kind="stable")]
        cuts = np.searchsorted(self.unit_lattice[by], np.arange(len(self.lattices) + 1)).tolist()
        seeds = self.seeds[self.row[by]] + mix(self.place[by].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(turn))
        words, found = self.unit_word[by], []
        for lattice, a, b in zip(self.lattices, cuts, cuts[1:]):
            if a < b:
                who = by[a:b]
                drawn, counts[who], log_prob[who] = lattice.events(words[a:b], seeds[a:b])
                found += [(who[entry], place, ids) for entry, place, ids, _ in drawn]
        return found

    @staticmethod
    def _flat(counts: np.ndarray, events: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all units in order, those of ``events`` put in place, and where each unit's begin."""
        begin = np.r_[0, np.cumsum(counts)]
        out = np.empty(begin[-1], np.int32)
        for who, place, ids in events:
            out[begin[who + 1] - 1 - place] = ids
        return out, begin

    def samples(self, k: int) -> Iterator[tuple]:
        """Per sample number: rows that have it, log-probabilities, perturbed scores, pieces, bounds; then the left score by row."""
        n, units = len(self.row), np.arange(len(self.row))
        none = np.full(self.rows, -np.inf)
        log_prob, counts = np.zeros(n), np.zeros(n, np.int64)
        parts = self._flat(counts, self.draw(units, 0, counts, log_prob)) if n else (np.zeros(0, np.int32), np.zeros(1, np.int64))
        score = gumbel_below(self.seeds, np.zeros(self.rows), -none)
        rest = self._left(log_prob, parts, units)
        # A set: (sample it follows, first differing unit, probability left of that unit, pieces excluded besides the sample's); by row, best first.
        agenda: list[list[tuple]] = [[] for _ in range(self.rows)]
        drawn = [(parts, log_prob)]
        active = np.ones(self.rows, bool)
        from_unit = self.first[:-1].copy()
        yield (active.copy(), self._sums(log_prob), score.copy(), *parts)
        for turn in range(1, k + 1):
            self._split(agenda, drawn, turn - 1, active, from_unit, rest, score, k + 1 - turn)
            chosen = [a.pop(0) if a else None for a in agenda]
            active = np.array([c is not None for c in chosen], bool)
            score = np.array([c[0] if c else -np.inf for c in chosen])
            if turn == k:
                yield score
                return
            if not active.any():
                for _ in range(turn, k):
                    yield active, none, none, np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
                yield none
                return
            from_unit = np.array([c[2] if c else self.first[r + 1] for r, c in enumerate(chosen)], np.int64)
            new_log, counts = np.zeros(n), np.zeros(n, np.int64)
            fresh = np.flatnonzero((units > from_unit[self.row]) & active[self.row])
            events = self.draw(fresh, turn, counts, new_log)
            rest, known = np.zeros(n), []
            for r, c in enumerate(chosen):
                if c:
                    (old, begin), old_log = drawn[c[1]]
                    unit, left, start = c[2], c[3], int(self.first[r])
                    excluded = [*c[4], self._pieces_of((old, begin), unit)]
                    lattice = self.lattices[self.unit_lattice[unit]]
                    seed = np.uint64((int(self.seeds[r]) + 0xA0761D6478BD642F * (turn + 1)) % (1 << 63))
                    word = int(self.unit_word[unit])
                    pieces, lp = Others(lattice, word, excluded).draw(seed)
                    # Units before the one that differs are those of the sample that is followed.
                    counts[start:unit] = begin[start + 1 : unit + 1] - begin[start:unit]
                    new_log[start:unit] = old_log[start:unit]
                    counts[unit], new_log[unit] = (pieces >= 0).sum(), lp
                    known.append((start, unit, old[begin[start] : begin[unit]], pieces[pieces >= 0]))
                    rest[unit] = left - np.exp(lp)
                    if rest[unit] < SUBTRACT and turn + 1 < k + 1:
                        rest[unit] = Others(lattice, word, [*excluded, pieces]).left()
                    self._excluded[unit] = excluded
            parts = self._flat(counts, events)
            for start, unit, before, own in known:
                parts[0][parts[1][start] : parts[1][unit]] = before
                parts[0][parts[1][unit] : parts[1][unit + 1]] = own
            rest[fresh] = self._left(new_log, parts, fresh)[fresh]
            drawn.append((parts, new_log))
            yield (active.copy(), self._sums(new_log), score.copy(), *parts)

    def _left(self, log_prob: np.ndarray, parts: tuple, units: np.ndarray) -> np.ndarray:
        """What each of ``units``' segmentations leaves of its probability: 0 where there is no other one."""
        units, rest = units[self.many[units]], np.zeros(len(self.row))
        rest[units] = -np.expm1(log_prob[units])
        little = units[rest[units] < SUBTRACT]
        out, begin = parts
        single = begin[little + 1] - begin[little] == 1
        one, more = little[single], little[~single]
        words, first = np.unique(self.different[one], return_index=True)
        for k, unit in zip(words.tolist(), one[first].tolist()):
            if np.isnan(self._whole[k]):
                self._whole[k] = self._others(parts, unit)
        rest[one] = self._whole[self.different[one]]
        for unit, a, b in zip(more.tolist(), begin[more].tolist(), begin[more + 1].tolist()):
            key = (int(self.different[unit]), out[a:b].tobytes())
            if key not in self._known:
                self._known[key] = self._others(parts, unit)
            rest[unit] = self._known[key]
        return rest

    def _others(self, parts: tuple, unit: int) -> float:
        return Others(self.lattices[self.unit_lattice[unit]], int(self.unit_word[unit]), [self._pieces_of(parts, unit)]).left()

    def _sums(self, log_prob: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, log_prob, self.rows) if len(self.row) else np.zeros(self.rows)

    def _split(self, agenda: list, drawn: list, turn: int, active: np.ndarray, from_unit: np.ndarray, rest: np.ndarray, score: np.ndarray, keep: int) -> None:
        """Put the parts of what the last samples left on the agenda; no row needs more than ``keep``."""
        log_prob = drawn[turn][1]
        total = np.r_[0, np.cumsum(log_prob)]
        prefix = total[:-1] - total[self.first[:-1]][self.row]
        use = np.flatnonzero((np.arange(len(self.row)) >= from_unit[self.row]) & active[self.row] & (rest > 0))
        row = self.row[use]
        noise = self.seeds[row] ^ mix(self.place[use].astype(np.uint64) + np.uint64((turn + 1) << 40))
        value = gumbel_below(noise, prefix[use] + np.log(rest[use]), score[row])
        # The best ``keep`` of each row, one at a time: rows are in order, and few are kept.
        begins = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else row
        size, open_, best = np.diff(np.r_[begins, len(row)]), value.copy(), []
        for _ in range(keep if len(row) else 0):
            top = np.flatnonzero((open_ == np.repeat(np.maximum.reduceat(open_, begins), size)) & (open_ > -np.inf))
            top = top[np.r_[True, row[top[1:]] != row[top[:-1]]]] if len(top) else top
            open_[top] = -np.inf
            best.append(top)
        best = np.sort(np.concatenate(best)) if best else np.zeros(0, np.int64)
        use, row, value = use[best], row[best], value[best]
        for u, r, x in zip(use.tolist(), row.tolist(), value.tolist()):
            again = self._excluded.get(u, []) if turn and u == from_unit[r] else []
            agenda[r].append((x, turn, u, float(rest[u]), again))
        for r in np.unique(row).tolist():
            agenda[r].sort(key=lambda a: -a[0])
            del agenda[r][keep:]

    def _pieces_of(self, parts: tuple, unit: int) -> np.ndarray:
        """A unit's pieces by their end."""
        ids = parts[0][parts[1][unit] : parts[1][unit + 1]]
        ends = np.cumsum(self.widths[ids])
        out = np.full(ends[-1] + 1, -1, np.int32)
        out[ends] = ids
        return out


def _sampler(path: str, k: int, sharpness: float, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, sharpness)
        for batch in batches:
            ids = batch.column(0)
            keys = np.asarray(ids.fill_null(-1))
            for a, b, data, offsets in blocks(batch.column(1), BLOCK_BYTES):
                block = Block(v, data, offsets, keys[a:b])
                found = list(block.samples(k))
                left = found.pop()
                columns: list[list] = [[] for _ in range(8)]
                for number, (active, log_prob, score, pieces, begin) in enumerate(found):
                    bounds = begin[block.first]
                    pieces = pieces.astype("<i4")
                    with np.errstate(over="ignore", divide="ignore"):
                        gap = log_prob - left
                        inclusion = np.where(gap < -30, gap, np.log(-np.expm1(-np.exp(np.minimum(gap, 700)))))
                    for r in np.flatnonzero(active).tolist():
                        own = pieces[bounds[r] : bounds[r + 1]]
                        values = (a + r, number, len(own), zlib.crc32(own), float(log_prob[r]), float(score[r]), float(inclusion[r]))
                        for column, value in zip(columns, values):
                            column.append(value)
                        if with_ids:
                            columns[7].append(own)
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
                arrays = [ids.take(pa.array(columns[0], pa.int64())), *(pa.array(c, t) for c, t in zip(columns[1:7], kinds))]
                names = ["doc_id", "sample", "n_pieces", "ids_crc32", "log_prob", "perturbed", "log_inclusion"]
                if with_ids:
                    arrays.append(pa.array(columns[7], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def sample_segmentations(docs: DataFrame, k: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text", sharpness: float = 1.0, with_ids: bool = False, vocabulary_path: str | None = None) -> DataFrame:
    """Up to ``k`` distinct segmentations of every row, in falling order of perturbed score.

    Columns ``doc_id, sample, n_pieces, ids_crc32`` (of little-endian 32-bit ids), ``log_prob, perturbed,
    log_inclusion`` and, with ``with_ids``, ``ids``.
    """
    text_batches(docs.sparkSession)
    path = vocabulary_path or public_tokenizers.path(VOCABULARY)
    schema = "doc_id long, sample int, n_pieces long, ids_crc32 long, log_prob double, perturbed double, log_inclusion double"
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(_sampler(path, k, sharpness, with_ids), schema + ", ids array<int>" * with_ids)


def decode(ids, v: Vocabulary) -> str:
    """The text of a segmentation: its pieces' bytes without the space put in front."""
    return b"".join([v.bytes[k] for k in ids])[1:].decode("utf-8", "replace")


def decoded(samples: DataFrame, ids_col: str = "ids", into: str = "text", vocabulary_path: str | None = None) -> DataFrame:
    """``samples`` with the text of ``ids_col``; null ids give null."""
    path = vocabulary_path or public_tokenizers.path(VOCABULARY)

    @F.pandas_udf("string")
    def of(column):
        v = vocabulary(path, 1.0)
        return column.map(lambda ids: None if ids is None else decode(ids, v))

    return samples.withColumn(into, of(F.col(ids_col)))


def op2_sentencepiece_sampling(spark, sf_dir: str) -> DataFrame:
    return sample_segmentations(table(spark, sf_dir, "documents"))
