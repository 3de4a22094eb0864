"""Vector compression to one byte a part, its codebooks trained over metric trees by the anchors hierarchy.

A vector is cut into ``PARTS`` equal parts and every part position has a codebook of its own. Rows stay where they
are read: each ``CHUNK`` of rows gets one tree a part position, built once and kept as a table of the checkpoint
folder.

* Middle-out: a ball of n points gets about sqrt(n) anchors. The next anchor is the point furthest from its own; it takes
  over the points nearer to it, and looks only at those that by the triangle inequality can be. Balls of anchors are
  split again below, and merged in pairs of the smallest joint ball above.
* Every ball caches the sum and the count of its points, its centre and its radius.
* A round hands the codebook's entries down the tree. A ball drops an entry that loses to the best one at every place of
  the ball, its children inherit what is left, and a ball with one entry left is wholly owned: it adds its cached sum and
  count, and its points are not looked at. Leaves with several entries compare their points with these.

Only sums and counts by (part, entry) leave the tasks: ``PARTS * ENTRIES`` rows, which the driver turns into the next
codebooks. Components are whole numbers and nothing is rounded, so the result is that of plain k-means.

Defined results: rows whose vector is null or empty, or holds a null or non-finite component, are dropped, and so are
vectors that cannot be cut: of another length than the first vector by id, or of a length that ``PARTS`` does not divide
(no rows, where that is the first one's). Components beyond ``LARGEST`` after scaling count as its ends. Rows with a null
id are coded and counted, but seed no entry. Rows that repeat an id are each a row; of equal ids the lesser vector seeds
first. With fewer vectors than entries the codebooks are as short as that.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import release, remove, stored, table, text_batches
from .vectors import finite, matrices, with_facts

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
CHUNK = 4096
LEAF = 12
LARGEST = 1 << 26


@dataclass
class Tree:
    """Balls over ``points[order]``, parents before children; ``left`` is -1 at leaves. A ball holds ``order[start:end]``."""

    points: np.ndarray
    order: np.ndarray
    part: np.ndarray
    start: np.ndarray
    end: np.ndarray
    left: np.ndarray
    right: np.ndarray
    sums: np.ndarray
    radius: np.ndarray

    FIELDS = {"points": np.int32, "order": np.int32, "part": np.int32, "start": np.int32, "end": np.int32, "left": np.int32, "right": np.int32, "sums": np.int64, "radius": np.float64}

    def packed(self) -> dict[str, bytes]:
        return {k: np.ascontiguousarray(getattr(self, k), dtype=t).tobytes() for k, t in self.FIELDS.items()}

    @classmethod
    def unpacked(cls, row: dict[str, bytes], width: int) -> Tree:
        found = {k: np.frombuffer(row[k], dtype=t) for k, t in cls.FIELDS.items()}
        return cls(**found | {k: found[k].reshape(-1, width) for k in ("points", "sums")})


def _first_of_each(flags: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The first set flag at or after each of the ``begins``; every segment has one."""
    at = np.flatnonzero(flags)
    return at[np.searchsorted(at, begins)]


def _anchors(points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The anchor (a number from 0 in its ball) of each point; ``points`` lie ball by ball. All balls grow in step."""
    n, begins = len(points), np.cumsum(sizes) - sizes
    ball = np.repeat(np.arange(len(sizes)), sizes)
    wanted = np.ceil(np.sqrt(sizes)).astype(np.int64)
    places = np.zeros((len(sizes), int(wanted.max())), np.int64)
    owner, places[:, 0] = np.zeros(n, np.int64), begins
    from_anchor = ((points - points[begins][ball]) ** 2).sum(axis=1)
    live, at = np.arange(len(sizes)), np.arange(n)
    for step in range(1, places.shape[1]):
        keep = (wanted[live] > step) & (np.maximum.reduceat(from_anchor[at], np.cumsum(sizes[live]) - sizes[live]) > 0)
        if not keep.all():
            at, live = at[np.repeat(keep, sizes[live])], live[keep]
        if not len(live):
            break
        first = np.cumsum(sizes[live]) - sizes[live]
        here = from_anchor[at]
        new = at[_first_of_each(here == np.repeat(np.maximum.reduceat(here, first), sizes[live]), first)]
        places[live, step] = new
        # A point nearer to its anchor than half the way from there to the new one cannot be nearer to the new one.
        apart = ((points[places[live, :step]] - points[new][:, None, :]) ** 2).sum(axis=2)
        row = np.repeat(np.arange(len(live)), sizes[live])
        near = np.flatnonzero(4 * here >= apart[row, owner[at]])
        mine = at[near]
        distance = ((points[mine] - points[new][row[near]]) ** 2).sum(axis=1)
        taken = distance < from_anchor[mine]
        owner[mine[taken]], from_anchor[mine[taken]] = step, distance[taken]
    return owner


def _merges(centres: np.ndarray, radii: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Steps that merge, in each of several balls, the pair of anchors with the smallest joint ball: balls, slots kept, slots gone.

    ``counts`` is 0 where a ball has no anchor in a slot.
    """
    balls, slots = counts.shape
    centres, radii, counts = centres.copy(), radii.copy(), counts.copy()
    each = np.arange(balls)

    def joint(k: np.ndarray) -> np.ndarray:
        apart = np.sqrt(((centres - centres[each, k][:, None]) ** 2).sum(axis=2))
        mine = radii[each, k][:, None]
        size = np.maximum(np.maximum(radii, mine), (apart + radii + mine) / 2)
        return np.where((counts > 0) & (counts[each, k] > 0)[:, None] & (np.arange(slots) != k[:, None]), size, np.inf)

    cost = np.stack([joint(np.full(balls, k)) for k in range(slots)], axis=1)
    steps = []
    while True:
        best = cost.reshape(balls, -1).argmin(axis=1)
        size = cost.reshape(balls, -1)[each, best]
        on = np.isfinite(size)
        if not on.any():
            return steps
        a, b = np.minimum(best // slots, best % slots), np.maximum(best // slots, best % slots)
        steps.append((each[on], a[on], b[on]))
        r, x, y = each[on], a[on], b[on]
        n = counts[r, x] + counts[r, y]
        centres[r, x] = (centres[r, x] * counts[r, x][:, None] + centres[r, y] * counts[r, y][:, None]) / n[:, None]
        radii[r, x], counts[r, x], counts[r, y] = size[on], n, 0
        fresh = joint(a)
        cost[r, y], cost[r, :, y] = np.inf, np.inf
        cost[r, x], cost[r, :, x] = fresh[on], fresh[on]


def _halves(merges: list[tuple[int, int]]) -> tuple[object, list[int]]:
    """The tree (a slot, or a pair of trees) that merges of slots in order make, and its slots from left to right."""
    grown: dict[int, object] = {}
    for a, b in merges:
        grown[a] = (grown.get(a, a), grown.pop(b, b))
    tree, laid = grown[merges[-1][0]], []
    todo = [tree]
    while todo:
        node = todo.pop()
        if isinstance(node, tuple):
            todo += [node[1], node[0]]
        else:
            laid.append(node)
    return tree, laid


def build(points: np.ndarray, part: np.ndarray, leaf: int = LEAF) -> Tree:
    """Trees over ``points`` (whole numbers), one for each value of ``part``, in one set of arrays. The first nodes are their roots."""
    points = np.ascontiguousarray(points, dtype=np.int64)
    order = np.argsort(part, kind="stable")
    kinds, sizes = np.unique(part, return_counts=True)
    ends = np.cumsum(sizes)
    start, end, left, right, of = (ends - sizes).tolist(), ends.tolist(), [-1] * len(kinds), [-1] * len(kinds), kinds.tolist()

    def hang(node: int, tree: object, begin: int, held: dict[int, int]) -> None:
        """Nodes below ``node`` for ``tree``, whose slots lie from ``begin`` on with ``held`` points each; its anchors are split later."""
        todo, at = [(node, tree)], begin
        while todo:
            k, branch = todo.pop()
            start[k] = at
            if isinstance(branch, tuple):
                left[k], right[k] = len(start), len(start) + 1
                for x in (start, end):
                    x += [-1, -1]
                left.extend((-1, -1)), right.extend((-1, -1)), of.extend((of[k], of[k]))
                todo += [(right[k], branch[1]), (left[k], branch[0])]
            else:
                at += held[branch]
                end[k] = at
                waiting.append(k)

    waiting = list(range(len(kinds)))
    first_new = 0
    while waiting:
        todo = np.array([k for k in waiting if end[k] - start[k] > leaf], np.int64)
        waiting = []
        if not len(todo):
            break
        first_new = len(start)
        begins = np.array([start[k] for k in todo])
        sizes = np.array([end[k] for k in todo]) - begins
        at = np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        owner = _anchors(points[order[at]], sizes)
        ball, slots = np.repeat(np.arange(len(todo)), sizes), int(owner.max()) + 1
        inner = np.argsort(ball * slots + owner, kind="stable")
        order[at] = order[at][inner]
        group, mine = (ball * slots + owner)[inner], points[order[at]]
        held = np.bincount(group, minlength=len(todo) * slots)
        first = np.flatnonzero(np.diff(group, prepend=-1))
        centres, radii = np.zeros((len(held), points.shape[1])), np.zeros(len(held))
        centres[group[first]] = np.add.reduceat(mine, first, axis=0) / held[group[first]][:, None]
        radii[group[first]] = np.sqrt(np.maximum.reduceat(((mine - centres[group]) ** 2).sum(axis=1), first))
        held, centres, radii = held.reshape(len(todo), slots), centres.reshape(len(todo), slots, -1), radii.reshape(len(todo), slots)
        many = (held > 0).sum(axis=1)
        # Balls with about as many anchors are merged together, so that none waits for far more slots than it has.
        band = np.ceil(np.log2(many)).astype(int)
        for k in np.unique(band[many > 1]):
            those = np.flatnonzero((band == k) & (many > 1))
            most = int(many[those].max())
            merged: dict[int, list[tuple[int, int]]] = {b: [] for b in those.tolist()}
            for balls, a, b in _merges(centres[those, :most], radii[those, :most], held[those, :most]):
                for x, y, z in zip(those[balls].tolist(), a.tolist(), b.tolist()):
                    merged[x].append((y, z))
            for b, merges in merged.items():
                tree, laid = _halves(merges)
                n = held[b]
                bounds = begins[b] + np.cumsum(n[: many[b]]) - n[: many[b]]
                order[begins[b] : begins[b] + sizes[b]] = np.concatenate([order[bounds[s] : bounds[s] + n[s]] for s in laid])
                hang(int(todo[b]), tree, int(begins[b]), dict(enumerate(n.tolist())))
        # Inner balls end where their right half does; children have greater numbers than their parents.
        for k in [*range(len(start) - 1, first_new - 1, -1), *todo.tolist()]:
            if left[k] >= 0:
                end[k] = end[right[k]]
    start_, end_, left_, right_, of_ = (np.array(x, np.int64) for x in (start, end, left, right, of))
    laid = points[order]
    running = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(laid, axis=0)])
    sums = running[end_] - running[start_]
    centre = sums / (end_ - start_)[:, None]
    radius = np.zeros(len(start_))
    level = np.arange(len(kinds))
    while len(level):
        size = end_[level] - start_[level]
        at = np.repeat(start_[level] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        far = ((laid[at] - np.repeat(centre[level], size, axis=0)) ** 2).sum(axis=1)
        radius[level] = np.sqrt(np.maximum.reduceat(far, np.cumsum(size) - size))
        level = np.concatenate([left_[level], right_[level]])
        level = level[level >= 0]
    return Tree(points, order, of_, start_, end_, left_, right_, sums, radius)


def _spread(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places from each start to its end, and which of them each belongs to."""
    size = end - start
    which = np.repeat(np.arange(len(start)), size)
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + start[which], which


def descend(tree: Tree, books: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Balls that one entry owns wholly, and points of shared leaves: nodes, their entries, places in ``order``, their entries.

    ``books`` is (part, entry, component). Of equal distances the lower entry wins, so equal entries above the first
    never own anything and are not handed down.
    """
    real = books.astype(np.float64)
    norms = (books**2).sum(axis=2).astype(np.float64)
    distinct = np.ones(books.shape[:2], bool)
    for p in range(len(books)):
        distinct[p] = False
        distinct[p, np.unique(books[p], axis=0, return_index=True)[1]] = True
    count = tree.end - tree.start
    nodes = np.flatnonzero(np.isin(np.arange(len(tree.start)), np.concatenate([tree.left, tree.right]), invert=True))
    wanted = distinct[tree.part[nodes]]
    while len(nodes):
        part = tree.part[nodes]
        centre = tree.sums[nodes] / count[nodes][:, None]
        # Squared distance less the square of the centre.
        value = norms[part] - 2 * np.einsum("nd,ned->ne", centre, real[part])
        value[~wanted] = np.inf
        best = value.argmin(axis=1)
        lead = value - value[np.arange(len(nodes)), best][:, None]
        apart = np.sqrt(((real[part] - real[part, best][:, None, :]) ** 2).sum(axis=2))
        # At any place of the ball the lead shrinks by no more than the diameter times the way between the entries.
        slack = 1e-9 * (1 + np.abs(norms[part]) + norms[part, best][:, None] + (centre**2).sum(axis=1)[:, None])
        keep = wanted & (lead <= 2 * tree.radius[nodes][:, None] * apart + slack)
        left = keep.sum(axis=1)
        owned = left == 1
        leaf = ~owned & (tree.left[nodes] < 0)
        places, which = _spread(tree.start[nodes[leaf]], tree.end[nodes[leaf]])
        mine = np.zeros(0, np.int64)
        if len(places):
            point, p, kept = tree.points[tree.order[places]].astype(np.int64), part[leaf][which], keep[leaf][which]
            # Pairs of a point and an entry that its leaf still has; the least distance, then the least entry.
            row, entry = np.nonzero(kept)
            away = ((point[row] - books[p[row], entry]) ** 2).sum(axis=1)
            first = np.flatnonzero(np.diff(row, prepend=-1))
            least = np.minimum.reduceat(away, first)
            mine = entry[_first_of_each(away == np.repeat(least, np.diff(np.append(first, len(row)))), first)]
        yield nodes[owned], keep[owned].argmax(axis=1), places, mine
        inner = ~owned & ~leaf
        nodes, wanted = np.concatenate([tree.left[nodes[inner]], tree.right[nodes[inner]]]), np.concatenate([keep[inner], keep[inner]])


def totals(tree: Tree, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of points and their counts by (part, entry); owned balls give their cached ones."""
    sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
    for balls, entry, places, mine in descend(tree, books):
        np.add.at(sums, (tree.part[balls], entry), tree.sums[balls])
        np.add.at(counts, (tree.part[balls], entry), (tree.end - tree.start)[balls])
        rows = tree.order[places]
        np.add.at(sums, (rows % len(books), mine), tree.points[rows])
        np.add.at(counts, (rows % len(books), mine), 1)
    return sums, counts


def nearest(tree: Tree, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entry of each point and its squared distance, in the order of ``points``."""
    found = np.zeros(len(tree.order), np.int64)
    for balls, entry, places, mine in descend(tree, books):
        inside, which = _spread(tree.start[balls], tree.end[balls])
        found[tree.order[inside]] = entry[which]
        found[tree.order[places]] = mine
    return found, ((tree.points - books[np.arange(len(found)) % len(books), found]) ** 2).sum(axis=1)


def cut_rows(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS) -> tuple[DataFrame, int]:
    """``id, label, v`` of the rows that take part, and their length (0: there are none)."""
    named = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v")).where(finite(F.col("v")))
    first = named.where("id is not null").orderBy("id", "v").select(F.size("v").alias("n")).first()
    width = first["n"] if first and first["n"] % parts == 0 else 0
    return named.where(F.size("v") == width), width


def seeds(rows: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """The first codebooks (part, entry, component): parts of the vectors with the least ids."""
    first = [r["v"] for r in rows.where("id is not null").orderBy("id", "v").limit(entries).collect()]
    return whole(np.array(first, np.float64)).reshape(len(first), parts, width // parts).transpose(1, 0, 2)


def whole(x: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(SCALE * x), -LARGEST, LARGEST).astype(np.int64)


def planted(rows: DataFrame, width: int, parts: int = PARTS, chunk: int = CHUNK) -> DataFrame:
    """Trees over the parts of every ``chunk`` rows: a row each, with the ids and labels of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0
        for batch in batches:
            while batch.num_rows:
                piece = batch.slice(0, chunk - n)
                waiting.append(piece)
                batch, n = batch.slice(piece.num_rows), n + piece.num_rows
                if n == chunk:
                    yield planted_one(waiting)
                    waiting, n = [], 0
                    release()
        if n:
            yield planted_one(waiting)

    def planted_one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        held = pa.Table.from_batches(batches).combine_chunks()
        (_, x), = matrices(held.column("v")).values()
        tree = build(whole(x).reshape(-1, width // parts), np.tile(np.arange(parts), len(x)))
        ends = pa.array([0, len(x)], pa.int32())
        lists = [pa.ListArray.from_arrays(ends, held.column(c).combine_chunks()) for c in ("id", "label")]
        return pa.RecordBatch.from_arrays([*lists, *(pa.array([b], pa.binary()) for b in tree.packed().values())], names=["id", "label", *Tree.FIELDS])

    kind = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(run, f"id array<long>, label array<{kind}>, " + ", ".join(f"`{k}` binary" for k in Tree.FIELDS))


def _trees(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[Tree, pa.Table]]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = pa.Table.from_batches([batch.slice(k, 1)])
            yield Tree.unpacked({f: row.column(f)[0].as_py() for f in Tree.FIELDS}, width), row


def refined(trees: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round; the driver gets one row for each part and entry."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, object), np.zeros(books.shape[:2], np.int64)
        for tree, _ in _trees(batches, width):
            s, n = totals(tree, books)
            sums, counts = sums + s, counts + n
        p, e = np.nonzero(counts)
        text = [[str(x) for x in row] for row in sums[p, e]]
        yield pa.RecordBatch.from_pydict({"part": pa.array(p.astype(np.int32)), "entry": pa.array(e.astype(np.int32)), "n": pa.array(counts[p, e]), "sums": pa.array(text, pa.list_(pa.string()))})

    found = trees.mapInArrow(run, "part int, entry int, n long, sums array<string>")
    total = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[k].cast("decimal(38,0)")).alias(f"s{k}") for k in range(width)])
    new = books.copy()
    for r in total.collect():
        new[r["part"], r["entry"]] = [int(r[f"s{k}"]) // r["n"] for k in range(width)]
    return new


def coded(trees: DataFrame, books: np.ndarray) -> DataFrame:
    """``id, label, code, error`` of every row."""
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree, row in _trees(batches, width):
            entry, away = nearest(tree, books)
            digits = entry.astype(np.uint8).reshape(-1, parts).tobytes().hex()
            codes = [digits[k : k + 2 * parts] for k in range(0, len(digits), 2 * parts)]
            yield pa.RecordBatch.from_arrays([row.column("id").combine_chunks().flatten(), row.column("label").combine_chunks().flatten(), pa.array(codes, pa.string()), pa.array(away.reshape(-1, parts).sum(axis=1), pa.int64())], names=["id", "label", "code", "error"])

    kind = trees.schema["label"].dataType.elementType.simpleString()
    return trees.mapInArrow(run, f"id long, label {kind}, code string, error long")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """``id, label, code, error`` of every row that takes part, and the codebooks (part, entry, component)."""
    rows, width = cut_rows(vectors, id_col, vector_col, label_col)
    if not width:
        kind = rows.schema["label"].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"id long, label {kind}, code string, error long"), np.zeros((PARTS, 0, 0), np.int64)
    text_batches(vectors.sparkSession)
    books = seeds(rows, width)
    trees, path = stored(planted(rows, width))
    for _ in range(rounds):
        books = refined(trees, books)
    found, _ = stored(coded(trees, books))
    remove(vectors.sparkSession, path)
    return found, books


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = compress(table(spark, sf_dir, "embeddings"))
    by_label = found.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"), F.count("*").alias("n"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return with_facts(found, by_label, "label", "n").select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
