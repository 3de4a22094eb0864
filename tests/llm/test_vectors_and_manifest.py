"""Vector codes, the Merkle manifest and collision counting against plain versions, and on awkward tables."""

import collections
import hashlib
import itertools
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.llm import codes, merkle, neighbours, queries, vectors

DOCS = "doc_id long, source string, lang string, n_chars long, text string"
VECTORS = "vec_id long, embedding array<float>, label int"
MANIFEST = "doc_id leaf subroot root proof_sha256 folded_root verified".split()


def ordered(rows):
    return sorted(rows, key=lambda r: [(x is not None, str(x)) for x in r])


def written(frame, folder, name):
    frame.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


# --- op11 ---


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """Codes of ``(vec_id, vector, label)`` by comparing every part with every entry."""
    cut = np.floor(256 * np.array([r[1] for r in rows], np.float64)).astype(np.int64).reshape(len(rows), parts, -1)
    seeds = sorted((r[0], r[1], k) for k, r in enumerate(rows) if r[0] is not None)[:entries]
    books = cut[[k for *_, k in seeds]].transpose(1, 0, 2).copy()
    square = lambda: ((cut[:, :, None, :] - books[None]) ** 2).sum(-1)
    for _ in range(rounds):
        own = square().argmin(-1)
        for p, e in itertools.product(range(parts), range(books.shape[1])):
            if (own[:, p] == e).any():
                books[p, e] = cut[own[:, p] == e, p].sum(0) // (own[:, p] == e).sum()
    own, errors = square().argmin(-1), square().min(-1).sum(1)
    by_label = collections.Counter()
    for r, e in zip(rows, errors.tolist()):
        by_label[r[2]] += e
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return ordered((r[0], bytes(own[k].tolist()).hex(), int(errors[k]), by_label[r[2]], digest) for k, r in enumerate(rows))


def found_codes(spark, folder):
    return ordered(tuple(r[c] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256")) for r in queries.op11_vector_codes(spark, folder).collect())


def test_op11(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert found_codes(spark, sf_dir) == plain_codes(rows)


def test_op11_copies_ties_nulls_and_clashing_names(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(codes, "CHUNK", 37)
    draw = np.random.default_rng(5)
    some = [(int(k), (draw.integers(-2, 3, 32) / 256).tolist(), int(k) % 3 if k % 4 else None) for k in draw.permutation(150)]
    rows = some + [(7, some[0][1], None)] * 60 + [(None, some[1][1], 1)] * 3
    bad = [(1000, None, 1), (1001, [float("nan")] * 32, 1), (1002, [1.0] * 31 + [None], 1), (1003, [float("inf")] * 32, 2), (1004, [], 2), (1005, [0.5] * 16, 2)]
    frame = spark.createDataFrame(rows + bad, VECTORS).select("*", F.lit(1).alias("v"), F.lit("x").alias("id"), F.lit(0).alias("__key")).repartition(3)
    assert found_codes(spark, written(frame, tmp_path, "embeddings")) == plain_codes(rows)


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(1, [0.5] * 15, 1), (2, [0.5] * 16, 1)], [(None, [0.5] * 16, 1)]])
def test_op11_nothing_to_cut(spark, tmp_path, rows):
    assert found_codes(spark, written(spark.createDataFrame(rows, VECTORS), tmp_path, "embeddings")) == []


def test_op11_huge_components_and_few_rows(spark, tmp_path):
    rows = [(1, [3e38] * 16, 1), (2, [-3e38] * 16, 1)]
    assert [r[1:3] for r in found_codes(spark, written(spark.createDataFrame(rows, VECTORS), tmp_path, "embeddings"))] == [("00" * 16, 0), ("01" * 16, 0)]


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 400), st.integers(1, 3), st.sampled_from([1, 2, 4]), st.integers(0, 6), st.integers(0, 1000))
def test_trees_hold_every_point_and_their_bounds(n, parts, width, spread, seed):
    draw = np.random.default_rng(seed)
    points = draw.integers(-spread, spread + 1, (n * parts, width))
    tree = codes.build(points, np.tile(np.arange(parts), n))
    assert sorted(tree.order.tolist()) == list(range(len(points)))
    for k in range(len(tree.start)):
        own = points[tree.order[tree.start[k] : tree.end[k]]]
        assert (own.sum(axis=0) == tree.sums[k]).all()
        assert np.sqrt(((own - own.mean(axis=0)) ** 2).sum(axis=1)).max() <= tree.radius[k] + 1e-9
        if tree.left[k] >= 0:
            assert (tree.start[k], tree.end[k]) == (tree.start[tree.left[k]], tree.end[tree.right[k]]) and tree.end[tree.left[k]] == tree.start[tree.right[k]]
    books = draw.integers(-spread, spread + 1, (parts, 9, width))
    entry, away = codes.nearest(codes.Tree.unpacked(tree.packed(), width), books)
    all_pairs = ((points[:, None, :] - books[np.tile(np.arange(parts), n)]) ** 2).sum(-1)
    assert (entry == all_pairs.argmin(1)).all() and (away == all_pairs.min(1)).all()
    sums, counts = codes.totals(tree, books)
    assert counts.sum() == len(points) and (sums.sum(axis=1) == points.reshape(n, parts, width).sum(axis=0)).all()


def test_balls_are_owned_whole():
    """Of well separated clusters no point is compared with an entry: cached sums are enough."""
    draw = np.random.default_rng(3)
    middle = np.array([[0, 0], [1000, 0], [0, 1000], [1000, 1000]])
    points = np.concatenate([m + draw.integers(-20, 21, (100, 2)) for m in middle])
    handed = list(codes.descend(codes.build(points, np.zeros(400, int)), middle[None]))
    assert sum(len(places) for _, _, places, _ in handed) == 0


# --- op12 ---


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_manifest(rows):
    shown = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = collections.defaultdict(list)
    for doc_id, source, lang, n_chars, text in rows:
        head = "".join(map(shown, (doc_id, source, lang, n_chars)))
        lowered = text and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        other = sha(head + shown(lowered)) if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0 else None
        groups[source].append((doc_id is not None, doc_id or 0, sha(head + shown(text)), other, doc_id))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][k : k + 16])) for k in range(0, len(out[-1]), 16)])
        return out

    def way(tree, k):
        for level in tree[:-1]:
            first = k // 16 * 16
            yield level[first:k], level[k + 1 : first + 16]
            k //= 16

    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([r[2] for r in sorted(groups[s], key=lambda r: r[:3])]) for s in names}
    over = levels([trees[s][-1][0] for s in names])
    out = []
    for n, s in enumerate(names):
        for k, r in enumerate(sorted(groups[s], key=lambda r: r[:3])):
            steps = [*way(trees[s], k), *way(over, n)]
            end = r[3] or r[2]
            for left, right in steps:
                end = sha("".join(left) + end + "".join(right))
            out.append((r[4], r[2], trees[s][-1][0], over[-1][0], sha("".join("".join(a + b) for a, b in steps)), end, end == over[-1][0]))
    return ordered(out)


def found_manifest(spark, folder):
    return ordered(tuple(r[c] for c in MANIFEST) for r in queries.op12_merkle_manifest(spark, folder).collect())


def test_op12(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert found_manifest(spark, sf_dir) == plain_manifest(rows)


def awkward_documents():
    draw = np.random.default_rng(4)
    names = [None, "", "a", "b", "é", "z\U0001f600", "￿", *["hot"] * 9]
    return [(int(draw.integers(0, 500)) if draw.random() > 0.05 else None, names[draw.integers(0, len(names))], None, 5, ["", "Abc", None, "É" * 3000][draw.integers(0, 4)]) for _ in range(700)]


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)], [(1, "a", "x", 1, "AB")] * 40 + [(None, None, "é", 3, "Z")] * 3, [(k, f"s{k % 300:03d}", "e", 1, "T") for k in range(400)], awkward_documents()], ids=["none", "one", "copies", "many sources", "awkward"])
def test_op12_awkward(spark, tmp_path, rows):
    frame = spark.createDataFrame(rows, DOCS).select("*", F.lit(0).alias("grp"), F.lit("x").alias("pid"), F.lit(1).alias("leaf"), F.lit(1).alias("id")).repartition(3)
    assert found_manifest(spark, written(frame, tmp_path, "documents")) == plain_manifest(rows)


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 5000), st.integers(0, 5000), st.integers(1, 600))
def test_what_is_missing_is_least_and_enough(size, begin, held):
    begin = begin % size
    end = min(size, begin + held)
    tree = [[str(k) for k in range(size)]]
    while len(tree[-1]) > 1:
        tree.append(merkle.parents(tree[-1]))
    asked = list(merkle.missing(begin, end, size))
    got = merkle.Levels(tree[0][begin:end], begin, size, {(level, k): tree[level][k] for level, k in asked})
    assert got.root == tree[-1][0]
    assert all(merkle.folded(tree[0][k], got.way(k)) == got.root for k in {begin, (begin + end) // 2, end - 1})
    # Nothing asked for lies over a leaf that is held.
    assert len(set(asked)) == len(asked) and not any(begin < min(size, (k + 1) * 16**level) and k * 16**level < end for level, k in asked)


# --- op13 ---


def exact(rows, k, of):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], np.float64)
    for n in np.flatnonzero(ids % of == 0):
        away = np.sqrt(((x - x[n]) ** 2).sum(1))
        away[n] = np.inf
        best = np.lexsort((ids, away))[: min(k, len(rows) - 1)]
        yield int(ids[n]), [(int(ids[b]), float(away[b])) for b in best]


def hits(frame):
    out = collections.defaultdict(list)
    for r in sorted(frame.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def test_op13_recall(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    found = hits(queries.op13_neighbours(spark, sf_dir))
    want = dict(exact(rows, 10, 100))
    assert sorted(found) == sorted(want)
    caught = sum(len({i for i, _ in found[q]} & {i for i, _ in best}) for q, best in want.items())
    assert caught >= 0.9 * sum(map(len, want.values()))
    place = dict(rows)
    for q, got in found.items():
        assert got == sorted(got, key=lambda g: (g[1], g[0])) and q not in {i for i, _ in got}
        assert all(abs(s - float(np.linalg.norm(np.array(place[q], float) - np.array(place[i], float)))) < 1e-12 for i, s in got)


def test_op13_over_many_blocks(spark, monkeypatch):
    draw = np.random.default_rng(9)
    rows = [(k, draw.standard_normal(24).tolist()) for k in range(3000)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    monkeypatch.setattr(neighbours, "GROUP_BYTES", 3000)
    found, want = hits(neighbours.nearest(neighbours.usable(frame), F.col("id") % 100 == 0)), dict(exact(rows, 10, 100))
    assert sum(len(dict(found[q]).keys() & dict(best).keys()) for q, best in want.items()) >= 0.9 * 300


def test_op13_copies_ties_and_few(spark, tmp_path):
    draw = np.random.default_rng(2)
    other = [(int(k), draw.standard_normal(6).astype(np.float32).tolist(), 0) for k in range(300, 340)]
    hot = [(int(k), [1.0, 0.0, 0.0, 0.0, 0.0, -0.0], 0) for k in range(0, 300)]
    bad = [(400, None, 0), (500, [0.0] * 6, 0), (600, [float("nan")] * 6, 0), (None, [1.0] * 6, 0), (700, [], 0), (800, [1.0, None], 0)]
    alone = [(900, [1.0, 2.0], 0), (901, [1.0, 3.0], 0), (900, [1.0, 2.0], 0)]
    frame = spark.createDataFrame(other + hot + bad + alone, VECTORS).select("*", F.lit(3).alias("id"), F.lit(4).alias("v"))
    found = hits(queries.op13_neighbours(spark, written(frame.repartition(3), tmp_path, "embeddings")))
    assert set(found) == {0, 100, 200, 300, 900}
    assert [i for i, _ in found[0]] == list(range(1, 11)) and [i for i, _ in found[100]] == list(range(10)) and [i for i, _ in found[200]] == list(range(10))
    assert found[300] == [(i, pytest.approx(s)) for i, s in dict(exact([r[:2] for r in other + hot], 10, 100))[300]]
    assert found[900] == [(900, 0.0), (900, 0.0), (901, 1.0), (901, 1.0)]


@pytest.mark.parametrize("rows", [[], [(100, [1.0, 2.0], 1)], [(101, [1.0, 2.0], 1), (102, [1.0, 2.0], 1)]])
def test_op13_no_candidates(spark, tmp_path, rows):
    assert hits(queries.op13_neighbours(spark, written(spark.createDataFrame(rows, VECTORS), tmp_path, "embeddings"))) == {}


def test_heavy_keys_meet_their_facts_where_they_are(spark, monkeypatch):
    monkeypatch.setattr(vectors, "MOST_HEAVY", 4)
    keys = [None] * 50 + ["a"] * 40 + ["b"] * 3 + ["c"]
    rows = spark.createDataFrame([(k, n) for n, k in enumerate(keys)], "k string, n long")
    facts = rows.groupBy("k").agg(F.count("*").alias("of"), F.sum("n").alias("total"))
    got = vectors.with_facts(rows, facts, "k", "of").collect()
    want = {k: sum(n for n, x in enumerate(keys) if x == k) for k in set(keys)}
    assert len(got) == len(keys) and all(r["total"] == want[r["k"]] for r in got)


# --- op8 ---


def test_language_sums_are_bounded_by_languages(monkeypatch):
    """Scores do not depend on how many words are summed at a time, and few are where languages are many."""
    import public_tokenizers

    from lodestrata.llm import langid

    data = np.frombuffer(" ".join(f"word{k} is{k % 7}" for k in range(300)).encode(), np.uint8)
    at = np.flatnonzero(np.r_[32, data] == 32)
    starts, ends = at, np.r_[at[1:] - 1, len(data)]
    path = public_tokenizers.path("piece_bpe_32k.model")
    base = langid.start(path)
    many = np.repeat(base, 40, axis=0)
    most = []
    forward = langid._forward
    monkeypatch.setattr(langid, "_forward", lambda trie, words, scaled, keep=None: most.append(words.shape[0] * scaled.shape[1]) or forward(trie, words, scaled, keep))
    found = langid.word_scores(path, data, starts, ends, many)
    assert max(most) <= max(langid.SUMS, 64 * 40)
    monkeypatch.setattr(langid, "SUMS", 1)
    assert np.allclose(langid.word_scores(path, data, starts, ends, base)[:, 0], found[:, 17])
