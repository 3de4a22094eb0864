"""Operators on awkward tables: nulls, empty and long texts, repeated rows, no rows, clashing extra columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import html, langid, packing, pii, quality, sampling, simhash, substring, tokencount, topk

LONG = " ".join(f"word{k % 700}x{k}" for k in range(30_000))
SHARED = " ".join(f"passage{k}" for k in range(60))
TEXTS = [
    (1, None),
    (2, ""),
    (3, " \t\n "),
    (4, "one"),
    (5, "a b c d e"),
    (6, f"before {SHARED} after"),
    (7, f"{SHARED}"),
    (7, f"{SHARED}"),
    (None, f"{SHARED} more"),
    (None, None),
    (8, LONG),
    (9, LONG),
    (10, "x" * 200_000),
    (11, "naïve café 中文字 🙂 ελληνικά"),
    (12, "mail bob@example.com or +1 (755) 555-3798, 10.0.0.1"),
]
CLASHING = "fp cell component carried slot packed bucket kind length salt rank node page text2 lang_pred kept_text query id v".split()


@pytest.fixture(scope="module")
def awkward(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3)
    return docs.select("*", *[F.lit(7).alias(c) for c in CLASHING], F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"))


@pytest.fixture(scope="module")
def nothing(awkward):
    return awkward.where("false")


def rows(df, *keys):
    return sorted(map(tuple, df.select(*keys).collect()), key=repr)


def model(docs):
    return langid.identify(docs, langid.fit(docs))


RUNS = {
    "simhash": simhash.simhash_groups,
    "near_dedup": simhash.near_dedup,
    "substring": substring.substring_dedup,
    "quality": quality.ledger,
    "pii": pii.personal_data,
    "redacted": pii.redacted,
    "tokens": tokencount.token_counts,
    "language": model,
    "pieces": packing.token_pieces,
    "pack": lambda d: packing.pack(packing.token_pieces(d).checkpoint()),
    "sampling": sampling.sample_segmentations,
}


@pytest.mark.parametrize("name", RUNS)
def test_empty_table_gives_no_rows(name, nothing):
    assert RUNS[name](nothing).count() == 0


@pytest.mark.parametrize("name", [n for n in RUNS if n not in ("near_dedup", "pieces", "pack", "sampling")])
def test_every_row_has_a_result(name, awkward):
    assert RUNS[name](awkward).count() == len(TEXTS)


def test_simhash_defined_results(awkward):
    found = rows(simhash.simhash_groups(awkward), "doc_id", "fp", "component_id")
    by = {r[0]: r for r in found if r[0] is not None}
    assert by[1][1:] == by[2][1:] == by[3][1:] == (0, 1)  # wordless texts are one group
    assert by[8][2] == by[9][2] == 8
    assert [r[2] for r in found if r[0] is None] == [None, None]
    assert len([r for r in found if r[0] == 7]) == 2


def test_near_dedup_keeps_smallest_and_null_ids(awkward):
    kept = [r[0] for r in simhash.near_dedup(awkward).select("doc_id").collect()]
    assert kept.count(7) == 2 and kept.count(None) == 2
    assert 9 not in kept and 2 not in kept and 3 not in kept


def test_substring_defined_results(awkward):
    found = substring.substring_dedup(awkward, carry=awkward.columns).select("doc_id", "n_words", "removed", "kept_text", "carried.cell").collect()
    by = {(r[0], r[1]): r for r in found}
    assert [tuple(x) for x in by[7, 60][2]] == [(0, 60)] and by[7, 60][3] == ""
    assert by[6, 62][2] == [] and by[6, 62][3] == f"before {SHARED} after"
    assert by[None, 61][2] == []  # a row without id loses nothing
    assert [tuple(x) for x in by[9, 30_000][2]] == [(0, 30_000)] and by[8, 30_000][2] == []
    assert {r[3] for r in found if r[0] in (1, 2)} == {None, ""}
    assert {r[4] for r in found} == {7}


def test_quality_defined_results(awkward):
    by = {r["doc_id"]: r for r in quality.ledger(awkward).collect() if r["doc_id"] is not None}
    assert by[1]["n_words"] == 0 and by[1]["failed_bits"] & quality.mask("few_words")
    assert by[10]["longest_word"] == 200_000 and by[10]["failed_bits"] & quality.mask("huge_word")
    assert by[11]["word_chars"] == len("naïvecafé中文字🙂ελληνικά")
    assert by[8]["n_words"] == 30_000 and not by[8]["failed_bits"] & quality.BASE


def test_letters_are_those_of_unicode(spark):
    for text in ("naïve «—» 中文 🙂🙂 ελ … 123 ß", "", "—" * 9, "é"):
        data = np.frombuffer(text.encode(), np.uint8)
        at = [len(text[:k].encode()) for k, c in enumerate(text) if c.isalpha()]
        assert np.flatnonzero(quality.letter_starts(data)).tolist() == at
    broken = np.frombuffer(b"a\xff\xc3 b\xe4\xb8 " + "ü".encode(), np.uint8)
    assert np.flatnonzero(quality.letter_starts(broken)).tolist() == [0, 4, 8]
    odd = spark.createDataFrame([(1, "— « » … 🙂 ¿ § € " * 5), (2, "это слова и буквы да " * 5)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_letter_words"] for r in quality.ledger(odd).collect()} == {1: 0, 2: 25}


def test_quality_ablation_counts(spark):
    book = spark.createDataFrame([(0b01,), (0b10,), (0b11,), (0,), (0,)], "failed_bits long")
    found = {r["rule"]: tuple(r)[1:] for r in quality.ablation(book, "base").collect()}
    assert found == {"few_words": (2, 1, 2, 3), "repeated_words": (2, 1, 2, 3)}


def test_pii_defined_results(awkward):
    by = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in pii.personal_data(awkward).collect() if r["doc_id"]}
    assert by[1] == [] and by[2] == []
    assert by[12] == [("email", 5, 20), ("phone", 24, 41), ("ip", 43, 51)]
    clean = {r["doc_id"]: r for r in pii.redacted(awkward).collect()}
    assert clean[12]["text"] == "mail [EMAIL] or [PHONE], [IP]" and clean[1]["text"] is None and clean[12]["cell"] == 7


def test_language_defined_results(awkward):
    by = {r["doc_id"]: r for r in model(awkward).collect() if r["doc_id"]}
    assert by[1]["lang_pred"] == by[2]["lang_pred"] == "und" and by[1]["score"] == 0.0
    assert by[8]["lang_pred"] == "en"


def test_language_with_nothing_to_learn(awkward):
    found = model(awkward.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in found.collect()} == {"und"}


def test_tokens_defined_results(awkward):
    by = {r["doc_id"]: tuple(r)[1:] for r in tokencount.token_counts(awkward).collect() if r["doc_id"]}
    assert by[1] == by[2] == by[3] == (0, 0)
    assert by[4] == (1, 1) and by[10][0] == 1


def test_packing_defined_results(awkward):
    pieces = packing.token_pieces(awkward).checkpoint()
    found = packing.pack(pieces).collect()
    assert len(found) == pieces.count()
    assert [r["length"] for r in found if r["doc_id"] in (1, 2)] == [1, 1]
    places = {}
    for r in found:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY


def test_sampling_defined_results(awkward):
    found = sampling.decoded(sampling.sample_segmentations(awkward, 2, with_ids=True), into="back").collect()
    want = {i: t or "" for i, t in TEXTS if i is not None}
    for r in found:
        if r["doc_id"] is not None:
            assert r["back"] == want[r["doc_id"]]
    empty = [r for r in found if r["doc_id"] == 1]
    assert [(r["sample"], r["n_pieces"], r["log_inclusion"]) for r in empty] == [(0, 0, 0.0)]
    assert len({tuple(r["ids"]) for r in found if r["doc_id"] == 11}) == 2


def test_html_defined_results(spark):
    page = "<html><body><nav>menu</nav><article><h1>T</h1><p>Body &amp; text</p></article></body></html>"
    pages = spark.createDataFrame([(1, "http://a.example/1", page, 3), (1, "http://a.example/1", page, 3), (None, None, page, 3), (2, "http://a.example/2", None, 3), (3, "x", "", 3)], "page_id long, url string, html string, node int")
    found = rows(html.extract_main_text(pages), "carried.page_id", "main_text", "carried.node")
    assert found == sorted([(1, "T\n\nBody & text", 3)] * 2 + [(None, "T\n\nBody & text", 3), (2, "", 3), (3, "", 3)], key=repr)
    assert html.extract_main_text(pages.where("false")).count() == 0


def test_topk_defined_results(spark):
    inf = float("inf")
    data = [(50, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0]), (None, [1.0, 1.0]), (9, [-1.0, 0.0]), (2, [1.0, 0.0]), (10, [])]
    vectors = topk.usable(spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("id", F.lit(1)))
    found = rows(topk.top_k(vectors.where("id = 50"), vectors, 3), "query_id", "rank", "vec_id", "score")
    assert found == [(50, 1, 1, 65536), (50, 2, 2, 65536), (50, 3, 2, 65536)]
    all_ = rows(topk.top_k(vectors.where("id = 50"), vectors, 99), "rank", "vec_id", "score")
    assert [r[1] for r in sorted(all_)] == [1, 2, 2, 3, 9]
    twice = topk.usable(spark.createDataFrame([(50, [1.0]), (50, [2.0]), (1, [3.0]), (100, []), (2, [])], "vec_id long, embedding array<double>"))
    found = rows(topk.top_k(twice.where("id % 50 = 0"), twice, 3), "query_id", "rank", "vec_id", "score")
    assert sorted(found) == [(50, 1, 1, 196608), (50, 1, 1, 393216), (50, 2, 50, 131072), (50, 2, 50, 131072), (100, 1, 2, 0)]
    assert topk.top_k(vectors.where("false"), vectors).count() == 0


def test_topk_over_many_blocks_and_groups(spark, monkeypatch):
    """Blocks that later passes leave out, floors from a share of them, ties over blocks, copies, and queries in groups."""
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 16)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "GROUP_BYTES", 700)
    monkeypatch.setattr(topk, "BIN_BITS", 4)
    draw = np.random.default_rng(8)
    data = [(int(k), (draw.integers(-40, 41, 6) / 16).tolist() if k % 5 else [1.0, 0.0, 0.5, 0.25, 0.0, 0.0]) for k in draw.permutation(700)]
    vectors = topk.usable(spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(5))
    found = rows(topk.top_k(vectors.where("id % 50 = 0"), vectors, 7), "query_id", "rank", "vec_id", "score")
    whole = {k: np.floor(256 * np.array(v)).astype(int) for k, v in data}
    want = []
    for q in range(0, 700, 50):
        best = sorted((-int(whole[q] @ v), k) for k, v in whole.items() if k != q)[:7]
        want += [(q, n, k, -s) for n, (s, k) in enumerate(best, 1)]
    assert sorted(found) == sorted(want)


def test_topk_huge_components(spark):
    data = [(50, [1e12, -3e12]), (1, [1e12, 1.0]), (2, [-1e12, 2e12]), (3, [7.25, 1.5])]
    vectors = topk.usable(spark.createDataFrame(data, "vec_id long, embedding array<double>"))
    found = {r["vec_id"]: r["score"] for r in topk.top_k(vectors.where("id = 50"), vectors).collect()}
    limit = 2**63 - 1
    want = {k: min(max(sum(int(256 * a) * int(256 * b) for a, b in zip(data[0][1], v)), -limit), limit) for k, v in data[1:]}
    assert found == want


def test_sampling_does_not_depend_on_blocks(spark, monkeypatch):
    import pyarrow as pa

    path = sampling.public_tokenizers.path(sampling.VOCABULARY)
    texts = ["the cat sat\non the mat", "", None, "x" * 60 + " unusually", "the the the", "naïve  Straße"] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    rows = {}
    for size in (1, 40, 6 << 20):
        monkeypatch.setattr(sampling, "BLOCK_BYTES", size)
        near = lambda r: {c: round(v, 9) if isinstance(v, float) else v for c, v in r.items()}
        rows[size] = sorted(str(near(r)) for b in sampling._sampler(path, 4, 1.0, True)(iter([batch])) for r in b.to_pylist())
    assert rows[1] == rows[40] == rows[6 << 20]
    seeds = [0, 7, 1 << 62, (1 << 63) - 5]
    assert [sampling.uniform_of(s) for s in seeds] == sampling.uniform(np.array(seeds, np.uint64)).tolist()
