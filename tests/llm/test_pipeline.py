"""The pipeline against the operators' plain versions, stage by stage."""

import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestrata.llm import packing, pii
from tests.llm.test_against_brute_force import WORD, plain_fingerprint


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("kept_text", F.lit(1))
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = (docs.collect(), columns)
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "pack":
            assert docs.columns == columns
    before = {r["doc_id"]: r for r in seen["language_id"][0]}
    after = {r["doc_id"]: r for r in seen["near_dedup"][0]}
    assert set(after) == {i for i, r in before.items() if r["text"] and any(c.isalpha() for c in r["text"])}
    prints = {i: plain_fingerprint(r["text"]) for i, r in after.items()}
    least = {i: i for i in prints}
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    while any(least[a] != least[b] for a, b in links):
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    kept = {r["doc_id"] for r in seen["substring_dedup"][0]}
    assert kept == {i for i, j in least.items() if i == j}
    cut = {r["doc_id"]: r["text"] for r in seen["personal_data"][0]}
    first, want = {}, {}
    for i in sorted(kept):
        words = WORD.findall(after[i]["text"])
        gone = [False] * len(words)
        for k in range(len(words) - 49):
            if first.setdefault(tuple(words[k : k + 50]), i) < i:
                gone[k : k + 50] = [True] * 50
        want[i] = " ".join(w for w, g in zip(words, gone) if not g) if any(gone) else after[i]["text"]
    assert cut == want
    clean = {r["doc_id"]: r for r in seen["pack"][0]}
    for i, r in clean.items():
        assert r["text"] == pii.redact(cut[i], pii.find_spans(cut[i])) and r["n_chars"] == len(r["text"])
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    pieces, places = {}, {}
    for r in docs.collect():
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, r in clean.items():
        ids = np.array([*tokenizer.encode(r["text"], add_special_tokens=False).ids, 0], "<u4")
        short = len(ids) % packing.CAPACITY or packing.CAPACITY
        cuts = [0, *range(short, len(ids) + 1, packing.CAPACITY)]
        assert sorted(pieces.pop(i)) == [(k, a, b - a, zlib.crc32(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert not pieces
    for held in places.values():
        held.sort()
        assert [a for a, _ in held] == [0, *np.cumsum([n for _, n in held])[:-1].tolist()] and sum(n for _, n in held) <= packing.CAPACITY
    run = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, docs.select(run.columns).collect()))


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_awkward_tables(name, stage, spark, sf_dir):
    """No rows; null ids, texts and languages; repeated rows; columns with the operators' names."""
    rows = [(1, "words of the text " * 30, "en"), (1, "words of the text " * 30, "en"), (None, "words without an id " * 9, None), (2, None, "de"), (3, "", "de"), (4, " \n", None), (5, "mail a.b@example.com now and then", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("doc_id", "text", "lang", "'s' AS source", "1L AS n_chars", "7 AS fp", "7 AS page", "7 AS slot", "7 AS carried")
    assert stage(spark, docs.where("false"), sf_dir).count() == 0
    found = stage(spark, docs, sf_dir)
    assert name == "pack" or found.columns == docs.columns
    ids = [r["doc_id"] for r in found.collect()]
    assert ids.count(1) == 2 and ids.count(None) == 1 and 5 in ids


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14))
