"""Pairs of what repeats are made where they are returned: neither kept nor moved, and each form is worked out once."""

import random

import duckdb
import pytest

from lodestrata.operators import graph
from lodestrata.plans import catalog

from .test_oracles import plain


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    """400 parcels of one box and 60 zones of one, which all meet, and ten other parcels."""
    folder = tmp_path_factory.mktemp("repeated")
    con = duckdb.connect()
    con.execute(f"COPY (SELECT i * 8633 AS p_partkey, 6 AS p_size FROM range(400) t(i) UNION ALL SELECT i + 1, 9 FROM range(10) t(i)) TO '{folder}/part.parquet' (FORMAT parquet)")
    con.execute(f"COPY (SELECT i * 720 AS s_suppkey FROM range(60) t(i)) TO '{folder}/supplier.parquet' (FORMAT parquet)")
    for t in ("part", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["G06_G08_difference", "G06_G08_intersection", "G08_clip_area_and_length"])
def test_pairs_are_not_kept(name, spark, repeated, monkeypatch):
    folder, con = repeated
    kept, checkpoint = [], type(spark.range(1)).checkpoint
    monkeypatch.setattr(type(spark.range(1)), "checkpoint", lambda df, *rest: (lambda done: (kept.append(done.count()), done)[1])(checkpoint(df, *rest)))
    found = catalog.queries()[name](spark, folder)
    cursor = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    want = sorted(tuple(plain(v) for v in r) for r in cursor.fetchall())
    assert sorted(tuple(plain(r[c]) for c in names) for r in found.collect()) == want
    assert len(want) >= 24_000 and kept and max(kept) < 2_000


@pytest.mark.parametrize("most", [20, 10_000])
def test_components_by_parts_and_rounds(spark, most):
    draw = random.Random(most)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 700)]
    root = {n: n for link in links for n in link}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    df = spark.createDataFrame([({"at": a}, {"at": b}) for a, b in links], "a struct<at:long>, b struct<at:long>")
    found = graph.connected_components(df, most)
    assert sorted((r["node"]["at"], r["component"]["at"]) for r in found.collect()) == sorted((n, top(n)) for n in root)
