"""Boxes that meet others are counted without their pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import boxes

SIDES = ("xmin", "ymin", "xmax", "ymax")


def some(spark, n, seed, name, p, sizes, whole):
    draw = np.random.default_rng(seed)
    low = draw.integers(0, 300, (n, 2)).astype(float) if whole else draw.uniform(-150, 150, (n, 2))
    high = low + draw.choice(sizes, (n, 1))
    at = np.c_[low, high]
    rows = [(int(k), *map(float, r)) for k, r in zip(draw.permutation(n) - n // 2, at)]
    return spark.createDataFrame(rows, f"{name} long, " + ", ".join(f"{p}{s} double" for s in SIDES)), rows


def brute(left, right):
    b = np.array(right)
    want = {}
    for k, x0, y0, x1, y1 in left:
        met = b[(b[:, 1] <= x1) & (x0 <= b[:, 3]) & (b[:, 2] <= y1) & (y0 <= b[:, 4])][:, 0]
        if len(met):
            want[k] = (len(met), int(met.min()), int(met.max()))
    return want


@pytest.mark.parametrize("whole", [True, False])
def test_boxes_met_are_counted_without_pairs(spark, monkeypatch, whole):
    left, lefts = some(spark, 300, 1, "a", "a", [0.0, 3.0, 250.0], whole)
    right, rights = some(spark, 9000, 2, "b", "b", [0.0, 2.0, 90.0], whole)
    left = left.unionByName(left.limit(1).withColumns({"a": F.lit(-999).cast("long"), "axmin": F.lit(None).cast("double")}))
    left = left.unionByName(left.limit(1).withColumns({"a": F.lit(-998).cast("long"), "axmin": F.lit(9e3), "axmax": F.lit(9e3)}))
    made, join = [], boxes.box_join
    monkeypatch.setattr(boxes, "box_join", lambda *of: (pairs := join(*of), made.append(pairs.count()))[0])
    found = {r["a"]: (r["n"], r["first"], r["last"]) for r in boxes.summed_up(left, right, "a", "b", "a", "b", 10.0, pairs=1000).collect()}
    want = brute(lefts, rights)
    assert found == want
    assert sum(made) < sum(n for n, *_ in want.values()) / 5


def test_few_pairs_and_no_boxes(spark):
    left, lefts = some(spark, 40, 3, "a", "a", [3.0, 50.0], True)
    right, rights = some(spark, 60, 4, "b", "b", [2.0], True)
    plain = lambda df: {r["a"]: (r["n"], r["first"], r["last"]) for r in df.collect()}
    assert plain(boxes.summed_up(left, right, "a", "b", "a", "b", 10.0)) == plain(boxes.summed_up(left, right, "a", "b", "a", "b", 10.0, pairs=0)) == brute(lefts, rights)
    assert not plain(boxes.summed_up(left, right.limit(0), "a", "b", "a", "b", 10.0))


def test_the_query_counts_so(spark, sf_dir, monkeypatch):
    from lodestrata.plans import q_match

    asked = []
    monkeypatch.setattr(boxes, "counts_met", lambda *of, met=boxes.counts_met: (asked.append(1), met(*of))[1])
    assert q_match.j13_sizes(spark, sf_dir).count() and asked
