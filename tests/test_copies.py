"""What repeats is worked out once: lines on one line, equal shapes, pairs of shapes of one form."""

from pyspark.sql import functions as F

from lodestrata.operators import network, shapes


def at(x, y):
    return F.struct(F.lit(x).cast("double").alias("x"), F.lit(y).cast("double").alias("y"))


def test_lines_on_one_line_are_cut_there(spark):
    k = F.col("id").cast("double")
    spot = lambda x: F.struct(x.alias("x"), F.lit(3.0).alias("y"))
    parts = spark.range(200).select(spot(k % 20).alias("a"), spot(k % 20 + 1 + k % 7).alias("b"))
    assert network._once_along_axes(parts, []).count() == 26
    assert network.noded(parts, 16.0).count() == 26


def test_pairs_of_one_form_are_worked_out_once(spark, monkeypatch):
    k = F.col("id").cast("double")
    ring = lambda x, y, w: F.array(F.array(*[F.struct((x + dx).alias("x"), (y + dy).alias("y")) for dx, dy in ((0.0, 0.0), (w, 0.0), (w, w), (0.0, w))]))
    pairs = spark.range(60).select("id", ring(k * 5, k, 4.0).alias("a"), ring(k * 5 + 2, k + 1 + k % 2, 4.0).alias("b"))
    seen, border = [], shapes.border
    monkeypatch.setattr(shapes, "border", lambda known, *rest: (seen.append(known.count()), border(known, *rest))[1])
    found = {r["id"]: r for r in shapes.intersection(pairs, ["id"], "a", "b", 8.0).collect()}
    assert seen == [4]
    assert {n: r["area"] for n, r in found.items()} == {n: 6.0 - 2 * (n % 2) for n in range(60)}
    assert all(min(p["x"] for p in r["rings"][0]) == n * 5 + 2 and min(p["y"] for p in r["rings"][0]) == n + 1 + n % 2 for n, r in found.items())


def test_origins_of_one_form_are_worked_out_once(spark, monkeypatch):
    k = F.col("id").cast("double")
    spot = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    box = lambda x, y, w, h: F.array(F.array(spot(x, y), spot(x + w, y), spot(x + w, y + h), spot(x, y + h)))
    origins = spark.range(40).select("id", (k * 40 + 0.5).alias("x"), (k % 7).alias("y"))
    walls = spark.range(40).where("id % 4 <> 3").select(box(k * 40 + 1.5 + k % 4, k % 7 - 9, F.lit(0.5), F.lit(18.0)).alias("rings"))
    seen, border = [], shapes.border
    monkeypatch.setattr(shapes, "border", lambda known, *rest: (seen.append(known.where("part = 0").count()), border(known, *rest))[1])
    found = {r["id"]: r for r in shapes.barrier_buffer(origins, ["id"], walls, 6.0, 16.0).collect()}
    assert seen == [4] and sorted(found) == list(range(40))
    assert all(abs(r["area"] - found[n % 4]["area"]) < 1e-9 for n, r in found.items())
    assert len({round(found[n]["area"], 6) for n in range(4)}) == 4
    right = lambda r: max(p["x"] for p in r["rings"][0])
    assert all(abs(right(r) - (n * 40 + (6.5 if n % 4 == 3 else 1.5 + n % 4))) < 1e-6 for n, r in found.items())
