"""Joins by cells give the same rows however they are dealt, and small files do not leave them in one task."""

import math
import random

from pyspark.sql import functions as F

from lodestrata.operators import grid, spatial
from lodestrata.plans import catalog


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def places(spark, n, seed, names, span=100.0):
    draw = random.Random(seed)
    return spark.createDataFrame([(k, draw.uniform(0, span), draw.uniform(0, span)) for k in range(n)], list(names)).coalesce(1)


def test_cells_are_dealt_by_their_pairs(spark):
    left = spark.range(3000).select((F.col("id") % 3).alias("k"), F.col("id").alias("a")).coalesce(1)
    right = spark.range(60).select((F.col("id") % 3).alias("k"), F.col("id").alias("b")).coalesce(1)
    found = spatial.cell_join(left, right, ["k"], pairs=500)
    assert found.rdd.getNumPartitions() >= 64
    assert rows(found, "a", "b") == rows(left.join(right, "k"), "a", "b")
    biggest = found.withColumn("at", F.spark_partition_id()).groupBy("at").count().agg(F.max("count")).first()[0]
    assert biggest < 8000  # of 20,000 pairs of each of the three keys


def test_dense_distance_join(spark):
    left, right = places(spark, 400, 1, ("a", "x", "y")), places(spark, 300, 2, ("b", "u", "v"))
    others = right.collect()
    want = sorted((p["a"], q["b"]) for p in left.collect() for q in others if math.hypot(p["x"] - q["u"], p["y"] - q["v"]) <= 20.0)
    assert rows(spatial.distance_join(left, right, ("x", "y"), ("u", "v"), 20.0), "a", "b") == want


def test_nearest_with_copies_and_far_points(spark):
    left, right = places(spark, 200, 3, ("a", "x", "y")), places(spark, 40, 4, ("b", "u", "v"), 30.0)
    right = right.unionByName(right.withColumn("b", F.col("b") + 100)).unionByName(right.withColumn("b", F.col("b") + 200))
    others = right.collect()
    near = {p["a"]: sorted((math.sqrt((p["x"] - q["u"]) ** 2 + (p["y"] - q["v"]) ** 2), q["b"]) for q in others) for p in left.collect()}
    want = sorted((a, b, k + 1) for a, all_ in near.items() for k, (d, b) in enumerate([x for x in all_ if x[0] <= 60.0][:4]))
    assert rows(spatial.nearest(left, right, ["a"], ("x", "y"), ("u", "v"), 60.0, "b", 4), "a", "b", "rank") == want


def test_polygons_of_many_sizes(spark):
    draw = random.Random(5)
    shapes = []
    for k in range(40):
        x, y, r = draw.uniform(0, 100), draw.uniform(0, 100), draw.choice([0.5, 4.0, 33.0])
        ring = lambda s: [(x + s * r * math.cos(t), y + s * r * draw.uniform(0.6, 1) * math.sin(t)) for t in (i * math.pi / 4 for i in range(8))]
        shapes.append((k, [ring(1), ring(0.4)]))
    polygons = spark.createDataFrame(shapes, "p long, rings array<array<struct<x:double,y:double>>>")
    points = places(spark, 800, 6, ("a", "x", "y"))

    def inside(x, y, rings):
        edges = [(p, q) for ring in rings for p, q in zip(ring, ring[1:] + ring[:1])]
        return sum((p[1] > y) != (q[1] > y) and x < (q[0] - p[0]) * (y - p[1]) / (q[1] - p[1]) + p[0] for p, q in edges) % 2 == 1

    want = sorted((p["a"], k) for p in points.collect() for k, rings in shapes if inside(p["x"], p["y"], rings))
    assert rows(spatial.polygon_join(points, polygons, "x", "y", "rings", 7.0), "a", "p") == want


def test_equal_boxes_are_one_kind(spark):
    df = spark.range(5000).select(F.col("id").alias("a"), (F.col("id") % 2).alias("x"))
    kinds = spatial.alike(df, ["x"], "a", 1000)
    assert 6 <= kinds.count() <= 10
    assert rows(kinds.select(F.explode("members").alias("a"), "x"), "a", "x") == rows(df, "a", "x")


def test_sampled_shapes_are_dealt(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (0, 4))])
    shapes = spark.range(400).select(F.col("id").alias("grid_id"), F.array(ring).alias("rings")).coalesce(1)
    found = grid.sample_shapes(shapes, "rings", 61)
    assert found.rdd.getNumPartitions() > 1
    assert found.where("inside").count() == 400 * found.where("grid_id = 0 and x > 0 and y > 0 and x + y < 4").count()


def joins(df):
    return [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]


def test_few_edges_are_columns(spark, sf_dir):
    for name, among in (("G05_point_in_polygon", 1), ("G05_holes_and_parts", 2)):
        plans = joins(catalog.queries()[name](spark, sf_dir))
        assert len(plans) == among and "lambda" not in plans[0]


def test_bands_are_literals(spark, sf_dir):
    found = catalog.queries()["G07_G11_G12_distance_bands"](spark, sf_dir)
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_scores_are_made_apart_from_pairs(spark, sf_dir):
    found = catalog.queries()["J13_G01_G02_G03_box_overlap"](spark, sf_dir)
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert sum("Repartition" in line and "false" in line for line in plan) >= 2
    assert all("round" not in line for line in joins(found))
