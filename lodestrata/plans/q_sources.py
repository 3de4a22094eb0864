"""Queries for JSON, GeoJSON and climate rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestrata.operators import relational as R
from lodestrata.sources import readers as S
from lodestrata.streaming import sessions

from .catalog import query
from .tables import table


@query("S01_S02_json_recordset", """SELECT n_regionkey, n_nationkey AS id, n_name AS name FROM nation""")
def s01(spark, sf_dir):
    packed = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.to_json(F.collect_list(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")))).alias("payload"))
    return S.json_array(packed, "payload", "id int, name string", ["n_regionkey"])


@query("S15_climate_days", """SELECT event_id, make_date(2023 + CAST(user_id % 2 AS INTEGER), 1, 1) + CAST(event_id % 360 AS INTEGER) AS date FROM events""")
def s15(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", (F.lit(2023) + F.col("user_id") % 2).cast("int").alias("year"), (F.col("event_id") % 360 + 1).alias("yday"))
    return S.climate_rows(rows, "year", "yday").select("event_id", "date")


@query("S03_box_pushdown", """SELECT p_partkey FROM part WHERE p_size <= 20 AND p_size + 3 >= 10 AND p_partkey <= 1500 AND p_partkey + 5 >= 100""")
def s03(spark, sf_dir):
    box = F.struct(F.col("p_size").alias("xmin"), (F.col("p_size") + 3).alias("xmax"), F.col("p_partkey").alias("ymin"), (F.col("p_partkey") + 5).alias("ymax"))
    return S.in_box(table(spark, sf_dir, "part").withColumn("bbox", box), "bbox", 10, 100, 20, 1500).select("p_partkey")


@query("S08_headed_sheet", """SELECT n_nationkey + 2 AS line, n_name AS name FROM nation""")
def s08(spark, sf_dir):
    body = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 2).alias("line"), F.array(F.col("n_nationkey").cast("string"), F.col("n_name")).alias("cells"))
    top = spark.createDataFrame([(0, ["a title"]), (1, ["key", " name "])], "line int, cells array<string>")
    return S.headed_sheet(top.unionByName(body), "line", "cells", "key").select("line", F.element_at("record", "name").alias("name"))


@query("S05_geojson_sequence", """SELECT n_nationkey AS id, n_name AS name, 'Point' AS geometry_type, '[' || n_regionkey || ',' || n_nationkey || ']' AS coordinates FROM nation""")
def s05(spark, sf_dir):
    feature = F.to_json(F.struct(
        F.lit("Feature").alias("type"), F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")).alias("properties"),
        F.struct(F.lit("Point").alias("type"), F.array("n_regionkey", "n_nationkey").alias("coordinates")).alias("geometry"),
    ))
    path = f"{R.shared_folder(spark)}/features-{uuid.uuid4().hex}"
    table(spark, sf_dir, "nation").select(F.concat(F.lit("\x1e"), feature).alias("value")).write.text(path)
    return S.geojson_sequence(spark, path, "id int, name string")


@query("S07_csv_filtered", """SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_acctbal > 0""")
def s07(spark, sf_dir):
    path = f"{R.shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal").write.csv(path, header=True)
    return S.csv_rows(spark, path, "s_suppkey bigint, s_name string, s_acctbal double", F.col("s_acctbal") > 0)


@query("S13_grid_records", """SELECT event_id, CAST(value AS DOUBLE) AS value FROM events WHERE (event_type = 'click' AND user_id % 3 = 0 AND event_id % 2 = 0) OR (event_type = 'view' AND user_id % 3 = 1 AND event_id % 2 = 1)""")
def s13(spark, sf_dir):
    level, forecast = F.concat(F.lit("level "), F.col("user_id") % 3), F.when(F.col("event_id") % 2 == 0, "anl").otherwise("1 hour fcst")
    records = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("variable"), level.alias("level"), forecast.alias("forecast"), F.col("value").cast("double").alias("value"))
    return S.grid_records(records, [("click", "level 0", "anl"), ("view", "level 1", "1 hour fcst")]).select("event_id", "value")


@query("S18_inline_values", """SELECT c_custkey, v.weight FROM customer JOIN (VALUES ('BUILDING', 3), ('MACHINERY', 1)) v(segment, weight) ON c_mktsegment = v.segment""")
def s18(spark, sf_dir):
    values = spark.createDataFrame([("BUILDING", 3), ("MACHINERY", 1)], "segment string, weight int")  # two rows
    return table(spark, sf_dir, "customer").join(F.broadcast(values), F.col("c_mktsegment") == F.col("segment")).select("c_custkey", "weight")


@query("P16_guardrails", """SELECT o_custkey, count(*) AS n, false AS future_order_assertion_authorized, false AS contact_authorized FROM orders GROUP BY o_custkey""")
def p16(spark, sf_dir):
    counted = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return R.with_guardrails(counted, "future_order_assertion_authorized", "contact_authorized")


@query("T01_available_now", """SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def t01(spark, sf_dir):
    """A scheduled refresh: what is new since the last run goes through a stream that ends when it is done."""
    folder = f"{R.shared_folder(spark)}/refresh-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events")
    events.write.parquet(f"{folder}/landed")
    stream = sessions.event_stream(spark, f"{folder}/landed", events.schema, files_per_batch=64)
    sessions.upsert_batches(stream, f"{folder}/table", ["user_id"], f"{folder}/state").awaitTermination()
    return sessions.latest_batch(spark, f"{folder}/table", events.schema).select("user_id", "event_id", "event_type")


@query(
    "S13_index_ranges",
    """WITH i AS (SELECT o_custkey AS file, o_orderkey AS record, o_orderkey * 100 AS start, o_orderstatus AS variable, substr(o_orderpriority, 1, 1) AS level FROM orders), r AS (SELECT *, lead(start) OVER (PARTITION BY file ORDER BY start, record) - 1 AS stop FROM i)
    SELECT file, CAST(record AS INTEGER) AS record, start, stop FROM r WHERE (variable = 'F' AND level = '1') OR (variable = 'O' AND level = '3')""",
)
def s13_ranges(spark, sf_dir):
    key = F.col("o_orderkey")
    line = F.concat_ws(":", key.cast("string"), (key * 100).cast("string"), F.lit("d=2024010100"), "o_orderstatus", F.concat(F.substring("o_orderpriority", 1, 1), F.lit(" m")), F.lit("anl"), F.lit(""))
    lines = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file"), line.alias("line"))
    return S.record_ranges(lines, "file", "line", [("F", "1 m", "anl"), ("O", "3 m", "anl")]).select("file", "record", "start", "stop")


@query(
    "S11_catalogue_windows",
    """WITH i AS (SELECT o_orderkey AS k, (o_orderkey * 37 % 1000)::DOUBLE AS x, (o_orderkey * 91 % 1000)::DOUBLE AS y, o_orderdate AS t, (o_custkey % 100)::DOUBLE AS cloud FROM orders),
    m AS (SELECT 's' || k AS item, b AS band, greatest(0, CAST(floor((200 - x) / 30) AS BIGINT)) AS col0, least(9, CAST(ceil((500 - x) / 30) AS BIGINT) - 1) AS col1, greatest(0, CAST(floor((y + 300 - 600) / 30) AS BIGINT)) AS row0, least(9, CAST(ceil((y + 300 - 100) / 30) AS BIGINT) - 1) AS row1
    FROM i, (VALUES ('B04'), ('B05')) v(b) WHERE x <= 500 AND x + 300 >= 200 AND y <= 600 AND y + 300 >= 100 AND t >= TIMESTAMP '1994-01-01' AND t < TIMESTAMP '1996-01-01' AND cloud <= 40) SELECT * FROM m WHERE col0 <= col1 AND row0 <= row1""",
)
def s11(spark, sf_dir):
    """Scenes of 10 by 10 cells of 30 units: those a search finds, and the part of each to be read for a field's box."""
    k = F.col("o_orderkey")
    x, y = (k * 37 % 1000).cast("double"), (k * 91 % 1000).cast("double")
    bands = F.map_from_arrays(F.array(F.lit("B04"), F.lit("B05")), F.array(*[F.struct(F.concat(F.lit(f"file:/scenes/{b}/"), k.cast("string")).alias("href")) for b in ("B04", "B05")]))
    properties = F.struct(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("datetime"), (F.col("o_custkey") % 100).cast("double").alias("eo:cloud_cover"))
    item = F.to_json(F.struct(F.concat(F.lit("s"), k.cast("string")).alias("id"), F.array(x, y, x + 300, y + 300).alias("bbox"), properties.alias("properties"), bands.alias("assets")))
    found = S.catalogue_items(table(spark, sf_dir, "orders").select(item.alias("item_json")), "item_json", (200, 100, 500, 600), "1994-01-01", "1996-01-01", 40.0)
    window = S.pixel_window([F.lit(float(v)) for v in (200, 100, 500, 600)], F.get("bbox", F.lit(0)), F.get("bbox", F.lit(3)), 30.0, 10, 10)
    return found.withColumn("w", window).where("w is not null").select("item", "band", "w.col0", "w.col1", "w.row0", "w.row1")


@query(
    "S12_octree_points",
    """WITH p AS (SELECT l_orderkey, l_linenumber, (l_partkey % 256)::DOUBLE AS x, (l_suppkey * 7 % 256)::DOUBLE AS y, l_linenumber % 4 AS level FROM lineitem) SELECT l_orderkey, l_linenumber, level FROM p WHERE x BETWEEN 20 AND 90 AND y BETWEEN 30 AND 200 AND level <= 2""",
)
def s12(spark, sf_dir):
    """Points are kept under their node of a quadtree of four levels; a box and a level choose the nodes to be read."""
    raw = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 256).cast("double").alias("x"), (F.col("l_suppkey") * 7 % 256).cast("double").alias("y"), (F.col("l_linenumber") % 4).cast("int").alias("level"))
    size = F.lit(256.0) / F.pow(F.lit(2.0), F.col("level"))
    low = {c: F.floor(F.col(c) / size) * size for c in ("x", "y")}
    placed = raw.withColumn("node", F.concat_ws("_", F.lit("n"), F.col("level").cast("string"), F.floor(F.col("x") / size).cast("string"), F.floor(F.col("y") / size).cast("string")))
    nodes = placed.select("node", "level", low["x"].alias("xmin"), low["y"].alias("ymin"), size.alias("size")).distinct()
    path = f"{R.shared_folder(spark)}/points-{uuid.uuid4().hex}"
    placed.repartition("node", F.col("l_orderkey") % 8).write.partitionBy("node").parquet(path)
    return S.octree_points(spark.read.parquet(path), nodes, (20, 30, 90, 200), 2).select("l_orderkey", "l_linenumber", "level")


@query("S06_S17_fetched_pages", """SELECT c_custkey // 10 AS page, CAST(200 AS INTEGER) AS status, c_custkey AS id, c_name AS name FROM customer""")
def s17(spark, sf_dir):
    """One request for each page of ten records; ``data:`` URLs stand in for a service, so that the tables decide the answers."""
    record = F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    pages = table(spark, sf_dir, "customer").groupBy(F.floor(F.col("c_custkey") / 10).alias("page")).agg(F.to_json(F.collect_list(record)).alias("features"))
    asked = pages.select("page", F.concat(F.lit("data:application/json,"), F.replace(F.url_encode("features"), F.lit("+"), F.lit("%20"))).alias("url"))
    answers = S.fetched(asked, "url").select("page", "answer.status", "answer.body")
    return S.json_array(answers, "body", "id bigint, name string", ["page", "status"])


@query(
    "S16_zip_members",
    """SELECT 'supplier-' || s_suppkey || '.txt' AS member, CAST(length(s_name) AS BIGINT) AS size, sha256(s_name) AS sha256, CASE WHEN s_suppkey % 5 = 0 THEN 'unlisted' WHEN s_suppkey % 3 = 0 THEN 'changed' ELSE 'ok' END AS verdict FROM supplier""",
)
def s16(spark, sf_dir):
    """Archives of one member for each supplier, opened and held against a list of checksums."""
    suppliers = table(spark, sf_dir, "supplier")
    member = F.concat(F.lit("supplier-"), F.col("s_suppkey").cast("string"), F.lit(".txt"))
    told = suppliers.where("s_suppkey % 5 <> 0").select(member.alias("member"), F.sha2(F.when(F.col("s_suppkey") % 3 == 0, F.lit("other")).otherwise(F.col("s_name")).cast("binary"), 256).alias("sha256"))
    files = S.zipped(suppliers.select(F.concat(member, F.lit(".zip")).alias("path"), member.alias("member"), F.col("s_name").alias("text")))
    return S.verified(S.zip_members(files), told).select("member", "size", "sha256", "verdict")
