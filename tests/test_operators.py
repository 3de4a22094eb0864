"""Operators on small hand-made tables, refusals and negative cases included."""

import datetime as dt
import json
import math
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.functions import geo, lines, overlay, solar, text
from lodestrata.operators import cadence, grid, kernels, network, ranks, relational, rules, shapes, spatial, state, stats, terrain
from lodestrata.operators.relational import distinct_on
from lodestrata.sources import readers, sinks
from lodestrata.streaming import sessions

ROOT = Path(__file__).resolve().parents[1]


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_cadence_of_single_null_and_regular_dates(spark):
    days = [("a", f"2023-0{m}-01") for m in range(1, 10)] + [("b", "2023-01-01"), ("b", "2023-01-01"), ("c", None)]
    events = spark.createDataFrame(days, "k string, d string").withColumn("d", F.col("d").cast("date"))
    found = {r["k"]: r for r in cadence.cadence(events, ["k"], "d").collect()}
    assert set(found) == {"a", "b"}
    assert found["b"]["confidence"] == "insufficient" and found["b"]["p50"] is None and found["b"]["projected_center"] is None
    assert found["a"]["confidence"] == "medium" and found["a"]["variability"] == "regular" and found["a"]["n_events"] == 9
    rolled = {r["k"]: r["window_status"] for r in cadence.roll_forward(cadence.cadence(events, ["k"], "d"), "2025-01-01").collect()}
    assert rolled["b"] == "not_projected"


def test_asof_keeps_every_left_row(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("b", 3)], "k string, t int")
    right = spark.createDataFrame([("a", 2, 1.0, 1), ("a", 5, 2.0, 1), ("a", 5, 3.0, 2)], "k string, u int, v double, id int")
    at = lambda **kw: {(r["k"], r["t"]): r["asof_v"] for r in relational.asof_join(left, right, ["k"], "t", "u", ["v"], tie="id", **kw).collect()}
    assert at() == {("a", 1): None, ("a", 5): 3.0, ("b", 3): None}
    assert at(strict=True) == {("a", 1): None, ("a", 5): 1.0, ("b", 3): None}


def test_asof_by_period_gives_the_same(spark):
    import random

    rng = random.Random(5)
    day = lambda: None if rng.random() < 0.1 else dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(24 * 40))
    key = lambda: rng.choice([1, 1, 1, 2, None])
    left = spark.createDataFrame([(k, key(), day()) for k in range(300)], "n int, k int, t timestamp_ntz")
    right = spark.createDataFrame([(key(), day(), k, k if k % 7 else None) for k in range(120)], "k int, u timestamp_ntz, id int, v int")
    run = lambda **kw: sorted(map(str, relational.asof_join(left, right, ["k"], "t", "u", ["v"], tie="id", **kw).collect()))
    for strict in (False, True):
        plain = run(strict=strict)
        assert len(plain) == 300 and run(strict=strict, period="day") == plain == run(strict=strict, period="month") == run(strict=strict, small=0)


def test_boxes_of_all_sizes_meet_once(spark):
    import random

    rng = random.Random(8)

    def boxes(n, side):
        out = []
        for k in range(n):
            x, y, w, h = rng.uniform(-500, 500), rng.uniform(-500, 500), *[rng.choice([0, 0.5, 7, 90, 2500]) for _ in range(2)]
            out.append((k, x, y, x + w, y + h))
        return out, spark.createDataFrame(out, f"{side} int, {side}xmin double, {side}ymin double, {side}xmax double, {side}ymax double")

    (a, left), (b, right) = boxes(120, "a"), boxes(150, "b")
    want = sorted((p[0], q[0]) for p in a for q in b if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4])
    assert sorted(map(tuple, spatial.box_join(left, right, "a", "b", 2.0).select("a", "b").collect())) == want
    assert spatial.box_join(left.limit(0), right, "a", "b", 2.0).count() == spatial.box_join(left, right.limit(0), "a", "b", 2.0).count() == 0


def test_ranges_refuse_what_is_too_large(spark):
    df = spark.createDataFrame([(1, 3), (5, 4), (None, 2)], "a long, b long")
    assert [r["m"] for r in relational.expand_range(df, "a", "b", "m").collect()] == [1, 2, 3]
    wide = relational.expand_range(spark.createDataFrame([(-5, 2_345_678)], "a long, b long"), "a", "b", "m").agg(F.count("*"), F.min("m"), F.max("m"), F.count_distinct("m")).first()
    assert tuple(wide) == (2_345_684, -5, 2_345_678, 2_345_684)
    with pytest.raises(Exception, match="more than 2 members"):
        relational.expand_range(df, "a", "b", "m", 2).collect()


def test_patterns_in_groups(spark):
    texts = spark.createDataFrame([(k, f"word{k} of {k % 3}") for k in range(20)], "id int, text string")
    patterns = spark.createDataFrame([(k, f"word{k}\\b") for k in range(20)], "n int, p string")
    for group in (100, 3):
        assert sorted((r["id"], r["n"]) for r in relational.regex_join(texts, "text", patterns, "p", group).collect()) == [(k, k) for k in range(20)]


def test_clamp():
    assert [relational.clamp(n) for n in (None, 0, 7, 1000)] == [10, 1, 7, 100]


def test_queue_expires_exhausts_and_claims(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    jobs = [(1, "leased", 1, 1, 3, None, t(1), t(0)), (2, "leased", 1, 3, 3, None, t(1), t(0)), (3, "queued", 9, 0, 3, t(9), None, t(0)), (4, "queued", 5, 0, 3, None, None, t(0)), (5, "done", 9, 1, 3, None, None, t(0))]
    queue = spark.createDataFrame(jobs, "id int, state string, priority int, attempt_count int, max_attempts int, next_attempt_at timestamp_ntz, lease_until timestamp_ntz, created_at timestamp_ntz")
    found = {r["id"]: (r["state"], r["claimed"], r["attempt_count"]) for r in state.claim(queue, F.lit("2024-01-01 05:00:00").cast("timestamp_ntz"), 1).collect()}
    assert found == {1: ("queued", False, 1), 2: ("exhausted", False, 3), 3: ("queued", False, 0), 4: ("leased", True, 1), 5: ("done", False, 1)}


def test_upsert_merges_and_keeps_the_rest(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 9), (None, "n", 0)], "k int, v string, c int")
    new = spark.createDataFrame([(2, "B", 3), (3, "C", 1), (None, "N", 4)], "k int, v string, c int")
    found = state.upsert(old, new, ["k"], {"c": F.greatest(F.col("old.c"), F.col("new.c"))})
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([(1, "a", 5), (2, "B", 9), (3, "C", 1), (None, "N", 4)], key=repr)
    added = state.upsert(old.where("k is not null"), new, ["k"])
    assert sorted(map(tuple, added.collect()), key=repr) == sorted([(1, "a", 5), (2, "B", 3), (3, "C", 1), (None, "N", 4)], key=repr)
    assert state.changed_rows(old, new, ["k"], ["v"]).where("k is not null").count() == 2


@pytest.mark.parametrize(("observed", "want"), [(None, "unavailable"), ("2024-02-01", "unavailable"), ("2024-01-01", "stale"), ("2024-01-09", "proxy")])
def test_freshness(spark, observed, want):
    assert value(spark, rules.freshness(F.lit(observed).cast("date"), F.lit("2024-01-10").cast("date"), 2, F.lit("proxy"))) == want


def test_status_drifts_by_reason(spark):
    same, other = state.mismatches({"sha": (F.lit("a"), F.lit("a"))}), state.mismatches({"sha": (F.lit("a"), F.lit(None).cast("string"))})
    yes, no = F.lit(True), F.lit(False)
    assert value(spark, state.reference_status(yes, no, yes, same)) == "available"
    assert value(spark, state.reference_status(yes, yes, yes, same)) == "stale"
    assert value(spark, state.reference_status(yes, no, no, other)) == "stale"
    assert value(spark, state.reference_status(no, no, no, same)) == "unavailable"
    with pytest.raises(ValueError, match="depend on themselves"):
        state.manifests(spark.createDataFrame([("a", "1"), ("b", "2")], "product string, own string"), spark.createDataFrame([("a", "b"), ("b", "a")], "product string, dependency string"))


@pytest.mark.parametrize(("best", "second", "want"), [(0.95, 0.1, "verified"), (0.95, 0.3, "ambiguous"), (0.8, 0.0, "ambiguous"), (None, 0.0, "unmatched")])
def test_verdict(spark, best, second, want):
    assert value(spark, spatial.verdict(F.lit(best).cast("double"), F.lit(second))) == want


def test_text_functions(spark):
    assert value(spark, text.identity_text(F.lit("North Gate of  Smith & Co."))) == "smith and co"
    assert value(spark, text.business_name(F.lit("Acme, Inc."))) == "acme"
    assert value(spark, text.address_key(F.lit("12 North Main Street"))) == "12 n main st"
    assert value(spark, text.trigram_similarity(F.lit("word"), F.lit("word"))) == 1.0
    assert value(spark, text.trigram_similarity(F.lit(""), F.lit("!"))) == 0.0


def test_geometry(spark):
    point = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    square = F.array(point(0, 0), point(4, 0), point(4, 4), point(0, 4))
    assert value(spark, geo.ring_area(square)) == 16
    assert value(spark, geo.in_ring(F.lit(1.0), F.lit(1.0), square)) and not value(spark, geo.in_ring(F.lit(5.0), F.lit(1.0), square))
    assert value(spark, geo.segment_distance(F.lit(3.0), F.lit(4.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))) == 5
    assert value(spark, F.size(geo.chaikin(square))) == 6
    east, north = geo.utm(F.lit(40.0), F.lit(-87.0), 16)
    assert value(spark, east) == pytest.approx(500_000, abs=1e-6) and value(spark, north) == pytest.approx(4_427_757.22, abs=1)


def test_sun(spark):
    at = F.lit("2024-03-20 12:07:00").cast("timestamp_ntz")
    zenith, azimuth = solar.position(at, F.lit(0.0), F.lit(0.0))
    assert value(spark, zenith) < 1.0
    _, _, hours = solar.events(F.lit("2024-06-21").cast("date"), F.lit(40.0), F.lit(-86.0))
    assert value(spark, hours) == pytest.approx(15.0, abs=0.1)
    assert value(spark, solar.events(F.lit("2024-06-21").cast("date"), F.lit(80.0), F.lit(0.0))[0]) is None
    facing = lambda aspect: value(spark, solar.incidence(F.lit(50.0), F.lit(180.0), F.lit(20.0), F.lit(aspect), F.lit(0.0)))
    assert facing(180.0) > facing(0.0)
    assert value(spark, solar.incidence(F.lit(50.0), F.lit(180.0), F.lit(20.0), F.lit(180.0), F.lit(45.0))) == 0


def cells_of(height, grid_id=0):
    return [(grid_id, r, c, float(v)) for r, line in enumerate(height) for c, v in enumerate(line) if v is not None]


GRID = "grid_id long, row long, col long, value double"


def test_pit_fills_to_its_outlet_and_water_runs_down(spark):
    height = [[9, 9, 9, 9], [9, 1, 5, 3], [9, 9, 9, 9]]
    holed = [[9, None, 9, 9], *height[1:]]
    filled = terrain.fill(spark.createDataFrame(cells_of(height) + cells_of(holed, 1), GRID), 2, 2)
    at = {(r["grid_id"], r["row"], r["col"]): r["filled"] for r in filled.collect()}
    assert (at[0, 1, 1], at[1, 1, 1], at[0, 1, 2]) == (5, 1, 5)
    to = {(r["row"], r["col"]): r["to"] for r in terrain.directions(filled, 2).where("grid_id = 0").collect()}
    assert to[1, 2] == kernels.AROUND.index((0, 1)) and to[1, 1] == kernels.AROUND.index((0, 1)) and to[1, 3] is None


@pytest.fixture(scope="module")
def uncut(spark):
    """A rough surface with holes, a lake with a pit over many tiles, and negative rows and columns."""
    draw = np.random.default_rng(4)
    height = draw.integers(0, 9, (21, 26)).astype(float)
    height[5:16, 4:20], height[7:13, 7:14] = 2, 1
    rows = [(1, r - 5, c - 7, float(height[r, c])) for r in range(21) for c in range(26) if draw.random() > 0.01]
    return spark.createDataFrame(rows + [(2, 0, 0, 1.0)], GRID).withColumn("inside", F.expr("row between -2 and 11 and col between -4 and 14"))


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("tile", [7, 5])
def test_cut_and_uncut_terrain_agree(spark, uncut, tile):
    whole, cut = terrain.fill(uncut), terrain.fill(uncut, tile, 2)
    assert rows_of(whole) == rows_of(cut)
    one, many = terrain.directions(whole), terrain.directions(cut, tile)
    assert rows_of(one) == rows_of(many)
    assert rows_of(terrain.accumulate(one.withColumn("w", F.lit(1)), "w")) == rows_of(terrain.accumulate(many.withColumn("w", F.lit(1)), "w", tile))


@pytest.mark.parametrize("run", [lambda g, t: terrain.flow_paths(g, 4, 5, t), lambda g, t: terrain.anatomy(g, 2, t), lambda g, t: terrain.horizon(g, 8, 6, 10.0, t), lambda g, t: terrain.visible_distance(g, [1.5], [2, 6], t), lambda g, t: grid.patches(g, "value", grid.FOUR, t)], ids=["paths", "anatomy", "horizon", "sight", "patches"])
def test_results_do_not_depend_on_tiles(uncut, run):
    assert rows_of(run(uncut, terrain.TILE)) == rows_of(run(uncut, 5))


def test_terrain_of_nothing(spark):
    none = spark.createDataFrame([], GRID)
    assert terrain.flow_accumulation(none).count() == 0 and terrain.flow_paths(none, 1).count() == 0
    blank = spark.createDataFrame([(0, 0, 0, None)], GRID)
    assert terrain.fill(blank).count() == 0


def test_patches_and_flood(spark):
    rows = [(0, r, c, k) for r, line in enumerate(["aab", "bba", "abb"]) for c, k in enumerate(line)]
    g = spark.createDataFrame(rows, "grid_id long, row long, col long, class string")
    sizes = sorted(r["count"] for r in grid.patches(g).groupBy("patch", "class").count().collect())
    assert sizes == [1, 1, 2, 5] or sum(sizes) == 9
    wall = g.withColumn("wall", F.col("class") == "b")
    assert grid.flood(wall, g.where("row = 0 and col = 0"), "wall").count() == 2


def test_lines_are_merged_through_nodes_of_two(spark):
    place = lambda n: (float(n), -5000.5)
    pairs = [(1, 2), (3, 2), (5, 6), (6, 7), (7, 5), (10, 11), (11, 12), (11, 13), *((k, k + 1) for k in range(20, 60))]
    s = spark.createDataFrame([(0, *place(a), *place(b)) for a, b in pairs] + [(1, *place(1), *place(2))], "grid_id long, ax double, ay double, bx double, by double")
    ends = lambda k: F.struct(F.col(f"{k}x").alias("x"), F.col(f"{k}y").alias("y"))
    lines = {}
    for r in network.merged(s.select("grid_id", ends("a").alias("a"), ends("b").alias("b")), ["grid_id"]).orderBy("place").collect():
        lines.setdefault((r["grid_id"], r["line"]), []).append(int(r["node"]["x"]))
    assert sorted(lines.values()) == sorted([[1, 2, 3], [5, 6, 7, 5], [10, 11], [11, 12], [11, 13], list(range(20, 61)), [1, 2]])


def test_ridge_and_quantiles(spark):
    df = spark.range(200).select((F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"), (F.col("id") % 4).alias("fold"))
    df = df.withColumn("y", 3 * F.col("a") - 2 * F.col("b") + 7)
    fitted = kernels.ridge(df, ["a", "b"], "y", 0.0, "fold")
    assert fitted["coefficients"]["a"] == pytest.approx(3) and fitted["intercept"] == pytest.approx(7)
    assert max(fitted["fold_mse"].values()) < 1e-9
    listed = F.array(*[F.lit(x) for x in (4, 1, 3, 2)])
    assert value(spark, stats.nearest_rank(listed, 0.5)) == 3 and value(spark, stats.floor_median(listed)) == 3
    assert value(spark, stats.normalised_entropy(F.array(F.lit(1.0), F.lit(1.0)))) == pytest.approx(1)


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "a.geojsonseq").write_text('\x1e{"type":"Feature","properties":{"name":"x"},"geometry":{"type":"Point","coordinates":[1,2]}}\n\x1e\n\x1enot json\n')
    found = readers.geojson_sequence(spark, str(tmp_path / "a.geojsonseq"), "name string").collect()
    assert [tuple(r) for r in found] == [("x", "Point", "[1,2]")]
    assert paged(spark) == [(at, at + k, f"f{at + k}") for at in (0, 3, 6) for k in range(3 if at < 6 else 1)]
    (tmp_path / "c.csv").write_text("id,kind\n1,keep\n2,drop\n")
    assert readers.csv_rows(spark, str(tmp_path / "c.csv"), "id int, kind string", F.col("kind") == "keep").count() == 1
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, p string")
    assert sinks.artifact(df, str(tmp_path), "x")[0] == sinks.artifact(df.orderBy(F.desc("k")).coalesce(1), str(tmp_path), "x")[0]
    sinks.replace_partitions(df, str(tmp_path / "t"), "p")
    sinks.replace_partitions(spark.createDataFrame([(7, "a")], "k int, p string"), str(tmp_path / "t"), "p")
    assert sorted((r["k"], r["p"]) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [(2, "b"), (7, "a")]


def paged(spark):
    """All rows of a local feature service with seven features in pages of three."""
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from urllib.parse import parse_qs, urlparse

    class Service(BaseHTTPRequestHandler):
        def do_GET(self):
            asked = {k: int(v[0]) for k, v in parse_qs(urlparse(self.path).query).items()}
            features = [{"id": k, "name": f"f{k}", "properties": {"deep": [k]}, "attributes": {"share": k / 2}} for k in range(7)][asked["offset"] :][: asked["limit"]]
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"features": features}).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        spark.dataSource.register(readers.PagedSource)
        url = f"http://127.0.0.1:{server.server_port}/?offset={{offset}}&limit={{limit}}"
        read = lambda size, lanes, kind, **more: sorted(map(tuple, spark.read.format("paged_features").schema(kind).options(url=url, pageSize=size, lanes=lanes, **more).load().collect()), key=repr)
        # Until a short page, whether the last one is short, full or empty, by one lane or more than there are pages.
        for size, lanes in (("3", "1"), ("3", "2"), ("7", "2"), ("1", "3"), ("100", "8")):
            assert [r[0] for r in read(size, lanes, "id long")] == list(range(7))
        assert read("4", "2", "id int, deep string, share double, gone boolean", total="4") == [(k, f'[{k}]', k / 2, None) for k in range(4)]
        return sorted(map(tuple, spark.read.format("paged_features").options(url=url, pageSize="3", total="7").load().collect()))
    finally:
        server.shutdown()


def test_streams(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = sessions.event_stream(spark, str(tmp_path / "in"), events.schema)
    counted = sessions.windowed_counts(stream, "event_type", "ts", "1 day", "60 days")
    q = counted.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) from counts").first()[0] == events.count()
    merged = sessions.upsert_batches(stream, str(tmp_path / "out"), ["user_id"], str(tmp_path / "ck"))
    merged.awaitTermination()
    kept = sessions.latest_batch(spark, str(tmp_path / "out"), events.schema)
    newest = distinct_on(events, ["user_id"], [F.desc("ts"), F.desc("event_id")])
    assert sorted(map(tuple, kept.select("user_id", "event_id").collect())) == sorted(map(tuple, newest.select("user_id", "event_id").collect()))
    batch = sessions.sessions(events, "user_id", "ts", "30 minutes", "1 hour")
    assert batch.agg(F.sum("n")).first()[0] == events.count()


def test_a_part_is_rewritten_only_by_batches_with_its_keys(spark, tmp_path):
    kind = "user_id long, event_id long, ts timestamp_ntz"
    for number, users in enumerate(([1, 2, 3, None], [1], [1], [1], [2, 9])):
        rows = spark.createDataFrame([(u, 10 * number, None) for u in users], kind).withColumn("ts", F.lit(f"2024-01-0{number + 1}").cast("timestamp_ntz"))
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = sessions.event_stream(spark, str(tmp_path / "in"), rows.schema)
        sessions.upsert_batches(stream, str(tmp_path / "out"), ["user_id"], str(tmp_path / "ck"), buckets=512).awaitTermination()
    kept = sessions.latest_batch(spark, str(tmp_path / "out"), rows.schema)
    assert {r["user_id"]: r["event_id"] for r in kept.collect()} == {1: 30, 2: 40, 3: 0, None: 0, 9: 40}
    assert sorted(sorted(numbers) for numbers in sessions._parts(spark, str(tmp_path / "out")).values()) == [[0], [0], [0, 4], [2, 3], [4]]
    assert sessions.latest_batch(spark, str(tmp_path / "none"), rows.schema).count() == 0


def test_phases_end_at_lost_rows(spark, tmp_path):
    df = spark.range(40)
    part = (F.col("id") % 4).cast("int")
    with pytest.raises(ValueError, match="lost or added"):
        state.run_phases(df, str(tmp_path / "a"), [("thin", lambda d: d.where("id <> 7"))], part, 4)
    seen = [state.run_phases(df, str(tmp_path / "b"), [("one", lambda d: d), ("two", lambda d: d)], part, 6, 5) for _ in range(3)]
    assert seen == ["one", "two", "complete"] and spark.read.parquet(str(tmp_path / "b" / "two")).count() == 40


def test_phases_may_lose_or_add_rows_by_rule(spark, tmp_path):
    df, part = spark.range(40), (F.col("id") % 4).cast("int")
    phases = [("thin", lambda d: d.where("id <> 7"), "fewer"), ("spread", lambda d: d.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))), "more"), ("kept", lambda d: d)]
    assert state.run_phases(df, str(tmp_path), phases, part, 4) == "complete"
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 78
    with pytest.raises(ValueError, match="lost or added"):
        state.run_phases(df, str(tmp_path / "b"), [("grown", phases[1][1], "fewer")], part, 4)


def test_one_run_holds_a_name(spark, tmp_path):
    folder = str(tmp_path)
    with state.single_flight(spark, folder, "x") as first, state.single_flight(spark, folder, "x") as second, state.single_flight(spark, folder, "y") as other:
        assert (first, second, other) == (True, False, True)
    with state.single_flight(spark, folder, "x") as again:
        assert again
    # Two drivers see the same lost claim; one gets it, and the lost one neither holds it nor ends the other's hold.
    lost, one, two, late = (state.Flight(spark, folder, "z", -1) for _ in range(4))
    assert lost.take(lost.next_number())
    seen = one.next_number(), two.next_number(), late.next_number()
    assert (one.take(seen[0]), two.take(seen[1])) == (True, False)
    assert one.holds() and not lost.holds()
    lost.release()
    assert one.holds() and not one.fs.exists(one._file(one.number, "done"))
    # The name goes on twice before the last of those that saw the lost claim tries for its number.
    one.release()
    assert two.take(two.next_number()) and two.holds()
    assert not late.take(seen[2]) and two.holds()


def test_a_hold_is_renewed_while_its_run_works(spark, tmp_path):
    import time

    with state.single_flight(spark, str(tmp_path), "x", stale_minutes=0.02) as first:
        time.sleep(2.5)
        with state.single_flight(spark, str(tmp_path), "x", stale_minutes=0.02) as second:
            assert (first, second) == (True, False)


def test_null_keys_are_equal_everywhere(spark):
    old = spark.createDataFrame([(None, 1), (1, 1)], "k int, v int")
    new = spark.createDataFrame([(None, 2), (2, 2)], "k int, v int")
    pairs = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert pairs(state.upsert(old, new, ["k"])) == [(1, 1), (2, 2), (None, 2)]
    assert pairs(state.insert_missing(old, new, ["k"])) == [(1, 1), (2, 2), (None, 1)]
    assert pairs(state.changed_rows(old, old, ["k"], ["v"])) == [] and pairs(state.changed_rows(old, new, ["k"], ["v"])) == [(2, 2), (None, 2)]
    assert pairs(relational.update_from(old, new, ["k"], ["v"])) == [(1, 1), (None, 2)]


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


RINGS = "id int, a array<array<struct<x:double,y:double>>>, b array<array<struct<x:double,y:double>>>"


def test_shapes_of_shapes(spark):
    """Concave shapes with holes, slanted edges, shared edges, touching corners, equal, disjoint, null and empty shapes."""
    star = ring((0, 0), (4, 1), (8, 0), (7, 4), (8, 8), (4, 7), (0, 8), (1, 4))
    frame = [ring((2, 2), (6, 2), (6, 6), (2, 6)), ring((3, 3), (3, 5), (5, 5), (5, 3))]
    slanted = [ring((-1, 3.3), (9, 2.1), (9, 5.7), (-1, 6.2))]
    box = lambda x, y: [ring((x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1))]
    cases = [([star], frame), ([star], slanted), (frame, slanted), (box(0, 0), box(1, 0)), (box(0, 0), box(1, 1)), (frame, frame), (box(0, 0), box(5, 5)), (frame, None), (frame, [])]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], RINGS)
    areas = {r["id"]: (r["own"], r["both"]) for r in df.select("id", overlay.shape_area(F.col("a")).alias("own"), F.when(F.size("b") > 0, overlay.shared_area(F.col("a"), F.col("b"))).otherwise(0.0).alias("both")).collect()}
    named = lambda out: {r["id"]: r for r in out.collect()}
    shared, rest = named(shapes.intersection(df, ["id"], "a", "b", 4.0)), named(shapes.difference(df, ["id"], "a", "b", 4.0))
    for k, (own, both) in areas.items():
        assert shared[k]["area"] == pytest.approx(both, abs=1e-5) if both > 1e-9 else k not in shared
        assert rest[k]["area"] == pytest.approx(own - both, abs=1e-5) if own - both > 1e-9 else k not in rest
    joined = named(shapes.union(df.select("id", F.explode(F.array("a", "b")).alias("rings")), ["id"], 4.0))
    assert [len(joined[k]["rings"]) for k in (3, 4, 5, 6)] == [1, 2, 2, 2] and joined[3]["area"] == pytest.approx(2)
    assert len(joined[3]["rings"][0]) == 4
    for r in [*shared.values(), *rest.values(), *joined.values()]:
        for way in r["rings"]:
            places = [(p["x"], p["y"]) for p in way]
            assert len(places) >= 3 and len(set(places)) == len(places)


def test_shortest_lines(spark):
    rows = [(ring((0, 0), (10, 0)), ring((3, 4), (3, 9))), (ring((0, 0), (10, 0)), ring((4, -1), (6, 1))), (ring((0, 0), (1, 1), (2, 0)), ring((5, 5), (8, 1))), (ring((0, 0)), ring((1, 1), (2, 2)))]
    df = spark.createDataFrame(rows, "a array<struct<x:double,y:double>>, b array<struct<x:double,y:double>>")
    found = [r[0] and [(p["x"], p["y"]) for p in r[0]] for r in df.select(lines.shortest(F.col("a"), F.col("b"))).collect()]
    assert found[0] == [(3, 0), (3, 4)] and found[1] == [(5, 0), (5, 0)] and found[3] is None
    along = [(1 + t / 500, 1 - t / 500) for t in range(501)], [(5 + 3 * t / 500, 5 - 4 * t / 500) for t in range(501)]
    assert math.dist(*found[2]) == pytest.approx(min(math.dist(p, q) for p in along[0] for q in along[1]), abs=0.01)


def test_buffers_and_valid_shapes(spark):
    line = spark.createDataFrame([(1, ring((0, 0), (10, 0))), (2, ring((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))), (3, ring((5, 5))), (4, [])], "id int, line array<struct<x:double,y:double>>")
    found = {r["id"]: r for r in shapes.buffered(line, ["id"], "line", 1.0, 8.0).collect()}
    round_ = 16 * np.sin(np.pi / 16)  # of 32 edges
    assert found[1]["area"] == pytest.approx(20 + round_, abs=1e-5) and found[3]["area"] == pytest.approx(round_, abs=1e-5)
    assert len(found[2]["rings"]) == 2 and found[2]["area"] == pytest.approx(36 - 4 + round_ - 4, abs=1e-5)
    assert set(found) == {1, 2, 3}
    bow = spark.createDataFrame([(1, [ring((0, 0), (2, 2), (2, 0), (0, 2))])], "id int, rings array<array<struct<x:double,y:double>>>")
    made = shapes.made_valid(bow, ["id"], 4.0).first()
    assert len(made["rings"]) == 2 and made["area"] == pytest.approx(2)
    # The part around the origin, with its hole, and nothing behind the wall; an origin in a wall has none.
    walls = spark.createDataFrame([([ring((2, -9), (3, -9), (3, 9), (2, 9))],), ([ring((-3, -1), (-2, -1), (-2, 1), (-3, 1))],)], "rings array<array<struct<x:double,y:double>>>")
    origins = spark.createDataFrame([(1, 0.0, 0.0), (2, 2.5, 0.0)], "id int, x double, y double")
    kept = shapes.barrier_buffer(origins, ["id"], walls, 6.0, 8.0).collect()
    assert [r["id"] for r in kept] == [1] and len(kept[0]["rings"]) == 2
    assert max(p["x"] for p in kept[0]["rings"][0]) == pytest.approx(2)


@pytest.mark.parametrize("small", [None, 0])
def test_quantiles_and_ranks_of_one_key(spark, small):
    """One key with all rows and nearly all values distinct, by windows and by range partitions."""
    values = [(k * 7919) % 1009 + (k % 3) / 7 for k in range(2000)]
    df = spark.createDataFrame([(None, v) for v in values] + [("a", 1.0), ("b", None)], "k string, v double").repartition(5)
    found = {r["k"]: (r["low"], r["high"]) for r in ranks.percentiles(df, ["k"], "v", {"low": 0.3, "high": 0.77}, small).collect()}
    assert found == {None: (pytest.approx(np.quantile(values, 0.3)), pytest.approx(np.quantile(values, 0.77))), "a": (1.0, 1.0)}
    placed = {r["v"]: r["r"] for r in ranks.average_ranks(df, "v", "r", ["k"], small).where("k is null").collect()}
    assert all(placed[v] == sum(x < v for x in values) + (values.count(v) + 1) / 2 for v in values[:50])


def test_running_totals_are_spread(spark):
    """Range partitions hold about as many rows each, though one key has all of them."""
    df = spark.range(4000).select(F.lit(1).alias("k"), F.xxhash64("id").alias("v"), F.lit(1).cast("long").alias("one"))
    found = ranks.running(df, ["k"], ["v"], {"one": "run"}, 0)
    assert sorted(r["run"] for r in found.collect()) == list(range(1, 4001))
    sizes = [r["count"] for r in df.repartitionByRange(4, "k", "v").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2000


def test_archives_and_answers(spark):
    made = readers.zipped(spark.createDataFrame([("a.zip", "m", "text"), ("b.zip", "n", None)], "path string, member string, text string"))
    broken = spark.createDataFrame([("c.zip", bytearray(b"no archive")), ("d.zip", None)], "path string, content binary")
    found = readers.zip_members(made.unionByName(broken))
    assert {(r["path"], r["member"], r["size"], r["error"] is None) for r in found.collect()} == {("a.zip", "m", 4, True), ("b.zip", "n", 0, True), ("c.zip", None, None, False), ("d.zip", None, None, False)}
    small = {(r["member"], r["content"] is None) for r in readers.zip_members(made, most=3).collect()}
    assert small == {("m", True), ("n", False)}
    told = spark.createDataFrame([("m", "0"), ("gone", "1")], "member string, sha256 string")
    assert sorted(r["verdict"] for r in readers.verified(found, told).collect()) == ["changed", "missing", "unlisted", "unreadable", "unreadable"]
    asked = spark.createDataFrame([("data:,yes",), ("file:///nowhere/at/all",), ("no address",), (None,)], "url string")
    answers = [r["answer"] for r in readers.fetched(asked, "url").collect()]
    assert [(a["status"], a["body"], a["error"] is None) for a in answers] == [(200, "yes", True), (None, None, False), (None, None, False), (None, None, True)]


def test_uploads_are_tried_again(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    seen = []

    class Service(BaseHTTPRequestHandler):
        def do_POST(self):
            rows = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            first = self.headers["Idempotency-Key"] not in [k for k, _ in seen]
            seen.append((self.headers["Idempotency-Key"], rows))
            self.send_response(503 if first and rows[0]["id"] == 0 else 200)
            self.end_headers()

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        batches = sinks.payloads(spark.range(25), ["id"], "id", 4, F.col("id") % 3)
        sent = sinks.uploaded(batches, f"http://127.0.0.1:{server.server_port}/").collect()
    finally:
        server.shutdown()
    assert sum(r["n"] for r in sent) == 25 and {r["status"] for r in sent} == {200} and max(r["tries"] for r in sent) == 2
    assert sorted(row["id"] for row in {k: rows for k, rows in seen}.values() for row in row) == list(range(25))


def test_shared_areas_of_any_polygons(spark):
    """Against sums over fine strips, for stars and triangles, one of them with a hole."""
    import math
    import random

    def star(n, cx, cy, near, far):
        return [(cx + (far if k % 2 else near) * math.cos(math.pi * k / n), cy + (far if k % 2 else near) * math.sin(math.pi * k / n)) for k in range(2 * n)]

    def spans(rings, y):
        cuts = sorted(p[0] + (y - p[1]) / (q[1] - p[1]) * (q[0] - p[0]) for ring in rings for p, q in zip(ring, ring[1:] + ring[:1]) if (p[1] > y) != (q[1] > y))
        return list(zip(cuts[::2], cuts[1::2]))

    def strips(a, b, n=20000, low=-10.0, high=10.0):
        step, total = (high - low) / n, 0.0
        for k in range(n):
            y = low + (k + 0.5) * step
            total += sum(max(0.0, min(p[1], q[1]) - max(p[0], q[0])) for p in spans(a, y) for q in spans(b, y)) * step
        return total

    rng = random.Random(3)
    pairs = []
    for k in range(6):
        a = [star(5, rng.uniform(-1, 1), rng.uniform(-1, 1), 1.5, 5)]
        centre = rng.uniform(-2, 2), rng.uniform(-2, 2)
        b = [star(3 + k, *centre, 2, 6)]
        if k % 2:
            b.append(star(3, *centre, 0.4, 0.9)[::-1])
        pairs.append((a, b))
    to_rows = lambda rings: [[{"x": x, "y": y} for x, y in ring] for ring in rings]
    kind = "array<array<struct<x:double,y:double>>>"
    df = spark.createDataFrame([(k, to_rows(a), to_rows(b)) for k, (a, b) in enumerate(pairs)] + [(6, [], to_rows(pairs[0][1])), (7, None, to_rows(pairs[0][1]))], f"k int, a {kind}, b {kind}")
    found = [r[0] for r in df.orderBy("k").select(overlay.shared_area(F.col("a"), F.col("b"))).collect()]
    assert found[:6] == pytest.approx([strips(a, b) for a, b in pairs], abs=2e-3) and found[6:] == [0.0, None]
    swapped = [r[0] for r in df.where("k < 6").orderBy("k").select(overlay.shared_area(F.col("b"), F.col("a"))).collect()]
    assert swapped == pytest.approx(found[:6])


def test_entry_without_the_training_package(tmp_path):
    import shutil

    for name in ("lodestrata", "__spark_entry__.py"):
        copy = shutil.copytree if (ROOT / name).is_dir() else shutil.copy
        copy(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "lodestrata" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(n.startswith('op') for n in q), len(q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
