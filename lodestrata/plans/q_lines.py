"""Queries for line referencing, rings, projections and expressions with their own null rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import geo
from lodestrata.functions import lines as L
from lodestrata.functions import vocabulary as V

from .catalog import query
from .tables import table

#: A staircase of length 16, so that fractions of it are exact.
STAIRS = ((0, 0), (4, 0), (4, 4), (12, 4))


def _stairs():
    return F.array(*[L.point(F.lit(x), F.lit(y)) for x, y in STAIRS])


def _supplier_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_nationkey", F.struct("s_suppkey", (F.col("s_suppkey") % 17).cast("double").alias("x"), (F.col("s_suppkey") * 7 % 13).cast("double").alias("y")).alias("p"))
    return rows.groupBy("s_nationkey").agg(F.array_sort(F.collect_list("p")).alias("p")).select("s_nationkey", F.transform("p", lambda p: L.point(p["x"], p["y"])).alias("line"))


@query(
    "G10_line_points",
    """WITH p AS (SELECT s_nationkey, list(CAST(s_suppkey % 17 AS DOUBLE) ORDER BY s_suppkey) AS x, list(CAST(s_suppkey * 7 % 13 AS DOUBLE) ORDER BY s_suppkey) AS y FROM supplier GROUP BY s_nationkey)
SELECT s_nationkey, CAST(len(x) AS INTEGER) AS n_points, x[1] AS start_x, y[-1] AS end_y, x[1] + 0.5 AS moved_x, y[-1] * 2 AS scaled_y, list_min(x) - 1 AS xmin, list_max(y) + 1 AS ymax, x[1] = x[-1] AND y[1] = y[-1] AS closed,
'LINESTRING(' || array_to_string(list_transform(range(1, len(x) + 1), lambda k: x[k] || ' ' || y[k]), ',') || ')' AS wkt FROM p""",
)
def line_points(spark, sf_dir):
    line = F.col("line")
    box = L.envelope(line, 1.0)
    moved, scaled = L.translate(line, 0.5, 0.0), L.scale(line, 1.0, 2.0)
    return _supplier_lines(spark, sf_dir).select(
        "s_nationkey", F.size(line).alias("n_points"), F.element_at(line, 1)["x"].alias("start_x"), F.element_at(line, -1)["y"].alias("end_y"), F.element_at(moved, 1)["x"].alias("moved_x"),
        F.element_at(scaled, -1)["y"].alias("scaled_y"), box["xmin"].alias("xmin"), box["ymax"].alias("ymax"), L.is_closed(line).alias("closed"), L.as_text(line).alias("wkt"),
    )


@query(
    "G10_line_locate",
    """WITH s(k, x1, y1, x2, y2, before) AS (VALUES (1, 0.0::DOUBLE, 0.0::DOUBLE, 4.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE), (2, 4.0, 0.0, 4.0, 4.0, 4.0), (3, 4.0, 4.0, 12.0, 4.0, 8.0)),
q AS (SELECT p_partkey, CAST(p_size % 15 AS DOUBLE) AS x, CAST(p_partkey % 9 AS DOUBLE) AS y FROM part),
c AS (SELECT p_partkey, k, x, y, least(greatest(x, x1), x2) AS nx, least(greatest(y, y1), y2) AS ny, x1, y1, before FROM q, s),
d AS (SELECT *, sqrt((x - nx) * (x - nx) + (y - ny) * (y - ny)) AS distance FROM c)
SELECT p_partkey, nx AS near_x, ny AS near_y, distance, (before + abs(nx - x1) + abs(ny - y1)) / 16 AS fraction, nx AS back_x, ny AS back_y FROM d QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY distance, k) = 1""",
)
def line_locate(spark, sf_dir):
    asked = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 15).cast("double").alias("x"), (F.col("p_partkey") % 9).cast("double").alias("y"))
    found = asked.withColumn("at", L.locate(_stairs(), F.col("x"), F.col("y"))).withColumn("back", L.interpolate(_stairs(), F.col("at.fraction")))
    return found.select("p_partkey", F.col("at.x").alias("near_x"), F.col("at.y").alias("near_y"), F.col("at.distance").alias("distance"), F.col("at.fraction").alias("fraction"), F.col("back.x").alias("back_x"), F.col("back.y").alias("back_y"))


@query(
    "G10_line_substring",
    """SELECT p_partkey, CAST(2 + (CASE WHEN 4 > a AND 4 < b THEN 1 ELSE 0 END) + (CASE WHEN 8 > a AND 8 < b THEN 1 ELSE 0 END) AS INTEGER) AS n_points, CAST(b - a AS DOUBLE) AS length,
CAST(CASE WHEN b <= 4 THEN b WHEN b <= 8 THEN 4 ELSE b - 4 END AS DOUBLE) AS end_x FROM (SELECT p_partkey, p_partkey % 8 AS a, p_partkey % 8 + 1 + p_size % 8 AS b FROM part)""",
)
def line_substring(spark, sf_dir):
    low = F.col("p_partkey") % 8
    cut = L.substring(_stairs(), low / 16, (low + 1 + F.col("p_size") % 8) / 16)
    rows = table(spark, sf_dir, "part").select("p_partkey", cut.alias("line"))
    return rows.select("p_partkey", F.size("line").alias("n_points"), geo.line_length(F.col("line")).alias("length"), F.element_at("line", -1)["x"].alias("end_x"))


@query(
    "G10_simplify_snap_hausdorff",
    """SELECT p_partkey, CAST(CASE WHEN a > 2 THEN 3 ELSE 2 END AS INTEGER) AS n_left, CAST(CASE WHEN a > 2 THEN 0 ELSE least(sqrt(16 + a * a), 8) END AS DOUBLE) AS hausdorff, CASE WHEN abs(a - 3) <= 1 THEN 3.0::DOUBLE ELSE CAST(a AS DOUBLE) END AS snapped_y, CAST(0.25 * 0 + 0.75 * a AS DOUBLE) AS cut_y
FROM (SELECT p_partkey, p_size % 6 AS a FROM part)""",
)
def simplify_snap(spark, sf_dir):
    p = lambda x, y: L.point(F.lit(x) if not isinstance(x, F.Column) else x, F.lit(y) if not isinstance(y, F.Column) else y)
    rows = table(spark, sf_dir, "part").select("p_partkey", F.array(p(0, 0), p(4, F.col("p_size") % 6), p(8, 0)).alias("line"))
    rows = rows.withColumn("left", L.simplify(F.col("line"), 2.0))
    snapped = L.snap(F.col("line"), F.array(p(4, 3)), 1.0)
    return rows.select("p_partkey", F.size("left").alias("n_left"), L.hausdorff(F.col("line"), F.col("left")).alias("hausdorff"), F.element_at(snapped, 2)["y"].alias("snapped_y"), F.element_at(geo.chaikin(F.col("line")), 2)["y"].alias("cut_y"))


@query(
    "G10_line_is_simple",
    """SELECT p_partkey, y < 2 OR (x = 0 AND y = 2) AS simple FROM (SELECT p_partkey, p_size % 4 AS x, p_partkey % 5 AS y FROM part)""",
)
def line_simple(spark, sf_dir):
    """Along the top, down, back and up: the last segment stays below the first, meets it, or closes the line at its start."""
    x, y = F.col("p_size") % 4, F.col("p_partkey") % 5
    line = F.array(L.point(F.lit(0), F.lit(2)), L.point(F.lit(4), F.lit(2)), L.point(F.lit(9), F.lit(-1)), L.point(x, F.lit(-1)), L.point(x, y))
    return table(spark, sf_dir, "part").select("p_partkey", L.is_simple(line).alias("simple"))


@query(
    "G08_rings",
    """SELECT p_partkey, x + w / 2 AS centre_x, y + h / 2 AS centre_y, w * h AS area, x + w / 2 AS inner_x, true AS holds, greatest(0, least(x + w, 20) - greatest(x, 10)) * h / (w * h) AS share, CAST(5 AS INTEGER) AS n_around
FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS x, CAST(p_partkey % 50 AS DOUBLE) AS y, CAST(4 * (1 + p_partkey % 4) AS DOUBLE) AS w, CAST(2 * (1 + p_size % 3) AS DOUBLE) AS h FROM part)""",
)
def rings(spark, sf_dir):
    x, y = F.col("p_size").cast("double"), (F.col("p_partkey") % 50).cast("double")
    w, h = (4 * (1 + F.col("p_partkey") % 4)).cast("double"), (2 * (1 + F.col("p_size") % 3)).cast("double")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.array(L.point(x, y), L.point(x + w, y), L.point(x + w, y + h), L.point(x, y + h)).alias("ring"))
    ring = F.col("ring")
    rows = rows.select("*", L.centroid(ring).alias("centre"), L.point_on_surface(ring).alias("inner"))
    return rows.select(
        "p_partkey", F.col("centre.x").alias("centre_x"), F.col("centre.y").alias("centre_y"), geo.ring_area(ring).alias("area"), F.col("inner.x").alias("inner_x"),
        geo.in_ring(F.col("inner.x"), F.col("inner.y"), ring).alias("holds"), L.ring_share(ring, 10, -1000, 20, 1000).alias("share"), F.size(L.boundary(ring)).alias("n_around"),
    )


@query(
    "G15_lambert",
    """WITH c AS (SELECT radians(33) AS p1, radians(45) AS p2, radians(39) AS p0), n AS (SELECT *, ln(cos(p1) / cos(p2)) / ln(tan(pi() / 4 + p2 / 2) / tan(pi() / 4 + p1 / 2)) AS n FROM c),
f AS (SELECT *, cos(p1) * tan(pi() / 4 + p1 / 2) ** n / n AS f FROM n)
SELECT event_id, round(6370000 * f / tan(pi() / 4 + radians(30 + user_id % 20) / 2) ** n * sin(n * radians(value / 10)), 2) AS easting, round(6370000 * f / tan(pi() / 4 + p0 / 2) ** n - 6370000 * f / tan(pi() / 4 + radians(30 + user_id % 20) / 2) ** n * cos(n * radians(value / 10)), 2) AS northing FROM events, f""",
)
def lambert(spark, sf_dir):
    east, north = geo.lambert(30 + F.col("user_id") % 20, F.col("value") / 10 - 96, 33, 45, 39, -96, 6_370_000.0, 0.0)
    return table(spark, sf_dir, "events").select("event_id", F.round(east, 2).alias("easting"), F.round(north, 2).alias("northing"))


@query(
    "S05_geojson_round_trip",
    """SELECT s_nationkey, count(*)::INTEGER AS n_points, sum(CAST(s_suppkey % 17 AS DOUBLE)) AS sum_x FROM supplier GROUP BY s_nationkey""",
)
def geojson(spark, sf_dir):
    back = _supplier_lines(spark, sf_dir).select("s_nationkey", L.from_geojson(L.as_geojson(F.col("line"))).alias("line"))
    return back.select("s_nationkey", F.size("line").alias("n_points"), F.aggregate("line", F.lit(0.0), lambda a, p: a + p["x"]).alias("sum_x"))


@query(
    "V01_null_rules",
    r"""SELECT c_custkey, concat(nullif(c_mktsegment, 'BUILDING'), '-', c_nationkey) AS joined, regexp_replace(c_name, '0+', '_') AS first_only, nullif(list_extract(regexp_extract_all(c_name, '[0-9]'), 2), '') AS second_digit, nullif(len(list_filter([c_nationkey, c_nationkey + 1], lambda v: v < 20)), 0)::INTEGER AS n_low,
list_position(['AUTOMOBILE', 'BUILDING', 'MACHINERY'], c_mktsegment)::BIGINT AS place, array_to_string(string_split(replace(c_mktsegment, 'U', '.'), '.'), '/') AS pieces FROM customer""",
)
def null_rules(spark, sf_dir):
    segment, name, nation = F.col("c_mktsegment"), F.col("c_name"), F.col("c_nationkey")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", V.concat_present(F.nullif(segment, F.lit("BUILDING")), F.lit("-"), nation.cast("string")).alias("joined"), V.replace_first(name, "0+", "_").alias("first_only"), V.nth_match(name, "[0-9]", 2).alias("second_digit"),
        V.array_length(F.filter(F.array(nation, nation + 1), lambda v: v < 20)).alias("n_low"), V.position_in(F.array(*map(F.lit, ("AUTOMOBILE", "BUILDING", "MACHINERY"))), segment).alias("place"),
        F.array_join(V.literal_split(F.replace(segment, F.lit("U"), F.lit(".")), "."), "/").alias("pieces"),
    )


@query(
    "V02_json_and_arrays",
    """SELECT c_custkey, '{' || CASE WHEN c_acctbal > 0 THEN '"k":' || c_nationkey || ',' ELSE '' END || '"s":"' || c_mktsegment || '"}' AS stripped, array_to_string(list_transform([c_mktsegment, 'x'], lambda v: CASE WHEN v = 'x' THEN 'y' ELSE v END), ',') AS replaced,
CAST(round(CAST(CAST(c_acctbal AS VARCHAR) AS DECIMAL(38,12)), 1) AS DOUBLE) AS rounded FROM customer""",
)
def json_arrays(spark, sf_dir):
    record = F.struct(F.when(F.col("c_acctbal") > 0, F.col("c_nationkey")).alias("k"), F.col("c_mktsegment").alias("s"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", V.strip_nulls(record).alias("stripped"), F.array_join(V.array_replace(F.array("c_mktsegment", F.lit("x")), F.lit("x"), F.lit("y")), ",").alias("replaced"),
        V.round_half_up(F.col("c_acctbal"), 1).cast("double").alias("rounded"),
    )
