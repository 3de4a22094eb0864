"""Queries for projections, predicates, joins, aggregation, windows, ordering, set operations and recursion."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrata.operators import relational as R
from lodestrata.operators.ranks import percentiles

from .catalog import query
from .tables import table

MONEY = "decimal(18,4)"
AS_OF = "1998-12-31"


def money(column):
    return F.col(column).cast(MONEY)


@query(
    "order_revenue_summary",
    """SELECT l_returnflag, l_linestatus, count(*) AS n_items, CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS sum_qty,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS sum_price, max(l_shipdate) AS last_ship
    FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
def order_revenue_summary(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    return items.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n_items"), F.sum(money("l_quantity")).cast("double").alias("sum_qty"), F.sum(money("l_extendedprice")).cast("double").alias("sum_price"), F.max("l_shipdate").alias("last_ship")
    )


@query(
    "P01_P02_P03_P05_projection_case_between",
    """SELECT o_orderkey, CASE WHEN o_totalprice >= 300000 THEN 'large' WHEN o_totalprice BETWEEN 100000 AND 299999.99 THEN 'medium' ELSE 'small' END AS size_class,
    o_orderpriority IN ('1-URGENT', '2-HIGH') AS is_urgent, false AS future_award_assertion_authorized
    FROM orders WHERE o_totalprice BETWEEN 50000 AND 400000""",
)
def p01(spark, sf_dir):
    """Also P16: guardrail constants stay in the output."""
    price = F.col("o_totalprice")
    size = F.when(price >= 300000, "large").when(price.between(100000, 299999.99), "medium").otherwise("small")
    urgent = F.array_contains(F.array(F.lit("1-URGENT"), F.lit("2-HIGH")), F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").where(price.between(50000, 400000)).select("o_orderkey", size.alias("size_class"), urgent.alias("is_urgent"), F.lit(False).alias("future_award_assertion_authorized"))


@query(
    "P04_distinct_from",
    """SELECT a.event_id, b.event_id AS next_id, a.event_type IS DISTINCT FROM b.event_type AS differs
    FROM events a LEFT JOIN events b ON b.event_id = a.event_id + 1""",
)
def p04(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    after = events.select(F.col("event_id").alias("next_id"), F.col("event_type").alias("next_type"))
    return events.join(after, F.col("next_id") == F.col("event_id") + 1, "left").select("event_id", "next_id", (~F.col("event_type").eqNullSafe(F.col("next_type"))).alias("differs"))


@query(
    "P06_P07_array_containment_overlap",
    """WITH t AS (SELECT user_id, list_sort(list_distinct(list(event_type))) AS kinds FROM events GROUP BY user_id)
    SELECT user_id, len(kinds) AS n_kinds, list_has_all(kinds, ['click', 'view']) AS has_all, list_has_any(kinds, ['error', 'purchase']) AS has_any FROM t""",
)
def p06(spark, sf_dir):
    kinds = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("kinds"))
    wanted, either = F.array(F.lit("click"), F.lit("view")), F.array(F.lit("error"), F.lit("purchase"))
    return kinds.select("user_id", F.size("kinds").cast("long").alias("n_kinds"), (F.size(F.array_except(wanted, "kinds")) == 0).alias("has_all"), F.arrays_overlap("kinds", either).alias("has_any"))


@query(
    "P08_P09_json_keys",
    """SELECT event_id, json_extract(props, '$.k') IS NOT NULL AS has_k, json_extract(props, '$.absent') IS NOT NULL AS has_absent,
    TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, list_contains(json_keys(props), 'k') AND NOT list_contains(json_keys(props), 'z') AS only_k,
    TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) = 7 AS holds_k7 FROM events""",
)
def p08(spark, sf_dir):
    value = F.try_variant_get(F.parse_json("props"), "$.k", "bigint")
    keys = F.json_object_keys("props")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.get_json_object("props", "$.k").isNotNull().alias("has_k"),
        F.get_json_object("props", "$.absent").isNotNull().alias("has_absent"),
        value.alias("k"),
        (F.array_contains(keys, "k") & ~F.array_contains(keys, "z")).alias("only_k"),
        (value == 7).alias("holds_k7"),
    )


@query(
    "P10_P11_like_regex",
    r"""SELECT p_partkey, p_name LIKE '%a%' AS like_a, p_type ILIKE '%brass%' AS ilike_brass, regexp_matches(p_brand, '^Brand#[1-3][0-9]$') AS brand_low,
    regexp_matches(p_type, '(?i)\b(tin|steel)\b') AS metal, NOT regexp_matches(p_name, '[0-9]') AS no_digit FROM part""",
)
def p10(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.col("p_name").like("%a%").alias("like_a"),
        F.col("p_type").ilike("%brass%").alias("ilike_brass"),
        F.col("p_brand").rlike("^Brand#[1-3][0-9]$").alias("brand_low"),
        F.col("p_type").rlike(r"(?i)\b(tin|steel)\b").alias("metal"),
        (~F.col("p_name").rlike("[0-9]")).alias("no_digit"),
    )


@query(
    "P12_J11_exists_flag",
    """SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS has_finished FROM customer""",
)
def p12(spark, sf_dir):
    finished = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return R.exists_flag(table(spark, sf_dir, "customer").select("c_custkey"), finished, ["c_custkey"], "has_finished")


@query(
    "P13_P14_optional_filters",
    """SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '5-LOW') ORDER BY o_orderkey LIMIT 100""",
)
def p13(spark, sf_dir):
    chosen = R.optional_filters(table(spark, sf_dir, "orders"), o_orderstatus="O", o_orderpriority=["1-URGENT", "5-LOW"], o_custkey=None)
    return chosen.select("o_orderkey", "o_orderstatus", "o_orderpriority").orderBy("o_orderkey").limit(R.clamp(5000))


@query(
    "P15_safe_casts",
    r"""SELECT event_id, TRY_CAST(nullif(regexp_replace(props, '[^0-9.]', '', 'g'), '') AS DOUBLE) AS number, TRY_CAST(event_type AS BIGINT) AS never,
    TRY_CAST(substr(CAST(ts AS VARCHAR), 1, 10) AS DATE) AS day FROM events""",
)
def p15(spark, sf_dir):
    digits = F.nullif(F.regexp_replace("props", "[^0-9.]", ""), F.lit(""))
    return table(spark, sf_dir, "events").select("event_id", digits.try_cast("double").alias("number"), F.col("event_type").try_cast("bigint").alias("never"), F.substring(F.col("ts").cast("string"), 1, 10).try_cast("date").alias("day"))


@query(
    "J01_J02_J03_J05_joins",
    """SELECT n_name, r_name, c_mktsegment, count(*) AS n_customers, count(o_orderkey) AS n_orders FROM customer
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 100000 AND o_orderdate >= TIMESTAMP '1995-01-01'
    GROUP BY n_name, r_name, c_mktsegment""",
)
def j01(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    nations = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    regions = table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    recent = (F.col("o_totalprice") > 100000) & (F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp_ntz"))
    joined = customers.join(nations, ["c_nationkey"]).join(regions, ["n_regionkey"]).join(table(spark, sf_dir, "orders"), (F.col("o_custkey") == F.col("c_custkey")) & recent, "left")
    return joined.groupBy("n_name", "r_name", "c_mktsegment").agg(F.count("*").alias("n_customers"), F.count("o_orderkey").alias("n_orders"))


@query(
    "J04_null_safe_join",
    """WITH a AS (SELECT event_id, nullif(event_type, 'view') AS kind FROM events), b AS (SELECT kind, count(*) AS n FROM a GROUP BY kind)
    SELECT a.event_id, b.n FROM a JOIN b ON a.kind IS NOT DISTINCT FROM b.kind""",
)
def j04(spark, sf_dir):
    a = table(spark, sf_dir, "events").select("event_id", F.nullif(F.col("event_type"), F.lit("view")).alias("kind"))
    b = a.groupBy(F.col("kind").alias("of")).agg(F.count("*").alias("n"))
    return a.join(b, F.col("kind").eqNullSafe(F.col("of"))).select("event_id", "n")


@query(
    "J06_C01_cross_single_row",
    """SELECT p_partkey, p_size > (SELECT avg(p_size) FROM part) AS above_mean, (SELECT max(p_size) FROM part) - p_size AS below_max FROM part""",
)
def j06(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    whole = parts.agg(F.avg("p_size").alias("mean"), F.max("p_size").alias("most"))  # one row, whatever the table's size
    return parts.crossJoin(F.broadcast(whole)).select("p_partkey", (F.col("p_size") > F.col("mean")).alias("above_mean"), (F.col("most") - F.col("p_size")).alias("below_max"))


@query(
    "J07_lateral_top1",
    """SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey, o_totalprice,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) t ON o_custkey = c_custkey AND rn = 1""",
)
def j07(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    return R.lateral_top1(table(spark, sf_dir, "customer").select("c_custkey"), orders, ["c_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")])


@query(
    "J08_C02_lateral_aggregate",
    """SELECT s_suppkey, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 40) AS n_large,
    (SELECT max(l_shipdate) FROM lineitem WHERE l_suppkey = s_suppkey) AS last_ship FROM supplier""",
)
def j08(spark, sf_dir):
    per = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count_if(F.col("l_quantity") > 40).alias("n"), F.max("l_shipdate").alias("last_ship"))
    return table(spark, sf_dir, "supplier").select("s_suppkey").join(per, "s_suppkey", "left").select("s_suppkey", F.coalesce("n", F.lit(0)).alias("n_large"), "last_ship")


@query(
    "J09_J21_S20_unnest",
    """WITH w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, generate_subscripts(string_split(p_name, ' '), 1) AS place FROM part)
    SELECT word, count(*) AS n, min(place) AS first_place, count(DISTINCT p_partkey) AS n_parts FROM w GROUP BY word""",
)
def j09(spark, sf_dir):
    words = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("at", "word"))
    return words.groupBy("word").agg(F.count("*").alias("n"), (F.min("at") + 1).cast("long").alias("first_place"), F.count_distinct("p_partkey").alias("n_parts"))


@query(
    "J10_lateral_scalar_call",
    """SELECT p_partkey, greatest(1, least(coalesce(p_size, 10), 20)) AS clamped, CASE WHEN p_retailprice > 0 THEN floor(ln(p_retailprice)) END AS magnitude FROM part""",
)
def j10(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.greatest(F.lit(1), F.least(F.coalesce("p_size", F.lit(10)), F.lit(20))).alias("clamped"), F.when(F.col("p_retailprice") > 0, F.floor(F.log("p_retailprice"))).cast("double").alias("magnitude"))


@query("J12_anti", """SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)""")
def j12(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return R.suppress(table(spark, sf_dir, "customer").select("c_custkey"), (orders, ["c_custkey"]))


@query(
    "J16_asof",
    """SELECT a.event_id, b.ts AS asof_ts, b.value AS asof_value FROM events a LEFT JOIN LATERAL (
    SELECT ts, value FROM events e WHERE e.user_id = a.user_id AND e.event_type = 'error' AND e.ts < a.ts ORDER BY ts DESC, event_id DESC LIMIT 1) b ON true""",
)
def j16(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    errors = events.where("event_type = 'error'").select("user_id", "event_id", "ts", "value")
    found = R.asof_join(events.select("user_id", "event_id", "ts"), errors, ["user_id"], "ts", "ts", ["value"], tie="event_id", strict=True)
    return found.select("event_id", "asof_ts", "asof_value")


@query(
    "J16_asof_by_period",
    """SELECT event_id, max(CASE WHEN event_type = 'click' THEN ts END) OVER w AS asof_ts FROM events WINDOW w AS (PARTITION BY event_id % 3 ORDER BY ts, CASE WHEN event_type = 'click' THEN 0 ELSE 1 END RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def j16_period(spark, sf_dir):
    """Three keys hold the whole table, so each is dealt by day."""
    events = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 3).alias("k"), "event_type", "ts")
    clicks = events.where("event_type = 'click'")
    return R.asof_join(events, clicks, ["k"], "ts", "ts", [], tie="event_id", period="day").select("event_id", "asof_ts")


@query(
    "J17_validity_join",
    """SELECT o.o_orderkey, count(l.l_linenumber) AS n_open FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey
    AND l.l_shipdate >= o.o_orderdate AND l.l_shipdate < o.o_orderdate + INTERVAL 60 DAY GROUP BY o.o_orderkey""",
)
def j17(spark, sf_dir):
    within = (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_shipdate") >= F.col("o_orderdate")) & (F.col("l_shipdate") < F.col("o_orderdate") + F.expr("interval 60 days"))
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), within, "left").groupBy("o_orderkey").agg(F.count("l_linenumber").alias("n_open"))


@query(
    "J18_S19_range_expansion",
    """WITH r AS (SELECT p_partkey, p_partkey * 3 AS low, p_partkey * 3 + p_size % 5 - 1 AS high FROM part),
    m AS (SELECT p_partkey, unnest(generate_series(low, high)) AS member FROM r) SELECT m.p_partkey, m.member, o_orderstatus FROM m JOIN orders ON o_orderkey = member""",
)
def j18(spark, sf_dir):
    ranges = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 3).alias("low"), (F.col("p_partkey") * 3 + F.col("p_size") % 5 - 1).alias("high"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("member"), "o_orderstatus")
    return R.expand_range(ranges, "low", "high", "member").join(orders, "member").select("p_partkey", "member", "o_orderstatus")


@query(
    "J19_A11_W01_rank_pivot",
    """WITH t AS (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders)
    SELECT o_custkey, max(o_totalprice) FILTER (WHERE rank = 1) AS best, max(o_totalprice) FILTER (WHERE rank = 2) AS second,
    max(o_totalprice) FILTER (WHERE rank = 1) - coalesce(max(o_totalprice) FILTER (WHERE rank = 2), 0) AS margin FROM t WHERE rank <= 2 GROUP BY o_custkey""",
)
def j19(spark, sf_dir):
    top = R.top_n(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 2)
    return R.rank_pivot(top, ["o_custkey"], "rank", "o_totalprice", ["best", "second"]).withColumn("margin", F.col("best") - F.coalesce("second", F.lit(0)))


@query(
    "J20_regex_join",
    r"""WITH p(family, pattern) AS (VALUES ('secret', 'token = "[0-9a-f]+"'), ('mail', '[a-z0-9.]+@[a-z0-9.]+'), ('rate', '[0-9]+%'))
    SELECT doc_id, family FROM documents JOIN p ON regexp_matches(text, pattern)""",
)
def j20(spark, sf_dir):
    """Also S18: an inline relation."""
    patterns = spark.createDataFrame([("secret", 'token = "[0-9a-f]+"'), ("mail", "[a-z0-9.]+@[a-z0-9.]+"), ("rate", "[0-9]+%")], "family string, pattern string")
    return R.regex_join(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", patterns, "pattern").select("doc_id", "family")


@query(
    "J22_update_from",
    """SELECT c_custkey, CASE WHEN n IS NOT NULL THEN 'buyer' ELSE c_mktsegment END AS c_mktsegment FROM customer
    LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 15) ON o_custkey = c_custkey""",
)
def j22(spark, sf_dir):
    buyers = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n")).where("n >= 15").select("c_custkey", F.lit("buyer").alias("c_mktsegment"))
    return R.update_from(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), buyers, ["c_custkey"], ["c_mktsegment"])


@query(
    "A01_A03_A04_A05_A07_aggregates",
    """SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users, count(*) FILTER (WHERE value > 50) AS n_high, bool_or(value > 99) AS any_top, bool_and(value >= 0) AS all_positive,
    min(value) AS least, max(value) AS most, CAST(sum(CAST(value AS DECIMAL(18,4))) FILTER (WHERE value > 50) AS DOUBLE) AS sum_high FROM events GROUP BY event_type""",
)
def a01(spark, sf_dir):
    high = F.col("value") > 50
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users"), F.count_if(high).alias("n_high"), F.bool_or(F.col("value") > 99).alias("any_top"),
        F.bool_and(F.col("value") >= 0).alias("all_positive"), F.min("value").alias("least"), F.max("value").alias("most"), F.sum(F.when(high, money("value"))).cast("double").alias("sum_high"),
    )


@query("A02_global_aggregate", """SELECT count(*) AS n, count(DISTINCT o_custkey) AS n_customers, min(o_orderdate) AS first_order, max(o_orderdate) AS last_order FROM orders""")
def a02(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("n_customers"), F.min("o_orderdate").alias("first_order"), F.max("o_orderdate").alias("last_order"))


@query(
    "A06_percentiles",
    """SELECT o_orderpriority, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY o_totalprice), 4) AS p25, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY o_totalprice), 4) AS p50,
    round(percentile_cont(0.9) WITHIN GROUP (ORDER BY o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 4) AS p90_finished FROM orders GROUP BY o_orderpriority""",
)
def a06(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    found = percentiles(orders, ["o_orderpriority"], "o_totalprice", {"p25": 0.25, "p50": 0.5})
    finished = percentiles(orders.where("o_orderstatus = 'F'"), ["o_orderpriority"], "o_totalprice", {"p90_finished": 0.9})
    return found.join(finished, "o_orderpriority", "left").select("o_orderpriority", *[F.round(c, 4).alias(c) for c in ("p25", "p50", "p90_finished")])


@query(
    "A08_A09_A10_A12_A13_ordered_lists",
    """SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities, list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey)[1] AS dearest,
    string_agg(CAST(o_orderkey AS VARCHAR), '|' ORDER BY o_orderdate, o_orderkey) AS history, '{"n":' || count(*) || '}' AS summary FROM orders GROUP BY o_custkey HAVING count(*) >= 5""",
)
def a08(spark, sf_dir):
    by_price = F.struct(F.col("o_totalprice"), -F.col("o_orderkey"))
    ordered = F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey")))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("priorities"),
        F.max_by("o_orderkey", by_price).alias("dearest"),
        F.array_join(F.transform(ordered, lambda x: x["o_orderkey"].cast("string")), "|").alias("history"),
        F.to_json(F.struct(F.count("*").alias("n"))).alias("summary"),
    ).where(F.size(F.split("history", "\\|")) >= 5)


@query(
    "A14_two_level",
    """SELECT n_orders, count(*) AS n_customers FROM (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey) GROUP BY n_orders""",
)
def a14(spark, sf_dir):
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_orders"))
    return per.groupBy("n_orders").agg(F.count("*").alias("n_customers"))


@query(
    "A15_horizon_sums",
    """WITH e AS (SELECT *, (SELECT max(ts) FROM events) AS as_of FROM events) SELECT user_id,
    CAST(sum(CAST(value AS DECIMAL(18,4))) FILTER (WHERE ts > as_of - INTERVAL 1 DAY) AS DOUBLE) AS sum_1d, CAST(sum(CAST(value AS DECIMAL(18,4))) FILTER (WHERE ts > as_of - INTERVAL 7 DAY) AS DOUBLE) AS sum_7d,
    CAST(sum(CAST(value AS DECIMAL(18,4))) FILTER (WHERE ts > as_of - INTERVAL 30 DAY) AS DOUBLE) AS sum_30d FROM e GROUP BY user_id""",
)
def a15(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    as_of = str(events.agg(F.max("ts")).first()[0])
    found = R.conditional_sums(events, ["user_id"], "ts", as_of, [1, 7, 30], money("value"))
    return found.select("user_id", *[F.col(f"sum_{n}d").cast("double").alias(f"sum_{n}d") for n in (1, 7, 30)])


@query(
    "A16_modal",
    """WITH t AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
    SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rn FROM t) WHERE rn = 1""",
)
def a16(spark, sf_dir):
    return R.modal(table(spark, sf_dir, "events"), ["user_id"], "event_type")


@query(
    "A17_extent",
    """SELECT n_regionkey, min(n_nationkey) AS xmin, max(n_nationkey) AS xmax, min(length(n_name)) AS ymin, max(length(n_name)) AS ymax, count(*) AS n FROM nation GROUP BY n_regionkey""",
)
def a17(spark, sf_dir):
    x, y = F.col("n_nationkey"), F.length("n_name").cast("long")
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.min(x).alias("xmin"), F.max(x).alias("xmax"), F.min(y).alias("ymin"), F.max(y).alias("ymax"), F.count("*").alias("n"))


@query(
    "A18_M12_unlock_rank",
    """WITH t AS (SELECT c_nationkey, c_mktsegment, count(*) AS assets FROM customer GROUP BY ALL)
    SELECT c_nationkey, c_mktsegment, CASE WHEN assets - 1 >= 5 AND (SELECT count(*) FROM t u WHERE u.c_nationkey = t.c_nationkey) >= 2 THEN 2 WHEN assets - 1 >= 2 THEN 1 ELSE 0 END AS unlock FROM t""",
)
def a18(spark, sf_dir):
    per = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("assets"))
    kinds = F.count("*").over(Window.partitionBy("c_nationkey"))
    others = F.col("assets") - 1
    return per.select("c_nationkey", "c_mktsegment", F.when((others >= 5) & (kinds >= 2), 2).when(others >= 2, 1).otherwise(0).alias("unlock"))


@query(
    "W02_W03_W04_W05_windows",
    """SELECT event_id, date_diff('second', lag(ts) OVER w, ts) AS gap_s, lead(event_type) OVER w AS next_type, count(*) OVER (PARTITION BY user_id) AS n_user,
    max(value) FILTER (WHERE event_type = 'purchase') OVER (PARTITION BY user_id) AS top_purchase FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def w02(spark, sf_dir):
    w, whole = Window.partitionBy("user_id").orderBy("ts", "event_id"), Window.partitionBy("user_id")
    seconds = lambda c: F.unix_timestamp(F.date_trunc("second", c).cast("timestamp"))
    return table(spark, sf_dir, "events").select(
        "event_id", (seconds(F.col("ts")) - F.lag(seconds(F.col("ts"))).over(w)).alias("gap_s"), F.lead("event_type").over(w).alias("next_type"),
        F.count("*").over(whole).alias("n_user"), F.max(F.when(F.col("event_type") == "purchase", F.col("value"))).over(whole).alias("top_purchase"),
    )


@query(
    "W06_W07_islands",
    """WITH c AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run_id FROM c)
    SELECT user_id, run_id, min(event_type) AS kind, count(*) AS n, min(ts) AS since, max(ts) AS until FROM r GROUP BY user_id, run_id""",
)
def w06(spark, sf_dir):
    runs = R.islands(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    return runs.groupBy("user_id", "run_id").agg(F.min("event_type").alias("kind"), F.count("*").alias("n"), F.min("ts").alias("since"), F.max("ts").alias("until"))


@query(
    "O01_O02_O09_order_limit",
    """SELECT event_id, event_type, v FROM (SELECT *, nullif(round(value), 50) AS v FROM events) ORDER BY event_type DESC, v DESC NULLS LAST, event_id LIMIT 250""",
)
def o01(spark, sf_dir):
    rounded = table(spark, sf_dir, "events").withColumn("v", F.nullif(F.round("value"), F.lit(50.0)))
    return rounded.orderBy(F.desc("event_type"), F.desc_nulls_last("v"), F.asc("event_id")).limit(250).select("event_id", "event_type", "v")


@query("O03_distinct_on", """SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderdate FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey DESC""")
def o03(spark, sf_dir):
    return R.distinct_on(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderdate")


@query("O04_distinct", """SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders""")
def o04(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@query("O05_caller_order", """SELECT n_nationkey, n_name, list_position([7, 3, 21, 0], n_nationkey) AS position FROM nation WHERE n_nationkey IN (7, 3, 21, 0)""")
def o05(spark, sf_dir):
    return R.caller_order(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey", [7, 3, 21, 0])


@query(
    "O06_over_fetch",
    """SELECT o_orderkey, o_totalprice, o_orderdate FROM (SELECT * FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 60) WHERE o_orderstatus <> 'P' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20)""",
)
def o06(spark, sf_dir):
    chosen = R.over_fetch(table(spark, sf_dir, "orders"), [F.desc("o_totalprice"), F.asc("o_orderkey")], F.col("o_orderstatus") != "P", [F.desc("o_orderdate"), F.asc("o_orderkey")], 20)
    return chosen.select("o_orderkey", "o_totalprice", "o_orderdate")


@query("O07_O08_keyset_page", """SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 50""")
def o07(spark, sf_dir):
    return R.keyset_page(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 1000, 50)


@query(
    "U01_U02_U03_U04_set_operations",
    """(SELECT 'all' AS op, k FROM (SELECT s_nationkey AS k FROM supplier UNION ALL SELECT c_nationkey FROM customer)) UNION ALL (SELECT 'distinct', k FROM (SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer))
    UNION ALL (SELECT 'except', k FROM (SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier)) UNION ALL (SELECT 'intersect', k FROM (SELECT n_nationkey AS k FROM nation INTERSECT SELECT s_nationkey FROM supplier))""",
)
def u01(spark, sf_dir):
    s, c, n = (table(spark, sf_dir, t).select(F.col(k).alias("k")) for t, k in (("supplier", "s_nationkey"), ("customer", "c_nationkey"), ("nation", "n_nationkey")))
    named = lambda df, op: df.select(F.lit(op).alias("op"), "k")
    return named(s.unionByName(c), "all").unionByName(named(s.union(c).distinct(), "distinct")).unionByName(named(n.subtract(s), "except")).unionByName(named(n.intersect(s), "intersect"))


@query(
    "C03_C04_cte_chain",
    """WITH spend AS (SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS total FROM orders GROUP BY o_custkey), ranked AS (SELECT *, row_number() OVER (ORDER BY total DESC, o_custkey) AS place FROM spend)
    SELECT o_custkey, total, place FROM ranked WHERE place <= 100""",
)
def c03(spark, sf_dir):
    spend = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum(money("o_totalprice")).cast("double").alias("total"))
    best = spend.orderBy(F.desc("total"), F.asc("o_custkey")).limit(100)  # top-k in each task first; the window then sees 100 rows
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("total"), F.asc("o_custkey"))).cast("long"))


@query(
    "C05_C06_recursive_closure",
    """WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 2 + 1) % 25 AS b FROM nation), w(root, node, depth) AS (SELECT a, b, 1 FROM e UNION SELECT root, b, depth + 1 FROM w JOIN e ON node = a WHERE depth < 30)
    SELECT root, node, min(depth) AS depth FROM w GROUP BY root, node""",
)
def c05(spark, sf_dir):
    edges = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("a"), ((F.col("n_nationkey") * 2 + 1) % 25).alias("b"))
    return R.recursive_closure(edges, "a", "b")


@query(
    "C05_recursive_cycles",
    """WITH RECURSIVE e(a, b) AS (SELECT n_nationkey, n_nationkey // 2 FROM nation WHERE n_nationkey > 0 UNION SELECT n_nationkey, (n_nationkey + 5) % 25 FROM nation WHERE n_regionkey = 0), w(root, node, path) AS (SELECT a, b, [a, b] FROM e UNION ALL SELECT root, b, list_append(path, b) FROM w JOIN e ON node = a WHERE NOT list_contains(path[2:], node) OR node <> root AND list_position(path, node) = len(path))
    SELECT DISTINCT root FROM w WHERE node = root""",
)
def c05_cycles(spark, sf_dir):
    """Nodes on a cycle, by the engine's own recursive query."""
    n, key = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    edges = n.where("n_nationkey > 0").select(key.alias("a"), F.floor(key / 2).alias("b")).union(n.where("n_regionkey = 0").select(key.alias("a"), ((key + 5) % 25).alias("b"))).distinct()
    return spark.sql("""
      WITH RECURSIVE e AS (SELECT * FROM {edges}),
      w(root, node, path) AS (
        SELECT a, b, array(b) FROM e
        UNION ALL
        SELECT root, b, array_append(path, b) FROM w JOIN e ON node = a WHERE node <> root AND NOT array_contains(path, b))
      SELECT DISTINCT root FROM w WHERE node = root""", edges=edges)


@query("C07_array_subquery", """SELECT n_regionkey, array_to_string(list_sort(list(n_name)), ',') AS names FROM nation GROUP BY n_regionkey""")
def c07(spark, sf_dir):
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names"))
