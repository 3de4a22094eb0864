"""Queries for cadence, statistics, scoring and rule evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrata.operators import cadence as C
from lodestrata.operators import ranks
from lodestrata.operators import rules as K
from lodestrata.operators import stats as S

from .catalog import query
from .tables import table

AS_OF = "1998-09-01"

_CADENCE = """WITH d AS (SELECT DISTINCT o_custkey, o_orderpriority, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderdate IS NOT NULL),
g AS (SELECT *, date_diff('day', lag(day) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY day), day) AS gap, CAST((month(day) + 2) % 12 // 3 + 1 AS INTEGER) AS quarter FROM d),
s AS (SELECT o_custkey, o_orderpriority, count(*) AS n_events, min(day) AS first_day, max(day) AS last_day, percentile_cont(0.25) WITHIN GROUP (ORDER BY gap) FILTER (WHERE gap > 0) AS p25,
 percentile_cont(0.5) WITHIN GROUP (ORDER BY gap) FILTER (WHERE gap > 0) AS p50, percentile_cont(0.75) WITHIN GROUP (ORDER BY gap) FILTER (WHERE gap > 0) AS p75 FROM g GROUP BY ALL),
q AS (SELECT o_custkey, o_orderpriority, quarter, count(*) AS n FROM g GROUP BY ALL), p AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY n DESC, quarter) = 1),
t AS (SELECT s.*, p.quarter AS peak_quarter, p.n AS peak_n, CAST(date_diff('day', first_day, last_day) AS INTEGER) AS history_days FROM s JOIN p USING (o_custkey, o_orderpriority)),
c AS (SELECT *, CASE WHEN n_events >= 5 AND history_days >= 365 THEN 'high' WHEN n_events >= 3 AND history_days >= 120 THEN 'medium' WHEN n_events >= 2 THEN 'low' ELSE 'insufficient' END AS confidence,
 CASE WHEN p50 IS NULL OR p50 <= 0 THEN 'unknown' WHEN (coalesce(p75, p50) - coalesce(p25, p50)) / p50 <= 0.35 THEN 'regular' WHEN (coalesce(p75, p50) - coalesce(p25, p50)) / p50 <= 0.8 THEN 'moderately_variable' ELSE 'highly_variable' END AS variability,
 round(peak_n / n_events, 3) AS peak_share, n_events >= 3 AND history_days >= 120 AND p50 > 0 AS ok FROM t),
w AS (SELECT * EXCLUDE (ok), CASE WHEN ok THEN last_day + CAST(greatest(1, floor(p50 + 0.5)) AS INTEGER) END AS projected_center, CASE WHEN ok AND p25 > 0 THEN last_day + CAST(greatest(1, floor(p25)) AS INTEGER) END AS projected_early,
 CASE WHEN ok AND p75 > 0 THEN last_day + CAST(greatest(1, ceil(p75)) AS INTEGER) END AS projected_late FROM c)"""


@query("R01_cadence", _CADENCE + " SELECT * FROM w")
def r01(spark, sf_dir):
    return C.cadence(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"], "o_orderdate")


@query(
    "R03_roll_forward",
    _CADENCE
    + f""", r AS (SELECT *, CASE WHEN projected_center IS NOT NULL THEN greatest(1, CAST(ceil(greatest(0, date_diff('day', last_day, DATE '{AS_OF}')) / p50) AS INTEGER)) END AS cycles FROM w),
r2 AS (SELECT *, CASE WHEN cycles IS NOT NULL THEN last_day + CAST(greatest(1, floor(cycles * p50 + 0.5)) AS INTEGER) END AS rolled_center FROM r),
r3 AS (SELECT *, rolled_center + CAST(floor(coalesce(p25, p50) - p50) AS INTEGER) AS rolled_early, rolled_center + CAST(ceil(coalesce(p75, p50) - p50) AS INTEGER) AS rolled_late FROM r2)
SELECT o_custkey, o_orderpriority, cycles, rolled_center, rolled_early, rolled_late, CASE WHEN rolled_center IS NULL THEN 'not_projected' WHEN DATE '{AS_OF}' BETWEEN rolled_early AND rolled_late THEN 'watch_window_open'
WHEN DATE '{AS_OF}' < rolled_early THEN 'upcoming' ELSE 'elapsed_pending_next_cycle' END AS window_status FROM r3""",
)
def r03(spark, sf_dir):
    rolled = C.roll_forward(C.cadence(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"], "o_orderdate"), AS_OF)
    return rolled.select("o_custkey", "o_orderpriority", "cycles", "rolled_center", "rolled_early", "rolled_late", "window_status")


@query(
    "R02_cadence_by_supplier",
    """WITH d AS (SELECT DISTINCT l_suppkey, CAST(l_shipdate AS DATE) AS day FROM lineitem), g AS (SELECT *, date_diff('day', lag(day) OVER (PARTITION BY l_suppkey ORDER BY day), day) AS gap FROM d)
    SELECT l_suppkey, count(*) AS n_events, percentile_cont(0.5) WITHIN GROUP (ORDER BY gap) AS p50, CAST(date_diff('day', min(day), max(day)) AS INTEGER) AS history_days FROM g GROUP BY l_suppkey""",
)
def r02(spark, sf_dir):
    return C.cadence(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_shipdate").select("l_suppkey", "n_events", "p50", "history_days")


@query(
    "R04_fiscal_quarter",
    r"""SELECT CAST((month(o_orderdate) + 2) % 12 // 3 + 1 AS INTEGER) AS quarter, CASE WHEN regexp_matches(o_orderpriority, '(?i)urgent|high') THEN 'pressing' WHEN regexp_matches(o_orderpriority, '(?i)low') THEN 'idle' ELSE 'usual' END AS scope, count(*) AS n FROM orders GROUP BY ALL""",
)
def r04(spark, sf_dir):
    scope = F.when(F.col("o_orderpriority").rlike("(?i)urgent|high"), "pressing").when(F.col("o_orderpriority").rlike("(?i)low"), "idle").otherwise("usual")
    return table(spark, sf_dir, "orders").groupBy(C.fiscal_quarter(F.col("o_orderdate")).alias("quarter"), scope.alias("scope")).agg(F.count("*").alias("n"))


@query(
    "R11_points",
    """SELECT o_orderkey, CASE WHEN o_totalprice >= 250000 THEN 2 WHEN o_totalprice >= 100000 THEN 1 ELSE 0 END + CASE WHEN date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02') <= 7 THEN 2 WHEN date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02') <= 21 THEN 1 ELSE 0 END
    + CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS points FROM orders WHERE date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02') BETWEEN 0 AND 45""",
)
def r11(spark, sf_dir):
    age = F.datediff(F.lit("1998-08-02").cast("date"), F.col("o_orderdate").cast("date"))
    score = S.banded(F.col("o_totalprice"), (250000, 2), (100000, 1), otherwise=0) + S.banded(-age, (-7, 2), (-21, 1), otherwise=0) + S.points((F.col("o_orderstatus") == "O", 1))
    return table(spark, sf_dir, "orders").where(age.between(0, 45)).select("o_orderkey", score.alias("points"))


@query(
    "R12_cohort_percentile_points",
    """WITH c AS (SELECT c_mktsegment, percentile_cont(0.5) WITHIN GROUP (ORDER BY c_acctbal) AS p50, percentile_cont(0.9) WITHIN GROUP (ORDER BY c_acctbal) AS p90 FROM customer GROUP BY c_mktsegment)
    SELECT c_custkey, CASE WHEN c_acctbal >= p90 THEN 3 WHEN c_acctbal >= p50 THEN 1 ELSE 0 END AS points FROM customer JOIN c USING (c_mktsegment)""",
)
def r12(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    cohort = ranks.percentiles(customers, ["c_mktsegment"], "c_acctbal", {"p50": 0.5, "p90": 0.9})
    balance = F.col("c_acctbal")
    return customers.join(cohort, "c_mktsegment").select("c_custkey", F.when(balance >= F.col("p90"), 3).when(balance >= F.col("p50"), 1).otherwise(0).alias("points"))


@query(
    "R13_feature_matrix",
    """WITH f AS (SELECT c_custkey, count(o_orderkey) FILTER (WHERE o_orderdate < TIMESTAMP '1997-01-01') AS n_before, max(o_totalprice) FILTER (WHERE o_orderdate < TIMESTAMP '1997-01-01') AS top_before,
    count(o_orderkey) FILTER (WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01') AS label_after FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)
    SELECT *, top_before IS NOT NULL AS has_top, round(((n_before > 0)::INT + (top_before IS NOT NULL)::INT) / 2, 3) AS completeness FROM f""",
)
def r13(spark, sf_dir):
    """Features come from before the cut, the label from after it."""
    cut, end = F.lit("1997-01-01").cast("timestamp_ntz"), F.lit("1998-01-01").cast("timestamp_ntz")
    before, after = F.col("o_orderdate") < cut, (F.col("o_orderdate") >= cut) & (F.col("o_orderdate") < end)
    joined = table(spark, sf_dir, "customer").select("c_custkey").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    f = joined.groupBy("c_custkey").agg(F.count(F.when(before, F.col("o_orderkey"))).alias("n_before"), F.max(F.when(before, F.col("o_totalprice"))).alias("top_before"), F.count(F.when(after, F.col("o_orderkey"))).alias("label_after"))
    has = F.col("top_before").isNotNull()
    return f.select("*", has.alias("has_top"), F.round(((F.col("n_before") > 0).cast("int") + has.cast("int")) / 2, 3).alias("completeness"))


@query(
    "R14_R15_seasonal_state",
    """WITH last AS (SELECT user_id, event_type, max(ts) AS seen FROM events GROUP BY ALL), s AS (SELECT user_id, event_type, CASE WHEN date_diff('day', CAST(seen AS DATE), DATE '2024-01-28') < 0 THEN 'unavailable' WHEN date_diff('day', CAST(seen AS DATE), DATE '2024-01-28') > 2 THEN 'stale' ELSE 'known' END AS state FROM last)
    SELECT user_id, count(*) FILTER (WHERE state = 'known') AS n_known, count(*) FILTER (WHERE state = 'stale') AS n_stale, CASE WHEN count(*) FILTER (WHERE state = 'known') = 5 THEN 'available' WHEN count(*) FILTER (WHERE state = 'known') > 0 THEN 'partial' ELSE 'unavailable' END AS status FROM s GROUP BY user_id""",
)
def r14(spark, sf_dir):
    last = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("ts").alias("seen"))
    state = K.freshness(F.col("seen").cast("date"), F.lit("2024-01-28").cast("date"), 2, F.lit("known"))
    s = last.select("user_id", state.alias("state"))
    known = F.count_if(F.col("state") == "known")
    return s.groupBy("user_id").agg(known.alias("n_known"), F.count_if(F.col("state") == "stale").alias("n_stale")).withColumn("status", F.when(F.col("n_known") == 5, "available").when(F.col("n_known") > 0, "partial").otherwise("unavailable"))


@query(
    "R16_season_counters",
    """SELECT user_id, count(DISTINCT CAST(ts AS DATE)) FILTER (WHERE value >= 38) AS deep_days, count(DISTINCT CAST(ts AS DATE)) FILTER (WHERE value <= 5) AS cold_days, count(DISTINCT CAST(ts AS DATE)) AS days
    FROM events WHERE month(ts) >= 11 OR month(ts) <= 5 GROUP BY user_id""",
)
def r16(spark, sf_dir):
    month, day = F.month("ts"), F.col("ts").cast("date")
    on = lambda test: F.count_distinct(F.when(test, day))
    return table(spark, sf_dir, "events").where((month >= 11) | (month <= 5)).groupBy("user_id").agg(on(F.col("value") >= 38).alias("deep_days"), on(F.col("value") <= 5).alias("cold_days"), F.count_distinct(day).alias("days"))


@query(
    "R17_latest_and_prior",
    """WITH o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE value >= 30 AND ts < TIMESTAMP '2024-01-20')
    SELECT user_id, max(value) FILTER (WHERE rn = 1) AS latest, max(value) FILTER (WHERE rn = 2) AS prior, round(max(value) FILTER (WHERE rn = 1) - max(value) FILTER (WHERE rn = 2), 6) AS delta,
    CASE WHEN count(*) FILTER (WHERE rn <= 2) = 2 THEN 'available' ELSE 'partial' END AS status FROM o GROUP BY user_id""",
)
def r17(spark, sf_dir):
    from lodestrata.operators.relational import rank_pivot, top_n

    usable = table(spark, sf_dir, "events").where((F.col("value") >= 30) & (F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz")))
    two = rank_pivot(top_n(usable, ["user_id"], [F.desc("ts"), F.desc("event_id")], 2), ["user_id"], "rank", "value", ["latest", "prior"])
    return two.select("*", F.round(F.col("latest") - F.col("prior"), 6).alias("delta"), F.when(F.col("prior").isNotNull(), "available").otherwise("partial").alias("status"))


@query(
    "R18_family_rollup",
    """SELECT c_nationkey, bool_or(c_acctbal > 9000) AS any_rich, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS segments, count(*) AS n,
    CASE WHEN count(*) >= 50 AND bool_or(c_acctbal > 9000) THEN 'propagate' WHEN count(*) >= 50 THEN 'review' ELSE 'hold' END AS gate FROM customer GROUP BY c_nationkey""",
)
def r18(spark, sf_dir):
    g = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.bool_or(F.col("c_acctbal") > 9000).alias("any_rich"), F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",").alias("segments"), F.count("*").alias("n"))
    return g.withColumn("gate", F.when((F.col("n") >= 50) & F.col("any_rich"), "propagate").when(F.col("n") >= 50, "review").otherwise("hold"))


@query(
    "R19_T12_routing_quality",
    """WITH w AS (SELECT user_id, event_type, row_number() OVER u AS place, lead(event_type) OVER u AS next_type FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, max(event_type) FILTER (WHERE place = 1) AS first_type, count(*) FILTER (WHERE next_type = event_type) AS loops, count(*) FILTER (WHERE event_type = 'error') AS errors, round(count(*) FILTER (WHERE event_type = 'error') / count(*), 4) AS error_rate FROM w GROUP BY user_id""",
)
def r19(spark, sf_dir):
    return K.session_metrics(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type", "error")


@query(
    "R20_sequence_match",
    """WITH s AS (SELECT user_id, list(event_type ORDER BY ts, event_id) AS seq FROM events GROUP BY user_id), p AS (SELECT user_id, seq, list_position(seq, 'view') AS a FROM s),
    q AS (SELECT *, CASE WHEN a > 0 AND list_position(seq[a+1:], 'click') > 0 THEN a + list_position(seq[a+1:], 'click') END AS b FROM p)
    SELECT user_id, coalesce(b IS NOT NULL AND list_position(seq[b+1:], 'purchase') > 0, false) AS follows, CAST(len(list_filter(range(1, len(seq)), lambda i: seq[i] = seq[i+1])) AS INTEGER) AS repeats FROM q""",
)
def r20(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    follows = K.follows(events, "user_id", ["ts", "event_id"], "event_type", ["view", "click", "purchase"])
    return follows.join(K.repeat_counts(events, "user_id", ["ts", "event_id"], "event_type"), "user_id").select("user_id", "follows", F.col("repeats").cast("int").alias("repeats"))


_RULES = """r(rule, kind, least, state) AS (VALUES ('buys', 'purchase', 12, NULL), ('errs', 'error', 20, NULL), ('looks', 'view', 1, 'blocked'), ('other', 'refund', 1, NULL))"""


@query(
    "R21_R22_rule_evaluator",
    f"""WITH {_RULES}, e AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), u AS (SELECT DISTINCT user_id FROM events)
    SELECT u.user_id, rule, CASE WHEN user_id % 5 = 0 THEN 'not_applicable' WHEN state = 'blocked' THEN 'blocked_measurement_alignment' WHEN n IS NULL THEN 'insufficient_input' WHEN n < least THEN 'not_applicable' ELSE 'active' END AS status,
    CASE WHEN user_id % 5 = 0 THEN 'registry_not_applicable' WHEN state = 'blocked' THEN 'measurement_alignment_blocked' WHEN n IS NULL THEN 'product_input_unavailable' WHEN n < least THEN 'value_constraint_not_satisfied' ELSE 'active' END AS reason
    FROM u CROSS JOIN r LEFT JOIN e USING (user_id) WHERE e.event_type = kind OR e.event_type IS NULL
    UNION ALL SELECT u.user_id, rule, CASE WHEN user_id % 5 = 0 THEN 'not_applicable' WHEN state = 'blocked' THEN 'blocked_measurement_alignment' ELSE 'insufficient_input' END, CASE WHEN user_id % 5 = 0 THEN 'registry_not_applicable' WHEN state = 'blocked' THEN 'measurement_alignment_blocked' ELSE 'product_input_unavailable' END
    FROM u CROSS JOIN r WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.user_id = u.user_id AND e.event_type = kind)""",
)
def r21(spark, sf_dir):
    rules = spark.createDataFrame([("buys", "purchase", 12, None), ("errs", "error", 20, None), ("looks", "view", 1, "blocked"), ("other", "refund", 1, None)], "rule string, kind string, least int, state string")
    events = table(spark, sf_dir, "events")
    evidence = events.groupBy("user_id", F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))
    scenarios = events.select("user_id").distinct()
    gates = [
        (F.col("user_id") % 5 == 0, "not_applicable", "registry_not_applicable"),
        (F.col("state") == "blocked", "blocked_measurement_alignment", "measurement_alignment_blocked"),
        (F.col("n").isNull(), "insufficient_input", "product_input_unavailable"),
        (F.col("n") < F.col("least"), "not_applicable", "value_constraint_not_satisfied"),
    ]
    return K.evaluate(scenarios, rules, evidence, ["user_id"], "kind", gates).select("user_id", "rule", "status", "reason")


@query(
    "R09_R10_classifier_gates",
    """SELECT p_partkey, service, state FROM (SELECT p_partkey, 'polish' AS service, CASE WHEN p_type LIKE '%POLISHED%' THEN 'supported' WHEN p_type LIKE '%BRUSHED%' THEN 'investigate' ELSE 'insufficient' END AS state FROM part
    UNION ALL SELECT p_partkey, 'plate', CASE WHEN p_type LIKE '%PLATED%' AND p_size > 20 THEN 'supported' WHEN p_type LIKE '%PLATED%' THEN 'investigate' ELSE 'insufficient' END FROM part)""",
)
def r09(spark, sf_dir):
    kind = F.col("p_type")
    gates = {
        "polish": F.when(kind.like("%POLISHED%"), "supported").when(kind.like("%BRUSHED%"), "investigate").otherwise("insufficient"),
        "plate": F.when(kind.like("%PLATED%") & (F.col("p_size") > 20), "supported").when(kind.like("%PLATED%"), "investigate").otherwise("insufficient"),
    }
    return K.classify(table(spark, sf_dir, "part"), ["p_partkey"], gates)


@query(
    "R23_spearman",
    """WITH r AS (SELECT c_mktsegment, c_acctbal, c_nationkey, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_mktsegment, c_acctbal) - 1) / 2 AS rx,
    rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) - 1) / 2 AS ry FROM customer) SELECT c_mktsegment, round(corr(rx, ry), 6) AS spearman, round(corr(c_acctbal, c_nationkey), 6) AS pearson, count(*) AS n FROM r GROUP BY c_mktsegment""",
)
def r23(spark, sf_dir):
    found = S.spearman(table(spark, sf_dir, "customer"), "c_acctbal", "c_nationkey", ["c_mktsegment"])
    return found.select("c_mktsegment", F.round("spearman", 6).alias("spearman"), F.round("pearson", 6).alias("pearson"), "n")


@query(
    "R24_variance_partition",
    """WITH m AS (SELECT p_size, avg(p_retailprice) AS gm, count(*) AS n FROM part GROUP BY p_size), t AS (SELECT avg(p_retailprice) AS m, count(*) AS n, sum((p_retailprice - (SELECT avg(p_retailprice) FROM part)) ** 2) AS ss FROM part)
    SELECT round(100 * (SELECT sum(m.n * (gm - t.m) ** 2) FROM m) / ss, 4) AS between_pct, round(100 - 100 * (SELECT sum(m.n * (gm - t.m) ** 2) FROM m) / ss, 4) AS within_pct, n FROM t""",
)
def r24(spark, sf_dir):
    return S.variance_partition(table(spark, sf_dir, "part"), "p_retailprice", "p_size").select(F.round("between_pct", 4).alias("between_pct"), F.round("within_pct", 4).alias("within_pct"), "n")


@query(
    "R28_entropy_dominance",
    """WITH c AS (SELECT user_id, list(n ORDER BY event_type) AS w, sum(n) AS t FROM (SELECT user_id, event_type, count(*)::DOUBLE AS n FROM events GROUP BY ALL) GROUP BY user_id)
    SELECT user_id, CASE WHEN len(w) > 1 THEN round(list_sum(list_transform(w, lambda x: -(x / t) * ln(x / t))) / ln(len(w)), 6) ELSE 0 END AS entropy, round(list_max(w) / t, 6) AS dominant FROM c""",
)
def r28(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").cast("double").alias("n"))
    shares = counts.groupBy("user_id").agg(F.array_sort(F.collect_list("n")).alias("w"))
    return shares.select("user_id", F.round(S.normalised_entropy(F.col("w")), 6).alias("entropy"), F.round(S.dominant_share(F.col("w")), 6).alias("dominant"))


@query(
    "R29_quantile_styles",
    """WITH s AS (SELECT p_brand, list_sort(list(p_retailprice)) AS v FROM part GROUP BY p_brand) SELECT p_brand, v[CAST(floor((len(v) - 1) * 0.9 + 0.5) AS INTEGER) + 1] AS nearest_p90, v[len(v) // 2 + 1] AS floor_median FROM s""",
)
def r29(spark, sf_dir):
    n = F.col("n")
    wanted = {"nearest_p90": F.floor((n - 1) * 0.9 + 0.5), "floor_median": F.floor(n / 2)}
    return ranks.at_ranks(table(spark, sf_dir, "part"), ["p_brand"], "p_retailprice", wanted)


@query(
    "R30_quintile_agreement",
    """WITH r AS (SELECT p_brand, p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2 AS a, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2 AS b, count(*) OVER (PARTITION BY p_brand) AS n FROM part),
    g AS (SELECT p_brand, least(4, floor((a - 0.5) * 5 / n)) AS ga, least(4, floor((b - 0.5) * 5 / n)) AS gb FROM r)
    SELECT p_brand, count(*) FILTER (WHERE ga = gb) AS agree, count(*) AS n, round(2 * count(*) FILTER (WHERE ga = 4 AND gb = 4) / nullif(count(*) FILTER (WHERE ga = 4) + count(*) FILTER (WHERE gb = 4), 0), 6) AS dice_top FROM g GROUP BY p_brand""",
)
def r30(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size", "p_retailprice")
    both = S.quantile_groups(S.quantile_groups(parts, "p_size", 5, "ga", ["p_brand"]), "p_retailprice", 5, "gb", ["p_brand"])
    top_a, top_b = F.col("ga") == 4, F.col("gb") == 4
    dice = 2 * F.count_if(top_a & top_b) / F.nullif(F.count_if(top_a) + F.count_if(top_b), F.lit(0))
    return both.groupBy("p_brand").agg(F.count_if(F.col("ga") == F.col("gb")).alias("agree"), F.count("*").alias("n"), F.round(dice, 6).alias("dice_top"))


@query(
    "R31_histogram",
    """SELECT event_type, CAST(greatest(0, least(9, floor((value - 0) / 10))) AS INTEGER) AS bin, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL""",
)
def r31(spark, sf_dir):
    return S.histogram(table(spark, sf_dir, "events"), "value", 0.0, 100.0, 10, ["event_type"])


@query(
    "G19_weighted_quantile",
    """WITH b AS (SELECT p_brand, p_size, sum(p_partkey % 7 + 1) AS w FROM part GROUP BY ALL), r AS (SELECT *, sum(w) OVER (PARTITION BY p_brand ORDER BY p_size ROWS UNBOUNDED PRECEDING) AS run, sum(w) OVER (PARTITION BY p_brand) AS t FROM b)
    SELECT p_brand, min(p_size) AS median_size FROM r WHERE run >= t * 0.5 GROUP BY p_brand""",
)
def g19(spark, sf_dir):
    return S.weighted_quantile(table(spark, sf_dir, "part").withColumn("w", F.col("p_partkey") % 7 + 1), ["p_brand"], "p_size", "w", 0.5, "median_size")


@query(
    "X30_robust_scale",
    """WITH q AS (SELECT quantile_cont(p_retailprice, 0.02) AS lo, quantile_cont(p_retailprice, 0.98) AS hi FROM part) SELECT p_partkey, round(greatest(0, least(1, (p_retailprice - lo) / (hi - lo))), 6) AS scaled FROM part, q""",
)
def x30(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    q = ranks.percentiles(parts, [], "p_retailprice", {"lo": 0.02, "hi": 0.98})
    return parts.crossJoin(F.broadcast(q)).select("p_partkey", F.round(S.robust_scale(F.col("p_retailprice"), F.col("lo"), F.col("hi")), 6).alias("scaled"))
