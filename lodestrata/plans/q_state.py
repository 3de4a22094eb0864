"""Queries for upserts, queues, freshness and identities."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestrata.operators import state as S
from lodestrata.operators.relational import checkpointed, shared_folder
from lodestrata.sources import sinks

from .catalog import query
from .tables import table


def base_and_delta(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return orders.where("o_orderpriority <> '3-MEDIUM'"), orders.where("o_orderstatus <> 'F'").withColumn("o_orderstatus", F.lit("X")).withColumn("o_totalprice", F.col("o_totalprice") - 100000)


_SPLIT = """b AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderpriority <> '3-MEDIUM'), d AS (SELECT o_orderkey, 'X' AS o_orderstatus, o_totalprice - 100000 AS o_totalprice FROM orders WHERE o_orderstatus <> 'F')"""


@query("K01_upsert", f"""WITH {_SPLIT} SELECT * FROM d UNION ALL SELECT * FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM d)""")
def k01(spark, sf_dir):
    old, new = base_and_delta(spark, sf_dir)
    return S.upsert(old, new, ["o_orderkey"])


@query("K01_insert_missing", f"""WITH {_SPLIT} SELECT * FROM b UNION ALL SELECT * FROM d WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b)""")
def k01_missing(spark, sf_dir):
    old, new = base_and_delta(spark, sf_dir)
    return S.insert_missing(old, new, ["o_orderkey"])


@query("K02_conditional_upsert", f"""WITH {_SPLIT} SELECT coalesce(d.o_orderkey, b.o_orderkey) AS o_orderkey, coalesce(d.o_orderstatus, b.o_orderstatus) AS o_orderstatus, greatest(b.o_totalprice, d.o_totalprice) AS o_totalprice FROM b FULL JOIN d ON b.o_orderkey = d.o_orderkey""")
def k02(spark, sf_dir):
    old, new = base_and_delta(spark, sf_dir)
    return S.upsert(old, new, ["o_orderkey"], {"o_totalprice": F.greatest(F.col("old.o_totalprice"), F.col("new.o_totalprice"))})


@query("K03_T04_changed_rows", f"""WITH {_SPLIT}, n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'X' ELSE (SELECT any_value(o_orderstatus) FROM orders o WHERE o.o_orderkey = d.o_orderkey) END AS o_orderstatus FROM d) SELECT n.* FROM n LEFT JOIN b USING (o_orderkey) WHERE n.o_orderstatus IS DISTINCT FROM b.o_orderstatus""")
def k03(spark, sf_dir):
    old, _ = base_and_delta(spark, sf_dir)
    orders = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))
    return S.changed_rows(old, orders, ["o_orderkey"], ["o_orderstatus"])


@query("K05_replace_scope", f"""WITH {_SPLIT} SELECT * FROM b WHERE NOT o_orderkey < 2000 UNION ALL SELECT * FROM d WHERE o_orderkey < 2000""")
def k05(spark, sf_dir):
    old, new = base_and_delta(spark, sf_dir)
    return S.replace_scope(old, new, F.col("o_orderkey") < 2000)


@query("K04_K06_K07_rebuild_returning", f"""WITH {_SPLIT} SELECT o_orderstatus, count(*) AS n FROM (SELECT * FROM d UNION ALL SELECT * FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM d)) GROUP BY o_orderstatus""")
def k04(spark, sf_dir):
    """Rebuild a table, write it whole, and summarise what was written."""
    old, new = base_and_delta(spark, sf_dir)
    return checkpointed(S.upsert(old, new, ["o_orderkey"])).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


_QUEUE = """q AS (SELECT event_id AS id, CASE WHEN event_type = 'click' THEN 'queued' WHEN event_type = 'view' THEN 'leased' ELSE 'done' END AS state, CAST(user_id % 5 AS INTEGER) AS priority, CAST(event_id % 4 AS INTEGER) AS attempt_count, 3 AS max_attempts,
ts AS created_at, ts + INTERVAL 1 HOUR AS next_attempt_at, CASE WHEN event_type = 'view' THEN ts + INTERVAL 45 MINUTE END AS lease_until FROM events)"""


def queue(spark, sf_dir):
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.when(kind == "click", "queued").when(kind == "view", "leased").otherwise("done").alias("state"), (F.col("user_id") % 5).cast("int").alias("priority"), (F.col("event_id") % 4).cast("int").alias("attempt_count"),
        F.lit(3).alias("max_attempts"), F.col("ts").alias("created_at"), (F.col("ts") + F.expr("interval 1 hour")).alias("next_attempt_at"), F.when(kind == "view", F.col("ts") + F.expr("interval 45 minutes")).alias("lease_until"),
    )


NOW = "2024-01-15 00:00:00"


@query(
    "T02_T03_lease_claim",
    f"""WITH {_QUEUE}, f AS (SELECT * REPLACE (CASE WHEN state = 'leased' AND lease_until < TIMESTAMP '{NOW}' AND attempt_count >= max_attempts THEN 'exhausted' WHEN state = 'leased' AND lease_until < TIMESTAMP '{NOW}' THEN 'queued' ELSE state END AS state) FROM q),
    c AS (SELECT id FROM f WHERE state = 'queued' AND coalesce(next_attempt_at, TIMESTAMP '{NOW}') <= TIMESTAMP '{NOW}' AND attempt_count < max_attempts ORDER BY priority DESC, next_attempt_at NULLS FIRST, created_at, id LIMIT 25)
    SELECT id, c.id IS NOT NULL AS claimed, CASE WHEN c.id IS NOT NULL THEN 'leased' ELSE state END AS state, CASE WHEN c.id IS NOT NULL THEN TIMESTAMP '{NOW}' + INTERVAL 45 MINUTE WHEN state = 'leased' THEN lease_until END AS lease_until, attempt_count + (c.id IS NOT NULL)::INT AS attempt_count FROM f LEFT JOIN c USING (id)""",
)
def t02(spark, sf_dir):
    return S.claim(queue(spark, sf_dir), F.lit(NOW).cast("timestamp_ntz"), 25).select("id", "claimed", "state", "lease_until", "attempt_count")


@query(
    "T03_report_backoff",
    f"""WITH {_QUEUE} SELECT id, CASE WHEN id % 10 > 5 THEN state WHEN id % 10 < 3 THEN 'done' WHEN attempt_count >= max_attempts THEN 'exhausted' ELSE 'queued' END AS state,
    CASE WHEN id % 10 BETWEEN 3 AND 5 AND attempt_count < max_attempts THEN TIMESTAMP '{NOW}' + to_minutes(CAST(5 * pow(2, greatest(0, attempt_count - 1)) AS INTEGER)) ELSE next_attempt_at END AS next_attempt_at FROM q""",
)
def t03(spark, sf_dir):
    jobs = queue(spark, sf_dir)
    results = jobs.where("id % 10 <= 5").select("id", (F.col("id") % 10 < 3).alias("ok"))
    return S.report(jobs, results, F.lit(NOW).cast("timestamp_ntz")).select("id", "state", "next_attempt_at")


@query("T08_T09_expiry_windows", """SELECT event_id, CASE WHEN ts + INTERVAL 5 DAY < TIMESTAMP '2024-01-20' THEN 'expired' ELSE 'active' END AS state, CASE WHEN date_diff('day', CAST(ts AS DATE), DATE '2024-01-20') < 0 THEN 'not_open' WHEN date_diff('day', CAST(ts AS DATE), DATE '2024-01-20') <= 3 THEN 'ideal' WHEN date_diff('day', CAST(ts AS DATE), DATE '2024-01-20') <= 10 THEN 'open' ELSE 'expired' END AS stage FROM events""")
def t08(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "ts", F.lit("active").alias("state"), (F.col("ts") + F.expr("interval 5 days")).alias("expires_at"))
    stage = S.service_window(F.col("ts").cast("date"), 3, 7, F.lit("2024-01-20").cast("date"))
    return S.expire(events, F.lit("2024-01-20").cast("timestamp_ntz")).select("event_id", "state", stage.alias("stage"))


@query("T07_supersede", """SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) > 1 AS superseded FROM events""")
def t07(spark, sf_dir):
    return S.latest_import(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "event_id").select("event_id", "superseded")


@query(
    "T05_T10_phase_validation",
    """SELECT phase, n, n = (SELECT count(*) FROM orders WHERE o_orderstatus IN ('F', 'O', 'P')) AS valid FROM (SELECT 'normalise' AS phase, count(*) AS n FROM orders UNION ALL SELECT 'materialise', count(*) FROM orders WHERE o_totalprice IS NOT NULL UNION ALL SELECT 'priced', count(*) FROM orders WHERE o_totalprice > 100000)""",
)
def t05(spark, sf_dir):
    """Phases of a finalisation with their counts against what they must hold; a resumed run starts at the first invalid one."""
    orders = table(spark, sf_dir, "orders")
    counts = orders.agg(F.count("*").alias("normalise"), F.count("o_totalprice").alias("materialise"), F.count_if(F.col("o_totalprice") > 100000).alias("priced"), F.count_if(F.col("o_orderstatus").isin("F", "O", "P")).alias("want"))
    phases = F.array(*[F.struct(F.lit(p).alias("phase"), F.col(p).alias("n")) for p in ("normalise", "materialise", "priced")])
    return counts.select("want", F.inline(phases)).select("phase", "n", (F.col("n") == F.col("want")).alias("valid"))


@query("T11_delta_classifier", """SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'high' WHEN c_acctbal > 0 THEN 'mid' ELSE 'low' END AS class FROM customer""")
def t11(spark, sf_dir):
    """Only changed keys are classified again and merged into the standing result."""
    customers = table(spark, sf_dir, "customer")
    grade = F.when(F.col("c_acctbal") > 5000, "high").when(F.col("c_acctbal") > 0, "mid").otherwise("low")
    standing = customers.select("c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", "old").otherwise(grade).alias("class"))
    again = customers.where("c_mktsegment = 'BUILDING'").select("c_custkey", grade.alias("class"))
    return S.upsert(standing, again, ["c_custkey"])


@query(
    "T13_day_completeness",
    """WITH h AS (SELECT user_id % 3 AS g, CAST((ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/Chicago') AS DATE) AS day, count(DISTINCT date_trunc('hour', ts)) AS hours FROM events GROUP BY ALL) SELECT g, day, hours, hours >= 0.75 * 24 AS complete FROM h""",
)
def t13(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("g", F.col("user_id") % 3)
    return S.completeness(events, ["g"], "ts", "America/Chicago").select("g", "day", "hours", "complete")


@query(
    "T14_freshness",
    """WITH l AS (SELECT user_id, event_type, max(ts) FILTER (WHERE value > 20) AS seen FROM events GROUP BY ALL) SELECT user_id, event_type, CASE WHEN seen IS NULL OR CAST(seen AS DATE) > DATE '2024-01-25' THEN 'unavailable' WHEN date_diff('day', CAST(seen AS DATE), DATE '2024-01-25') > CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 7 END THEN 'stale' WHEN event_type = 'error' THEN 'proxy' ELSE 'known' END AS state FROM l""",
)
def t14(spark, sf_dir):
    last = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max(F.when(F.col("value") > 20, F.col("ts"))).alias("seen"))
    kind, age = F.col("event_type"), F.datediff(F.lit("2024-01-25").cast("date"), F.col("seen").cast("date"))
    allowed = F.when(kind == "view", 1).when(kind == "click", 2).otherwise(7)
    state = F.when(F.col("seen").isNull() | (age < 0), "unavailable").when(age > allowed, "stale").when(kind == "error", "proxy").otherwise("known")
    return last.select("user_id", "event_type", state.alias("state"))


@query("I01_I02_identity_signature", r"""SELECT p_partkey, sha256(p_partkey || '|' || p_brand || '|' || p_size) AS identity, 'brand=' || p_brand || '|size=' || p_size AS signature, CAST(p_size AS VARCHAR) AS size, NULL::VARCHAR AS absent FROM part""")
def i01(spark, sf_dir):
    signature = F.concat(F.lit("brand="), "p_brand", F.lit("|size="), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", S.identity(F.col("p_partkey"), F.col("p_brand"), F.col("p_size")).alias("identity"), signature.alias("signature"), S.signature_value(signature, "size").alias("size"), S.signature_value(signature, "absent").alias("absent"))


@query(
    "I03_I04_I08_dependency_reasons",
    """WITH p AS (SELECT n_nationkey AS product FROM nation), d AS (SELECT n_nationkey AS product, (n_nationkey + k) % 25 AS dependency FROM nation, (VALUES (1), (2)) v(k)),
    e AS (SELECT product, dependency, CASE WHEN dependency % 7 = 0 THEN NULL ELSE 'v' || dependency END AS cur, CASE WHEN product % 5 = 0 THEN NULL WHEN dependency % 4 = 0 THEN 'old' ELSE 'v' || dependency END AS rec FROM d)
    SELECT product, coalesce(string_agg(CASE WHEN cur IS NULL THEN dependency || ':unavailable' WHEN rec IS NULL THEN dependency || ':unrecorded' WHEN rec <> cur THEN dependency || ':changed' END, ',' ORDER BY CASE WHEN cur IS NULL THEN dependency || ':unavailable' WHEN rec IS NULL THEN dependency || ':unrecorded' WHEN rec <> cur THEN dependency || ':changed' END), '') AS reasons FROM e GROUP BY product""",
)
def i03(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("product"))
    edges = n.select("product", F.explode(F.array(F.lit(1), F.lit(2))).alias("k")).select("product", ((F.col("product") + F.col("k")) % 25).cast("string").alias("dependency"))
    current = n.select(F.col("product").cast("string").alias("dependency"), F.when(F.col("product") % 7 != 0, F.concat(F.lit("v"), F.col("product").cast("string"))).alias("current_id"))
    recorded = edges.where("product % 5 <> 0").select("product", "dependency", F.when(F.col("dependency").cast("int") % 4 == 0, "old").otherwise(F.concat(F.lit("v"), "dependency")).alias("recorded_id"))
    return S.dependency_reasons(n, edges, recorded, current).select("product", F.array_join("reasons", ",").alias("reasons"))


@query(
    "I06_I07_reference_status",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'unavailable' WHEN o_orderpriority IS DISTINCT FROM '1-URGENT' AND o_totalprice > 300000 OR (o_custkey % 2 = 0 AND o_orderdate < TIMESTAMP '1995-01-01') THEN 'stale' ELSE 'available' END AS status,
    CASE WHEN o_orderpriority <> '1-URGENT' AND o_totalprice > 300000 THEN 'priority' ELSE '' END AS reasons FROM orders""",
)
def i06(spark, sf_dir):
    wanted = F.when(F.col("o_totalprice") > 300000, "1-URGENT").otherwise(F.col("o_orderpriority"))
    reasons = S.mismatches({"priority": (F.col("o_orderpriority"), wanted)})
    status = S.reference_status(F.col("o_orderstatus") != "P", F.col("o_custkey") % 2 == 0, F.col("o_orderdate") < F.lit("1995-01-01").cast("timestamp_ntz"), reasons)
    return table(spark, sf_dir, "orders").select("o_orderkey", status.alias("status"), F.array_join(reasons, ",").alias("reasons"))


@query(
    "I05_manifest",
    """WITH RECURSIVE p AS (SELECT p_partkey AS k, p_brand || ':' || p_size AS own FROM part), m(k, identity) AS (SELECT k, sha256(own) FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.k = p.k // 2) OR k // 2 = k UNION ALL SELECT p.k, sha256(p.own || '|' || m.k || '=' || m.identity) FROM m JOIN p ON p.k // 2 = m.k AND p.k <> m.k) SELECT CAST(k AS VARCHAR) AS product, identity FROM m""",
)
def i05(spark, sf_dir):
    """Every part depends on the part of half its key, where there is one."""
    parts = table(spark, sf_dir, "part")
    own = parts.select(F.col("p_partkey").cast("string").alias("product"), F.concat_ws(":", "p_brand", "p_size").alias("own"))
    up = parts.select(F.col("p_partkey").cast("string").alias("product"), F.floor(F.col("p_partkey") / 2).alias("h"), "p_partkey").where("h <> p_partkey")
    there = parts.select(F.col("p_partkey").alias("h"))
    return S.manifests(own, up.join(there, "h").select("product", F.col("h").cast("string").alias("dependency")))


@query(
    "K01_upsert_null_keys",
    """WITH b AS (SELECT nullif(n_nationkey % 10, 3) AS k, n_name AS v FROM nation WHERE n_nationkey < 8), d AS (SELECT nullif(n_nationkey % 10, 3) AS k, lower(n_name) AS v FROM nation WHERE n_nationkey BETWEEN 13 AND 19) SELECT k, v FROM d UNION ALL SELECT b.k, b.v FROM b WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.k IS NOT DISTINCT FROM b.k)""",
)
def k01_null(spark, sf_dir):
    n, k = table(spark, sf_dir, "nation"), F.nullif(F.col("n_nationkey") % 10, F.lit(3)).alias("k")
    return S.upsert(n.where("n_nationkey < 8").select(k, F.col("n_name").alias("v")), n.where("n_nationkey between 13 and 19").select(k, F.lower("n_name").alias("v")), ["k"])


@query("K08_I09_content_manifest", """SELECT n_regionkey, count(*) AS n, sha256(string_agg(n_nationkey || ':' || n_name, ';' ORDER BY n_nationkey)) AS content_sha FROM nation GROUP BY n_regionkey""")
def k08(spark, sf_dir):
    lines = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.concat(x["n_nationkey"].cast("string"), F.lit(":"), x["n_name"]))
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n"), F.sha2(F.array_join(lines, ";").cast("binary"), 256).alias("content_sha"))


@query(
    "K08_lease_check",
    """WITH a AS (SELECT o_orderkey AS job, CASE WHEN o_orderkey % 5 = 0 THEN 'other' ELSE 'w' || o_custkey END AS token, CASE WHEN o_orderkey % 7 = 0 THEN 'bad' ELSE sha256(o_orderpriority) END AS declared, sha256(o_orderpriority) AS content, o_orderstatus, o_custkey, o_orderdate FROM orders)
    SELECT job, CASE WHEN o_orderstatus = 'P' THEN 'no_lease' WHEN token <> 'w' || o_custkey THEN 'other_holder' WHEN o_orderdate < TIMESTAMP '1995-01-01' THEN 'lease_expired' WHEN declared <> content THEN 'sha_differs' END AS reason FROM a""",
)
def k08_lease(spark, sf_dir):
    orders, holder = table(spark, sf_dir, "orders"), F.concat(F.lit("w"), F.col("o_custkey").cast("string"))
    content = F.sha2(F.col("o_orderpriority").cast("binary"), 256)
    artifacts = orders.select(
        F.col("o_orderkey").alias("job"), F.when(F.col("o_orderkey") % 5 == 0, "other").otherwise(holder).alias("token"),
        F.when(F.col("o_orderkey") % 7 == 0, "bad").otherwise(content).alias("declared_sha"), content.alias("content_sha"),
    )
    leases = orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("job"), holder.alias("holder"), F.col("o_orderdate").alias("lease_until"))
    return S.accepted(artifacts, leases, F.lit("1995-01-01").cast("timestamp_ntz")).select("job", "reason")


@query(
    "K09_payloads",
    """WITH r AS (SELECT o_custkey % 16 AS bucket, (row_number() OVER (PARTITION BY o_custkey % 16 ORDER BY o_orderkey) - 1) // 25 AS batch, o_orderkey, o_orderstatus FROM orders)
    SELECT bucket, batch, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last, '[' || string_agg('{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}', ',' ORDER BY o_orderkey) || ']' AS payload FROM r GROUP BY bucket, batch""",
)
def k09(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    return sinks.payloads(orders, ["o_orderkey", "o_orderstatus"], "o_orderkey", 25, F.col("o_custkey") % 16)


@query(
    "T05_resumed_phases",
    """SELECT o_orderkey, upper(replace(o_orderpriority, '-', ' ')) AS priority, CASE WHEN o_totalprice > 100000 THEN 'large' ELSE 'small' END AS kind, sha256(o_orderkey || '|' || upper(replace(o_orderpriority, '-', ' '))) AS identity FROM orders""",
)
def t05_resumed(spark, sf_dir):
    """Three phases over eight parts: a first run ends after eleven parts, in the second phase, and a second run takes it up."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    path = f"{shared_folder(spark)}/phases-{uuid.uuid4().hex}"
    phases = [
        ("normalising", lambda d: d.withColumn("priority", F.upper(F.replace("o_orderpriority", F.lit("-"), F.lit(" ")))).drop("o_orderpriority")),
        ("materialising", lambda d: d.withColumn("kind", F.when(F.col("o_totalprice") > 100000, "large").otherwise("small")).drop("o_totalprice")),
        ("identified", lambda d: d.withColumn("identity", S.identity(F.col("o_orderkey"), F.col("priority")))),
    ]
    part = F.pmod(F.xxhash64("o_orderkey"), F.lit(8)).cast("int")
    reached = [S.run_phases(orders, path, phases, part, 8, budget) for budget in (11, None)]
    if reached != ["materialising", "complete"]:
        raise AssertionError(f"phases reached: {reached}")
    return spark.read.parquet(f"{path}/identified").drop("chunk")


@query(
    "T10_invariants",
    """WITH n AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'F' THEN 'F' ELSE 'X' END AS status, lower(trim(substr(o_orderpriority, 3))) AS priority, o_totalprice, o_orderdate FROM orders)
    SELECT o_orderkey, status, priority, sha256(o_orderkey || '|' || priority) AS identity, concat_ws(',', CASE WHEN NOT o_totalprice > 1000 THEN 'price' END, CASE WHEN NOT o_orderdate < TIMESTAMP '1998-01-01' THEN 'date' END, CASE WHEN status = 'X' AND priority = 'urgent' THEN 'status' END) AS violations, o_custkey % 10 = 3 AS orphan FROM n""",
)
def t10(spark, sf_dir):
    """A write that may not change a final status, sets a normal form and an identity, and tells what it breaks and what it refers to in vain."""
    orders = table(spark, sf_dir, "orders")
    old = orders.select("o_orderkey", F.col("o_orderstatus").alias("status"))
    new = S.keep_terminal(old, orders.withColumn("status", F.lit("X")), ["o_orderkey"], "status", ["F"])
    priority = F.lower(F.trim(F.substring("o_orderpriority", 3, 100)))
    rules = {"price": F.col("o_totalprice") > 1000, "date": F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz"), "status": ~((F.col("status") == "X") & (F.col("priority") == "urgent"))}
    held = S.enforce(new, {"priority": priority, "identity": S.identity(F.col("o_orderkey"), priority)}, rules)
    parents = table(spark, sf_dir, "customer").where("c_custkey % 10 <> 3").select(F.col("c_custkey").alias("o_custkey"))
    lost = S.orphans(held, parents, ["o_custkey"]).select("o_orderkey", F.lit(True).alias("orphan"))
    return held.join(lost, "o_orderkey", "left").select("o_orderkey", "status", "priority", "identity", F.array_join("violations", ",").alias("violations"), F.coalesce("orphan", F.lit(False)).alias("orphan"))


@query(
    "I09_source_probe",
    """SELECT s_suppkey AS source, CASE WHEN s_suppkey % 4 = 0 THEN 'new' WHEN s_suppkey % 4 = 1 AND s_suppkey % 3 = 0 THEN 'unreachable' WHEN s_suppkey % 3 = 1 THEN 'changed' ELSE 'unchanged' END AS verdict, CASE WHEN NOT (s_suppkey % 4 = 1 AND s_suppkey % 3 = 0) THEN sha256('name=' || s_name || chr(10) || 'version=' || CAST(s_suppkey % 3 = 1 AS INTEGER)) END AS identity FROM supplier""",
)
def i09(spark, sf_dir):
    """Metadata as two requests saw it: fields in another order and with other times of the request, some with another version."""
    k, suppliers = F.col("s_suppkey"), table(spark, sf_dir, "supplier")
    name = F.col("s_name").alias("name")
    first = F.to_json(F.struct(name, F.lit(0).alias("version"), F.lit("morning").alias("asked")))
    second = F.to_json(F.struct(F.lit("evening").alias("asked"), (k % 3 == 1).cast("int").alias("version"), name))
    recorded = suppliers.where("s_suppkey % 4 <> 0").select(k.alias("source"), S.source_identity(first, ["asked"]).alias("identity"))
    current = suppliers.where("not (s_suppkey % 4 = 1 and s_suppkey % 3 = 0)").select(k.alias("source"), S.source_identity(second, ["asked"]).alias("identity"))
    return S.probe(recorded, current, "source").join(current, "source", "left")


@query("T06_single_flight", """SELECT o_orderstatus, count(*) AS n, true AS held, false AS second FROM orders GROUP BY o_orderstatus""")
def t06(spark, sf_dir):
    """A rebuild that holds its name: a second run that comes meanwhile is turned away."""
    folder = f"{shared_folder(spark)}/locks-{uuid.uuid4().hex}"
    with S.single_flight(spark, folder, "rebuild") as held, S.single_flight(spark, folder, "rebuild") as second:
        counted = checkpointed(table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n")))
    return counted.withColumns({"held": F.lit(held), "second": F.lit(second)})
