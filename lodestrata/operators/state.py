"""Upserts, lease queues, expiry, identities and freshness as transforms of tables.

What a database does in place is here a function from the old table (and the changes) to the new one; times are
arguments, so a run can be repeated. Null keys are equal to each other in all of them.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import checkpointed, distinct_on

#: Minutes of a lease.
LEASE_MINUTES = 45


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], merge: dict[str, Column] | None = None) -> DataFrame:
    """``old`` with rows of ``new`` added or put in place of those with their key (one row a key in each).

    ``merge`` gives columns that both sides decide, as expressions over ``old.x`` and ``new.x``.
    """
    merge = merge or {}
    marked = new.withColumn("__in", F.lit(True))  # a mark of its own, since keys may be null
    joined = old.alias("old").join(marked.alias("new"), [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in keys], "full_outer")
    pick = lambda c: F.when(F.col("__in"), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}"))
    return joined.select(*[(merge[c] if c in merge else pick(c)).alias(c) for c in old.columns])


def insert_missing(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``old`` and the rows of ``new`` whose key it lacks."""
    there = old.select(*[F.col(k).alias(f"__{k}") for k in keys])
    return old.unionByName(new.join(there, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]), "left_anti").select(*old.columns))


def changed_rows(old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows of ``new`` that are not in ``old`` or differ in ``columns``."""
    was = old.select(*[F.col(k).alias(f"__key_{k}") for k in keys], F.lit(True).alias("__was"), *[F.col(c).alias(f"__{c}") for c in columns])
    same = reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"__{c}")), columns, F.coalesce("__was", F.lit(False)))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in keys])
    return new.join(was, on, "left").where(~same).select(*new.columns)


def replace_scope(old: DataFrame, new: DataFrame, scope: Column) -> DataFrame:
    """``old`` without the rows in ``scope``, and the rows of ``new`` that are in it."""
    return old.where(~F.coalesce(scope, F.lit(False))).unionByName(new.where(scope).select(*old.columns))


def claim(queue: DataFrame, now: Column, n: int, key: str = "id") -> DataFrame:
    """The queue after a worker takes ``n`` jobs; ``claimed`` marks them.

    Leases that ran out go back to ``queued``, or to ``exhausted`` after their last attempt. Then the first ``n``
    due jobs by priority, due time and age are ``leased`` with one attempt more.
    """
    over = (F.col("state") == "leased") & (F.col("lease_until") < now)
    spent = F.col("attempt_count") >= F.col("max_attempts")
    state = F.when(over & spent, "exhausted").when(over, "queued").otherwise(F.col("state"))
    fresh = queue.withColumn("state", state).withColumn("lease_until", F.when(F.col("state") == "leased", F.col("lease_until")))
    due = (F.col("state") == "queued") & (F.coalesce("next_attempt_at", now) <= now) & (F.col("attempt_count") < F.col("max_attempts"))
    first = fresh.where(due).orderBy(F.desc("priority"), F.asc_nulls_first("next_attempt_at"), F.asc("created_at"), F.asc(key)).limit(n).select(F.col(key), F.lit(True).alias("claimed"))
    marked = fresh.join(F.broadcast(first), key, "left").withColumn("claimed", F.coalesce("claimed", F.lit(False)))
    took = F.col("claimed")
    return marked.withColumns(
        {
            "state": F.when(took, "leased").otherwise(F.col("state")),
            "lease_until": F.when(took, now + F.expr(f"interval {LEASE_MINUTES} minutes")).otherwise(F.col("lease_until")),
            "attempt_count": F.col("attempt_count") + F.when(took, 1).otherwise(0),
        }
    )


def report(queue: DataFrame, results: DataFrame, now: Column, base_minutes: int = 5, key: str = "id") -> DataFrame:
    """The queue after results (key, ``ok``): done, exhausted after the last attempt, or queued again after a wait that doubles."""
    joined = queue.join(results.select(key, F.col("ok").alias("__ok")), key, "left")
    known, ok = F.col("__ok").isNotNull(), F.col("__ok")
    spent = F.col("attempt_count") >= F.col("max_attempts")
    wait = F.make_dt_interval(mins=(F.lit(base_minutes) * F.pow(F.lit(2.0), F.greatest(F.lit(0), F.col("attempt_count") - 1))).cast("int"))
    state = F.when(~known, F.col("state")).when(ok, "done").when(spent, "exhausted").otherwise("queued")
    again = known & ~ok & ~spent
    return joined.withColumns({"next_attempt_at": F.when(again, now + wait).otherwise(F.col("next_attempt_at")), "state": state, "lease_until": F.when(~known, F.col("lease_until"))}).drop("__ok")


def expire(df: DataFrame, now: Column, until: str = "expires_at", state: str = "state") -> DataFrame:
    return df.withColumn(state, F.when((F.col(state) == "active") & (F.col(until) < now), "expired").otherwise(F.col(state)))


def service_window(onset: Column, ideal_days: int, decay_days: int, as_of: Column) -> Column:
    """Place of ``as_of`` in the window that an event opens."""
    age = F.datediff(as_of, onset)
    return F.when(age < 0, "not_open").when(age <= ideal_days, "ideal").when(age <= ideal_days + decay_days, "open").otherwise("expired")


def latest_import(df: DataFrame, keys: Sequence[str], time: str, tie: str) -> DataFrame:
    """Marks all but the newest row of each key as superseded."""
    w = Window.partitionBy(*keys).orderBy(F.desc(time), F.desc(tie))
    return df.withColumn("superseded", F.row_number().over(w) > 1)


def identity(*parts: Column) -> Column:
    """SHA-256 of the parts joined by ``|``; null counts as the empty text."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"), 256)


def signature_value(signature: Column, key: str) -> Column:
    """Value of a key in ``k=v|k=v``; null where it is missing."""
    return F.try_element_at(F.str_to_map(signature, F.lit("\\|"), F.lit("=")), F.lit(key))


def mismatches(pairs: dict[str, tuple[Column, Column]]) -> Column:
    """Names of the pairs that differ, nulls equal to each other."""
    return F.array_compact(F.array(*[F.when(~a.eqNullSafe(b), F.lit(name)) for name, (a, b) in pairs.items()]))


def reference_status(present: Column, temporal: Column, expired: Column, reasons: Column) -> Column:
    """``unavailable`` without a record; ``stale`` with a reason, or expired where expiry counts; else ``available``."""
    return F.when(~F.coalesce(present, F.lit(False)), "unavailable").when((F.size(reasons) > 0) | (temporal & expired), "stale").otherwise("available")


def dependency_reasons(products: DataFrame, dependencies: DataFrame, recorded: DataFrame, current: DataFrame) -> DataFrame:
    """Reasons of each product: a dependency whose current identity is missing, unrecorded or another one."""
    edges = products.select("product").join(dependencies, "product").join(recorded, ["product", "dependency"], "left").join(current, "dependency", "left")
    reason = F.when(F.col("current_id").isNull(), F.concat("dependency", F.lit(":unavailable"))).when(F.col("recorded_id").isNull(), F.concat("dependency", F.lit(":unrecorded"))).when(F.col("recorded_id") != F.col("current_id"), F.concat("dependency", F.lit(":changed")))
    found = edges.groupBy("product").agg(F.array_sort(F.collect_set(reason)).alias("reasons"))
    return products.join(found, "product", "left").withColumn("reasons", F.coalesce("reasons", F.array().cast("array<string>")))


def manifests(own: DataFrame, dependencies: DataFrame) -> DataFrame:
    """``product, identity``: SHA-256 over a product's own text and its dependencies' identities, ``own|a=…|b=…`` by name.

    ``own`` has ``product, own`` for every product, ``dependencies`` has ``product, dependency``. Each round resolves the
    products whose dependencies all are; rounds grow with the depth of the graph. A cycle resolves nothing and raises.
    """
    waiting = own.select("product", F.coalesce("own", F.lit("")).alias("own"))
    wanted = dependencies.groupBy("product").agg(F.count("*").alias("wanted"))
    done = own.select("product", F.lit("").alias("identity")).where("false")
    while True:
        part = F.struct("dependency", F.col("identity").alias("id"))
        met = dependencies.join(done.select(F.col("product").alias("dependency"), "identity"), "dependency").groupBy("product").agg(F.array_sort(F.collect_list(part)).alias("parts"))
        each = waiting.join(wanted, "product", "left").join(met, "product", "left").where(F.coalesce("wanted", F.lit(0)) == F.coalesce(F.size("parts"), F.lit(0)))
        lines = F.transform(F.coalesce("parts", F.array().cast(met.schema["parts"].dataType)), lambda p: F.concat(p["dependency"], F.lit("="), p["id"]))
        ready = checkpointed(each.select("product", F.sha2(F.array_join(F.concat(F.array("own"), lines), "|").cast("binary"), 256).alias("identity")))
        if ready.isEmpty():
            break
        done = checkpointed(done.unionByName(ready))
        waiting = checkpointed(waiting.join(ready.select("product"), "product", "left_anti"))
    if not waiting.isEmpty():
        raise ValueError("products that depend on themselves or on what is not there")
    return done


def completeness(df: DataFrame, keys: Sequence[str], time: str, zone: str, least: float = 0.75) -> DataFrame:
    """Local days with the share of their hours that have a row; days of a clock change have 23 or 25 hours."""
    local = F.from_utc_timestamp(F.col(time).cast("timestamp"), zone)
    day = F.date_trunc("day", local)
    start, end = F.to_utc_timestamp(F.col("day"), zone), F.to_utc_timestamp(F.col("day") + F.expr("interval 1 day"), zone)
    hours = df.groupBy(*keys, day.alias("day")).agg(F.count_distinct(F.date_trunc("hour", F.col(time))).alias("hours"))
    expected = (F.unix_timestamp(end) - F.unix_timestamp(start)) / 3600
    return hours.withColumn("expected", expected.cast("int")).withColumn("complete", F.col("hours") >= least * F.col("expected")).withColumn("day", F.to_date("day"))


def accepted(artifacts: DataFrame, leases: DataFrame, now: Column, job: str = "job") -> DataFrame:
    """``artifacts`` (job, ``token``, ``declared_sha``, ``content_sha``) with ``reason``: null where one may be recorded.

    ``leases`` has one row a job: ``holder`` (the token that has it) and ``lease_until``. The first reason counts:
    ``no_lease``, ``other_holder``, ``lease_expired``, ``sha_differs``.
    """
    held = artifacts.join(leases.select(job, F.col("holder").alias("__holder"), F.col("lease_until").alias("__until")), job, "left")
    reason = (
        F.when(F.col("__holder").isNull(), "no_lease")
        .when(~F.col("__holder").eqNullSafe(F.col("token")), "other_holder")
        .when(F.col("__until").isNull() | (F.col("__until") < now), "lease_expired")
        .when(~F.col("declared_sha").eqNullSafe(F.col("content_sha")), "sha_differs")
    )
    return held.withColumn("reason", reason).drop("__holder", "__until")


def enforce(df: DataFrame, normal: dict[str, Column], rules: dict[str, Column]) -> DataFrame:
    """What triggers do before a write: columns set by ``normal``, then ``violations``: the names of the ``rules`` that do not hold.

    A rule that is null does not hold. Rows without violations may be written; the others keep why they may not.
    """
    ready = df.withColumns(normal) if normal else df
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))
    return ready.withColumn("violations", failed)


def keep_terminal(old: DataFrame, new: DataFrame, keys: Sequence[str], status: str, final: Sequence[str]) -> DataFrame:
    """``new`` with the status of ``old`` where that is a final one, which no later write may change."""
    was = old.where(F.col(status).isin(list(final))).select(*keys, F.col(status).alias("__was"))
    return new.join(was, list(keys), "left").withColumn(status, F.coalesce("__was", status)).drop("__was")


def orphans(df: DataFrame, parents: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose parent is not there: what a check of references at commit would refuse. A null key refers to nothing."""
    present = reduce(lambda a, k: a & F.col(k).isNotNull(), on, F.lit(True))
    return df.where(present).join(parents.select(*on), list(on), "left_anti")


def source_identity(metadata: Column, volatile: Sequence[str] = ()) -> Column:
    """SHA-256 of a source's metadata (a JSON object) by its sorted keys, without those that change on every request. Null for no object."""
    fields = F.map_filter(F.from_json(metadata, "map<string,string>"), lambda k, v: ~k.isin(list(volatile)) if volatile else F.lit(True))
    lines = F.transform(F.array_sort(F.map_entries(fields)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null"))))
    return F.sha2(F.array_join(lines, "\n").cast("binary"), 256)


def probe(recorded: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """``key, verdict`` of each source by the ``identity`` on record and the present one: unchanged, changed, new or unreachable."""
    both = recorded.select(key, F.col("identity").alias("was"), F.lit(True).alias("__old")).join(current.select(key, F.col("identity").alias("now")), key, "full_outer")
    verdict = F.when(F.col("__old").isNull(), "new").when(F.col("now").isNull(), "unreachable").when(F.col("was").eqNullSafe(F.col("now")), "unchanged").otherwise("changed")
    return both.select(key, verdict.alias("verdict"))


def _filesystem(spark, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


#: What a phase may do to the number of rows of a part.
ROW_RULES = {"same": lambda came, went: came == went, "fewer": lambda came, went: went <= came, "more": lambda came, went: went >= came, "any": lambda came, went: True}


def run_phases(source: DataFrame, path: str, phases: Sequence[tuple], chunk: Column, chunks: int, budget: int | None = None) -> str:
    """Takes ``source`` through ``phases`` in ``chunks`` parts (numbers from ``chunk``) and returns the phase reached, or ``complete``.

    A phase is a name, a step and, where rows do not stay as many, a rule: ``same`` (the default), ``fewer``, ``more`` or
    ``any``. A phase writes each part under its number and then notes how many rows came in (what the phase before noted
    as gone out) and went out. A run that ended early is taken up at the first part without a note; a part that was half
    written is written again. The next phase begins when every part of the one before is noted and holds to its rule, else
    the run raises. ``budget`` ends a run after that many parts. What the driver holds is one note a part.
    """
    spark = source.sparkSession
    current, came = source.withColumn("chunk", chunk), None
    for name, step, *rule in phases:
        at, notes = f"{path}/{name}", f"{path}/{name}-notes"
        fs, place = _filesystem(spark, notes)
        done = {r["chunk"]: (r["came"], r["went"]) for r in spark.read.parquet(notes).collect()} if fs.exists(place) else {}
        todo = [k for k in range(chunks) if k not in done]
        if budget is not None:
            todo, budget = todo[:budget], budget - len(todo[:budget])
        if todo:
            part = current.where(F.col("chunk").isin(todo))
            stepped = step(part)
            stepped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk").parquet(at)
            written = {r["chunk"]: r["went"] for r in spark.read.schema(stepped.schema).parquet(at).where(F.col("chunk").isin(todo)).groupBy("chunk").agg(F.count("*").alias("went")).collect()}
            if came is None:
                came = {r["chunk"]: r["came"] for r in part.groupBy("chunk").agg(F.count("*").alias("came")).collect()}
            told = {k: (came.get(k, 0), written.get(k, 0)) for k in todo}
            spark.createDataFrame([(k, *n) for k, n in told.items()], "chunk int, came long, went long").coalesce(1).write.mode("append").parquet(notes)
            done |= told
        if len(done) < chunks:
            return name
        if bad := sorted(k for k, (a, b) in done.items() if not ROW_RULES[rule[0] if rule else "same"](a, b)):
            raise ValueError(f"phase {name} lost or added rows in parts {bad}")
        current, came = spark.read.schema(step(current).schema).parquet(at), {k: went for k, (_, went) in done.items()}
    return "complete"


class Flight:
    """A run's hold on a name: numbered claims in a folder, of which the highest counts.

    A claim is a file that only one run can create; its number is one more than the highest there, and it is tried for only
    if that one is done or was not renewed in time. The highest claim is never deleted, so a run that looked long ago finds
    its number taken, or, if it was cleared away, a higher one, and gives way. The folder's file system must create
    files atomically, as HDFS and local disks do; object stores do not.
    """

    def __init__(self, spark, folder: str, name: str, stale_minutes: float = LEASE_MINUTES):
        self.spark, self.folder, self.name, self.stale = spark, folder, name, stale_minutes * 60_000
        self.fs, _ = _filesystem(spark, folder)
        self.number: int | None = None

    def _file(self, number: int, kind: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{self.name}.{number}.{kind}")

    def _now(self) -> int:
        return self.spark._jvm.java.lang.System.currentTimeMillis()

    def claims(self) -> list[int]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        names = [f.getPath().getName() for f in self.fs.listStatus(folder)] if self.fs.exists(folder) else []
        own = [n.removeprefix(f"{self.name}.").removesuffix(".claim") for n in names if n.startswith(f"{self.name}.") and n.endswith(".claim")]
        return sorted(int(n) for n in own if n.isdigit())

    def next_number(self) -> int | None:
        """The number to try for; None while another run holds the name."""
        highest = max(self.claims(), default=0)
        if highest and not self.fs.exists(self._file(highest, "done")):
            if self._now() - self.fs.getFileStatus(self._file(highest, "claim")).getModificationTime() <= self.stale:
                return None
        return highest + 1

    def take(self, number: int | None) -> bool:
        if number is None:
            return False
        try:
            self.fs.create(self._file(number, "claim"), False).close()
        except Py4JJavaError as refused:
            if not self.fs.exists(self._file(number, "claim")) and max(self.claims(), default=0) <= number:
                raise refused
            return False
        if max(self.claims()) > number:
            self.fs.delete(self._file(number, "claim"), False)
            return False
        self.number = number
        for old in self.claims():
            if old < number:
                self.fs.delete(self._file(old, "claim"), False)
                self.fs.delete(self._file(old, "done"), False)
        return True

    def renew(self) -> None:
        self.fs.setTimes(self._file(self.number, "claim"), self._now(), -1)

    def holds(self) -> bool:
        return self.number is not None and max(self.claims(), default=0) == self.number

    def release(self) -> None:
        """Marks the run's own claim as done; a claim that another run has taken over since is left alone."""
        if self.holds():
            self.fs.create(self._file(self.number, "done"), True).close()


@contextmanager
def single_flight(spark, folder: str, name: str, stale_minutes: float = LEASE_MINUTES) -> Iterator[bool]:
    """``with single_flight(…) as mine``: true for the one run that holds ``name`` at a time.

    The hold is renewed every third of ``stale_minutes`` while the block runs, so only a driver that was lost loses it.
    """
    flight = Flight(spark, folder, name, stale_minutes)
    mine, ended = flight.take(flight.next_number()), threading.Event()

    def renewed() -> None:
        while not ended.wait(max(0.05, stale_minutes * 20)):
            if flight.holds():
                flight.renew()

    keeper = threading.Thread(target=renewed, daemon=True)
    if mine:
        keeper.start()
    try:
        yield mine
    finally:
        ended.set()
        if mine:
            keeper.join()
            flight.release()
