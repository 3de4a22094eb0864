"""Relational building blocks that Spark has no single operator for, as DataFrame compositions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A side is broadcast by hand only up to this many rows; beyond it the plain join is used.
BROADCAST_ROWS = 100_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint where it has at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def distinct_on(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row of each key in ``order``; the order should end in a unique column."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows of each key with their rank. Spark prunes inside each task before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def lateral_top1(left: DataFrame, right: DataFrame, on: Sequence[str], order: Sequence[Column], where: Column | None = None) -> DataFrame:
    """Left join with the first matching row of ``right`` in ``order`` (a correlated top-1)."""
    best = distinct_on(right if where is None else right.where(where), on, order)
    return left.join(best, list(on), "left")


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, values: Sequence[str], tie: str | None = None, strict: bool = False, period: str | None = None, small: int | None = None) -> DataFrame:
    """Latest ``values`` of ``right`` at or before (``strict``: before) each left row's time, by key.

    One union and one window over the key; neither side is broadcast or multiplied. Of right rows with equal
    times the one with the largest ``tie`` counts. Rows without a time match nothing. One key may hold much of a table: beyond
    ``small`` rows (two million, if not given) both sides are dealt by ranges of key and time, and with a ``period`` (as
    ``date_trunc`` takes it) by period; the last values of each are carried on to the next ones, and the result is the same.
    """
    value = F.struct(F.col(right_time).alias("__time"), *[F.col(v) for v in values])
    order = F.lit(0).cast("long") if tie is None else F.col(tie).cast("long")
    events = right.where(F.col(right_time).isNotNull()).select(*by, F.col(right_time).alias("__at"), F.lit(1 if strict else 0).alias("__side"), order.alias("__tie"), value.alias("__value"))
    kept = left.select(*by, F.col(left_time).alias("__at"), F.lit(0 if strict else 1).alias("__side"), F.lit(0).cast("long").alias("__tie"), F.struct(*left.columns).alias("__row"))
    both = kept.unionByName(events, allowMissingColumns=True)
    if period is None:
        from .ranks import last_known

        found = last_known(both, by, ["__at", "__side", "__tie"], "__value", "__last", small).where("__row is not null")
        return found.select("__row.*", F.col("__last.__time").alias(f"asof_{right_time}"), *[F.col(f"__last.{v}").alias(f"asof_{v}") for v in values])
    both = both.withColumn("__part", F.date_trunc(period, "__at"))
    w = Window.partitionBy(*by, "__part").orderBy("__at", "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__last", F.last("__value", ignorenulls=True).over(w)).where("__row is not null")
    ends = both.groupBy(*by, "__part").agg(F.max_by("__value", F.when(F.col("__value").isNotNull(), F.struct("__at", "__tie"))).alias("__end"))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*[F.col(k).alias(f"__{i}") for i, k in enumerate(by)], F.col("__part").alias("__in"), F.last("__end", ignorenulls=True).over(before).alias("__carried"))
    same = reduce(lambda on, k: on & F.col(k[1]).eqNullSafe(F.col(f"__{k[0]}")), enumerate(by), F.col("__part").eqNullSafe(F.col("__in")))
    found = found.join(carried, same, "left").withColumn("__last", F.coalesce("__last", "__carried"))
    return found.select("__row.*", F.col("__last.__time").alias(f"asof_{right_time}"), *[F.col(f"__last.{v}").alias(f"asof_{v}") for v in values])


def conditional_sums(df: DataFrame, keys: Sequence[str], time: str, as_of: str, horizons: Sequence[int], value: Column, prefix: str = "sum") -> DataFrame:
    """Sums over the last n days before ``as_of``, one column for each horizon, in one aggregation."""
    end = F.lit(as_of).cast("timestamp_ntz")
    sums = [F.sum(F.when((F.col(time) > end - F.expr(f"interval {n} days")) & (F.col(time) <= end), value)).alias(f"{prefix}_{n}d") for n in horizons]
    return df.groupBy(*keys).agg(*sums)


def rank_pivot(df: DataFrame, keys: Sequence[str], rank: str, value: str, names: Sequence[str]) -> DataFrame:
    """Values of rank 1, 2, … as columns of one row for each key."""
    return df.groupBy(*keys).agg(*[F.max(F.when(F.col(rank) == k + 1, F.col(value))).alias(n) for k, n in enumerate(names)])


def modal(df: DataFrame, keys: Sequence[str], value: str, count: str = "n") -> DataFrame:
    """Most frequent value of each key; of equally frequent ones the smallest."""
    counted = df.groupBy(*keys, value).agg(F.count("*").alias(count))
    return distinct_on(counted, keys, [F.desc(count), F.asc(value)])


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, run: str = "run_id") -> DataFrame:
    """Adds the number of the run of equal consecutive values (from 1) that each row is in."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("__new", changed).withColumn(run, F.sum("__new").over(upto)).drop("__new")


def exists_flag(df: DataFrame, other: DataFrame, on: Sequence[str], name: str) -> DataFrame:
    """``df`` with a boolean that tells whether ``other`` has the key; no row is multiplied."""
    there = other.select(*on).distinct().withColumn("__there", F.lit(True))
    return df.join(there, list(on), "left").withColumn(name, F.coalesce("__there", F.lit(False))).drop("__there")


def suppress(df: DataFrame, *others: tuple[DataFrame, Sequence[str]]) -> DataFrame:
    """Rows that none of ``others`` (frame, key) has."""
    return reduce(lambda d, o: d.join(o[0].select(*o[1]).distinct(), list(o[1]), "left_anti"), others, df)


def expand_range(df: DataFrame, low: str, high: str, member: str, most: int | None = None, span: int = 100_000) -> DataFrame:
    """One row for each whole number from ``low`` to ``high``; empty where reversed or null, refused beyond ``most`` if that is given.

    Ranges are cut into spans first, so none is ever one array of all its members.
    """
    size = F.col(high) - F.col(low) + 1
    begins = F.when(size > 0, F.sequence(F.col(low).cast("long"), F.col(high).cast("long"), F.lit(span).cast("long")))
    if most is not None:
        begins = F.when(size > most, F.raise_error(F.lit(f"a range has more than {most} members")).cast("array<bigint>")).otherwise(begins)
    spans = df.withColumn("__from", F.explode(begins))
    return spans.withColumn(member, F.explode(F.sequence(F.col("__from"), F.least(F.col("__from") + span - 1, F.col(high).cast("long"))))).drop("__from")


def optional_filters(df: DataFrame, **wanted) -> DataFrame:
    """Equality on every column with a value; a list means membership, None means no filter."""
    for column, value in wanted.items():
        if value is not None:
            df = df.where(F.col(column).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(column) == value)
    return df


def clamp(n: int | None, default: int = 10, most: int = 100) -> int:
    """A row limit between 1 and ``most``."""
    return max(1, min(default if n is None else n, most))


def keyset_page(df: DataFrame, key: str, after, n: int) -> DataFrame:
    """The next ``n`` rows behind a cursor."""
    page = df if after is None else df.where(F.col(key) > after)
    return page.orderBy(key).limit(clamp(n, most=10_000))


def over_fetch(df: DataFrame, first: Sequence[Column], keep: Column, again: Sequence[Column], n: int, times: int = 3) -> DataFrame:
    """``n`` rows by ``again`` among those of the first ``n * times`` by ``first`` that pass ``keep``."""
    return df.orderBy(*first).limit(n * times).where(keep).orderBy(*again).limit(n)


def caller_order(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Rows whose ``column`` is among ``values``, in the order of ``values``."""
    listed = F.array(*[F.lit(v) for v in values])
    return df.where(F.col(column).isin(list(values))).withColumn("position", F.array_position(listed, F.col(column)).cast("int")).orderBy("position")


def regex_join(df: DataFrame, text: str, patterns: DataFrame, pattern: str, group: int = BROADCAST_ROWS) -> DataFrame:
    """Every row with every pattern that it matches. Patterns go out in groups of about ``group`` rows, each broadcast, however many there are."""
    known = checkpointed(patterns)
    groups = max(1, -(-known.count() // group))
    parts = [known if groups == 1 else known.where(F.pmod(F.xxhash64(pattern, *[c for c in known.columns if c != pattern]), F.lit(groups)) == g) for g in range(groups)]
    return reduce(DataFrame.unionByName, [df.join(F.broadcast(p), F.expr(f"`{text}` rlike `{pattern}`")) for p in parts])


def update_from(df: DataFrame, changes: DataFrame, on: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``df`` with ``columns`` replaced where ``changes`` has the key (one row for each key); null keys are equal."""
    new = changes.select(*[F.col(k).alias(f"__key_{k}") for k in on], F.lit(True).alias("__hit"), *[F.col(c).alias(f"__{c}") for c in columns])
    joined = df.join(new, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in on]), "left")
    return joined.select(*[F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def recursive_closure(edges: DataFrame, source: str, target: str) -> DataFrame:
    """``root, node, depth`` over all paths' nodes, each at its least depth; cycles end as no new pair comes.

    Pairs found so far are kept in the checkpoint folder when the chain of joins gets long.
    """
    step = edges.select(F.col(source).alias("root"), F.col(target).alias("node")).distinct()
    reached = frontier = step.withColumn("depth", F.lit(1))
    hop = edges.select(F.col(source).alias("node"), F.col(target).alias("next")).distinct()
    depth = 1
    while True:
        depth += 1
        new = frontier.join(hop, "node").select("root", F.col("next").alias("node")).distinct()
        frontier = new.join(reached, ["root", "node"], "left_anti").withColumn("depth", F.lit(depth))
        frontier = checkpointed(frontier)
        if frontier.isEmpty():
            return reached
        reached = reached.unionByName(frontier)


def shared_folder(spark) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share; a temporary one only where none is set and all runs on one machine."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        import tempfile

        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lodestrata-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def with_guardrails(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with columns that are false by contract: what the rows do not authorise anyone to assert."""
    return df.withColumns({n: F.lit(False) for n in names})
