"""Running totals, ranks and exact quantiles by key that no task gathers, even where one key holds all rows.

Rows are range-partitioned by key and value, so a partition is a run of neighbours of bounded size. Totals inside
partitions are windows of that size, and what lies before a partition is a sum over one row for each key and partition.
Up to ``SMALL`` rows, after equal values are counted together, one window by key does the same.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import checkpointed

#: Rows up to which a window by key is used; it bounds what one task sorts.
SMALL = 2_000_000
#: Rows of a range partition.
SPAN = 1_000_000


def on_keys(keys: Mapping[str, str]) -> Column:
    """Equality of columns and their counterparts, nulls equal."""
    return reduce(lambda a, b: a & b, [F.col(a).eqNullSafe(F.col(b)) for a, b in keys.items()], F.lit(True))


def with_keys(df: DataFrame, facts: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``df`` with the columns of ``facts``, one row for each key, null keys included."""
    named = facts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[c for c in facts.columns if c not in keys])
    return df.join(named, on_keys({k: f"__k{i}" for i, k in enumerate(keys)}), how).drop(*[f"__k{i}" for i in range(len(keys))])


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Mapping[str, str], small: int | None = None) -> DataFrame:
    """``df`` with, for each column and name in ``sums``, its total over the key's rows up to and with each row in ``order``.

    ``order`` should end in a column that tells a key's rows apart.
    """
    df = checkpointed(df)
    n = df.count()
    if n <= (SMALL if small is None else small):
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({into: F.sum(c).over(w) for c, into in sums.items()})
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-n // SPAN))
    ranged = checkpointed(df.repartitionByRange(parts, *keys, *order)).withColumn("__pid", F.spark_partition_id())
    inside = Window.partitionBy("__pid", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumns({into: F.sum(c).over(inside) for c, into in sums.items()})
    totals = ranged.groupBy("__pid", *keys).agg(*[F.sum(c).alias(f"__{into}") for c, into in sums.items()])
    before = Window.partitionBy(*keys).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    behind = totals.select("__pid", *keys, *[F.coalesce(F.sum(f"__{into}").over(before), F.lit(0)).alias(f"__{into}") for into in sums.values()])
    joined = with_keys(local, behind, ["__pid", *keys])
    return joined.select(*df.columns, *[(F.col(into) + F.col(f"__{into}")).alias(into) for into in sums.values()])


def last_known(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, into: str, small: int | None = None) -> DataFrame:
    """``df`` with the latest ``value`` that is not null among the key's rows up to and with each row in ``order``.

    Beyond ``small`` rows the latest value of each range partition is carried on to the next ones, as in ``running``.
    """
    df = checkpointed(df)
    n = df.count()
    latest = F.last(value, ignorenulls=True)
    if n <= (SMALL if small is None else small):
        return df.withColumn(into, latest.over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-n // SPAN))
    # Rows that are equal in the order are told apart, so that no partition gets all of them.
    told = [*order, "__n"]
    ranged = checkpointed(df.withColumn("__n", F.monotonically_increasing_id()).repartitionByRange(parts, *keys, *told)).withColumn("__pid", F.spark_partition_id())
    inside = Window.partitionBy("__pid", *keys).orderBy(*told).rowsBetween(Window.unboundedPreceding, 0)
    ends = ranged.groupBy("__pid", *keys).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*told))).alias("__end"))
    before = Window.partitionBy(*keys).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("__pid", *keys, F.last("__end", ignorenulls=True).over(before).alias("__carried"))
    joined = with_keys(ranged.withColumn(into, latest.over(inside)), carried, ["__pid", *keys])
    return joined.select(*df.columns, F.coalesce(into, "__carried").alias(into))


def counted(df: DataFrame, keys: Sequence[str], value: str, small: int | None = None) -> DataFrame:
    """``keys, value, __c, __end, n``: how often each value occurs, how many of the key's values are not above it, and of how many."""
    found = running(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__c")), keys, [value], {"__c": "__end"}, small)
    return with_keys(found, found.groupBy(*keys).agg(F.sum("__c").alias("n")), keys) if keys else found.crossJoin(F.broadcast(found.agg(F.sum("__c").alias("n"))))


def _looked_up(df: DataFrame, keys: Sequence[str], value: str, ranks: Mapping[str, Column], small: int | None) -> DataFrame:
    inside = lambda r: (r >= F.col("__end") - F.col("__c")) & (r < F.col("__end"))
    return counted(df, keys, value, small).groupBy(*keys).agg(F.max("n").alias("n"), *[F.max(F.when(inside(r), F.col(value))).alias(name) for name, r in ranks.items()])


def at_ranks(df: DataFrame, keys: Sequence[str], value: str, ranks: Mapping[str, Column], small: int | None = None) -> DataFrame:
    """``keys`` and, for each rank from 0 (an expression over the number ``n`` of a key's values), the value in that place."""
    return _looked_up(df, keys, value, ranks, small).select(*keys, *ranks)


def percentiles(df: DataFrame, keys: Sequence[str], value: str, shares: Mapping[str, float], small: int | None = None) -> DataFrame:
    """``keys`` and, for each share, the value that part of the way up the key's ordered values, between two of them in proportion."""
    place = lambda p: (F.col("n") - 1) * F.lit(float(p))
    ranks = {f"{name}__{end}": f(place(p)) for name, p in shares.items() for end, f in (("low", F.floor), ("high", F.ceil))}
    found = _looked_up(df, keys, value, ranks, small)
    between = lambda name, p: F.col(f"{name}__low") + (F.col(f"{name}__high") - F.col(f"{name}__low")) * (place(p) - F.floor(place(p)))
    return found.select(*keys, *[between(name, p).alias(name) for name, p in shares.items()])


def average_ranks(df: DataFrame, value: str, into: str, keys: Sequence[str] = (), small: int | None = None) -> DataFrame:
    """``df`` with ranks from 1, ties at their mean; rows without a value have none and are left out."""
    places = counted(df, keys, value, small).select(*keys, value, (F.col("__end") - (F.col("__c") - 1) / 2).alias(into))
    return with_keys(df.where(F.col(value).isNotNull()), places, [*keys, value])
