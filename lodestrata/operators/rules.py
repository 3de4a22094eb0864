"""Rule evaluation, classification ladders, session metrics and freshness of evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import broadcast_if_small


def freshness(observed: Column, as_of: Column, fresh_days: int, fresh_state: Column) -> Column:
    """``unavailable`` for no or a future observation, ``stale`` beyond ``fresh_days``, else ``fresh_state``."""
    age = F.datediff(as_of, observed)
    return F.when(observed.isNull() | (age < 0), "unavailable").when(age > fresh_days, "stale").otherwise(fresh_state)


def evaluate(scenarios: DataFrame, rules: DataFrame, evidence: DataFrame, on: Sequence[str], kind: str, gates: Sequence[tuple[Column, str, str]], passed: str = "active") -> DataFrame:
    """Every rule for every scenario, with the status and reason of the first gate that holds.

    A scenario meets each rule by design, so the result has scenarios times rules rows; the rules are the small
    side. Gates see columns of the scenario, the rule and the evidence of the rule's ``kind`` (null if there is none).
    """
    pairs = scenarios.crossJoin(broadcast_if_small(rules))
    seen = pairs.join(evidence, [*on, kind], "left")
    status = reason = None
    for test, s, r in gates:
        status = F.when(test, s) if status is None else status.when(test, s)
        reason = F.when(test, r) if reason is None else reason.when(test, r)
    return seen.withColumn("status", status.otherwise(passed)).withColumn("reason", reason.otherwise(passed))


def classify(df: DataFrame, keys: Sequence[str], gates: dict[str, Column]) -> DataFrame:
    """One row for each key and service with the state of its ladder; one scan for all services."""
    states = F.array(*[F.struct(F.lit(name).alias("service"), state.alias("state")) for name, state in gates.items()])
    return df.select(*keys, F.inline(states))


def session_metrics(events: DataFrame, keys: Sequence[str], order: Sequence[str], kind: str, error: str) -> DataFrame:
    """First kind, immediate repeats and error rate of each key's sequence."""
    w = Window.partitionBy(*keys).orderBy(*order)
    seen = events.select(*keys, F.col(kind).alias("kind"), F.row_number().over(w).alias("place"), F.lead(kind).over(w).alias("next_kind"))
    return seen.groupBy(*keys).agg(
        F.max(F.when(F.col("place") == 1, F.col("kind"))).alias("first_type"),
        F.count_if(F.col("next_kind") == F.col("kind")).alias("loops"),
        F.count_if(F.col("kind") == error).alias("errors"),
        F.round(F.count_if(F.col("kind") == error) / F.count("*"), 4).alias("error_rate"),
    )


def follows(events: DataFrame, key: str, order: Sequence[str], column: str, wanted: Sequence[str]) -> DataFrame:
    """``key, follows``: whether ``wanted`` occurs in order, other elements between allowed.

    Each step is the least place after the step before, a pre-aggregated minimum, so no key's events are gathered.
    """
    place = F.struct(*order)
    reached = events.groupBy(key).agg(F.min(F.when(F.col(column) == wanted[0], place)).alias("at"))
    for x in wanted[1:]:
        later = events.where(F.col(column) == x).select(key, place.alias("next")).join(reached.withColumnRenamed("at", "was"), key).where(F.col("next") > F.col("was"))
        found = later.groupBy(key).agg(F.min("next").alias("at"))
        reached = reached.select(key).join(found, key, "left")
    return reached.select(key, F.col("at").isNotNull().alias("follows"))


def repeat_counts(events: DataFrame, key: str, order: Sequence[str], column: str) -> DataFrame:
    """``key, repeats``: places where an element equals the one before; a sorted pass that spills."""
    before = F.lag(column).over(Window.partitionBy(key).orderBy(*order))
    return events.select(key, (F.col(column) == before).alias("same")).groupBy(key).agg(F.count_if("same").alias("repeats"))


def has_subsequence(sequence: Column, wanted: Sequence[str]) -> Column:
    """Whether ``wanted`` occurs in order, other elements between allowed."""
    listed = F.array(*[F.lit(x) for x in wanted])
    step = lambda at, x: F.when((at < len(wanted)) & (F.get(listed, at) == x), at + 1).otherwise(at)
    return F.aggregate(sequence, F.lit(0), step) == len(wanted)


def repeats(sequence: Column) -> Column:
    """Places where an element equals the one before."""
    shifted = F.slice(sequence, 2, F.greatest(F.lit(0), F.size(sequence) - 1))
    pairs = F.zip_with(F.slice(sequence, 1, F.greatest(F.lit(0), F.size(sequence) - 1)), shifted, lambda a, b: a == b)
    return F.size(F.filter(pairs, lambda same: same))
