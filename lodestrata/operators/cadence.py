"""Cadence of dated events: gaps, their quartiles, confidence tiers and projected windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import percentiles
from .relational import modal

#: Tier, least events, least days of history.
TIERS = (("high", 5, 365), ("medium", 3, 120), ("low", 2, 0))
PROJECTED_EVENTS, PROJECTED_DAYS = 3, 120
VARIABILITY = (("regular", 0.35), ("moderately_variable", 0.80))


def whole(x: Column) -> Column:
    """Half away from zero, as a whole number."""
    return F.floor(x + 0.5).cast("int")


def fiscal_quarter(date: Column) -> Column:
    """Quarter of a year that begins in October."""
    return (F.floor((F.month(date) + 2) % 12 / 3) + 1).cast("int")


def tier(events: Column, history_days: Column) -> Column:
    out = None
    for name, n, days in TIERS:
        test = (events >= n) & (history_days >= days)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("insufficient")


def variability(p25: Column, p50: Column, p75: Column) -> Column:
    spread = (F.coalesce(p75, p50) - F.coalesce(p25, p50)) / p50
    return F.when(p50.isNull() | (p50 <= 0), "unknown").when(spread <= VARIABILITY[0][1], VARIABILITY[0][0]).when(spread <= VARIABILITY[1][1], VARIABILITY[1][0]).otherwise("highly_variable")


def cadence(events: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    """One row for each key: events (distinct dates), history, gap quartiles, tier, variability, peak quarter and the projected window.

    Null dates are left out, and a key without a date has no row. A single date makes the tier ``insufficient``
    and leaves quartiles and window null.
    """
    dated = events.where(F.col(date).isNotNull()).select(*keys, F.col(date).cast("date").alias("day")).distinct()
    w = Window.partitionBy(*keys).orderBy("day")
    gaps = dated.withColumn("gap", F.datediff("day", F.lag("day").over(w)))
    stats = dated.groupBy(*keys).agg(F.count("*").alias("n_events"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    quartiles = percentiles(gaps.where("gap > 0"), keys, "gap", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    stats = stats.join(quartiles, list(keys), "left")
    quarters = dated.withColumn("quarter", fiscal_quarter(F.col("day")))
    peak = modal(quarters, keys, "quarter").withColumnRenamed("quarter", "peak_quarter").withColumnRenamed("n", "peak_n")
    return _described(stats.join(peak, list(keys), "left"))


def _described(stats: DataFrame) -> DataFrame:
    history = F.datediff("last_day", "first_day")
    p25, p50, p75 = F.col("p25"), F.col("p50"), F.col("p75")
    projected = (F.col("n_events") >= PROJECTED_EVENTS) & (history >= PROJECTED_DAYS) & (p50 > 0)
    after = lambda days, ok: F.when(projected & ok, F.date_add("last_day", F.greatest(F.lit(1), days)))
    return stats.select(
        "*",
        history.alias("history_days"),
        tier(F.col("n_events"), history).alias("confidence"),
        variability(p25, p50, p75).alias("variability"),
        F.round(F.col("peak_n") / F.col("n_events"), 3).alias("peak_share"),
        after(whole(p50), F.lit(True)).alias("projected_center"),
        after(F.floor(p25).cast("int"), p25 > 0).alias("projected_early"),
        after(F.ceil(p75).cast("int"), p75 > 0).alias("projected_late"),
    )


def roll_forward(stats: DataFrame, as_of: str) -> DataFrame:
    """``cadence`` rows with the window moved on by whole cycles to reach ``as_of``, and its status."""
    day = F.lit(as_of).cast("date")
    p50 = F.col("p50")
    late_by = F.greatest(F.lit(0), F.datediff(day, "last_day"))
    cycles = F.when(F.col("projected_center").isNotNull(), F.greatest(F.lit(1), F.ceil(late_by / p50).cast("int")))
    center = F.date_add("last_day", F.greatest(F.lit(1), whole(cycles * p50)))
    early = F.date_add(F.col("rolled_center"), F.floor(F.coalesce("p25", p50) - p50).cast("int"))
    late = F.date_add(F.col("rolled_center"), F.ceil(F.coalesce("p75", p50) - p50).cast("int"))
    rolled = stats.withColumn("cycles", cycles).withColumn("rolled_center", F.when(F.col("cycles").isNotNull(), center))
    rolled = rolled.withColumn("rolled_early", early).withColumn("rolled_late", late)
    status = F.when(F.col("rolled_center").isNull(), "not_projected").when(day.between(F.col("rolled_early"), F.col("rolled_late")), "watch_window_open").when(day < F.col("rolled_early"), "upcoming").otherwise("elapsed_pending_next_cycle")
    return rolled.withColumn("window_status", status)
