"""Statistics: quantile conventions, correlation, variance shares, entropy, histograms, points and percentiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import average_ranks, running, with_keys


def nearest_rank(values: Column, p: float) -> Column:
    """Element of the sorted array nearest to rank ``(n - 1) * p``; null for an empty one."""
    ordered = F.array_sort(values)
    return F.when(F.size(values) > 0, F.element_at(ordered, (F.floor((F.size(values) - 1) * p + 0.5) + 1).cast("int")))


def floor_median(values: Column) -> Column:
    """Element at ``floor(n / 2)`` of the sorted array."""
    return F.when(F.size(values) > 0, F.element_at(F.array_sort(values), (F.floor(F.size(values) / 2) + 1).cast("int")))


def spearman(df: DataFrame, x: str, y: str, keys: Sequence[str]) -> DataFrame:
    """Spearman and Pearson correlation for each key."""
    ranked = average_ranks(average_ranks(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), x, "__rx", keys), y, "__ry", keys)
    return ranked.groupBy(*keys).agg(F.corr("__rx", "__ry").alias("spearman"), F.corr(x, y).alias("pearson"), F.count("*").alias("n"))


def variance_partition(df: DataFrame, value: str, group: str) -> DataFrame:
    """Shares of the sum of squares between groups and within them, from sums alone."""
    v = F.col(value).cast("double")
    per = df.where(v.isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    whole = per.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("between"))
    mean = F.col("s") * F.col("s") / F.col("n")
    total = F.col("q") - mean
    return whole.select((100 * (F.col("between") - mean) / total).alias("between_pct"), (100 * (F.col("q") - F.col("between")) / total).alias("within_pct"), "n")


def normalised_entropy(shares: Column) -> Column:
    """Entropy of non-negative weights over the logarithm of their number; 0 for one or none."""
    total = F.aggregate(shares, F.lit(0.0), lambda a, x: a + x)
    terms = F.aggregate(shares, F.lit(0.0), lambda a, x: a + F.when(x > 0, -(x / total) * F.log(x / total)).otherwise(0.0))
    return F.when((F.size(shares) > 1) & (total > 0), terms / F.log(F.size(shares).cast("double"))).otherwise(0.0)


def dominant_share(shares: Column) -> Column:
    total = F.aggregate(shares, F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.array_max(shares) / total)


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, keys: Sequence[str] = ()) -> DataFrame:
    """Counts in equal bins from ``low`` to ``high``; values outside count in the end bins."""
    at = F.floor((F.col(value) - low) / ((high - low) / bins)).cast("int")
    return df.where(F.col(value).isNotNull()).groupBy(*keys, F.greatest(F.lit(0), F.least(F.lit(bins - 1), at)).alias("bin")).agg(F.count("*").alias("n"))


def weighted_quantile(df: DataFrame, keys: Sequence[str], value: str, weight: str, p: float, into: str) -> DataFrame:
    """Least value at which the running weight reaches the share ``p``; weights are added up by value first."""
    bins = df.where(F.col(value).isNotNull() & (F.col(weight) > 0)).groupBy(*keys, value).agg(F.sum(weight).alias("__w"))
    summed = running(bins, keys, [value], {"__w": "__run"})
    summed = with_keys(summed, summed.groupBy(*keys).agg(F.sum("__w").alias("__all")), keys)
    return summed.where(F.col("__run") >= F.col("__all") * p).groupBy(*keys).agg(F.min(value).alias(into))


def quantile_groups(df: DataFrame, value: str, groups: int, into: str, keys: Sequence[str]) -> DataFrame:
    """Group from 0 by the average rank among the key's rows; equal values share a group."""
    ranked = average_ranks(df.where(F.col(value).isNotNull()), value, "__rank", keys)
    sized = with_keys(ranked, ranked.groupBy(*keys).agg(F.count("*").alias("__size")), keys)
    return sized.withColumn(into, F.least(F.lit(groups - 1), F.floor((F.col("__rank") - 0.5) * groups / F.col("__size"))).cast("int")).drop("__rank", "__size")


def points(*rules: tuple[Column, int]) -> Column:
    """Sum of the points of the rules that hold; a null test gives none."""
    total = F.lit(0)
    for test, n in rules:
        total = total + F.when(test, n).otherwise(0)
    return total


def banded(value: Column, *bands: tuple[float, object], otherwise=None) -> Column:
    """Result of the first band whose least value is reached."""
    out = None
    for least, result in bands:
        out = F.when(value >= least, result) if out is None else out.when(value >= least, result)
    return out.otherwise(otherwise)


def robust_scale(value: Column, low: Column, high: Column) -> Column:
    """``value`` between two percentiles as 0 to 1, cut off outside; null where they coincide."""
    return F.when(high > low, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low))))
