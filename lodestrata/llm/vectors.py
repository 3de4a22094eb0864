"""Vectors as arrays inside tasks, and joins whose one side repeats a key very often."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Of ``n`` rows at most this many keys can have over ``n / MOST_HEAVY`` rows each, which bounds what is broadcast.
MOST_HEAVY = 4096


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite; an empty one counts as not there."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))), F.lit(False))


def matrices(column: pa.ChunkedArray | pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Row numbers and vectors (as double) for each length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(column.value_lengths())
    values = np.asarray(column.flatten(), dtype=np.float64)
    begins = np.cumsum(lengths) - lengths
    return {int(n): (rows := np.flatnonzero(lengths == n), values[begins[rows][:, None] + np.arange(n)]) for n in np.unique(lengths)}


def with_facts(rows: DataFrame, facts: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` with the columns of ``facts``, one row for each value of ``key``, nulls one value, ``count`` rows each.

    Keys with more than one in ``MOST_HEAVY`` of all rows are at most that many, so their facts are broadcast and their
    rows stay where they are; the others meet in a shuffle in which none of them is large.
    """
    total = facts.agg(F.sum(F.col(count).cast("decimal(38,0)")).alias("n")).first()["n"] or 0
    facts = facts.withColumnRenamed(key, "__key")
    carried = [c for c in facts.columns if c not in ("__key", count)]
    heavy = F.col(count) > total / MOST_HEAVY
    marked = rows.join(F.broadcast(facts.where(heavy).withColumn("__heavy", F.lit(True)).drop(count)), F.col(key).eqNullSafe(F.col("__key")), "left")
    often = marked.where("__heavy").select(*rows.columns, *carried)
    seldom = marked.where("__heavy is null").select(*rows.columns).join(facts.where(~heavy), F.col(key).eqNullSafe(F.col("__key")))
    return often.unionByName(seldom.select(*rows.columns, *carried))
