"""Expressions whose null or match rules differ from the built-in ones of the same purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def concat_present(*parts: Column) -> Column:
    """Concatenation that leaves nulls out."""
    return F.concat_ws("", *parts)


def replace_first(text: Column, pattern: str, new: str) -> Column:
    """``text`` with the first match of ``pattern`` replaced by the plain text ``new``."""
    at = F.regexp_instr(text, F.lit(pattern))
    long = F.length(F.regexp_substr(text, F.lit(pattern)))
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), F.lit(new), F.substring(text, at + long, F.length(text)))).otherwise(text)


def nth_match(text: Column, pattern: str, n: int) -> Column:
    """The nth match (from 1) of ``pattern``, or null."""
    return F.get(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lit(n - 1))


def array_length(a: Column) -> Column:
    """Number of elements; null for none."""
    return F.nullif(F.size(a), F.lit(0))


def position_in(a: Column, value: Column) -> Column:
    """Place (from 1) of a value in an array; null where it is absent."""
    return F.nullif(F.array_position(a, value), F.lit(0))


def array_replace(a: Column, old: Column, new: Column) -> Column:
    return F.transform(a, lambda v: F.when(v.eqNullSafe(old), new).otherwise(v))


def strip_nulls(record: Column) -> Column:
    """JSON of a struct without its null fields."""
    return F.to_json(record, {"ignoreNullFields": "true"})


def round_half_up(value: Column, places: int) -> Column:
    """Rounding of the decimal value, not of its binary neighbour."""
    return F.round(value.cast("decimal(38,12)"), places)


def acos_safe(value: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value)))


def literal_split(text: Column, delimiter: str) -> Column:
    """Pieces between a delimiter that is taken literally; an empty text has none."""
    pieces = F.split(text, r"\Q" + delimiter + r"\E")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(pieces)
