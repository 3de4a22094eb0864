"""Boxes that meet others, counted and summed up without making the pairs.

A box misses another where it lies wholly on one side of it along an axis, and it cannot lie on both sides. So those met are all less
those beyond each of the four sides, plus those beyond two sides at a corner, which were taken off twice. Ends of boxes become ranks.
Of two ranks the greater one is told by their first digit that differs, so the boxes beyond a corner are found, for each pair of
digits along the two axes, among those that agree in the digits before: groups of at most ``2 ** (2 * DIGIT)`` counted cells, however
many boxes there are. The first and last box met are sought in runs of ids that grow, by those only that have not met one before.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import running
from .relational import broadcast_if_small, checkpointed
from .spatial import PAIRS, box_join

#: Bits of a digit at most.
DIGIT = 8
#: Ids of the first run at least, and how many times as many the next one has.
FIRST, FAN = 64, 64
#: Sides beyond which a box may lie: after a box's end or before its beginning.
SIDES = ("after", "before")
#: What boxes of one group share: the two digits at hand and those before them.
GROUP = ["level", "px", "py"]
#: Cells that one call counts, about, beside those of one group.
LOT = 500_000


def _ranked(left: DataFrame, right: DataFrame, a: str, b: str, axis: str) -> tuple[DataFrame, DataFrame, int]:
    """Both sides with places along an axis, so that a right box lies beyond a side of a left one where its place is greater; and the greatest."""
    ends = lambda df, p: df.select(F.explode(F.array(f"{p}{axis}min", f"{p}{axis}max")).alias("v"))
    values = ends(left, a).unionByName(ends(right, b)).distinct().withColumn("__one", F.lit(1).cast("long"))
    ranks = checkpointed(running(values, [], ["v"], {"__one": "r"}).select("v", "r"))
    most = ranks.count()
    looked = broadcast_if_small(ranks)

    def told(df: DataFrame, p: str, after: str, before: str) -> DataFrame:
        for end, name, place in ((after, "after", F.col("r")), (before, "before", most + 1 - F.col("r"))):
            df = df.join(looked.withColumnRenamed("v", f"{p}{axis}{end}"), f"{p}{axis}{end}").withColumn(f"__{axis}{name}", place).drop("r")
        return df

    return told(left, a, "max", "min"), told(right, b, "min", "max"), most


def _digits(most: int) -> tuple[int, int]:
    """Number of digits of places up to ``most``, and their bits."""
    n = -(-most.bit_length() // DIGIT)
    return n, -(-most.bit_length() // n)


def _in_cells(df: DataFrame, corners: Sequence[Column], digits: dict[str, tuple[int, int]]) -> DataFrame:
    """Rows of ``df`` by corner (structs of ``corner``, ``x``, ``y`` and more) and digits: group (``level, px, py``) and cell ``at``."""
    placed = df.withColumn("c", F.explode(F.array(*corners)))
    for axis, (n, bits) in digits.items():
        place = F.col("c")[axis]
        step = lambda k, place=place, bits=bits: F.struct(F.lit(k).alias("l"), F.shiftright(place, bits * (k + 1)).alias("p"), F.shiftright(place, bits * k).bitwiseAND(2**bits - 1).cast("int").alias("d"))
        placed = placed.withColumn(f"__{axis}", F.explode(F.array(*[step(k) for k in range(n)])))
    x, y = F.col("__x"), F.col("__y")
    level = (F.col("c.corner") * 64 + x["l"] * 8 + y["l"]).cast("int")
    return placed.select(*df.columns, "c", level.alias("level"), x["p"].alias("px"), y["p"].alias("py"), F.shiftleft(x["d"], digits["y"][1]).bitwiseOR(y["d"]).alias("at"))


def _beyond(wide: int, high: int):
    """How many boxes of a group's cells lie beyond the cells asked for along both axes, for the groups of a lot."""

    def of_group(x: np.ndarray, y: np.ndarray, n: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        if len(x) * len(u) <= 1 << 16:
            return n @ ((x[:, None] > u) & (y[:, None] > v))
        sums = np.zeros((2**wide + 1, 2**high + 1), np.int64)
        sums[x, y] = n
        return sums[::-1, ::-1].cumsum(axis=0).cumsum(axis=1)[::-1, ::-1][u + 1, v + 1]

    def of(cells: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        cells, asked = (df.sort_values(GROUP, ignore_index=True) for df in (cells, asked))
        group = asked.groupby(GROUP, sort=False).ngroup().to_numpy()
        begins = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else group
        ends = np.r_[begins[1:], len(group)] if len(group) else group
        spans = cells.reset_index().groupby(GROUP, as_index=False)["index"].agg(low="min", high="max")
        spans = asked.loc[begins, GROUP].merge(spans, on=GROUP, how="left")
        at, want, n = cells["at"].to_numpy(), asked["at"].to_numpy(), cells["n"].to_numpy()
        x, y, u, v = at >> high, at & (2**high - 1), want >> high, want & (2**high - 1)
        found = np.zeros(len(asked), np.int64)
        here = np.flatnonzero(spans["low"].notna().to_numpy())
        lows, highs = spans["low"].to_numpy()[here].astype(np.int64), spans["high"].to_numpy()[here].astype(np.int64) + 1
        for k, i, j in zip(here.tolist(), lows.tolist(), highs.tolist()):
            p, q = begins[k], ends[k]
            found[p:q] = of_group(x[i:j], y[i:j], n[i:j], u[p:q], v[p:q])
        return asked[[*GROUP, "at"]].assign(n=found)[found > 0]

    return of


def counts_met(left: DataFrame, right: DataFrame, a: str, b: str, key: str) -> DataFrame:
    """``key, n``: how many right boxes overlap or touch the left boxes of each ``key``, where there are any.

    Work grows with the rows of both sides, and with the square of the number of digits of their places, not with the pairs.
    Boxes with a null corner, or that end before they begin, meet nothing.
    """
    sides = lambda p: [f"{p}{c}{e}" for c in "xy" for e in ("min", "max")]
    whole = lambda df, p: df.where((F.col(f"{p}xmin") <= F.col(f"{p}xmax")) & (F.col(f"{p}ymin") <= F.col(f"{p}ymax")))
    lefts, rights = whole(left, a).select(key, *sides(a)), whole(right, b).select(*sides(b))
    total = rights.count()
    if not total:
        return lefts.select(key, F.lit(0).cast("long").alias("n")).limit(0)
    digits = {}
    for axis in "xy":
        lefts, rights, most = _ranked(lefts, rights, a, b, axis)
        digits[axis] = _digits(most)
    # Not beyond one side but anywhere along the other axis is beyond place 0 there.
    corner = lambda k, x, y, sign: F.struct(F.lit(k).alias("corner"), x.alias("x"), y.alias("y"), F.lit(sign).alias("sign"))
    of = lambda axis, side: F.col(f"__{axis}{side}").cast("long")
    none = F.lit(0).cast("long")
    corners = [corner(2 * i + j, of("x", s), of("y", t), 1) for i, s in enumerate(SIDES) for j, t in enumerate(SIDES)]
    alone = [corner(2 * i, of("x", s), none, -1) for i, s in enumerate(SIDES)] + [corner(j, none, of("y", t), -1) for j, t in enumerate(SIDES)]
    places = [f"__{axis}{side}" for axis in "xy" for side in SIDES]
    boxes = rights.groupBy(*places).agg(F.count("*").alias("copies"))
    cells = checkpointed(_in_cells(boxes, corners, digits).groupBy(*GROUP, "at").agg(F.sum("copies").alias("n")))
    queries = _in_cells(lefts.select(key, *places), corners + alone, digits).select(key, "c.sign", *GROUP, "at")
    asked = checkpointed(queries.select(*GROUP, "at").distinct())
    # Groups go to lots of about ``LOT`` cells; where only one side has cells there is nothing to count.
    lots = max(cells.sparkSession.sparkContext.defaultParallelism, -(-(cells.count() + asked.count()) // LOT))
    dealt = lambda df: df.withColumn("lot", F.pmod(F.xxhash64(*GROUP), F.lit(lots))).groupBy("lot")
    found = dealt(cells).cogroup(dealt(asked)).applyInPandas(_beyond(digits["x"][1], digits["y"][1]), "level int, px long, py long, at int, n long")
    missed = queries.join(checkpointed(found), [*GROUP, "at"]).groupBy(key).agg(F.sum(F.col("sign") * F.col("n")).alias("__n"))
    known = lefts.groupBy(key).agg(F.count("*").alias("__rows")).join(missed, key, "left")
    return known.select(key, (F.col("__rows") * total + F.coalesce("__n", F.lit(0))).alias("n")).where("n > 0")


def _runs(ids: DataFrame) -> list:
    """Ends of runs of ids ``v`` from the least on, each of some ``FAN`` times as many as those before it; the last run has no end."""
    ends, before = [], None
    while True:
        at, n = ids.agg(F.percentile_approx("v", 1.0 / FAN), F.count("*")).first()
        if n <= FIRST * FAN or n == before:
            return ends[::-1]
        ends.append(at)
        ids, before = ids.where(F.col("v") <= at), n


def _least_met(left: DataFrame, right: DataFrame, a: str, b: str, key: str, least: Column, size: float) -> DataFrame:
    """``key, v``: the smallest ``least`` of the right boxes that each left box meets; every one meets some."""
    right = right.withColumn("v", least)
    ends, found, rest = _runs(right.select("v")), None, left
    for low, high in zip([None, *ends], [*ends, None]):
        run = right.where((F.lit(True) if low is None else F.col("v") > low) & (F.lit(True) if high is None else F.col("v") <= high))
        met = checkpointed(box_join(rest, run, a, b, size).groupBy(key).agg(F.min("v").alias("v")))
        found = met if found is None else found.unionByName(met)
        rest = checkpointed(rest.join(met, key, "left_anti"))
        if high is None or rest.isEmpty():
            return found


def summed_up(left: DataFrame, right: DataFrame, a: str, b: str, key: str, id_col: str, size: float, pairs: int = PAIRS) -> DataFrame:
    """``key, n, first, last``: how many right boxes each left box overlaps or touches, the least and greatest ``id_col`` (a whole number) of these.

    Left boxes that meet none have no row. Up to ``pairs`` pairs in all are made as they are. ``size`` should suit most boxes.
    """
    n = checkpointed(counts_met(left, right, a, b, key))
    if (n.agg(F.sum("n")).first()[0] or 0) <= pairs:
        return box_join(left, right, a, b, size).groupBy(key).agg(F.count("*").alias("n"), F.min(id_col).alias("first"), F.max(id_col).alias("last"))
    meeting = checkpointed(left.join(n.select(key), key, "left_semi"))
    first = _least_met(meeting, right, a, b, key, F.col(id_col), size).withColumnRenamed("v", "first")
    last = _least_met(meeting, right, a, b, key, -F.col(id_col), size).select(key, (-F.col("v")).alias("last"))
    return n.join(first, key).join(last, key)
