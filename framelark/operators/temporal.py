"""Joins on time that stay parallel inside one hot key: points in intervals, and the row before or after.

A key's time is cut into cells. Rows meet inside their cell, so a key that holds a third of
all rows is as many tasks as it has cells; what crosses a cell border is one row per cell.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def _same(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    return reduce(and_, [left[c].eqNullSafe(right[f"_r_{c}"]) for c in columns])


def interval_join(
    points: DataFrame, intervals: DataFrame, keys: list[str], time: str, start: str, end: str, cell: float, how: str = "inner"
) -> DataFrame:
    """Every point with every interval of its keys that holds it (``start <= time < end``); all columns of both.

    An interval stands in each ``cell`` that it touches, a point in one, so a pair meets exactly once.
    Take ``cell`` near the usual length of an interval. Null times and bounds, empty and
    reversed intervals match nothing (points without a match stay with ``how="left"``); null keys are equal. Columns of
    ``intervals`` that points have too, keys apart, must be renamed before.
    """
    at = lambda c: F.floor(F.col(c).cast("double") / cell).cast("bigint")
    # The end is left out, so an interval that ends on a border does not reach the next cell's points.
    spread = intervals.filter(F.col(start) < F.col(end)).withColumn("_cell", F.explode(F.sequence(at(start), at(end))))
    spread = spread.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in spread.columns if c != "_cell"], F.col("_cell").alias("_r__cell"))
    left = points.withColumn("_cell", at(time))
    on = _same(left, spread, keys) & (left["_cell"] == spread["_r__cell"]) & (left[time] >= spread[start]) & (left[time] < spread[end])
    drop = ["_cell", "_r__cell", *[f"_r_{k}" for k in keys]]
    return left.join(spread, on, how).drop(*drop)


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    time: str,
    right_time: str,
    columns: list[str],
    cell: float,
    direction: str = "backward",
    tolerance: float | None = None,
) -> DataFrame:
    """Every left row with ``right_time`` and ``columns`` of the right row nearest to it in time, or nulls.

    ``backward``: the last right row at or before it; ``forward``: the first at or after it;
    ``nearest``: the closer of both, the earlier one when they are equally close. Right rows at one
    time: the one with the largest ``columns``. Beyond ``tolerance`` there is no match. Rows with a null time
    match nothing; null keys are equal. Left rows stay as they are, repeated ones too.
    """
    if direction == "nearest":
        back = asof_join(left, right, keys, time, right_time, columns, cell, "backward", tolerance)
        names = [right_time, *columns]
        packed = back.select(*left.columns, F.when(F.col(right_time).isNotNull(), F.struct(*names)).alias("_back"))
        ahead = asof_join(packed, right, keys, time, right_time, columns, cell, "forward", tolerance)
        before = F.col(time).cast("double") - F.col("_back").getField(right_time).cast("double")
        after = F.col(right_time).cast("double") - F.col(time).cast("double")
        first = F.coalesce(before <= after, F.col("_back").isNotNull())
        pick = F.when(first, F.col("_back")).otherwise(F.struct(*names))
        return ahead.select(*left.columns, pick.alias("_pick")).select(*left.columns, *[F.col("_pick").getField(n).alias(n) for n in names])
    sign = {"backward": 1, "forward": -1}[direction]
    clock = lambda c: F.col(c).cast("double") * sign
    row = F.struct(*[F.col(c) for c in left.columns])
    found = F.struct(clock(right_time).alias("t"), F.struct(*columns).alias("v"), F.col(right_time).alias("at"))
    l = left.select(*keys, clock(time).alias("_t"), row.alias("_row"), F.lit(None).cast(right.select(found).schema[0].dataType).alias("_hit"))  # noqa: E741
    r = right.filter(F.col(right_time).isNotNull()).select(*keys, clock(right_time).alias("_t"), F.lit(None).cast(left.select(row).schema[0].dataType).alias("_row"), found.alias("_hit"))
    both = l.unionByName(r).withColumn("_cell", F.floor(F.col("_t") / cell).cast("bigint"))
    # The newest right row of each cell, then of all cells before it: one row per cell.
    cells = both.groupBy(*keys, "_cell").agg(F.max("_hit").alias("_newest"))
    earlier = W.partitionBy(*keys).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    carried = cells.select(*[F.col(c).alias(f"_r_{c}") for c in [*keys, "_cell"]], F.max("_newest").over(earlier).alias("_carry"))
    inside = W.partitionBy(*keys, "_cell").orderBy("_t").rangeBetween(W.unboundedPreceding, 0)  # equal times count
    met = both.join(carried, _same(both, carried, [*keys, "_cell"])).withColumn("_best", F.greatest(F.max("_hit").over(inside), F.col("_carry")))
    ok = F.col("_t").isNotNull()
    if tolerance is not None:
        ok &= F.col("_t") - F.col("_best.t") <= tolerance
    best = F.when(ok, F.col("_best"))
    out = met.filter("_row IS NOT NULL").select("_row.*", best.alias("_best"))
    return out.select(*left.columns, F.col("_best.at").alias(right_time), *[F.col("_best.v").getField(c).alias(c) for c in columns])
