"""Operators that depend on order: islands, continuation, as-of and band joins, page ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finquill.operators import scan


def islands(rows: DataFrame, keys: list[str], order: list[str], position: str, gap: float) -> DataFrame:
    """A group number that grows wherever the step in ``position`` exceeds ``gap``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    step = F.coalesce((F.abs(F.col(position) - F.lag(position).over(w)) > gap).cast("int"), F.lit(0))
    return rows.withColumn("__step", step).withColumn("row_group", F.sum("__step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__step")


def merge_continuations(rows: DataFrame, keys: list[str], order: list[str], is_continuation: Column) -> DataFrame:
    """Pairs a row with a following continuation; rows that are consumed don't pair again.

    In a run of continuations every second one starts a new pair, so the place in the run
    decides: no loop over rows.  Continuations before any other row pair among themselves.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = rows.withColumn("__cont", F.coalesce(is_continuation, F.lit(False)).cast("int"))
    rows = rows.withColumn("__run", F.sum(1 - F.col("__cont")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(Window.partitionBy(*keys, "__run").orderBy(*order))
    rows = rows.withColumn("__place", place - 1)
    return rows.withColumn("consumed", F.col("__place") % 2 == 1).drop("__cont", "__run", "__place")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, target: int = scan.TARGET) -> DataFrame:
    """For each left row the last ``value`` of right at or before it: one union and one scan, no range join.

    A key of more than ``target`` rows is split over tasks (see ``scan``).
    """
    a = left.select(*keys, at, *[c for c in left.columns if c not in (*keys, at)], F.lit(None).cast(right.schema[value].dataType).alias("__v"), F.lit(1).alias("__side"))
    missing = [F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns if c not in (*keys, at)]
    b = right.select(*keys, at, *missing, F.col(value).alias("__v"), F.lit(0).alias("__side"))
    rows = scan.with_slices(a.unionByName(b), keys, at, target)
    return scan.with_last(rows, keys, at, "__v", f"last_{value}", ["__side", "__v"]).where("__side = 1").drop("__v", "__side", "__slice")


def band_join(left: DataFrame, right: DataFrame, a: str, b: str, width: int) -> DataFrame:
    """Rows with |a - b| < width: a left row is in one bucket of twice the width, a right one in the one or two that its band touches."""
    near = left.withColumn("__bucket", F.floor(F.col(a) / (2 * width)))
    far = right.withColumn("__bucket", F.explode(F.array_distinct(F.array(*[F.floor((F.col(b) + k) / (2 * width)) for k in (-width, width)]))))
    return near.join(far, "__bucket").where(F.abs(F.col(a) - F.col(b)) < width).drop("__bucket")


def band_differences(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, width: int) -> DataFrame:
    """Distinct (keys, diff) with diff = a - b of rows (keys[0], a) and (keys[1], b) with |a - b| < width.

    Both sides are made distinct before they meet.  A right key with one value can't give a
    difference twice, so the pairs, of which there may be many more than rows, aren't
    shuffled for that; only those of right keys with several values are.
    """
    one, other = left.select(keys[0], a).distinct(), right.select(keys[1], b).distinct()
    ends = other.groupBy(keys[1]).agg(F.min(b).alias(b), F.max(b).alias("__last"))
    several = other.join(ends.where(F.col(b) < F.col("__last")).select(keys[1]), keys[1])

    def met(some: DataFrame) -> DataFrame:
        return band_join(one, some, a, b, width).select(*keys, (F.col(a) - F.col(b)).alias("diff"))

    return met(ends.where(F.col(b) == F.col("__last")).drop("__last")).unionByName(met(several).distinct())


def trim_range(rows: DataFrame, keys: list[str], page: str, low: Column, high: Column) -> DataFrame:
    """Rows in [low, high]; all rows of a key that has none there."""
    inside = (F.col(page) >= F.coalesce(low, F.lit(1))) & (high.isNull() | (F.col(page) <= high))
    has = F.max(inside.cast("int")).over(Window.partitionBy(*keys))
    return rows.withColumn("__in", inside).withColumn("__any", has).where("__in or __any = 0").drop("__in", "__any")
