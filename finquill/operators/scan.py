"""Values of the row before, and the last known ones, where one key may hold most of the rows.

A window over a key puts all of its rows into one task.  Here keys of more than ``target`` rows are cut into
slices of equal width of the order column; windows run over (key, slice), and what a slice hands on
to the next (one row a slice) is carried over by a window over the slices and joined by (key, slice), which no key
makes hot.  Slices are as even as the order column is: row numbers give even ones.

The cut depends on counts, least and greatest values alone, so it is the same whenever it is computed anew.  Null
keys are one key; null order values come first and are in the first slice; rows of equal order are taken by the columns of ``ties``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType

#: Rows that one task takes of a key.
TARGET = 1_000_000
#: No key is cut into more slices.
MOST = 10_000


def _same(left: DataFrame, right: DataFrame, names: list[str], mark: str) -> Column:
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[f"{mark}{n}"]) for n in names])


def _joined(left: DataFrame, right: DataFrame, names: list[str], how: str = "left") -> DataFrame:
    """``right`` to ``left`` by names, null to null."""
    mark = "__r_"
    renamed = right.withColumnsRenamed({n: f"{mark}{n}" for n in names})
    return left.join(renamed, _same(left, renamed, names, mark), how).drop(*[f"{mark}{n}" for n in names])


def _number(rows: DataFrame, order: str) -> Column | None:
    """A number that grows with the order column; None if its type has none."""
    kind = rows.schema[order].dataType
    if isinstance(kind, NumericType | TimestampType):
        return F.col(order).cast("double")
    if isinstance(kind, DateType):
        return F.unix_date(order).cast("double")
    if isinstance(kind, TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{order}`)").cast("double")
    return None


def with_slices(rows: DataFrame, keys: list[str], order: str, target: int = TARGET) -> DataFrame:
    """``__slice`` of each row: 0 but in keys of more than ``target`` rows, and where the order has no numbers (texts)."""
    x = _number(rows, order)
    if x is None:
        return rows.withColumn("__slice", F.lit(0).cast("long"))
    stats = rows.groupBy(*keys).agg(F.count("*").alias("__n"), F.min(x).alias("__low"), F.max(x).alias("__high")).where(F.col("__n") > target)
    out = _joined(rows, stats, keys)
    slices = F.least(F.ceil(F.col("__n") / target), F.lit(MOST))
    at = F.floor((x - F.col("__low")) * slices / F.nullif(F.col("__high") - F.col("__low"), F.lit(0.0)))
    return out.withColumn("__slice", F.when(at.isNotNull(), F.greatest(F.lit(0), F.least(slices - 1, at))).otherwise(0).cast("long")).drop("__n", "__low", "__high")


def with_previous(rows: DataFrame, keys: list[str], order: str, columns: list[str], ties: list[str] | None = None) -> DataFrame:
    """``__before``: ``columns`` of the row before, as a struct (null at the first row); rows have ``__slice``."""
    by = [order, *(ties or [])]
    inner = Window.partitionBy(*keys, "__slice").orderBy(*by)
    own = F.struct(*columns)
    out = rows.withColumn("__before", F.lag(own).over(inner)).withColumn("__first", F.row_number().over(inner) == 1)
    # the last row of a slice: nulls of the order come first, as in the window
    rank = F.struct(*[x for b in by for x in (F.col(b).isNotNull().alias(f"{b}_known"), F.col(b))])
    last = rows.groupBy(*keys, "__slice").agg(F.max_by(own, rank).alias("__last"))
    carried = last.withColumn("__carry", F.lag("__last").over(Window.partitionBy(*keys).orderBy("__slice"))).drop("__last")
    out = _joined(out, carried, [*keys, "__slice"])
    return out.withColumn("__before", F.when(F.col("__first"), F.col("__carry")).otherwise(F.col("__before"))).drop("__first", "__carry")


def with_last(rows: DataFrame, keys: list[str], order: str, value: str, out: str, ties: list[str] | None = None) -> DataFrame:
    """``out``: the last ``value`` that isn't null, at the row or before it; rows have ``__slice``."""
    by = [order, *(ties or [])]
    inner = Window.partitionBy(*keys, "__slice").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    rank = F.struct(*[x for b in by for x in (F.col(b).isNotNull().alias(f"{b}_known"), F.col(b))])
    here = rows.withColumn("__here", F.last(value, ignorenulls=True).over(inner))
    last = rows.groupBy(*keys, "__slice").agg(F.max_by(value, F.when(F.col(value).isNotNull(), rank)).alias("__last"))
    before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.withColumn("__carry", F.last("__last", ignorenulls=True).over(before)).drop("__last")
    return _joined(here, carried, [*keys, "__slice"]).withColumn(out, F.coalesce("__here", "__carry")).drop("__here", "__carry")


def with_total(rows: DataFrame, keys: list[str], totals: dict[str, Column]) -> DataFrame:
    """Sums over a key, added up by slice first and joined by (key, slice); rows have ``__slice``."""
    parts = rows.groupBy(*keys, "__slice").agg(*[F.sum(c).alias(f"__p_{n}") for n, c in totals.items()])
    whole = Window.partitionBy(*keys)
    summed = parts.select(*keys, "__slice", *[F.sum(f"__p_{n}").over(whole).alias(n) for n in totals])
    return _joined(rows, summed, [*keys, "__slice"])
