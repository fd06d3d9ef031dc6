"""Data-quality rules.  Each gives one row per finding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finquill.operators import scan

from finquill.functions.scalars import pct_difference

TOLERANCE = 0.02
HIGH = 0.05
UNIT_SPREAD = 10_000
LOW_CONFIDENCE = 0.75


def accounting_identity(st: DataFrame) -> DataFrame:
    """Assets against liabilities and net worth, within TOLERANCE."""
    total = F.col("current_liabilities") + F.col("term_liabilities") + F.col("net_worth")
    diff = F.round(pct_difference(F.col("total_assets"), total), 4)
    severity = F.when(diff > HIGH, "high").when(diff > TOLERANCE, "medium").otherwise("passed")
    return st.where(F.col("total_assets").isNotNull() & total.isNotNull()).select("company", "fy", diff.alias("diff"), severity.alias("severity"))


def sign_check(st: DataFrame) -> DataFrame:
    return st.where("net_sales < 0").select("company", "fy", "net_sales")


def profit_consistency(st: DataFrame) -> DataFrame:
    kind = F.when((F.col("pbt") > 0) & (F.col("pat") > F.col("pbt") * 1.1), "pat_above_pbt").when((F.col("pbt") < 0) & (F.col("pat") > 0), "loss_but_pat")
    return st.select("company", "fy", kind.alias("finding")).where("finding is not null")


def unit_spread(st: DataFrame, fields: list[str]) -> DataFrame:
    """Largest to smallest positive key value above UNIT_SPREAD."""
    positive = F.filter(F.array(*[F.col(f) for f in fields]), lambda v: v > 0)
    spread = F.try_divide(F.array_max(positive), F.array_min(positive))
    return st.select("company", "fy", F.when(F.size(positive) >= 2, spread).alias("spread")).where(F.col("spread") > UNIT_SPREAD).withColumn("spread", F.round("spread", 2))


def low_confidence(values: DataFrame) -> DataFrame:
    return values.where(F.col("value").isNotNull() & (F.col("confidence") < LOW_CONFIDENCE))


def is_close(a: Column, b: Column, absolute: float = 1.0) -> Column:
    return F.abs(a - b) <= F.greatest(1e-9 * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))


def repeated_rows(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Every repeat after the first of equal keys (null equals null)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("repeat_no", F.row_number().over(w)).where("repeat_no > 1")


def balance_progression(rows: DataFrame, account: str, target: int = scan.TARGET) -> DataFrame:
    """Rows (account, idx, balance, credit, debit; cents) that break the running balance.

    The direction of each statement is what more of its rows agree with, ascending on a
    tie.  An account of more than ``target`` rows is split over tasks (see ``scan``).
    """
    sliced = scan.with_slices(rows.select(account, "idx", "balance", "credit", "debit"), [account], "idx", target)
    both = scan.with_previous(sliced, [account], "idx", ["balance", "credit", "debit"], ["balance", "credit", "debit"])
    before = F.col("__before")
    both = both.withColumn("expected_up", before["balance"] + F.col("credit") - F.col("debit")).withColumn("expected_down", before["balance"] - before["credit"] + before["debit"])
    both = both.withColumns({f"{way}_ok": (F.abs(F.col("balance") - F.col(f"expected_{way}")) <= 100).cast("int") for way in ("up", "down")})
    both = scan.with_total(both, [account], {"ups": F.col("up_ok"), "downs": F.col("down_ok")})
    both = both.withColumn("ascending", F.coalesce("ups", F.lit(0)) >= F.coalesce("downs", F.lit(0)))
    wrong = F.when(F.col("ascending"), F.col("up_ok")).otherwise(F.col("down_ok")) == 0
    expected = F.when(F.col("ascending"), F.col("expected_up")).otherwise(F.col("expected_down"))
    return both.where(wrong).select(account, "idx", "balance", expected.alias("expected"), "ascending")


def field_confidence(values: DataFrame, issues: DataFrame) -> DataFrame:
    """Base confidence by whether there is a value, lowered to the least confident issue."""
    worst = issues.groupBy("doc_id", "field").agg(F.min("confidence").alias("worst"))
    base = F.when(F.col("value").isNotNull() & (F.col("value") != ""), 0.95).otherwise(0.0)
    return values.join(worst, ["doc_id", "field"], "left").select("doc_id", "field", F.least(base, F.coalesce("worst", F.lit(1.0))).alias("confidence"))
