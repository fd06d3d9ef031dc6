"""Checks of documents and statements, each as a column expression, one aggregate or one window.

Values that are null take part in no check; a frame without rows gives no issues.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finquill.functions.scalars import is_currency, is_date, is_float, pct_difference

TOLERANCE = 1.0
#: Below this variance of the Laplacian a page is too blurry.
BLUR = 15.0
# Fields by the type that their values must have.
DATE_FIELDS = ("invoice_date", "date", "po_date")
FLOAT_FIELDS = ("subtotal", "cgst", "sgst", "igst", "total_tax", "grand_total", "tax", "total")
STRING_FIELDS = ("invoice_number", "vendor_name", "vendor_gstin", "customer_name", "customer_gstin", "merchant_name", "receipt_number", "bank_name", "account_number", "statement_period", "po_number", "buyer_name", "report_name", "period")
ITEM_FLOATS, TRANSACTION_FLOATS = ("quantity", "unit_price", "amount"), ("debit", "credit", "balance")


def close(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(tolerance), 1e-9 * F.greatest(F.abs(a), F.abs(b)))


def amount_mismatch(subtotal: Column, tax: Column, total: Column) -> Column:
    """Whether subtotal and tax don't make the total; only where subtotal and total are there and not 0."""
    known = (F.coalesce(subtotal, F.lit(0.0)) != 0) & (F.coalesce(total, F.lit(0.0)) != 0)
    return known & ~close(subtotal + F.coalesce(tax, F.lit(0.0)), total)


def invoice_tax(total_tax: Column, *parts: Column) -> Column:
    """The total tax, or without one the sum of its parts."""
    whole = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))
    return F.coalesce(F.nullif(total_tax, F.lit(0.0)), whole)


def typed_issues(fields: DataFrame) -> DataFrame:
    """(doc, part, key, status, confidence) of values of the wrong type.

    ``fields`` has doc, part (document, line_item or transaction), key, value (text) and is_text
    (whether the value was a string); empty values are of any type.
    """
    key, value, part = F.col("key"), F.col("value"), F.col("part")
    bad_date, bad_float, not_text = ~is_date(value), ~is_float(value), ~F.col("is_text")
    on_document = (
        F.when(key.isin(*DATE_FIELDS), F.when(bad_date, 0.3)).when(key.isin(*FLOAT_FIELDS), F.when(bad_float, 0.3)).when(key.isin(*STRING_FIELDS), F.when(not_text, 0.3)).when(key == "currency", F.when(~is_currency(value), 0.4))
    )
    on_item = F.when(key == "description", F.when(not_text, 0.5)).when(key.isin(*ITEM_FLOATS), F.when(bad_float, 0.5))
    on_transaction = F.when(key == "date", F.when(bad_date, 0.4)).when(key.isin(*TRANSACTION_FLOATS), F.when(bad_float, 0.4)).when(key == "description", F.when(not_text, 0.5))
    confidence = F.when(part == "document", on_document).when(part == "line_item", on_item).when(part == "transaction", on_transaction)
    rows = fields.where(value.isNotNull() & (value != "")).select("doc", "part", "key", F.lit("invalid_type").alias("status"), confidence.alias("confidence"))
    return rows.where("confidence is not null")


def missing_fields(fields: DataFrame, required: DataFrame, optional: list[str]) -> DataFrame:
    """doc and the required fields (joined) that have no value, but for optional ones."""
    wanted = required.where(~F.col("field").isin(*optional))
    have = fields.where("value is not null").select("doc", "field").distinct()
    gaps = fields.select("doc").distinct().join(wanted).join(have, ["doc", "field"], "left_anti")
    return gaps.groupBy("doc").agg(F.array_join(F.array_sort(F.collect_list("field")), ", ").alias("missing"))


def assets_passed(current: Column, net_block: Column, total: Column, limit: float = 0.15) -> Column:
    """Whether current assets and the net block come near total assets (a check that can only pass)."""
    return F.coalesce(pct_difference(current + net_block, total) <= limit, F.lit(False))


def issues_of(warnings: DataFrame, units: DataFrame, low: DataFrame) -> DataFrame:
    """(doc, field, status, confidence) of a statement's warnings, unit warnings and values of low confidence."""
    a = warnings.select("doc", F.lit("cma_data").alias("field"), F.col("check").alias("status"), F.when(F.col("severity") == "high", 0.4).otherwise(0.6).alias("confidence"))
    b = units.select("doc", F.lit("cma_data").alias("field"), F.lit("unit_mismatch").alias("status"), F.lit(0.5).alias("confidence"))
    c = low.select("doc", F.concat_ws(".", "section", "field").alias("field"), F.lit("low_confidence").alias("status"), "confidence")
    return a.unionByName(b).unionByName(c)


def summary(issues: DataFrame, passed: DataFrame) -> DataFrame:
    """Numbers of warnings, low confidences, unit warnings and passed checks of each document; one union, one aggregate."""
    kind = F.when(F.col("status") == "low_confidence", "low").when(F.col("status") == "unit_mismatch", "unit").otherwise("warning")
    rows = issues.select("doc", kind.alias("kind")).unionByName(passed.select("doc", F.lit("passed").alias("kind")))
    return rows.groupBy("doc").agg(*[F.count_if(F.col("kind") == k).alias(n) for k, n in (("warning", "n_warnings"), ("low", "n_low_confidence"), ("unit", "n_unit_warnings"), ("passed", "n_passed"))])


def laplacian(pixels: DataFrame) -> DataFrame:
    """img and score: the population variance of the Laplacian of pixels (img, y, x, v).

    Neighbours come from two windows, one along each axis; beyond an edge the pixel itself stands.
    """
    v = F.col("v").cast("double")
    along, across = Window.partitionBy("img", "y").orderBy("x"), Window.partitionBy("img", "x").orderBy("y")
    around = [F.coalesce(f(v).over(w), v) for w in (along, across) for f in (F.lag, F.lead)]
    rows = pixels.select("img", (around[0] + around[1] + around[2] + around[3] - 4 * v).alias("response"))
    return rows.groupBy("img").agg(F.var_pop("response").alias("score"))


def blurry(scores: DataFrame, keys: list[str], threshold: float = BLUR) -> DataFrame:
    """A document is too blurry only if all its pages are."""
    return scores.groupBy(*keys).agg(F.count("*").alias("checked_pages"), F.bool_and(F.col("score") < threshold).alias("blurry"))


def balance_sums(values: DataFrame, assets: list[str], liabilities: list[str], limit: float = 0.15) -> DataFrame:
    """Sums of the components of either side by company and year, their difference, and whether they balance."""
    side = [F.sum(F.when(F.col("field").isin(*names), F.col("value"))) for names in (assets, liabilities)]
    rows = values.groupBy("company", "fy").agg(*[F.coalesce(s, F.lit(0.0)).alias(n) for s, n in zip(side, ("assets", "liabilities"), strict=True)])
    rows = rows.withColumn("difference", F.round(F.abs(F.col("assets") - F.col("liabilities")), 2))
    return rows.withColumn("balanced", F.col("difference") < limit)
