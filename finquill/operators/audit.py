"""Tracing of injected values back to the text of their document.

Values and texts meet by document, so a document's numbers and renderings are compared in one row;
null texts hold no number and null values are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of field names that say nothing about the context.
NOISE = ("of", "the", "a", "an", "in", "on", "for", "and", "&", "from", "to", "total", "net")


def numbers_in(text: Column) -> Column:
    """All distinct numbers of a text, without thousands separators; those in parentheses also negative."""
    text = F.coalesce(text, F.lit(""))
    plain = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in (r"[\d,]+\.\d+", r"\d+\.\d+", r"[\d,]+")])
    inside = F.regexp_extract_all(text, F.lit(r"\((\d[\d,]*\.?\d*)\)"), F.lit(1))

    def numbers(found: Column) -> Column:
        bare = F.transform(found, lambda x: F.regexp_replace(x, ",", ""))
        return F.transform(F.filter(bare, lambda x: x.rlike(r"\d")), lambda x: x.try_cast("double"))

    return F.array_distinct(F.concat(numbers(plain), numbers(inside), F.transform(numbers(inside), lambda x: -x)))


def renderings(value: Column) -> Column:
    """How an amount may stand in a text: with two decimals or, if whole, none; with or without thousands separators."""
    a = F.abs(value)
    forms = F.array(F.format_string("%.2f", a), F.format_number(a, 2))
    whole = F.array(F.format_string("%d", F.floor(a)), F.format_number(F.floor(a), 0))
    return F.array_distinct(F.when(a == F.floor(a), F.concat(forms, whole)).otherwise(forms))


def occurs(value: Column, text: Column) -> Column:
    return F.exists(renderings(value), lambda f: F.coalesce(text, F.lit("")).contains(f))


def context_words(field: Column) -> Column:
    return F.array_except(F.split(F.lower(field), r"\s+"), F.array(*[F.lit(w) for w in NOISE]))


def trace(rows: DataFrame) -> DataFrame:
    """``rows`` (value, text, formula, is_override, evidence) with status.

    The order of the rules: formulas, overrides, values found as they are, values near a number of
    the text, computed values, the rest.
    """
    found = occurs(F.col("value"), F.col("text"))
    near = F.exists(numbers_in(F.col("text")), lambda n: (F.abs(n - F.abs(F.col("value"))) < 0.05) & (n != 0))
    override = F.when(found, "OVERRIDE_VERIFIED").otherwise("OVERRIDE_UNVERIFIED")
    status = (
        F.when(F.col("formula").isNotNull(), "FORMULA")
        .when(F.col("is_override"), override)
        .when(found, "VERIFIED")
        .when(near, "ROUNDING_MISMATCH")
        .when(F.contains(F.coalesce("evidence", F.lit("")), F.lit("[COMPUTED]")), "COMPUTED")
        .otherwise("NOT_FOUND")
    )
    return rows.where("value is not null or formula is not null").withColumn("status", status)


def value_pattern(value: Column) -> Column:
    """A pattern for a whole amount with or without thousands separators."""
    digits = F.format_string("%d", F.floor(F.abs(value)))
    return F.concat(F.lit(r"(^|[^0-9])"), F.regexp_replace(digits, r"(\d)(?=(\d{3})+$)", "$1,?"), F.lit(r"([^0-9]|$)"))


def with_confidence(rows: DataFrame, sheet_map: DataFrame, values: DataFrame, years: list[str]) -> DataFrame:
    """``rows`` (row_no) with field, confidence and evidence of the first of ``years`` that the field has."""
    rank = F.array_position(F.array(*[F.lit(y) for y in years]), F.col("fy"))
    best = values.where(F.col("fy").isin(*years)).groupBy("section", "field").agg(F.min_by(F.struct("confidence", "evidence"), rank).alias("b"))
    named = rows.join(sheet_map.select("row_no", "section", "field"), "row_no", "left")
    return named.join(best, ["section", "field"], "left").select(*rows.columns, "field", "b.confidence", "b.evidence")
