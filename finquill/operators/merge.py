"""Selecting records across documents, chunks and years."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finquill.operators.containment import both_ways


def best_of_documents(values: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: known value, primary first, higher confidence, earlier document.

    ``max_by`` over a struct is a partial aggregate: no sort, and a hot key is
    combined before the shuffle.
    """
    rows = values.where("value is not null and fy is not null and fy <> 'unknown'")
    rank = F.struct(F.col("is_primary"), F.coalesce("confidence", F.lit(0.0)), -F.col("doc_ord"))
    best = F.max_by(F.struct("value", "confidence", "doc_ord", "is_primary"), rank).alias("b")
    return rows.groupBy(*keys).agg(best).select(*keys, "b.value", "b.confidence", "b.doc_ord", "b.is_primary")


def best_of_chunks(values: DataFrame, keys: list[str]) -> DataFrame:
    """Highest positive confidence, first chunk on ties."""
    rows = values.where("value is not null and confidence > 0")
    best = F.max_by(F.struct("value", "confidence", "chunk_ord"), F.struct(F.col("confidence"), -F.col("chunk_ord"))).alias("b")
    return rows.groupBy(*keys).agg(best).select(*keys, "b.value", "b.confidence", "b.chunk_ord")


def scaffold(found: DataFrame, fields: DataFrame, companies: DataFrame, years: DataFrame) -> DataFrame:
    """Every company, field and year, with the value found or null; dimensions are small tables."""
    frame = companies.crossJoin(years).crossJoin(fields)
    return frame.join(found, ["company", "field", "fy"], "left")


def financial_years(values: DataFrame) -> DataFrame:
    return values.where("fy <> 'unknown'").select("fy").distinct().orderBy(F.split("fy", "-")[0].cast("int"), "fy")


def first_of_labels(items: DataFrame, partition: list[str], order: list[str]) -> DataFrame:
    """The first row of each label, whatever its case."""
    w = Window.partitionBy(*partition, F.lower(F.trim("label"))).orderBy(*order)
    return items.where("trim(label) <> ''").withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def unmapped(items: DataFrame, terms: DataFrame) -> DataFrame:
    """Labels that neither contain nor are contained in a known term of four letters or more."""
    known = terms.select(F.lower("term").alias("__t")).where("length(__t) >= 4").distinct()
    rows = items.withColumn("__label", F.lower(F.trim("label"))).where("__label <> ''")
    return rows.join(both_ways(rows, "__label", known, "__t").select("__label").distinct(), "__label", "left_anti").select(*items.columns)
