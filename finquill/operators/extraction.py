"""A document from its pages to its fields: candidates, the rule extractor, a second pass, and what is known about it.

Fields without a match are there with null values; documents without candidates have all fields
null; null documents are one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finquill.operators import extract
from finquill.operators.candidates import document_metadata, page_candidates, parsed
from finquill.sources.steps import written

_USED = ("doc", "page", "kind", "table_no", "row_no", "item_no", "label", "current_value", "previous_value")


def _framed(pages: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Every document of the pages with every field; the catalogue is a short table."""
    every = catalogue.select("field").distinct().groupBy().agg(F.collect_set("field").alias("__fields"))
    return pages.select("doc").distinct().join(F.broadcast(every), F.lit(True)).select("doc", F.explode("__fields").alias("field"))


def document_fields(pages: DataFrame, terms: DataFrame, catalogue: DataFrame, learned: DataFrame | None = None, parts: DataFrame | None = None) -> DataFrame:
    """(doc, field, current, previous, from_second) of pages (doc, page, text).

    The first candidate of a field's terms (field, term) gives its values: by page, tables before lines, in their
    order.  Fields without any are looked for again with ``learned`` terms.  Both are found in one aggregate, without sorting a
    document's candidates.  The candidates and the labels' fields, and the pages' ``parts`` if they aren't given, are written
    once (``steps.clear`` deletes them).
    """
    parts = parsed(pages) if parts is None else parts
    candidates = written(page_candidates(pages, parts).select(*_USED), "candidates")
    known = terms.select("field", "term", F.lit(False).alias("again"))
    if learned is not None:
        known = known.unionByName(learned.select("field", "term", F.lit(True).alias("again")))
    known = known.join(catalogue.select("field"), "field", "left_semi")
    # labels' fields are few and their size is known once they are written, so candidates aren't dealt by label
    fields = written(extract.label_fields(candidates, known, ["field", "again"]), "label-fields", result=False)
    at = F.struct("page", (F.col("kind") == "line").alias("prose"), "table_no", "row_no", "item_no", "label", "current_value", "previous_value").alias("at")
    found = candidates.select("doc", F.lower("label").alias("__label"), at).join(fields, "__label").select("doc", "field", "again", "at")
    rows = found.unionByName(_framed(parts, catalogue).withColumn("again", F.lit(None).cast("boolean")), allowMissingColumns=True)

    def first(again: bool) -> Column:
        return F.min(F.when(F.col("again") == again, F.col("at")))

    def number(which: str, c: str) -> Column:
        return extract.bare_number(F.col(f"{which}.{c}_value"))

    one = rows.groupBy("doc", "field").agg(first(False).alias("__one"), first(True).alias("__two"))
    one = one.select("doc", "field", *(number(f"__{w}", c).alias(f"__{w}_{c}") for w in ("one", "two") for c in ("current", "previous")))
    empty = F.col("__one_current").isNull() & F.col("__one_previous").isNull()
    values = [F.when(empty, F.col(f"__two_{c}")).otherwise(F.col(f"__one_{c}")).alias(c) for c in ("current", "previous")]
    return one.select("doc", "field", *values, (empty & F.coalesce("__two_current", "__two_previous").isNotNull()).alias("from_second"))


def document_summary(pages: DataFrame, fields: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """One row a document: years, pages processed and rejected, fields found, all fields, coverage in percent with one decimal."""
    return document_metadata(pages, parts).join(extract.coverage(fields), "doc", "left")
