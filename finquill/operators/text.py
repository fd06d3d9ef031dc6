"""Chunks, keyword scores, routing and labels of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finquill.functions.scalars import hits
from finquill.operators.pages import MAIN_STATEMENTS, PAGE_TYPES

CHUNK, OVERLAP = 6000, 1500

# Words that speak for a kind of document, in order of preference on ties.
DOCUMENT_WORDS = {
    "invoice": ["invoice", "tax invoice", "gstin", "cgst", "sgst", "igst", "invoice no"],
    "receipt": ["receipt", "paid", "payment received", "merchant", "cash memo"],
    "bank_statement": ["bank statement", "account number", "transaction", "debit", "credit", "balance"],
    "purchase_order": ["purchase order", "po number", "buyer", "ship to", "bill to"],
    "financial_report": ["profit and loss", "balance sheet", "financial report", "revenue", "assets"],
}
# Words of pages that are reports about statements.
REJECTED_PAGES = [
    "independent auditor", "auditor's report", "auditors' report", "auditors report", "caro report", "caro, 2016",
    "caro 2020", "directors' report", "directors report", "board's report", "board report", "corporate governance",
    "management discussion", "notice of annual general", "notice of agm", "proxy form", "attendance slip",
    "compliance certificate", "secretarial audit", "independent practitioner's report",
    "independent accountant's review report", "annexure a", "annexure b", "companies (auditor's report)",
    "companies (auditors report)", "annexure to",
]
#: Pages on which a document says its unit.
UNIT_PAGES = 15
# How documents say their unit, in order; the rest are in lakhs.
UNIT_WORDS = {
    "Crores": ["in crores", "rs. in crores", "₹ in crores", "rupees in crores", "(rs. crores)", "(₹ crores)", "amount in crore", "figures in crore"],
    "Thousands": ["in thousands", "rs. in thousands", "₹ in thousands"],
}
#: Words of the main statements; a page with one of them is kept.
STATEMENT_WORDS = [w for name in MAIN_STATEMENTS for w in PAGE_TYPES[name]]


def chunks(texts: DataFrame, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Overlapping windows; the last one ends with the text."""
    step = size - overlap
    n = F.greatest(F.lit(1), F.ceil((F.char_length("text") - size) / step) + 1).cast("int")
    each = texts.withColumn("chunk_idx", F.explode(F.sequence(F.lit(0), n - 1)))
    return each.withColumn("chunk", F.substring(F.col("text"), F.col("chunk_idx") * step + 1, F.lit(size)))


def document_chunks(pages: DataFrame, doc: str = "doc", page: str = "page", text: str = "text", size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc, chunk_idx, chunk): windows over all pages of a document in order, each under a line that names it.

    No document is put together as a whole: a page knows where it begins (a running sum of lengths) and gives
    each window its part.  Null texts are empty; pages of one number go by their texts.
    """
    step = size - overlap
    piece = F.concat(F.lit("\n=== Page "), F.col(page).cast("string"), F.lit(" ===\n"), F.coalesce(F.col(text), F.lit("")), F.lit("\n"))
    rows = pages.select(F.col(doc).alias("doc"), F.col(page).alias("__page"), piece.alias("__piece")).withColumn("__n", F.char_length("__piece").cast("long"))
    upto = Window.partitionBy("doc").orderBy("__page", "__piece").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__end", F.sum("__n").over(upto)).withColumn("__all", F.sum("__n").over(Window.partitionBy("doc"))).withColumn("__at", F.col("__end") - F.col("__n"))
    last = F.greatest(F.lit(1), F.ceil((F.col("__all") - size) / step) + 1) - 1
    low = F.greatest(F.lit(0), F.floor((F.col("__at") - size) / step) + 1)
    high = F.least(last, F.floor((F.col("__end") - 1) / step))
    rows = rows.where(low <= high).withColumn("chunk_idx", F.explode(F.sequence(low, high)))
    start = F.greatest(F.col("__at"), F.col("chunk_idx") * step)
    end = F.least(F.col("__end"), F.col("chunk_idx") * step + size)
    part = F.substring(F.col("__piece"), (start - F.col("__at") + 1).cast("int"), (end - start).cast("int"))
    parts = F.array_sort(F.collect_list(F.struct("__at", part.alias("p"))))
    return rows.groupBy("doc", "chunk_idx").agg(F.array_join(F.transform(parts, lambda x: x["p"]), "").alias("chunk"))


def document_unit(pages: DataFrame, doc: str = "doc", page: str = "page", text: str = "text", first: int = UNIT_PAGES) -> DataFrame:
    """(doc, unit) by the words for a unit on a document's first pages: Crores, else Thousands, else Lakhs."""
    order = Window.partitionBy(doc).orderBy(page, text)
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    near = pages.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= first)
    seen = [F.max(hits(low, words) > 0).alias(f"__{name}") for name, words in UNIT_WORDS.items()]
    unit_of = None
    for name in UNIT_WORDS:
        unit_of = F.when(F.col(f"__{name}"), name) if unit_of is None else unit_of.when(F.col(f"__{name}"), name)
    return near.groupBy(F.col(doc).alias("doc")).agg(*seen).select("doc", unit_of.otherwise("Lakhs").alias("unit"))


def relevance(text: Column, words: list[str], weight: int = 8) -> Column:
    return F.least(F.lit(100), F.lit(weight) * hits(text, words))


def top_chunks(scored: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best positive scores, earlier chunks first on ties."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "chunk_idx")
    return scored.where("score > 0").withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r")


def spread(rows: DataFrame, keys: list[str], idx: str, total: Column, k: int) -> DataFrame:
    """Evenly spaced rows: all if there are at most k, else those with idx = floor(i * n / k)."""
    first = F.ceil(F.col(idx) * k / total)
    return rows.where((total <= k) | (F.floor(first * total / k) == F.col(idx)) & (first < k))


def document_kind(text: Column) -> tuple[Column, Column]:
    """(kind or unknown, confidence); at least two words must speak for a kind."""
    scores = [F.struct(hits(text, words).alias("s"), F.lit(-k).alias("o"), F.lit(name).alias("kind")) for k, (name, words) in enumerate(DOCUMENT_WORDS.items())]
    best = F.array_max(F.array(*scores))
    known = best["s"] >= 2
    return F.when(known, best["kind"]).otherwise("unknown"), F.when(known, F.round(F.least(F.lit(0.95), 0.55 + 0.1 * best["s"]), 2)).otherwise(0.2)


def is_rejected_page(text: Column, rejected: list[str] = REJECTED_PAGES, kept: list[str] = STATEMENT_WORDS) -> Column:
    return (hits(text, rejected) > 0) & (hits(text, kept) == 0)


def unit(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.contains("crore"), "Crores").when(low.contains("thousand"), "Thousands").otherwise("Lakhs")


def year_mode(found: DataFrame, keys: list[str]) -> DataFrame:
    """The most frequent year; of equal ones that seen first."""
    n = found.groupBy(*keys, "year").agg(F.count("*").alias("n"), F.min("seen").alias("seen"))
    best = F.max_by(F.struct("year", "n"), F.struct(F.col("n"), -F.col("seen"))).alias("b")
    return n.groupBy(*keys).agg(best).select(*keys, "b.year", "b.n")


def snippets(lines: DataFrame, term: str, before: int = 2, after: int = 3) -> DataFrame:
    """First matching line of each (doc, array ``lines``), with its neighbours."""
    at = F.array_position(F.transform("lines", lambda x: F.lower(x).contains(term)), True)
    rows = lines.withColumn("line_no", at.cast("int")).where("line_no > 0")
    start = F.greatest(F.lit(1), F.col("line_no") - before)
    return rows.withColumn("snippet", F.array_join(F.slice("lines", start, F.col("line_no") + after - start + 1), "\n"))
