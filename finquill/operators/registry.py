"""Registry, jobs, costs, audit shares and injection of values into sheet rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Estimated tokens per page and per extraction call, and calls per document.
PAGE_TOKENS = (1700, 900)
CALL_TOKENS = (1800, 350)
CALLS = 190


def listing(documents: DataFrame) -> DataFrame:
    """Documents and bytes of each company, with the number of all documents on every row."""
    each = documents.groupBy("company_slug").agg(F.count("*").alias("n_documents"), F.sum("size_bytes").alias("size_bytes"))
    total = documents.agg(F.count("*").alias("total_documents"))
    return each.crossJoin(F.broadcast(total))


def new_documents(arriving: DataFrame, known: DataFrame) -> DataFrame:
    """Arriving documents whose content a company doesn't have yet; one of each content."""
    fresh = arriving.join(known.select("company_slug", "sha256"), ["company_slug", "sha256"], "left_anti")
    return fresh.dropDuplicates(["company_slug", "sha256"])


def without(documents: DataFrame, slug: str, doc_id: str) -> DataFrame:
    return documents.where(~((F.lower("company_slug") == slug.strip().lower()) & (F.col("doc_id") == doc_id)))


def percent(progress: Column, total: Column) -> Column:
    return F.round(progress * 100.0 / F.greatest(total, F.lit(1))).cast("int")


def reusable(jobs: DataFrame, company: str, doc_ids: list[str], order: str = "job_id", force: bool = False) -> DataFrame:
    """Each company's first job (by ``order``, the order in which jobs were made) that is still open, or done with the same
    documents; none with ``force``."""
    same = F.array_sort("doc_ids") == F.array(*[F.lit(x) for x in sorted(doc_ids)])
    open_or_same = F.col("status").isin("running", "pending") | ((F.col("status") == "done") & same)
    return jobs.where(open_or_same & F.lit(not force)).groupBy(company).agg(F.min_by("job_id", order).alias("job_id"))


def priced(documents: DataFrame, keys: list[str], prices: DataFrame, ocr_model: str, extraction_model: str) -> DataFrame:
    """documents, pages, tokens and cost by a table of prices (model, input, output per million tokens); null for unknown models."""
    sums = documents.groupBy(*keys).agg(F.count("*").alias("documents"), F.sum("pages").alias("pages"))

    def price(model: str, name: str) -> DataFrame:
        return prices.where(F.col("model") == model).agg(F.first("input").alias(f"{name}_in"), F.first("output").alias(f"{name}_out"))

    rows = sums.crossJoin(F.broadcast(price(ocr_model, "ocr"))).crossJoin(F.broadcast(price(extraction_model, "ext")))  # one row each
    ocr = (F.col("pages") * PAGE_TOKENS[0] * F.col("ocr_in") + F.col("pages") * PAGE_TOKENS[1] * F.col("ocr_out")) / 1_000_000
    calls = F.col("documents") * CALLS
    ext = (calls * CALL_TOKENS[0] * F.col("ext_in") + calls * CALL_TOKENS[1] * F.col("ext_out")) / 1_000_000
    tokens = F.col("pages") * sum(PAGE_TOKENS) + calls * sum(CALL_TOKENS)
    return rows.select(*keys, "documents", "pages", tokens.alias("tokens"), F.round(ocr, 4).alias("ocr_cost"), F.round(ext, 4).alias("extraction_cost"), F.round(F.round(ocr, 4) + F.round(ext, 4), 4).alias("total_cost"))


def cost(documents: DataFrame, keys: list[str], page_price: tuple[float, float], call_price: tuple[float, float]) -> DataFrame:
    """Pages and estimated cost (prices per million tokens in and out)."""
    sums = documents.groupBy(*keys).agg(F.sum("pages").alias("pages"), F.count("*").alias("_n"))
    ocr = (F.col("pages") * PAGE_TOKENS[0] * page_price[0] + F.col("pages") * PAGE_TOKENS[1] * page_price[1]) / 1_000_000
    calls = (F.col("_n") * CALLS * CALL_TOKENS[0] * call_price[0] + F.col("_n") * CALLS * CALL_TOKENS[1] * call_price[1]) / 1_000_000
    return sums.select(*keys, "pages", F.round(ocr, 4).alias("ocr_cost"), F.round(calls, 4).alias("extraction_cost"))


def audit_shares(rows: DataFrame) -> DataFrame:
    each = rows.groupBy("status").agg(F.count("*").alias("n"))
    total = each.agg(F.sum("n").alias("_all"))
    return each.crossJoin(F.broadcast(total)).select("status", "n", F.round(F.col("n") * 100.0 / F.col("_all"), 1).alias("share"))


def inject(rows: DataFrame, values: DataFrame, overrides: DataFrame) -> DataFrame:
    """Override, then value, then default of each sheet row; where it came from."""
    out = rows.join(values, "row_no", "left").join(overrides, "row_no", "left")
    origin = F.when(F.col("override").isNotNull(), "override").when(F.col("value").isNotNull(), "value").otherwise("default")
    return out.select("row_no", F.coalesce("override", "value", "default").alias("value"), origin.alias("origin"))


def cache_hits(documents: DataFrame, cache: DataFrame, version: int) -> DataFrame:
    """Documents with a cached result of this version and fingerprint."""
    return documents.join(cache.where(F.col("version") == version), ["doc_id", "fingerprint"])


def learned(extraction: DataFrame, known_terms: DataFrame, least: float = 0.95) -> DataFrame:
    """New (field, term) pairs from confident evidence that no field knows yet."""
    from finquill.functions.scalars import candidate_term

    found = extraction.where(F.col("confidence") >= least).select("field", candidate_term(F.col("evidence")).alias("term")).where("term is not null and term <> lower(field)")
    return found.join(known_terms.select(F.lower("term").alias("term")), "term", "left_anti").distinct().select("field", "term")
