"""Documents, uploads, caches, jobs and models: selections and small lookups.

Null and empty values are told apart only where a rule says so: an empty text and a 0 fall through
to the next of several fields, as do nulls.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Answers of a model service that mean that the quota is used up, and families of models.
QUOTA_MARKERS = ("insufficient_quota", "exceeded your current quota", "you have run out of credits", "credit balance is too low", "billing_hard_limit_reached")
MODEL_FAMILIES = ("gemma", "qwen", "granite", "docling", "llama", "deepseek")
MSME = ("micro enterprises", "small enterprises", "msme", "micro and small")
OTHERS = ("other than micro", "creditors other than", "other creditors", "other than")


def quota_exhausted(code: Column, body: Column) -> Column:
    low = F.lower(F.coalesce(body, F.lit("")))
    return F.coalesce(code.isin(402, 429), F.lit(False)) & reduce(or_, [low.contains(m) for m in QUOTA_MARKERS])


def retry_delay(attempt: Column, quota: Column, base: float, tries: int = 3) -> Column:
    """Seconds before the next attempt (from 0), growing linearly; null if there is none. Quota errors aren't tried again."""
    return F.when(~quota & (attempt + 1 < tries), base * (attempt + 1))


def resolve_model(asked: DataFrame, models: DataFrame) -> DataFrame:
    """asked and model: the same name, else the first that contains or is contained, else of the same family, else the first.

    ``models`` (ord, model) is the short list of a service.
    """
    a, m = F.lower("asked"), F.lower("model")
    family = F.coalesce(*[F.when(a.contains(w) & m.contains(w), F.lit(k)) for k, w in enumerate(MODEL_FAMILIES)], F.lit(len(MODEL_FAMILIES)))
    rank = F.when(F.col("asked") == F.col("model"), F.struct(F.lit(0).alias("r"), F.lit(0).alias("f"), "ord"))
    rank = rank.when(m.contains(a) | a.contains(m), F.struct(F.lit(1).alias("r"), F.lit(0).alias("f"), "ord")).otherwise(F.struct(F.lit(2).alias("r"), family.alias("f"), "ord"))
    return asked.join(models).groupBy("asked").agg(F.min_by("model", rank).alias("model"))


def cache_key(size: Column, model: Column, start_page: Column, content: Column) -> Column:
    """32 hex digits of size, model, first page and the first 64 KiB of a file."""
    head = F.concat(F.concat(size.cast("string"), model, F.concat(F.lit("ocr_start_page="), F.coalesce(start_page, F.lit(1)).cast("string"))).cast("binary"), F.substring(content, 1, 65536))
    return F.substring(F.sha2(head, 256), 1, 32)


def read_through(wanted: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """``wanted`` with the cached value (null: still to be made) and whether it was there."""
    found = cache.select(key, F.col("value").alias("cached"), F.lit(True).alias("__hit"))
    return wanted.join(found, key, "left").withColumn("hit", F.coalesce("__hit", F.lit(False))).drop("__hit")


def cleared(cache: DataFrame, which: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The cache without the entries ``which`` (all, if null), and their number as a frame of one row."""
    gone = F.lit(True) if which is None else F.coalesce(which, F.lit(False))
    return cache.where(~gone), cache.agg(F.count_if(gone).alias("n_cleared"))


def current_terms(terms: DataFrame, version: int) -> DataFrame:
    return terms.where(F.col("version") == version).select("field", F.lower("term").alias("term")).distinct()


def upload_error(filename: Column, size: Column, start: Column, end: Column) -> Column:
    """Why an upload is refused (null: it isn't): only PDFs that aren't empty, first page not after the last."""
    pages = F.coalesce(start > end, F.lit(False)) | F.coalesce(start < 1, F.lit(False))
    return F.when(~F.coalesce(F.lower(filename).endswith(".pdf"), F.lit(False)), "unsupported_format").when(F.coalesce(size, F.lit(0)) == 0, "empty_document").when(pages, "invalid_page_range")


def skipped(documents: DataFrame) -> DataFrame:
    """A warning for each document that wasn't read."""
    return documents.where("status <> 'success'").select("doc", F.format_string("%s: skipped (%s)", F.col("filename"), F.col("status")).alias("warning"))


def year_columns(financial_years: DataFrame, starts: list[int]) -> DataFrame:
    """(company, fy, col): the column of a year by its start; where no year of a company fits, its last ones by place."""
    listed = financial_years.groupBy("company").agg(F.array_sort(F.collect_set("fy")).alias("fys"))
    place = F.array(*[F.lit(str(s)) for s in starts])
    by_start = F.filter(F.transform("fys", lambda f: F.struct(f.alias("fy"), F.array_position(place, F.split(f, "-")[0]).cast("int").alias("col"))), lambda x: x["col"] > 0)
    last = F.slice("fys", F.greatest(F.lit(1), F.size("fys") - (len(starts) - 1)), F.lit(len(starts)))
    by_place = F.transform(last, lambda f, i: F.struct(f.alias("fy"), (i + 1).cast("int").alias("col")))
    cells = F.when(F.size(by_start) > 0, by_start).otherwise(by_place)
    return listed.select("company", F.explode(cells).alias("c")).select("company", "c.fy", "c.col")


def first_of(*fields: Column) -> Column:
    """The first text that is neither null nor empty."""
    return F.coalesce(*[F.nullif(f.cast("string"), F.lit("")) for f in fields])


def first_amount(*fields: Column) -> Column:
    """The first amount that is neither null nor 0."""
    return F.coalesce(*[F.nullif(f, F.lit(0.0)) for f in fields])


def effective_pages(start: Column, end: Column, pages: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.coalesce(end, pages), pages) - F.coalesce(start, F.lit(1)) + 1)


def by_year(merged: DataFrame, current: Column, previous: Column) -> DataFrame:
    """Values of a merged statement as current and previous of an extraction."""
    which = F.when(F.col("fy") == current, "current").when(F.col("fy") == previous, "previous")
    rows = merged.withColumn("__which", which).where("__which is not null")
    return rows.groupBy("company", "field").agg(*[F.max(F.when(F.col("__which") == k, F.col("value"))).alias(k) for k in ("current", "previous")])


def aligned(values: DataFrame, aliases: DataFrame) -> DataFrame:
    """Values under the name that a report knows them by: ``aliases`` (field, alias)."""
    return values.join(aliases, "field", "left").withColumn("field", F.coalesce("alias", "field")).drop("alias")


def job_states(events: DataFrame) -> DataFrame:
    """The state of each job after its last event: uploaded, processing, completed, or failed with a code."""
    last = events.groupBy("job_id").agg(F.max_by(F.struct("event", "code"), F.col("seq")).alias("e"))
    state = F.when(F.col("e.event") == "error", "failed").when(F.col("e.event") == "finish", "completed").when(F.col("e.event") == "start", "processing").otherwise("uploaded")
    return last.select("job_id", state.alias("status"), F.when(state == "failed", F.coalesce("e.code", F.lit("processing_failure"))).alias("error_code"))


def trade_payables(rows: DataFrame, keys: list[str]) -> DataFrame:
    """msme, others and total of each key; the total only where both parts are there."""
    low = F.lower("label")
    other = reduce(or_, [low.contains(w) for w in OTHERS])
    small = reduce(or_, [low.contains(w) for w in MSME]) & ~low.contains("other than")
    found = rows.groupBy(*keys).agg(F.max_by("value", F.when(small & F.col("value").isNotNull(), F.col("pos"))).alias("msme"), F.max_by("value", F.when(other & ~small & F.col("value").isNotNull(), F.col("pos"))).alias("others"))
    return found.withColumn("total", F.col("msme") + F.col("others"))


def first_primary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of a primary document, else the first of any; confidence isn't asked."""
    rank = F.struct((~F.col("is_primary")).alias("p"), "doc_ord")
    return rows.groupBy(*keys).agg(F.min_by(F.struct("value", "doc_ord"), rank).alias("b")).select(*keys, "b.value", "b.doc_ord")


def merged_documents(documents: DataFrame) -> DataFrame:
    """The list of documents of a merged company: doc_id, filename, years (either name, else unknown), status, fields found.

    ``documents`` has current_fy, previous_fy, primary_fy, secondary_fy, status and fields_found; empty years count as
    missing, a document without an extraction has found none.
    """

    def year(*names: str) -> Column:
        return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names], F.lit("unknown"))

    return documents.select("doc_id", "filename", year("current_fy", "primary_fy").alias("primary_fy"), year("previous_fy", "secondary_fy").alias("secondary_fy"), F.coalesce("status", F.lit("unknown")).alias("status"), F.coalesce(F.col("fields_found").cast("int"), F.lit(0)).alias("fields_found"))
