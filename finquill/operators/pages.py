"""Pages and lines of scanned statements: types, rejects, sections, years and places of keywords.

All are column expressions or one window per document.  Null texts count as empty: they have no
type but Other, no year and no matching line; documents without rows have no result.  Helper
columns are named so that they can't clash with a caller's (two leading underscores).
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finquill.functions.scalars import hits
from finquill.operators.containment import MANY, containing

# Words of page types, in the order in which equal scores stand.
PAGE_TYPES = {
    "Balance Sheet": ["balance sheet", "equity & liabilities", "equity and liabilities", "shareholders fund", "shareholders' funds", "non-current assets", "current assets", "current liabilities", "total assets", "property plant and equipment"],
    "Statement of Profit and Loss": ["statement of profit and loss", "profit and loss", "revenue from operations", "total expense", "profit before tax", "profit for the year", "earnings per equity share", "employee benefits expense", "depreciation and amortization"],
    "Cash Flow Statement": ["cash flow", "cashflow", "cash generated from operations", "investing activities", "financing activities", "net cash flow", "profit before taxation"],
    "Notes to Accounts": ["note 2", "note 3", "note 4", "note 5", "note 6", "note 7", "note 8", "note 9", "note 10", "note 11", "note 12", "note 16", "note 17", "note 19", "note 20", "note 21", "note 22", "note 23", "note 24", "note 25", "note 26", "accompanying notes", "notes to financial", "notes forming part"],
    "Fixed Asset Schedule": ["gross block", "net block", "depreciation block", "tangible assets", "accumulated depreciation", "additions during the year", "deletions during the year"],
    "Borrowing Schedule": ["long-term borrowings", "long term borrowings", "secured loans", "unsecured loans", "term loans from bank", "current maturities of non-current"],
    "Receivable Schedule": ["trade receivables", "undisputed trade receivable", "disputed trade receivable", "ageing schedule", "outstanding for following periods"],
    "Payable Schedule": ["trade payables", "dues of micro enterprise", "dues of creditors other than", "outstanding for following periods from due date of payment"],
    "Tax Schedule": ["deferred tax", "current tax", "tax expense", "income tax", "contingent liabilities"],
}
MAIN_STATEMENTS = ("Balance Sheet", "Statement of Profit and Loss", "Cash Flow Statement")
NOTE_PHRASES = ["accompanying notes", "notes to financial", "notes forming part"]
#: Words by which a type stands out with one hit; without them two are needed.
_OWN_NAMES = {name: (name.lower(), *(("profit & loss",) if name == MAIN_STATEMENTS[1] else ())) for name in MAIN_STATEMENTS} | {"Notes to Accounts": tuple(NOTE_PHRASES)}
AUDIT_PAGES = ["auditor's report", "auditors report", "directors' report", "directors report", "auditor’s report", "directors’ report"]
# Words that give the statement away where no page type does, in order.
STATEMENT_HINTS = (
    ("Statement of Profit and Loss", ["profit and loss", "revenue from operations", "total expense", "depreciation"]),
    ("Balance Sheet", ["balance sheet", "equity & liabilities", "share capital", "borrowings"]),
    ("Cash Flow Statement", ["cash flow", "operating activities", "investing activities"]),
)
# Header cells, headers and footers, and words of rows that are no values.
HEADER_WORDS = ["particular", "note no", "asat 31st", "as at 31st", "year ended", "ended 31st"]
HEADER_FOOTER = (r"^page\s*\d+", r"^\d+\s*of\s*\d+$", r"^confidential$", r"^annual\s*report\s*\d{4}", r"^statements? forming part of", r"signature\s*to\s*note", r"referred\s*to\s*in\s*our\s*report")
REJECT_WORDS = ["auditor", "caro", "annexure", "certification", "chartered accountant", "signature", "declaration", "compliance certificate", "memorandum", "articles of association", "directors' report", "directors report", "board's report", "board report", "signatories", "signed in terms of our report"]
PROSE_SKIP = (r"din\s*no\s*:", r"udin\s*:", r"cin\s*:", r"membership\s*no", r"registration\s*no", r"date\s*:", r"place\s*:", r"page\s*\d+", r"director", r"partner")
SECTIONS = (
    (r"shareholders['’]?\s*funds?", "Shareholders' Funds"),
    (r"non[- ]current\s+(?:liabilities|assets)", "Non-Current {}"),
    (r"current\s+(?:liabilities|assets)", "Current {}"),
    (r"income", "Income"),
    (r"expenses?", "Expenses"),
    (r"operating\s+activities", "Operating Activities"),
    (r"investing\s+activities", "Investing Activities"),
    (r"financing\s+activities", "Financing Activities"),
)
# How texts spell the end of a financial year.
YEAR_PATTERNS = (
    r"year\s+ended\s+(?:march|mar)[\s,]+31[,\s]+(\d{4})",
    r"march\s+31[,\s]+(\d{4})",
    r"31\s*(?:st|nd|rd|th)?\s*(?:march|mar)[,\s]+(\d{4})",
    r"as\s+at\s+(?:march|mar)[\s,]+31[,\s]+(\d{4})",
    r"for\s+the\s+year\s+ended[^\n]*?(\d{4})",
    r"year\s+ended[^\n]*?31[^\n]*?(\d{4})",
)
BALANCE_WORDS = (("balance sheet", 8), ("equity and liabilities", 8), ("share capital", 5), ("reserves", 3), ("non current liabilities", 3), ("short term borrowings", 3), ("trade payables", 3))


def _any(text: Column, words: list[str]) -> Column:
    return reduce(or_, [text.contains(w) for w in words])


#: Words of which ``types_of_hits`` needs the hits: of each type, of its own names, and of audit pages.
TYPE_WORDS = [*PAGE_TYPES.values(), *(list(_OWN_NAMES.get(name, ())) for name in PAGE_TYPES), AUDIT_PAGES]


def types_of_hits(counts: Column) -> Column:
    """Types of a page, best first, by the hits of TYPE_WORDS; Other where none stands out."""
    stand = []
    for k, name in enumerate(PAGE_TYPES):
        n, own = counts[k], counts[len(PAGE_TYPES) + k]
        enough = (n > 0) & ((n >= 2) | (own > 0)) if name in _OWN_NAMES else n > 0
        stand.append(F.when(enough, F.struct((-n).alias("s"), F.lit(k).alias("k"), F.lit(name).alias("name"))))
    names = F.sort_array(F.array_compact(F.array(*stand)))["name"]
    return F.when((counts[2 * len(PAGE_TYPES)] > 0) | (F.size(names) == 0), F.array(F.lit("Other"))).otherwise(names)


def page_types(text: Column) -> Column:
    """Types of a page by hits of their words, best first; Other where none stands out.

    The text is brought to lower case once and each word is looked up once.
    """
    low = F.array(F.lower(F.coalesce(text, F.lit(""))))
    counts = F.transform(low, lambda t: F.array(*(hits(t, words, lowered=True) if words else F.lit(0) for words in TYPE_WORDS)))
    return F.get(F.transform(counts, types_of_hits), 0)


def statement_type(types: Column, text: Column) -> Column:
    """The main statement of a page: its best page type of that kind, else by words, else the balance sheet."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return statement_of(types, [_any(low, words) for _, words in STATEMENT_HINTS])


def statement_of(types: Column, hinted: list[Column]) -> Column:
    """``statement_type`` by whether there are words of each of STATEMENT_HINTS."""
    main = F.filter(types, lambda t: t.isin(*MAIN_STATEMENTS))
    out = F.when(F.size(main) > 0, F.get(main, F.lit(0)))
    for (name, _), is_hinted in zip(STATEMENT_HINTS, hinted, strict=True):
        out = out.when(is_hinted, name)
    return out.otherwise("Balance Sheet")


def is_header_cell(cell: Column) -> Column:
    return _any(F.lower(F.coalesce(cell, F.lit(""))), HEADER_WORDS)


def is_header_row(cells: Column) -> Column:
    # no header word has a line break, so the row's cells can be looked through at once
    return is_header_cell(F.array_join(cells, "\n"))


def is_total_row(label: Column) -> Column:
    return F.coalesce(label, F.lit("")).rlike(r"(?i)\b(total|sub\s*total|grand\s*total)\b")


def is_rejected_candidate(label: Column, context: Column, evidence: Column, statement: Column) -> Column:
    """Rows of no main statement or note, without a letter, headers, footers, and rows of reports about statements."""
    low, ev, ctx = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (label, evidence, context))
    known = F.coalesce(statement.isin(*MAIN_STATEMENTS, "Notes to Accounts"), F.lit(False))
    edge = reduce(or_, [low.rlike(p) | ev.rlike(p) for p in HEADER_FOOTER])
    return ~known | ~low.rlike(r"\p{L}") | edge | _any(low, REJECT_WORDS) | _any(ctx, REJECT_WORDS) | _any(ev, REJECT_WORDS)


def is_prose_skipped(line: Column) -> Column:
    """Lines that can't be values: short ones, and those of signatures, dates and numbers of papers."""
    low = F.lower(F.trim(F.coalesce(line, F.lit(""))))
    return (F.char_length(low) < 8) | reduce(or_, [low.rlike(p) for p in PROSE_SKIP])


def outside_tables(lines: DataFrame, keys: list[str], at: str, line: str) -> DataFrame:
    """Lines that aren't between ``<table`` and ``</table>``: a running count of both over the lines of a key."""
    low = F.lower(F.coalesce(F.col(line), F.lit("")))
    before = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(low.contains("</table>"), 0).when(low.contains("<table"), 1), ignorenulls=True).over(before)
    return lines.withColumn("__in", F.coalesce(last, F.lit(0))).where((F.col("__in") == 0) & ~low.contains("</table>")).drop("__in")


def section_of(line: Column) -> Column:
    """The section that a line opens, or null."""
    low = F.lower(F.trim(F.coalesce(line, F.lit(""))))
    side = F.when(low.contains("asset"), "Assets").otherwise("Liabilities")
    out = None
    for pattern, name in SECTIONS:
        value = F.concat(F.lit(name.format("")), side) if "{}" in name else F.lit(name)
        out = F.when(low.rlike(pattern), value) if out is None else out.when(low.rlike(pattern), value)
    return out


def context_paths(lines: DataFrame, keys: list[str], at: str, label: str, statement: Column) -> DataFrame:
    """context_path of each line: statement, the section opened last, and the label, without repeats."""
    before = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    section = F.last(section_of(F.col(label)), ignorenulls=True).over(before)
    rows = lines.withColumn("__section", section)
    parts = F.array_distinct(F.array_compact(F.array(F.nullif(statement, F.lit("")), F.col("__section"), F.nullif(F.col(label), F.lit("")))))
    return rows.withColumn("context_path", F.array_join(parts, " > ")).drop("__section")


def years_in(text: Column) -> Column:
    """Years (2010 to 2035) of all spellings in a text, in order of spelling, then of place; one phrase may count several times."""
    # a lambda's variable is there once, an expression would be worked out for each spelling
    low = F.array(F.lower(F.coalesce(text, F.lit(""))))
    found = F.flatten(F.transform(low, lambda t: F.concat(*[F.regexp_extract_all(t, F.lit(p), F.lit(1)) for p in YEAR_PATTERNS])))
    return F.filter(F.transform(found, lambda y: y.cast("int")), lambda y: y.between(2010, 2035))


def label_of_year(year: Column) -> Column:
    return F.concat((year - 1).cast("string"), F.lit("-"), F.lpad((year % 100).cast("string"), 2, "0"))


def year_of_document(pages: DataFrame, keys: list[str], page: str, text: str | None = None, years: str | None = None) -> DataFrame:
    """The end year that a document's pages name most often (ties: seen first), with current and previous labels.

    The pages have a ``text``, or the ``years`` in it as ``years_in`` has them.
    """
    named = years_in(F.col(text)) if years is None else F.col(years)
    seen = pages.select(*keys, F.col(page).alias("__page"), F.posexplode(named).alias("__at", "year"))
    each = seen.groupBy(*keys, "year").agg(F.count("*").alias("__n"), F.min(F.struct("__page", "__at")).alias("__first"))
    rank = F.struct(F.col("__n"), -F.col("__first.__page"), -F.col("__first.__at"))
    best = each.groupBy(*keys).agg(F.max_by("year", rank).alias("year"))
    return best.withColumn("current_fy", label_of_year(F.col("year"))).withColumn("previous_fy", label_of_year(F.col("year") - 1))


def year_of_filename(name: Column) -> tuple[Column, Column]:
    """(current, previous) labels by three spellings: FY2023-24, 2023-24, 2024; null if there is none."""
    name = F.coalesce(name, F.lit(""))
    marked, plain, single = r"(?i)(?:fy|ay)[_\s-]?(\d{4})[_\-](\d{2,4})", r"(\d{4})[_\-](\d{2})\b", r"\b(20\d{2})\b"
    start, end = F.regexp_extract(name, marked, 1).try_cast("int"), F.regexp_extract(name, marked, 2)
    two = F.when(F.char_length(end) == 4, F.substring(end, 3, 2)).otherwise(F.lpad(((start + 1) % 100).cast("string"), 2, "0"))
    first = F.regexp_extract(name, plain, 1).try_cast("int")
    only = F.regexp_extract(name, single, 1).try_cast("int")
    current = F.when(start.isNotNull(), F.concat(start.cast("string"), F.lit("-"), two)).when(first.isNotNull(), F.concat(first.cast("string"), F.lit("-"), F.regexp_extract(name, plain, 2))).when(only.isNotNull(), label_of_year(only))
    before = F.when(start.isNotNull(), label_of_year(start)).when(first.isNotNull(), label_of_year(first)).when(only.isNotNull(), label_of_year(only - 1))
    return current, before


def end_year(fy: Column) -> Column:
    """2024-25, 2024-2025 or any 20xx to the end year; null for unknown."""
    start, end = F.regexp_extract(fy, r"(\d{4})-(\d{2,4})", 1).try_cast("int"), F.regexp_extract(fy, r"(\d{4})-(\d{2,4})", 2)
    spelled = F.when(F.char_length(end) == 4, end.try_cast("int")).when(F.char_length(end) == 2, F.floor(start / 100).cast("int") * 100 + end.try_cast("int"))
    return F.when(fy == "unknown", F.lit(None).cast("int")).otherwise(F.coalesce(spelled, F.regexp_extract(fy, r"\b(20\d{2})\b", 1).try_cast("int")))


def old_year(text: Column) -> Column:
    """End year by the first of three spellings that occurs, if it is from 2015 to 2035."""
    low = F.lower(F.coalesce(text, F.lit("")))
    tries = [F.regexp_extract(low, p, 1).try_cast("int") for p in (r"march\s+31[,\s]+(\d{4})", r"31\s*(?:st|nd|rd|th)?\s+march[,\s]+(\d{4})", r"march[,\s]+(\d{4})")]
    return F.coalesce(*[F.when(y.between(2015, 2035), y) for y in tries])


def best_balance_page(pages: DataFrame, keys: list[str], page: str, text: str, hint: int = 14, window: int = 3) -> DataFrame:
    """The page near ``hint`` whose words weigh most (ties: the first); ``hint`` itself where none weighs."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    weight = sum((F.lit(n) * low.contains(w).cast("int") for w, n in BALANCE_WORDS[1:]), F.lit(BALANCE_WORDS[0][1]) * low.contains(BALANCE_WORDS[0][0]).cast("int"))
    near = F.col(page).between(max(1, hint - window), min(hint + window, 44))
    rows = pages.select(*keys, F.col(page).alias("__page"), F.when(near, weight).otherwise(0).alias("score"))
    best = rows.groupBy(*keys).agg(F.max_by(F.struct("__page", "score"), F.struct(F.col("score"), -F.col("__page"))).alias("__b"))
    return best.select(*keys, F.when(F.col("__b.score") > 0, F.col("__b.__page")).otherwise(hint).alias("best_page"), F.col("__b.score").alias("score"))


def company_line(lines: DataFrame, keys: list[str], at: str, line: str) -> DataFrame:
    """The first line of more than five characters with the word limited."""
    one = F.trim(F.col(line))
    rows = lines.where(F.lower(one).contains("limited") & (F.char_length(one) > 5))
    return rows.groupBy(*keys).agg(F.min_by(one, F.col(at)).alias("company_name"))


def find_pages(pages: DataFrame, text: str, every: list[str], some: list[str], lines: int = 50) -> DataFrame:
    """Pages with all words of ``every`` and one of ``some`` (if any), and their first lines."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    wanted = F.lit(True)
    for w in every:
        wanted &= low.contains(w)
    if some:
        wanted &= _any(low, some)
    return pages.where(wanted).withColumn("head", F.array_join(F.slice(F.split(text, "\n"), 1, lines), "\n"))


def line_context(pages: DataFrame, text: str, pattern: str, before: int = 2, after: int = 4) -> DataFrame:
    """Each line that matches, with the lines around it."""
    rows = pages.withColumn("__lines", F.split(text, "\n")).withColumn("__n", F.size("__lines"))
    rows = rows.select("*", F.posexplode("__lines").alias("line_no", "line")).where(F.col("line").rlike(pattern))
    start = F.greatest(F.lit(0), F.col("line_no") - before)
    around = F.slice("__lines", start + 1, F.least(F.col("__n"), F.col("line_no") + after + 1) - start)
    return rows.withColumn("around", F.array_join(around, "\n")).drop("__lines", "__n")


def field_snippets(pages: DataFrame, keys: list[str], page: str, text: str, terms: DataFrame, before: int = 2, after: int = 3, limit: int = 6) -> DataFrame:
    """For each field the first line of a page that has one of its terms, with its neighbours; the first ``limit`` pages.

    Pages meet the terms (field, term) that they contain, by rare parts of the terms or, if these are few, as they
    are.  The pages' texts are never broadcast, whatever Spark takes their size to be.
    """
    known = terms.select("field", F.lower("term").alias("__term")).distinct()
    low = pages.select(*keys, page, F.lower(F.col(text)).alias("__low"))
    n_terms = known.count()
    met = containing(low, [*keys, page], "__low", known, "__term", n_terms).join(F.broadcast(known) if n_terms <= MANY else known, "__term")
    fields = met.groupBy(*keys, page, "field").agg(F.collect_set("__term").alias("__terms"))
    rows = pages.withColumn("__lines", F.split(F.coalesce(F.col(text), F.lit("")), "\n")).join(fields.hint("merge"), [*keys, page])
    at = F.array_position(F.transform("__lines", lambda x: F.exists("__terms", lambda t: F.lower(x).contains(t))), True)
    rows = rows.withColumn("line_no", at.cast("int")).where("line_no > 0")
    start = F.greatest(F.lit(1), F.col("line_no") - before)
    rows = rows.withColumn("snippet", F.array_join(F.slice("__lines", start, F.col("line_no") + after - start + 1), "\n"))
    order = Window.partitionBy(*keys, "field").orderBy(page)
    return rows.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= limit).select(*keys, "field", page, "line_no", "snippet")
