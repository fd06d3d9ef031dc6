"""From pages to candidate rows: page, table and line work of a document as one operator.

``page_facts`` reads what a page's markup says by itself in Arrow batches, once: its result is written, since
tables, lines and years are read from it by different paths.  All else are expressions over a table, a row or a
line; pages are dealt over the cores, and nothing else is shuffled but tables to their document's years.
A page stands alone: its statement, notes and section begin anew.  Pages that are rejected or show no
statement give no rows.

Null and empty texts give no rows and count as pages; tables without rows, header rows, rows without
a label and labels that can't be values are left out; repeated pages give repeated rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finquill.functions.markup import page_markup
from finquill.operators import pages as paging
from finquill.operators.page_facts import with_facts
from finquill.operators.text import is_rejected_page
from finquill.sources.steps import written

# How lines end in amounts.
_LABEL = r"""^([A-Za-z][\w\s&\(\)'"/,.-]{3,}?)"""
_AMOUNT = r"\s+([\d,]+\.?\d*|\(\d[\d,]*\.?\d*\)|-)"
COLUMNS = ("doc", "page", "kind", "table_no", "row_no", "item_no", "label", "context_path", "source_statement", "note_number", "current_value", "previous_value", "evidence")


def with_roles(tables: DataFrame) -> DataFrame:
    """current_col, previous_col, label_col and note_col (-1: none) of each table by the votes of its header.

    Where the years aren't known, the first year seen names the current column and the years of other columns
    vote for the previous one.  Without a voted label column it is the one with most letters below the header.
    """
    known, width = F.col("current").isNotNull() & F.col("previous").isNotNull(), F.col("width")

    def named(year: str, unknown: str, default: int) -> Column:
        return F.coalesce(F.when(known, F.get("named_cols", F.array_position("named", F.col(year)).cast("int") - 1)).otherwise(F.col(unknown)), F.lit(default))

    out = tables.withColumns({"__cur": named("current", "first_col", 1), "__prev": named("previous", "other_col", 2)})
    counted = F.transform("letters", lambda n, j: F.struct(n.alias("n"), (-j).alias("j")))
    most = F.array_max(F.filter(counted, lambda x: (-x["j"] != F.col("__cur")) & (-x["j"] != F.col("__prev"))))["j"]
    return out.withColumns({
        "label_col": F.coalesce("voted_label", -most, F.lit(0)),
        "current_col": F.when(F.col("__cur") < width, F.col("__cur")).otherwise(F.when(width > 1, 1).otherwise(0)),
        "previous_col": F.when(F.col("__prev") < width, F.col("__prev")).otherwise(F.when(width > 2, 2).otherwise(-1)),
    }).drop("__cur", "__prev", "width", "named", "named_cols", "first_col", "other_col", "voted_label", "letters", "current", "previous")


def _by_column(values: Column) -> Column:
    """Current and previous amounts of a row: by the columns' roles, other columns by their order."""
    start = F.struct(F.lit("").alias("cur"), F.lit("").alias("prev"))
    in_order = F.col("current_col") < F.col("previous_col")

    def more(a: Column, b: Column) -> Column:
        return F.when(a == "", b).otherwise(F.concat(a, F.lit(" "), b))

    def step(s: Column, x: Column) -> Column:
        no_cur, no_prev = s["cur"] == "", s["prev"] == ""
        other = (x["c"] != F.col("current_col")) & (x["c"] != F.col("previous_col"))
        to_cur = (x["c"] == F.col("current_col")) | (other & no_cur & (in_order | ~no_prev))
        to_prev = (x["c"] == F.col("previous_col")) | (other & no_prev & (~in_order | ~no_cur))
        cur, prev = s["cur"].alias("cur"), s["prev"].alias("prev")
        return F.when(to_cur, F.struct(more(s["cur"], x["v"]).alias("cur"), prev)).when(to_prev, F.struct(cur, more(s["prev"], x["v"]).alias("prev"))).otherwise(s)

    return F.aggregate(values, start, step)


def _by_order(values: Column) -> Column:
    """Current and previous amounts under jammed labels: the first two cells with amounts, in the columns' order."""
    none = F.lit("")
    first, second = F.get(values, 0), F.get(values, 1)
    in_order = (F.col("current_col") < F.col("previous_col")) | (F.col("previous_col") == -1)
    two = F.when(in_order, F.struct(first["v"].alias("cur"), second["v"].alias("prev"))).otherwise(F.struct(second["v"].alias("cur"), first["v"].alias("prev")))
    one = F.when(first["c"] == F.col("previous_col"), F.struct(none.alias("cur"), first["v"].alias("prev"))).otherwise(F.struct(first["v"].alias("cur"), none.alias("prev")))
    return F.when(F.size(values) >= 2, two).when(F.size(values) == 1, one).otherwise(F.struct(none.alias("cur"), none.alias("prev")))


def _amounts(joined: str) -> Column:
    """Amounts that are joined by spaces."""
    return F.when(F.col(joined) == "", F.array().cast("array<string>")).otherwise(F.split(joined, " "))


def _path(statement: Column, section: Column, label: Column) -> Column:
    """Statement, section and label, joined; a label that is there already isn't repeated."""
    above = F.array_compact(F.array(F.nullif(statement, F.lit("")), section))
    return F.array_join(F.when(F.array_contains(above, label), above).otherwise(F.concat(above, F.array(label))), " > ")


def _shaped(rows: DataFrame) -> DataFrame:
    """Candidates of statements and notes that can be values: the rules of ``pages.is_rejected_candidate``.

    Statements and evidence were judged with the page.  A label is part of its evidence or a known one, and a context path
    has else only fixed words, so only what begins a label is left to be judged.
    """
    label = F.lower(F.trim(F.coalesce("label", F.lit(""))))
    bad = ~label.rlike(r"\p{L}") | label.rlike("|".join(p for p in paging.HEADER_FOOTER if p[0] == "^"))
    return rows.where(~bad).select(*COLUMNS)


def parse(pages: DataFrame) -> DataFrame:
    """Pages (doc, page, text) with the facts of ``page_facts``."""
    # few bytes take long here, so pages are dealt over all cores, whatever files they lie in
    return with_facts(pages.select("doc", "page", "text").repartition("doc", "page"))


def parsed(pages: DataFrame) -> DataFrame:
    """``parse``, written once for all that reads it."""
    return written(parse(pages), "pages", result=False)


def table_candidates(parts: DataFrame) -> DataFrame:
    """Candidates of the tables of pages with ``current`` and ``previous`` end years."""
    tables = parts.select("doc", "page", "source_statement", "current", "previous", F.monotonically_increasing_id().alias("__id"), F.posexplode("tables").alias("table_no", "__t"))
    tables = with_roles(tables.select("doc", "page", "source_statement", "current", "previous", "__id", "table_no", "__t.*"))
    shared = ["doc", "page", "table_no", "row_no", "source_statement", "note_number", "evidence", "__v"]

    def rows_of(some: DataFrame, own: Column, values_of: Callable[[Column], Column]) -> DataFrame:
        rows = some.select("*", F.explode("rows").alias("__row")).drop("rows").select("*", "__row.*").drop("__row")
        # a generator's output isn't written out again in every later expression
        return rows.select("*", F.explode(F.array(values_of(F.filter("amounts", lambda x: (x["c"] != F.col("note_col")) & ((x["c"] != F.col("label_col")) | own))))).alias("__v"))

    # tables with jammed labels are few and are told apart before any work on their rows
    plain = rows_of(tables.where(F.size("jammed") == 0), F.lit(False), _by_column).select(*shared, F.split(F.get("labels", F.col("label_col")), "\n").alias("__labels"))
    plain = plain.select(*shared, F.posexplode("__labels").alias("item_no", "label")).withColumn("label", F.trim("label")).where(F.char_length("label") >= 2)

    below = rows_of(tables.where(F.size("jammed") > 0), F.lit(True), _by_order).where(F.col("row_no") > F.col("jammed_row"))
    below = below.withColumn("__n", F.greatest(F.size(_amounts("__v.cur")), F.size(_amounts("__v.prev")))).where("__n > 0")
    before = Window.partitionBy("doc", "page", "table_no", "__id").orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)
    below = below.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    below = below.select(*shared, "jammed", "__before", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)).alias("item_no"))
    below = below.select(*shared, "item_no", F.get("jammed", (F.col("__before") + F.col("item_no")).cast("int")).alias("label")).where("label is not null")

    out = plain.unionByName(below)
    out = out.withColumns({"kind": F.lit("table"), "current_value": F.get(_amounts("__v.cur"), F.col("item_no")), "previous_value": F.get(_amounts("__v.prev"), F.col("item_no"))})
    return _shaped(out.withColumn("context_path", _path(F.col("source_statement"), F.lit(None).cast("string"), F.col("label"))))


def prose_candidates(parts: DataFrame) -> DataFrame:
    """Candidates of the lines outside tables that end in one or two amounts; the section is the one opened last on the page."""
    lines = parts.select("doc", "page", "source_statement", "note_number", F.inline("lines"))
    # a second amount is taken where there is one: no shorter label leaves a single amount then
    ends = _LABEL + _AMOUNT + f"(?:{_AMOUNT})?" + r"\s*$"
    plain = F.octet_length("line") == F.char_length("line")

    def of(f: Callable[[str], Column]) -> Column:
        # classes of all of Unicode are slow and add nothing where the line is ASCII
        return F.when(plain, f(ends)).otherwise(f(f"(?U){ends}"))

    def part(k: int) -> Column:
        return of(lambda p: F.regexp_extract("line", p, k))

    rows = lines.where(of(lambda p: F.col("line").rlike(p)))
    rows = rows.select("doc", "page", "source_statement", "note_number", "section", "line_no", F.col("line").alias("evidence"), F.trim(part(1)).alias("label"), part(2).alias("current_value"), part(3).alias("previous_value"))
    rows = rows.withColumns({c: F.when(~F.col(c).isin("", "-"), F.col(c)) for c in ("current_value", "previous_value")})
    rows = rows.withColumns({"kind": F.lit("line"), "table_no": F.lit(None).cast("int"), "row_no": F.col("line_no"), "item_no": F.lit(0)})
    return _shaped(rows.withColumn("context_path", _path(F.col("source_statement"), F.col("section"), F.col("label"))))


def page_candidates(pages: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """All candidates of pages (doc, page, text): COLUMNS, ordered within a page by kind (table first), table_no, row_no, item_no.

    ``parts`` are the pages as ``parsed`` has them, if they are there already; else they are written
    (``steps.clear`` deletes them).
    """
    parts = parsed(pages) if parts is None else parts
    years = paging.year_of_document(parts, ["doc"], "page", years="years").select("doc", F.col("year").alias("current"), (F.col("year") - 1).alias("previous"))
    tables = parts.where(F.size("tables") > 0).join(years, "doc", "left")
    return table_candidates(tables).unionByName(prose_candidates(parts.where(F.size("lines") > 0)))


def document_metadata(pages: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """doc, current_fy and previous_fy (unknown if no page names a year), pages_processed, pages_rejected.

    Of ``parts``, the pages as ``parsed`` has them, only the years and the judgement are read.
    """
    if parts is None:
        # what a page is rejected by is its markup; its tables, lines and types aren't needed
        rows = pages.select("doc", "page", "text").repartition("doc", "page")
        years = paging.year_of_document(rows, ["doc"], "page", "text")
        judged = page_markup(rows.select("doc", "text")).select("doc", F.coalesce(is_rejected_page(F.col("markup")), F.lit(False)).alias("rejected"))
    else:
        years, judged = paging.year_of_document(parts, ["doc"], "page", years="years"), parts.select("doc", "rejected")
    counts = judged.groupBy("doc").agg(F.count("*").alias("pages_processed"), F.count_if("rejected").alias("pages_rejected"))
    named = {c: F.coalesce(c, F.lit("unknown")) for c in ("current_fy", "previous_fy")}
    return counts.join(years.select("doc", "current_fy", "previous_fy"), "doc", "left").withColumns(named).select("doc", "current_fy", "previous_fy", "pages_processed", "pages_rejected")
