"""Queries over whole scanned documents made from orders and line items: a page an order, a document a customer.

Pages are balance sheets with Markdown tables, profit and loss statements with HTML tables whose
years stand the other way round, reports that are rejected, and prose.  The SQL builds the
expected rows from the line items themselves, not from the texts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from finquill.operators import candidates, documents, extraction, text
from finquill.plans.named import choose, query
from finquill.plans.statement import load

_LABELS = ["Trade receivables", "Share capital", "Other payables", "Auditor fees", "12345", "x", "Other Income", "Provision for gratuity", "Trade payables"]
#: Labels as candidates spell them: known ones in their usual spelling.
_SPELLED = ["Trade Receivables", "Share Capital", "Other payables", "Auditor fees", "12345", "x", "Other Income", "Provision for gratuity", "Trade Payables"]
LABEL, SPELLED = choose("l_partkey", _LABELS), choose("l_partkey", _SPELLED)
# amounts can't be taken for a year of the header (22.25 could: the first rows vote too)
CURRENT = "concat(CAST(CAST(floor(l_extendedprice) AS BIGINT) + 200000 AS STRING), '.50')"
PREVIOUS = "CASE WHEN l_linenumber % 3 = 0 THEN '-' ELSE concat(CAST(CAST(floor(l_quantity) AS BIGINT) + 100 AS STRING), '.25') END"
YEAR = "(2022 + o_custkey % 3)"


def pages(spark, sf):
    """doc, page, text."""
    line = F.struct("l_linenumber", F.expr(LABEL).alias("label"), F.expr(CURRENT).alias("cur"), F.expr(PREVIOUS).alias("prev"))
    lines = load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    rows = load(spark, sf, "orders").join(lines, "o_orderkey", "left").withColumn("lines", F.coalesce("lines", F.array().cast(lines.schema["lines"].dataType)))
    year = F.expr(YEAR).cast("string")
    before = F.expr(f"{YEAR} - 1").cast("string")
    each = {
        0: lambda x: F.concat(F.lit("| "), x["label"], F.lit(" | "), x["cur"], F.lit(" | "), x["prev"], F.lit(" | "), x["l_linenumber"].cast("string"), F.lit(" |")),
        1: lambda x: F.concat(F.lit("<tr><td>"), x["label"], F.lit("</td><td>"), x["prev"], F.lit("</td><td>"), x["cur"], F.lit("</td></tr>")),
        3: lambda x: F.concat(x["label"], F.lit("  "), x["cur"], F.lit(" "), x["prev"]),
    }
    each[2] = each[3]
    head = {
        0: F.concat(F.when(F.col("o_orderkey") % 8 == 0, F.lit("Note 7 - Borrowings of the company\n")).otherwise(F.lit("")), F.lit("Balance Sheet as at March 31, "), year, F.lit(" of the company\nCurrent assets\n| Particulars | 31 March "), year, F.lit(" | 31 March "), before, F.lit(" | Note |\n|---|---|---|---|\n")),
        1: F.concat(F.lit("Statement of Profit and Loss, revenue from operations, march 31, "), year, F.lit(" and so on\n<table><tr><th>Particulars</th><th>"), before, F.lit("</th><th>"), year, F.lit("</th></tr>")),
        2: F.concat(F.lit("Independent auditor's report, March 31, "), year, F.lit(" of the firm\n")),
        3: F.concat(F.lit("Balance Sheet, total assets, March 31, "), year, F.lit(" of the company\nCurrent liabilities\n")),
    }
    tail = {1: F.lit("</table>")}
    text = None
    for k in range(4):
        made = F.concat(head[k], F.array_join(F.transform("lines", each[k]), "" if k == 1 else "\n"), tail.get(k, F.lit("")))
        text = F.when(F.col("o_orderkey") % 4 == k, made) if text is None else text.when(F.col("o_orderkey") % 4 == k, made)
    return rows.select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("page"), text.alias("text"))


_CANDIDATES = f"""
  l AS (SELECT o_custkey AS doc, o_orderkey AS page, o_orderkey % 4 AS kind_no, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, {LABEL}, {CURRENT}, {PREVIOUS}) AS n, l_linenumber,
      {LABEL} AS raw, {SPELLED} AS spelled, {CURRENT} AS cur, {PREVIOUS} AS prev FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 4 <> 2),
  t AS (SELECT doc, page, 'table' AS kind, 0 AS table_no, n AS row_no, spelled AS label,
      CASE kind_no WHEN 0 THEN 'Balance Sheet' ELSE 'Statement of Profit and Loss' END AS source_statement, NULL AS section, CASE WHEN page % 8 = 0 THEN '7' ELSE '' END AS note_number,
      cur AS current_value, prev AS previous_value, CASE kind_no WHEN 0 THEN concat(raw, ' | ', cur, ' | ', prev, ' | ', l_linenumber) ELSE concat(raw, ' | ', prev, ' | ', cur) END AS evidence
      FROM l WHERE kind_no IN (0, 1)),
  p AS (SELECT doc, page, 'line' AS kind, CAST(NULL AS INT) AS table_no, n + 1 AS row_no, CASE WHEN raw = 'x' THEN concat('x  ', cur) ELSE raw END AS label, 'Balance Sheet' AS source_statement,
      coalesce(last_value(CASE WHEN raw = 'Other Income' THEN 'Income' END IGNORE NULLS) OVER (PARTITION BY page ORDER BY n), 'Current Liabilities') AS section, '' AS note_number,
      -- a label has four characters at least, so a short one takes the first amount with it
      CASE WHEN raw = 'x' THEN nullif(prev, '-') ELSE cur END AS current_value, CASE WHEN raw <> 'x' THEN nullif(prev, '-') END AS previous_value, concat(raw, '  ', cur, ' ', prev) AS evidence FROM l WHERE kind_no = 3),
  c AS (SELECT doc, page, kind, table_no, CAST(row_no AS INT) AS row_no, 0 AS item_no, label, concat_ws(' > ', source_statement, section, CASE WHEN label = section THEN NULL ELSE label END) AS context_path,
      source_statement, note_number, current_value, previous_value, evidence FROM (SELECT * FROM t UNION ALL SELECT * FROM p) WHERE label NOT IN ('Auditor fees', '12345', 'x'))"""


@query(f"WITH {_CANDIDATES} SELECT * FROM c")
def page_candidates(spark, sf):
    return candidates.page_candidates(pages(spark, sf))


_FY = f"concat(y - 1, '-', lpad(CAST(y % 100 AS VARCHAR), 2, '0')) AS current_fy, concat(y - 2, '-', lpad(CAST((y - 1) % 100 AS VARCHAR), 2, '0')) AS previous_fy"
_META = f"""m AS (SELECT doc, {_FY}, pages_processed, pages_rejected FROM (SELECT o_custkey AS doc, 2022 + o_custkey % 3 AS y, count(*) AS pages_processed,
      count(*) FILTER (WHERE o_orderkey % 4 = 2) AS pages_rejected FROM orders GROUP BY o_custkey))"""


@query(f"WITH {_META} SELECT * FROM m")
def document_metadata(spark, sf):
    return candidates.document_metadata(pages(spark, sf))


_TERMS = [("receivables", "trade receivable"), ("payables", "trade payables"), ("payables", "other payables of all kinds"), ("capital", "share capital"), ("other_income", "income"), ("inventory", "inventories")]
_LEARNED = [("inventory", "gratuity"), ("capital", "trade receivables"), ("cash", "cash in hand")]
_FIELDS = [*dict.fromkeys(f for f, _ in _TERMS), "cash"]


def _tables(spark):
    return spark.createDataFrame(_TERMS, "field string, term string"), spark.createDataFrame(_LEARNED, "field string, term string"), spark.createDataFrame([(f,) for f in _FIELDS], "field string")


def _values(rows: list[tuple[str, ...]]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows) + ")"


def _pass(name: str, terms: list[tuple[str, str]]) -> str:
    """First candidate of each field: by page, tables before lines."""
    number = "CAST(nullif({}, '-') AS DOUBLE)"
    return f"""{name} AS (SELECT doc, field, {number.format('current_value')} AS cur, {number.format('previous_value')} AS prev FROM c JOIN {_values(terms)} AS t(field, term)
      ON contains(lower(label), term) OR contains(term, lower(label)) QUALIFY row_number() OVER (PARTITION BY doc, field ORDER BY page, kind DESC, table_no, row_no, label) = 1)"""


_FOUND = f"""WITH {_CANDIDATES}, {_META}, {_pass('one', _TERMS)}, {_pass('two', _LEARNED)},
  d AS (SELECT doc, field FROM (SELECT DISTINCT o_custkey AS doc FROM orders), {_values([(f,) for f in _FIELDS])} AS f(field)),
  e AS (SELECT doc, field, one.cur IS NULL AND one.prev IS NULL AS empty, one.cur AS c1, one.prev AS p1, two.cur AS c2, two.prev AS p2 FROM d LEFT JOIN one USING (doc, field) LEFT JOIN two USING (doc, field)),
  f AS (SELECT doc, field, CASE WHEN empty THEN c2 ELSE c1 END AS "current", CASE WHEN empty THEN p2 ELSE p1 END AS previous, empty AND coalesce(c2, p2) IS NOT NULL AS from_second FROM e)"""


def _fields(spark, of, parts=None):
    terms, learned, catalogue = _tables(spark)
    return extraction.document_fields(of, terms, catalogue, learned, parts)


@query(f"{_FOUND} SELECT * FROM f")
def document_fields(spark, sf):
    return _fields(spark, pages(spark, sf))


@query(f"""{_FOUND} SELECT m.*, found, total, round(found * 100.0 / total, 1) AS coverage FROM m
  JOIN (SELECT doc, count(coalesce("current", previous)) AS found, count(*) AS total FROM f GROUP BY doc) USING (doc)""")
def scanned_summary(spark, sf):
    of = pages(spark, sf)
    parts = candidates.parsed(of)
    return extraction.document_summary(of, _fields(spark, of, parts), parts)


_PAGED = "SELECT doc_id % 97 AS doc, doc_id AS page, text FROM documents"
_PIECES = f"SELECT doc, string_agg(concat(chr(10), '=== Page ', page, ' ===', chr(10), coalesce(text, ''), chr(10)), '' ORDER BY page, text) AS t FROM ({_PAGED}) GROUP BY doc"


@query(f"""SELECT doc, CAST(k AS BIGINT) AS chunk_idx, length(c) AS n_chars, sha256(c) AS sha FROM (
  SELECT doc, k, substr(t, CAST(k * 4500 + 1 AS BIGINT), 6000) AS c FROM (SELECT doc, t, unnest(range(0, CAST(greatest(1, ceil((length(t) - 6000) / 4500.0) + 1) AS BIGINT))) AS k FROM ({_PIECES})))""")
def paged_chunks(spark, sf):
    rows = text.document_chunks(load(spark, sf, "documents").selectExpr("doc_id % 97 AS doc", "doc_id AS page", "text"))
    return rows.select("doc", F.col("chunk_idx").cast("bigint").alias("chunk_idx"), F.char_length("chunk").cast("bigint").alias("n_chars"), F.sha2("chunk", 256).alias("sha"))


_UNITS = choose("o_orderkey", ["Rs. in Lakhs", "amount in crore", "rupees", "₹ in thousands", "plain", "crores", "in lakhs", "notes", "of", "it", "at", "on", "by"])


@query(f"""SELECT doc, CASE WHEN bool_or(t LIKE '%amount in crore%') THEN 'Crores' WHEN bool_or(t LIKE '%in thousands%') THEN 'Thousands' ELSE 'Lakhs' END AS unit
  FROM (SELECT o_custkey AS doc, {_UNITS} AS t FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 4) GROUP BY doc""")
def document_units(spark, sf):
    return text.document_unit(load(spark, sf, "orders").selectExpr("o_custkey AS doc", "o_orderkey AS page", f"{_UNITS} AS text"), first=4)


_DOCS = """o_orderkey AS doc_id, o_orderpriority AS filename, CASE WHEN o_orderkey % 3 = 0 THEN '2023-24' WHEN o_orderkey % 3 = 1 THEN '' END AS current_fy, CASE WHEN o_orderkey % 2 = 0 THEN '2022-23' END AS primary_fy,
  CAST(NULL AS STRING) AS previous_fy, CASE WHEN o_orderkey % 5 = 0 THEN '2021-22' END AS secondary_fy, CASE WHEN o_orderkey % 4 > 0 THEN o_orderstatus END AS status, CASE WHEN o_orderkey % 7 > 0 THEN o_custkey END AS fields_found"""


@query(f"""SELECT doc_id, filename, CASE WHEN doc_id % 3 = 0 THEN '2023-24' WHEN doc_id % 2 = 0 THEN '2022-23' ELSE 'unknown' END AS primary_fy, CASE WHEN doc_id % 5 = 0 THEN '2021-22' ELSE 'unknown' END AS secondary_fy,
  CASE WHEN doc_id % 4 = 0 THEN 'unknown' ELSE status END AS status, CAST(CASE WHEN doc_id % 7 = 0 THEN 0 ELSE fields_found END AS INT) AS fields_found FROM (SELECT {_DOCS} FROM orders)""")
def merged_documents(spark, sf):
    return documents.merged_documents(load(spark, sf, "orders").selectExpr(*[x.strip() for x in _split(_DOCS)]))


def _split(listed: str) -> list[str]:
    """Expressions of a list, cut at the commas outside brackets."""
    out, depth = [""], 0
    for c in listed:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out
