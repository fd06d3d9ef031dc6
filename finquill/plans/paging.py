"""Queries over pages and lines of scanned statements, made from orders and line items.

The SQL is written by hand; of the operators it shares only the fixed words.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from finquill.operators import pages as op
from finquill.plans.named import choose, query, words_table
from finquill.plans.statement import load

_HEAD = [
    "Balance Sheet as at March 31, 2024", "Statement of Profit and Loss for the year ended 31st March, 2023", "Cash flow from operating activities and investing activities",
    "Notes forming part of accounts: Note 4 Share capital", "Independent auditor's report", "Gross block and net block, 31 Mar 2022", "Deferred tax and trade payables", "Nothing of note here",
    "Financial year ended March 31, 2021 and March 31 2020", "EQUITY AND LIABILITIES Shareholders' Funds", "for the year ended on the last day of 2019",
]
_TAIL = [
    "Revenue from Operations 45,230.18 38,910.43", "Total current assets 1,200.50", "Acme Trading Limited", "Date : 12/04/2024", "Short term borrowings 10.00",
    "Total expense and depreciation", "Reserves and share capital", "annexure b of the report", "march 2018",
]
#: A page per order: document is the customer, page the order's number.
PAGE = f"concat({choose('o_orderkey', _HEAD)}, chr(10), {choose('o_orderkey + o_custkey', _TAIL)}, chr(10), {choose('o_custkey', _HEAD)}, chr(10), {choose('o_orderkey * 3 + 1', _TAIL)})"
PAGES_SQL = f"SELECT o_custkey AS doc, o_orderkey AS page, {PAGE} AS text FROM orders"
_LINE = [
    "Revenue from Operations", "Shareholders' Funds", "Non-current liabilities", "Trade Payables 12.50", "Page 12 of 40", "Current assets", "12345", "signature to note 4", "Other Income",
    "Statement forming part of accounts", "<table><tr><td>Share Capital</td></tr>", "rows go on", "</table>", "Place: Pune", "Cash from financing activities", "Grand Total", "Particulars", "short",
]
LINE = choose("l_partkey", _LINE)
LINES_SQL = f"SELECT l_orderkey AS doc, l_linenumber * 10000000 + l_partkey AS pos, {LINE} AS line FROM lineitem"


def pages(spark, sf):
    return load(spark, sf, "orders").selectExpr("o_custkey AS doc", "o_orderkey AS page", f"{PAGE} AS text")


def lines(spark, sf):
    return load(spark, sf, "lineitem").selectExpr("l_orderkey AS doc", "l_linenumber * 10000000 + l_partkey AS pos", f"{LINE} AS line")


_TYPES = f"""p AS ({PAGES_SQL}),
 s AS (SELECT p.page, w.ord, w.name, count(*) AS n FROM p JOIN {words_table(op.PAGE_TYPES).replace('AS words', 'AS w')} ON contains(lower(p.text), w.word) GROUP BY ALL),
 k AS (SELECT s.page, s.name, s.ord, s.n FROM s JOIN p USING (page) WHERE
   (name NOT IN ('Balance Sheet', 'Statement of Profit and Loss', 'Cash Flow Statement', 'Notes to Accounts'))
   OR (name = 'Notes to Accounts' AND (n >= 2 OR regexp_matches(lower(text), 'accompanying notes|notes to financial|notes forming part')))
   OR (name <> 'Notes to Accounts' AND (n >= 2 OR contains(lower(text), lower(name)) OR (name = 'Statement of Profit and Loss' AND contains(lower(text), 'profit & loss'))))),
 t AS (SELECT p.page, p.doc, p.text, CASE WHEN regexp_matches(lower(p.text), '(auditor''s|auditors|directors''|directors|auditor’s|directors’) report') THEN ['Other']
   ELSE coalesce((SELECT list(k.name ORDER BY k.n DESC, k.ord) FROM k WHERE k.page = p.page), ['Other']) END AS types FROM p)"""


@query(f"WITH {_TYPES} SELECT page, array_to_string(types, '|') AS types FROM t")
def page_types(spark, sf):
    return pages(spark, sf).select("page", F.array_join(op.page_types(F.col("text")), "|").alias("types"))


@query(f"""WITH {_TYPES} SELECT page, coalesce(list_filter(types, lambda x: x IN ('Balance Sheet', 'Statement of Profit and Loss', 'Cash Flow Statement'))[1],
  CASE WHEN regexp_matches(lower(text), 'profit and loss|revenue from operations|total expense|depreciation') THEN 'Statement of Profit and Loss'
       WHEN regexp_matches(lower(text), 'balance sheet|equity & liabilities|share capital|borrowings') THEN 'Balance Sheet'
       WHEN regexp_matches(lower(text), 'cash flow|operating activities|investing activities') THEN 'Cash Flow Statement' ELSE 'Balance Sheet' END) AS statement FROM t""")
def statement_type(spark, sf):
    rows = pages(spark, sf).withColumn("types", op.page_types(F.col("text")))
    return rows.select("page", op.statement_type(F.col("types"), F.col("text")).alias("statement"))


@query(f"SELECT doc, pos, regexp_matches(lower(line), 'particular|note no|asat 31st|as at 31st|year ended|ended 31st') AS header FROM ({LINES_SQL})")
def header_rows(spark, sf):
    return lines(spark, sf).select("doc", "pos", op.is_header_row(F.array("line", F.lit("1,000.00"))).alias("header"))


@query(f"SELECT doc, pos, regexp_matches(line, '(?i)\\b(total|sub\\s*total|grand\\s*total)\\b') AS total FROM ({LINES_SQL})")
def total_rows(spark, sf):
    return lines(spark, sf).select("doc", "pos", op.is_total_row(F.col("line")).alias("total"))


_STMT = choose("l_orderkey", ["Balance Sheet", "Notes to Accounts", "Other", "Cash Flow Statement"])


@query(f"""SELECT doc, pos, s NOT IN ('Balance Sheet', 'Statement of Profit and Loss', 'Cash Flow Statement', 'Notes to Accounts') OR NOT regexp_matches(line, '[A-Za-z]')
  OR regexp_matches(lower(line), '^page\\s*\\d+|^\\d+\\s*of\\s*\\d+$|^confidential$|^annual\\s*report\\s*\\d{{4}}|^statements? forming part of|signature\\s*to\\s*note|referred\\s*to\\s*in\\s*our\\s*report')
  OR regexp_matches(lower(line), 'auditor|caro|annexure|certification|chartered accountant|signature|declaration|compliance certificate|memorandum|articles of association|directors. report|directors report|board.s report|board report|signatories|signed in terms of our report') AS rejected
  FROM (SELECT l_orderkey AS doc, l_linenumber * 10000000 + l_partkey AS pos, {LINE} AS line, {_STMT} AS s FROM lineitem)""")
def candidate_reject(spark, sf):
    rows = load(spark, sf, "lineitem").selectExpr("l_orderkey AS doc", "l_linenumber * 10000000 + l_partkey AS pos", f"{LINE} AS line", f"{_STMT} AS s")
    return rows.select("doc", "pos", op.is_rejected_candidate(F.col("line"), F.lit("x > y"), F.col("line"), F.col("s")).alias("rejected"))


@query(f"SELECT doc, pos, line FROM ({LINES_SQL}) WHERE length(trim(line)) >= 8 AND NOT regexp_matches(lower(trim(line)), 'din\\s*no\\s*:|udin\\s*:|cin\\s*:|membership\\s*no|registration\\s*no|date\\s*:|place\\s*:|page\\s*\\d+|director|partner')")
def prose_lines(spark, sf):
    return lines(spark, sf).where(~op.is_prose_skipped(F.col("line")))


@query(f"""WITH l AS ({LINES_SQL}), o AS (SELECT doc, pos, contains(lower(line), '</table>') AS c FROM l WHERE contains(lower(line), '<table') OR contains(lower(line), '</table>'))
 SELECT l.doc, l.pos, l.line FROM l WHERE NOT contains(lower(line), '</table>') AND coalesce((SELECT arg_max(o.c, o.pos) FROM o WHERE o.doc = l.doc AND o.pos <= l.pos), true)""")
def lines_outside_tables(spark, sf):
    return op.outside_tables(lines(spark, sf), ["doc"], "pos", "line")


_SECTION = """CASE WHEN regexp_matches(lower(line), 'shareholders[''’]?\\s*funds?') THEN 'Shareholders'' Funds'
 WHEN regexp_matches(lower(line), 'non[- ]current\\s+(liabilities|assets)') THEN CASE WHEN contains(lower(line), 'asset') THEN 'Non-Current Assets' ELSE 'Non-Current Liabilities' END
 WHEN regexp_matches(lower(line), 'current\\s+(liabilities|assets)') THEN CASE WHEN contains(lower(line), 'asset') THEN 'Current Assets' ELSE 'Current Liabilities' END
 WHEN contains(lower(line), 'income') THEN 'Income' WHEN contains(lower(line), 'expense') THEN 'Expenses'
 WHEN regexp_matches(lower(line), 'operating\\s+activities') THEN 'Operating Activities' WHEN regexp_matches(lower(line), 'investing\\s+activities') THEN 'Investing Activities'
 WHEN regexp_matches(lower(line), 'financing\\s+activities') THEN 'Financing Activities' END"""


@query(f"""WITH l AS (SELECT *, {_SECTION} AS s FROM ({LINES_SQL}))
 SELECT doc, pos, 'Balance Sheet' || CASE WHEN x IS NULL THEN '' ELSE ' > ' || x END || CASE WHEN line = x THEN '' ELSE ' > ' || line END AS context_path
 FROM (SELECT doc, pos, line, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos ROWS UNBOUNDED PRECEDING), NULL) AS x FROM l)""".replace("WHEN line = x THEN", "WHEN x IS NOT NULL AND line = x THEN"))
def context_paths(spark, sf):
    return op.context_paths(lines(spark, sf), ["doc"], "pos", "line", F.lit("Balance Sheet")).select("doc", "pos", "context_path")


_YEARS = """y AS (SELECT doc, page, k, i, CAST(found[i] AS INT) AS year FROM (SELECT doc, page, k, found, unnest(range(1, len(found) + 1)) AS i FROM (
  SELECT doc, page, k, regexp_extract_all(lower(text), pat, 1) AS found FROM p, (VALUES
    (1, 'year\\s+ended\\s+(?:march|mar)[\\s,]+31[,\\s]+(\\d{4})'), (2, 'march\\s+31[,\\s]+(\\d{4})'), (3, '31\\s*(?:st|nd|rd|th)?\\s*(?:march|mar)[,\\s]+(\\d{4})'),
    (4, 'as\\s+at\\s+(?:march|mar)[\\s,]+31[,\\s]+(\\d{4})'), (5, 'for\\s+the\\s+year\\s+ended[^\\n]*?(\\d{4})'), (6, 'year\\s+ended[^\\n]*?31[^\\n]*?(\\d{4})')) AS pats(k, pat)) WHERE len(found) > 0)),
 c AS (SELECT doc, year, count(*) AS n, min(page * 1000 + k * 100 + i) AS seen FROM y WHERE year BETWEEN 2010 AND 2035 GROUP BY ALL)"""


@query(f"""WITH p AS ({PAGES_SQL}), {_YEARS}
 SELECT doc, year, (year - 1) || '-' || lpad(CAST(year % 100 AS VARCHAR), 2, '0') AS current_fy, (year - 2) || '-' || lpad(CAST((year - 1) % 100 AS VARCHAR), 2, '0') AS previous_fy
 FROM c QUALIFY row_number() OVER (PARTITION BY doc ORDER BY n DESC, seen) = 1""")
def fy_from_text(spark, sf):
    return op.year_of_document(pages(spark, sf), ["doc"], "page", "text")


_NAME = choose("o_orderkey", ["acme FY_2022-23.pdf", "acme ay2023_2024 final.pdf", "report 2021-22 v2.pdf", "scan 2024.pdf", "scan 1999.pdf", "FY 2020-21.pdf", "notes 20231.pdf"])


@query(f"""WITH n AS (SELECT o_orderkey AS doc, {_NAME} AS name FROM orders), m AS (SELECT doc, name, regexp_extract(name, '(?i)(fy|ay)[_\\s-]?(\\d{{4}})[_\\-](\\d{{2,4}})', 2) AS a, regexp_extract(name, '(?i)(fy|ay)[_\\s-]?(\\d{{4}})[_\\-](\\d{{2,4}})', 3) AS b,
  regexp_extract(name, '(\\d{{4}})[_\\-](\\d{{2}})\\b', 1) AS c, regexp_extract(name, '(\\d{{4}})[_\\-](\\d{{2}})\\b', 2) AS d, regexp_extract(name, '\\b(20\\d{{2}})\\b', 1) AS e FROM n)
 SELECT doc, CASE WHEN a <> '' THEN a || '-' || CASE WHEN len(b) = 4 THEN b[3:4] ELSE CAST((CAST(a AS INT) + 1) % 100 AS VARCHAR) END WHEN c <> '' THEN c || '-' || d WHEN e <> '' THEN (CAST(e AS INT) - 1) || '-' || e[3:4] END AS current_fy,
  CASE WHEN a <> '' THEN (CAST(a AS INT) - 1) || '-' || a[3:4] WHEN c <> '' THEN (CAST(c AS INT) - 1) || '-' || c[3:4] WHEN e <> '' THEN (CAST(e AS INT) - 2) || '-' || CAST((CAST(e AS INT) - 1) % 100 AS VARCHAR) END AS previous_fy FROM m""")
def fy_from_filename(spark, sf):
    current, previous = op.year_of_filename(F.col("name"))
    return load(spark, sf, "orders").selectExpr("o_orderkey AS doc", f"{_NAME} AS name").select("doc", current.alias("current_fy"), previous.alias("previous_fy"))


_FY = choose("o_orderkey", ["2024-25", "2023-2024", "unknown", "FY 2022", "1999", "1998-99", "2019-2"])


@query(f"""SELECT doc, CASE WHEN fy = 'unknown' THEN NULL WHEN regexp_matches(fy, '\\d{{4}}-\\d{{4}}') THEN CAST(split_part(fy, '-', 2) AS INT)
  WHEN regexp_matches(fy, '\\d{{4}}-\\d{{2}}') THEN CAST(fy[1:2] AS INT) * 100 + CAST(split_part(fy, '-', 2) AS INT) ELSE TRY_CAST(nullif(regexp_extract(fy, '\\b(20\\d{{2}})\\b', 1), '') AS INT) END AS year
  FROM (SELECT o_orderkey AS doc, {_FY} AS fy FROM orders)""")
def fy_end_year(spark, sf):
    return load(spark, sf, "orders").selectExpr("o_orderkey AS doc", f"{_FY} AS fy").select("doc", op.end_year(F.col("fy")).alias("year"))


@query(f"""WITH p AS ({PAGES_SQL}), m AS (SELECT page, TRY_CAST(regexp_extract(lower(text), 'march\\s+31[,\\s]+(\\d{{4}})', 1) AS INT) AS a, TRY_CAST(regexp_extract(lower(text), '31\\s*(?:st|nd|rd|th)?\\s+march[,\\s]+(\\d{{4}})', 1) AS INT) AS b,
  TRY_CAST(regexp_extract(lower(text), 'march[,\\s]+(\\d{{4}})', 1) AS INT) AS c FROM p)
 SELECT page, CASE WHEN a BETWEEN 2015 AND 2035 THEN a WHEN b BETWEEN 2015 AND 2035 THEN b WHEN c BETWEEN 2015 AND 2035 THEN c END AS year FROM m""")
def fy_old_spellings(spark, sf):
    return pages(spark, sf).select("page", op.old_year(F.col("text")).alias("year"))


_WEIGHT = "8 * contains(t, 'balance sheet')::INT + 8 * contains(t, 'equity and liabilities')::INT + 5 * contains(t, 'share capital')::INT + 3 * contains(t, 'reserves')::INT + 3 * contains(t, 'non current liabilities')::INT + 3 * contains(t, 'short term borrowings')::INT + 3 * contains(t, 'trade payables')::INT"


@query(f"""WITH p AS (SELECT doc, CAST(page % 40 AS INT) AS no, lower(text) AS t FROM ({PAGES_SQL})), s AS (SELECT doc, no, CASE WHEN no BETWEEN 11 AND 17 THEN {_WEIGHT} ELSE 0 END AS score FROM p)
 SELECT doc, CASE WHEN score > 0 THEN no ELSE 14 END AS best_page, score FROM s QUALIFY row_number() OVER (PARTITION BY doc ORDER BY score DESC, no) = 1""")
def balance_sheet_page(spark, sf):
    return op.best_balance_page(pages(spark, sf).withColumn("page", (F.col("page") % 40).cast("int")), ["doc"], "page", "text")


@query(f"WITH l AS (SELECT doc, page, unnest(string_split(text, chr(10))) AS line, unnest(range(4)) AS i FROM ({PAGES_SQL})) SELECT doc, arg_min(trim(line), page * 10 + i) AS company_name FROM l WHERE contains(lower(line), 'limited') AND length(trim(line)) > 5 GROUP BY doc")
def company_names(spark, sf):
    rows = pages(spark, sf).select("doc", "page", F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("pos", F.col("page") * 10 + F.col("i"))
    return op.company_line(rows, ["doc"], "pos", "line")


@query(f"SELECT page, array_to_string(string_split(text, chr(10))[1:2], chr(10)) AS head FROM ({PAGES_SQL}) WHERE contains(lower(text), 'share capital') AND (contains(lower(text), 'reserves') OR contains(lower(text), 'balance sheet'))")
def page_finder(spark, sf):
    return op.find_pages(pages(spark, sf), "text", ["share capital"], ["reserves", "balance sheet"], 2).select("page", "head")


@query(f"""WITH l AS (SELECT page, string_split(text, chr(10)) AS ls, unnest(range(4)) AS i FROM ({PAGES_SQL}))
 SELECT page, CAST(i AS INT) AS line_no, array_to_string(ls[greatest(1, i - 1):i + 5], chr(10)) AS around FROM l WHERE regexp_matches(ls[i + 1], '1,?200\\.50')""")
def value_context(spark, sf):
    return op.line_context(pages(spark, sf), "text", r"1,?200\.50").select("page", "line_no", "around")


@query(f"""WITH f AS (SELECT * FROM (VALUES ('Capital', 'share capital'), ('Capital', 'reserves'), ('Sales', 'revenue from')) AS f(field, term)), l AS (SELECT doc, page, string_split(text, chr(10)) AS ls, unnest(range(1, 5)) AS i FROM ({PAGES_SQL})),
 m AS (SELECT doc, page, field, min(i) AS line_no, any_value(ls) AS ls FROM l JOIN f ON contains(lower(ls[i]), term) GROUP BY doc, page, field)
 SELECT doc, field, page, CAST(line_no AS INT) AS line_no, array_to_string(ls[greatest(1, line_no - 2):line_no + 3], chr(10)) AS snippet FROM m QUALIFY row_number() OVER (PARTITION BY doc, field ORDER BY page) <= 6""")
def field_snippets(spark, sf):
    terms = spark.createDataFrame([("Capital", "share capital"), ("Capital", "Reserves"), ("Sales", "revenue from")], "field string, term string")
    return op.field_snippets(pages(spark, sf), ["doc"], "page", "text", terms)


@query(f"SELECT doc, string_agg(text, chr(10) || chr(10) ORDER BY page) AS markdown FROM ({PAGES_SQL}) GROUP BY doc")
def document_markdown(spark, sf):
    """All pages of a document as one text, in page order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"])
    return pages(spark, sf).groupBy("doc").agg(F.array_join(ordered, "\n\n").alias("markdown"))
