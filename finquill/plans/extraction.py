"""Queries over tables, candidates, fields and sheet rows; the SQL is written by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from finquill.operators import extract, merge, tables
from finquill.operators.pages import is_header_cell
from finquill.plans.named import choose, query
from finquill.plans.statement import load

_POS = "l_linenumber * 10000000 + l_partkey * 100 + l_suppkey % 100"
_LABEL = choose("l_partkey", ["Revenue from Operations", "Share Capital", "Trade Payables", "Net Sales", "Total Current Assets", "Other Income", "Short", "Borrowings from banks", "Custom Item A", "Capital"])
_CUR = "concat(CAST(CAST(l_quantity AS INT) AS STRING), '.5')"
_PREV = "CASE WHEN l_suppkey % 3 > 0 THEN concat('(', CAST(CAST(l_quantity AS INT) + 1 AS STRING), '.25)') END"
_CANDS = f"SELECT l_orderkey AS doc, {_POS} AS pos, CAST(l_linenumber AS INT) AS page, {_LABEL} AS label, {_CUR} AS current_value, {_PREV} AS previous_value FROM lineitem"
_TERMS = [("Sales", "revenue from"), ("Sales", "Net Sales"), ("Capital", "share capital account"), ("Capital", "Capital"), ("Payables", "trade payables"), ("Loans", "borrowings")]
_TERMS_SQL = "(VALUES " + ", ".join(f"('{f}', '{t}')" for f, t in _TERMS) + ") AS t(field, term)"


def _cands(spark, sf):
    return load(spark, sf, "lineitem").selectExpr("l_orderkey AS doc", f"{_POS} AS pos", "CAST(l_linenumber AS INT) AS page", f"{_LABEL} AS label", f"{_CUR} AS current_value", f"{_PREV} AS previous_value")


def _terms(spark):
    return spark.createDataFrame(_TERMS, "field string, term string")


# ---- column roles and candidates ------------------------------------------
# a table per order: header rows from the order, a row per line
_H = [choose("o_orderkey", ["Particulars", "Description", "x", "Assets"]), choose("o_custkey", ["Note No", "As at 31st March 2025", "2025", ""]), choose("o_orderkey + 1", ["31st march 2025", "FY 24", "2024", "Note"]), choose("o_custkey + 1", ["2024", "25", "", "31st march 2024"])]
_HEAD = ", ".join(f"{h} AS h{k}" for k, h in enumerate(_H))
_CELLS = f"""h AS (SELECT o_orderkey AS doc, {_HEAD} FROM orders), hc AS (SELECT doc, 0 AS row_no, unnest([0, 1, 2, 3]) AS col_no, unnest([h0, h1, h2, h3]) AS text FROM h),
 l AS (SELECT l_orderkey AS doc, 2 + row_number() OVER (PARTITION BY l_orderkey ORDER BY {_POS}, l_extendedprice) AS row_no, {_LABEL} AS label, {_CUR} AS cur FROM lineitem),
 cells AS (SELECT * FROM hc UNION ALL SELECT doc, row_no, unnest([0, 1, 2, 3]), unnest([label, '7', cur, 'abc']) FROM l)"""


def _cells(spark, sf):
    from pyspark.sql import Window

    h = load(spark, sf, "orders").selectExpr("o_orderkey AS doc", *[f"{x} AS h{k}" for k, x in enumerate(_H)])
    head = h.select("doc", F.lit(0).alias("row_no"), F.posexplode(F.array("h0", "h1", "h2", "h3")).alias("col_no", "text"))
    rows = load(spark, sf, "lineitem").selectExpr("l_orderkey AS doc", f"{_POS} AS pos", f"{_LABEL} AS label", f"{_CUR} AS cur", "l_extendedprice")
    rows = rows.withColumn("row_no", 2 + F.row_number().over(Window.partitionBy("doc").orderBy("pos", "l_extendedprice")))
    body = rows.select("doc", "row_no", F.posexplode(F.array("label", F.lit("7"), "cur", F.lit("abc"))).alias("col_no", "text"))
    return head.unionByName(body)


_ROLES = f"""{_CELLS}, v AS (SELECT doc, row_no, col_no, regexp_matches(lower(text), '\\b(2025|25)\\b') AS c, regexp_matches(lower(text), '\\b(2024|24)\\b') AS p, regexp_matches(lower(text), 'particular|asset|liabilit|equity|description') AS l, contains(lower(text), 'note') AS n FROM cells WHERE row_no < 3),
 g AS (SELECT doc, max(col_no) + 1 AS width FROM cells GROUP BY doc),
 a AS (SELECT g.doc, width, (SELECT col_no FROM v WHERE v.doc = g.doc AND c GROUP BY col_no ORDER BY count(*) DESC, min(row_no), col_no LIMIT 1) AS c, (SELECT col_no FROM v WHERE v.doc = g.doc AND p GROUP BY col_no ORDER BY count(*) DESC, min(row_no), col_no LIMIT 1) AS p,
  (SELECT col_no FROM v WHERE v.doc = g.doc AND l GROUP BY col_no ORDER BY count(*) DESC, min(row_no), col_no LIMIT 1) AS l, (SELECT col_no FROM v WHERE v.doc = g.doc AND n GROUP BY col_no ORDER BY count(*) DESC, min(row_no), col_no LIMIT 1) AS n FROM g),
 b AS (SELECT doc, coalesce(c, CASE WHEN width > 1 THEN 1 ELSE 0 END) AS current_col, coalesce(p, CASE WHEN width > 2 THEN 2 ELSE -1 END) AS previous_col, l, coalesce(n, -1) AS note_col FROM a),
 m AS (SELECT cells.doc, cells.col_no, sum(CASE WHEN row_no >= 3 THEN length(regexp_replace(text, '[^A-Za-z]', '', 'g')) ELSE 0 END) AS letters FROM cells GROUP BY ALL),
 r AS (SELECT b.doc, current_col, previous_col, coalesce(l, (SELECT m.col_no FROM m WHERE m.doc = b.doc AND m.col_no <> current_col AND m.col_no <> previous_col ORDER BY letters DESC, m.col_no LIMIT 1), 0) AS label_col, note_col FROM b)"""


@query(f"WITH {_ROLES} SELECT doc, CAST(current_col AS INT) AS current_col, CAST(previous_col AS INT) AS previous_col, CAST(label_col AS INT) AS label_col, CAST(note_col AS INT) AS note_col FROM r")
def column_roles(spark, sf):
    return tables.column_roles(_cells(spark, sf), ["doc"], F.lit(2025), F.lit(2024))


@query(f"""WITH {_ROLES}, w AS (SELECT cells.doc, row_no, max(CASE WHEN col_no = label_col THEN nullif(trim(text), '') END) AS label, max(CASE WHEN col_no = note_col THEN nullif(trim(text), '') END) AS note, max(CASE WHEN col_no = current_col THEN nullif(trim(text), '') END) AS current_value,
 max(CASE WHEN col_no = previous_col THEN nullif(trim(text), '') END) AS previous_value, bool_or(regexp_matches(lower(text), 'particular|note no|asat 31st|as at 31st|year ended|ended 31st')) AS head FROM cells JOIN r ON r.doc = cells.doc GROUP BY cells.doc, row_no)
 SELECT doc, CAST(row_no AS INT) AS row_no, label, note, current_value, previous_value FROM w WHERE NOT head AND label IS NOT NULL AND (current_value IS NOT NULL OR previous_value IS NOT NULL)""")
def table_candidates(spark, sf):
    cells = _cells(spark, sf)
    return tables.candidates(cells, tables.column_roles(cells, ["doc"], F.lit(2025), F.lit(2024)), ["doc"], is_header_cell(F.col("text")))


_PROSE = choose("l_partkey", ["Share Capital 1,020.00 1,018.00", "Other Income 41.89", "no amount here", "12 34", "Depreciation (5.5)", "Note 4"])


@query(f"""SELECT doc, pos, trim(CASE WHEN t2 THEN regexp_extract(s, '^(.*?[A-Za-z].*?)\\s+(\\(?-?\\d[\\d,]*(?:\\.\\d+)?\\)?)\\s+(\\(?-?\\d[\\d,]*(?:\\.\\d+)?\\)?)\\s*$', 1) ELSE regexp_extract(s, '^(.*?[A-Za-z].*?)\\s+(\\(?-?\\d[\\d,]*(?:\\.\\d+)?\\)?)\\s*$', 1) END) AS label,
 CASE s WHEN 'Share Capital 1,020.00 1,018.00' THEN '1,020.00' ELSE split_part(s, ' ', -1) END AS current_value, CASE s WHEN 'Share Capital 1,020.00 1,018.00' THEN '1,018.00' END AS previous_value
 FROM (SELECT l_orderkey AS doc, {_POS} AS pos, {_PROSE} AS s, {_PROSE} LIKE 'Share%' AS t2 FROM lineitem) WHERE s NOT IN ('no amount here', '12 34')""")
def prose_candidates(spark, sf):
    rows = load(spark, sf, "lineitem").selectExpr("l_orderkey AS doc", f"{_POS} AS pos", f"{_PROSE} AS s")
    return tables.prose_candidates(rows, ["doc", "pos"], "s")


@query(f"""WITH c AS (SELECT doc, pos, label, current_value, 'table' AS source FROM ({_CANDS}) UNION ALL SELECT l_orderkey, {_POS}, 'Other Income', '41.89', 'prose' FROM lineitem WHERE l_partkey % 6 = 1)
 SELECT source, label, count(*) AS n FROM c GROUP BY ALL""")
def candidate_union(spark, sf):
    rows = load(spark, sf, "lineitem").selectExpr("l_orderkey AS doc", f"{_POS} AS pos", f"{_PROSE} AS s").where("s like 'Other%'")
    prose = tables.prose_candidates(rows, ["doc", "pos"], "s").withColumn("source", F.lit("prose"))
    both = _cands(spark, sf).withColumn("source", F.lit("table")).unionByName(prose, allowMissingColumns=True)
    return both.groupBy("source", "label").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT o_custkey AS doc, o_orderkey AS pos, CASE WHEN o_orderkey % 5 = 0 THEN ['A', 'B', 'C', 'D'] END AS labels, CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN [] WHEN 1 THEN ['1'] ELSE ['2', '3'] END AS vals FROM orders),
 c AS (SELECT *, sum(CASE WHEN labels IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY pos) AS cell FROM r), b AS (SELECT *, coalesce(sum(len(vals)) OVER (PARTITION BY doc, cell ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c WHERE cell > 0),
 e AS (SELECT doc, pos, before, unnest(vals) AS value, unnest(range(len(vals))) AS k FROM b) SELECT doc, pos, CAST(k AS INT) AS k, CASE WHEN before + k < 4 THEN substr('ABCD', CAST(before + k + 1 AS INT), 1) END AS label, value FROM e""")
def jammed_alignment(spark, sf):
    rows = load(spark, sf, "orders").selectExpr("o_custkey AS doc", "o_orderkey AS pos", "CASE WHEN o_orderkey % 5 = 0 THEN array('A', 'B', 'C', 'D') END AS labels", "CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN CAST(array() AS ARRAY<STRING>) WHEN 1 THEN array('1') ELSE array('2', '3') END AS vals")
    return tables.align_labels(rows, ["doc"], "pos")


_WORD = "CAST(l_linenumber * 20 + l_partkey % 3 AS INT) AS top, CAST(l_partkey * 1000 + l_suppkey % 1000 AS INT) AS left_at, CAST(l_partkey % 100 AS INT) AS x_pct, concat('w', CAST(l_partkey AS STRING)) AS text, CAST(l_partkey * 7 % 100 AS INT) AS conf"


@query(f"SELECT doc, top, text FROM (SELECT l_orderkey AS doc, {_WORD} FROM lineitem) WHERE conf >= 40 AND trim(text) <> ''")
def usable_words(spark, sf):
    return tables.usable_words(load(spark, sf, "lineitem").selectExpr("l_orderkey AS doc", "CAST(l_linenumber * 20 + l_partkey % 3 AS INT) AS top", "concat('w', CAST(l_partkey AS STRING)) AS text", "CAST(l_partkey * 7 % 100 AS INT) AS conf")).select("doc", "top", "text")


def _words(spark, sf):
    return load(spark, sf, "lineitem").selectExpr("l_orderkey AS doc", "CAST(l_linenumber * 20 + l_partkey % 3 AS INT) AS top", "CAST(l_partkey * 1000 + l_suppkey % 1000 AS INT) AS left", "CAST(l_partkey % 100 AS INT) AS x_pct", "concat('w', CAST(l_partkey AS STRING)) AS text")


@query(f"""WITH w AS (SELECT l_orderkey AS doc, {_WORD} FROM lineitem), g AS (SELECT *, sum(CASE WHEN d > 10 THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY top, left_at ROWS UNBOUNDED PRECEDING) AS row_group FROM (SELECT *, coalesce(abs(top - lag(top) OVER (PARTITION BY doc ORDER BY top, left_at)), 0) AS d FROM w))
 SELECT doc, CAST(row_group AS BIGINT) AS row_group, coalesce(string_agg(text, ' ' ORDER BY left_at) FILTER (x_pct < 54), '') AS label, coalesce(string_agg(text, ' ' ORDER BY left_at) FILTER (x_pct BETWEEN 60 AND 77), '') AS current_text, coalesce(string_agg(text, ' ' ORDER BY left_at) FILTER (x_pct > 77), '') AS previous_text, string_agg(text, ' ' ORDER BY left_at) AS raw FROM g GROUP BY doc, row_group""")
def scanned_rows(spark, sf):
    return tables.scanned_rows(_words(spark, sf), ["doc"])


_PART = choose("o_orderkey", ["Long", "- term borrowings", "Trade payables", "term loans", "short", "enterprises"])


@query(f"""WITH r AS (SELECT o_custkey AS doc, o_orderkey AS pos, {_PART} AS label, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE CAST(o_orderkey AS VARCHAR) END AS cur FROM orders), p AS (SELECT *, lag(lower(label)) OVER w AS above, lead(label) OVER w AS nl, lead(cur) OVER w AS nc FROM r WINDOW w AS (PARTITION BY doc ORDER BY pos)),
 c AS (SELECT *, CASE WHEN above IS NOT NULL AND (label IN ('- term borrowings', 'term loans', 'enterprises') OR (above IN ('long', 'short') AND (label LIKE '-%' OR label LIKE 'term%'))) THEN 1 ELSE 0 END AS goes_on FROM p),
 u AS (SELECT *, sum(1 - goes_on) OVER (PARTITION BY doc ORDER BY pos) AS run FROM c), q AS (SELECT *, row_number() OVER (PARTITION BY doc, run ORDER BY pos) - 1 AS place FROM u), z AS (SELECT *, place % 2 = 1 AS consumed, coalesce(lead(place % 2 = 1) OVER (PARTITION BY doc ORDER BY pos), false) AS pair FROM q)
 SELECT doc, pos, CASE WHEN pair THEN label || ' ' || nl ELSE label END AS label, CASE WHEN pair THEN coalesce(nullif(nc, ''), cur) ELSE cur END AS current_text FROM z WHERE NOT consumed""")
def continuation_rows(spark, sf):
    rows = load(spark, sf, "orders").selectExpr("o_custkey AS doc", "o_orderkey AS pos", f"{_PART} AS label", "CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE CAST(o_orderkey AS STRING) END AS current_text", "'' AS previous_text", "'r' AS raw")
    return tables.joined_rows(rows, ["doc"], "pos").select("doc", "pos", "label", "current_text")


# ---- catalogue, terms and hints -------------------------------------------
@query("SELECT o_orderkey AS doc, o_orderpriority AS section, o_orderstatus AS field FROM orders WHERE (o_orderpriority, o_orderstatus) IN (SELECT o_orderpriority, o_orderstatus FROM orders WHERE o_orderkey % 500 = 0)")
def known_fields(spark, sf):
    rows = load(spark, sf, "orders").selectExpr("o_orderkey AS doc", "o_orderpriority AS section", "o_orderstatus AS field")
    return extract.known_fields(rows, rows.where("doc % 500 = 0")).select("doc", "section", "field")


_CAT = "SELECT p_brand AS section, p_partkey AS ord, p_name || CAST(p_partkey AS VARCHAR) AS field FROM part"


def _catalogue(spark, sf):
    return load(spark, sf, "part").selectExpr("p_brand AS section", "p_partkey AS ord", "concat(p_name, CAST(p_partkey AS STRING)) AS field")


@query(f"SELECT section, count(*) AS n_fields, string_agg(field, '|' ORDER BY ord) AS fields FROM ({_CAT}) GROUP BY section")
def catalogue_by_section(spark, sf):
    return extract.catalogue_by_section(_catalogue(spark, sf)).withColumn("fields", F.array_join("fields", "|"))


@query(f"SELECT section, field, CAST((row_number() OVER (PARTITION BY section ORDER BY ord) - 1) // 4 AS INT) AS batch FROM ({_CAT})")
def field_batches(spark, sf):
    return extract.batches(_catalogue(spark, sf)).select("section", "field", "batch")


@query("SELECT DISTINCT lower(trim(t)) AS term FROM (SELECT p_name AS t FROM part UNION ALL SELECT p_type FROM part UNION ALL SELECT ' ' || p_brand || ' ' FROM part) WHERE trim(t) <> ''")
def known_terms(spark, sf):
    p = load(spark, sf, "part")
    return extract.known_terms(*[p.select(F.expr(c).alias("term")) for c in ("p_name", "p_type", "concat(' ', p_brand, ' ')")])


@query("SELECT term, count(*) AS n FROM (SELECT p_brand AS term FROM part UNION ALL SELECT p_type FROM part WHERE p_size % 2 = 0) GROUP BY term")
def entity_overlay(spark, sf):
    p = load(spark, sf, "part")
    base = p.select(F.lit("f").alias("field"), F.col("p_brand").alias("term"))
    overlay = p.select(F.lit("f").alias("field"), F.col("p_type").alias("term"), F.when(F.col("p_size") % 2 == 0, "llp").otherwise("trust").alias("entity_type"))
    return extract.entity_terms(base, overlay, "llp").groupBy("term").agg(F.count("*").alias("n"))


_HINTS = f"""m AS (SELECT doc, t.field, label, current_value, previous_value, min(pos) AS pos, arg_min(page, pos) AS page FROM ({_CANDS}) JOIN {_TERMS_SQL} ON contains(lower(label), lower(term)) OR contains(lower(term), lower(label)) GROUP BY ALL),
 h AS (SELECT *, row_number() OVER (PARTITION BY doc, field ORDER BY pos, label, current_value NULLS FIRST, previous_value NULLS FIRST) AS place FROM m QUALIFY place <= 5)"""


@query(f"WITH {_HINTS} SELECT doc, field, label, current_value, previous_value, page, pos, place FROM h")
def candidate_hints(spark, sf):
    return extract.hints(_cands(spark, sf), _terms(spark))


@query(f"WITH {_HINTS} SELECT doc, field, 'Field ''' || field || ''' matches in table:' || chr(10) || string_agg('  - Label: ' || label || ' | Current: ' || coalesce(current_value, 'None') || ' | Previous: ' || coalesce(previous_value, 'None') || ' (Page ' || CAST(page AS VARCHAR) || ')', chr(10) ORDER BY place) AS hints FROM h GROUP BY doc, field")
def hint_texts(spark, sf):
    return extract.hint_text(extract.hints(_cands(spark, sf), _terms(spark)))


_EXTRACTED = f"{_HINTS}, x AS (SELECT d.doc, f.field, TRY_CAST(regexp_replace(current_value, '[()]', '', 'g') AS DOUBLE) AS current, TRY_CAST(regexp_replace(previous_value, '[()]', '', 'g') AS DOUBLE) AS previous FROM (SELECT DISTINCT doc FROM ({_CANDS})) d CROSS JOIN (SELECT DISTINCT field FROM {_TERMS_SQL}) f LEFT JOIN (SELECT * FROM h WHERE place = 1) h ON h.doc = d.doc AND h.field = f.field)"


@query(f"WITH {_EXTRACTED} SELECT * FROM x")
def rule_extraction(spark, sf):
    return extract.extracted(_cands(spark, sf), _terms(spark), _terms(spark)).select("doc", "field", "current", "previous")


@query(f"WITH {_EXTRACTED} SELECT doc, count(coalesce(current, previous)) AS found, count(*) AS total, round(count(coalesce(current, previous)) * 100.0 / count(*), 1) AS coverage FROM x GROUP BY doc")
def extraction_coverage(spark, sf):
    return extract.coverage(extract.extracted(_cands(spark, sf), _terms(spark), _terms(spark)))


@query(f"WITH {_EXTRACTED} SELECT doc, field FROM x WHERE current IS NULL AND previous IS NULL")
def null_fields(spark, sf):
    return extract.null_fields(extract.extracted(_cands(spark, sf), _terms(spark), _terms(spark)))


@query(f"""WITH {_EXTRACTED}, s AS (SELECT l_orderkey AS doc, 'Loans' AS field, max(l_extendedprice) AS c FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY l_orderkey)
 SELECT x.doc, x.field, CASE WHEN current IS NULL AND previous IS NULL THEN s.c ELSE current END AS current, previous, current IS NULL AND previous IS NULL AND s.c IS NOT NULL AS from_second FROM x LEFT JOIN s ON s.doc = x.doc AND s.field = x.field""")
def second_pass(spark, sf):
    second = load(spark, sf, "lineitem").where("l_orderkey % 2 = 0").groupBy(F.col("l_orderkey").alias("doc")).agg(F.max("l_extendedprice").alias("current"))
    return extract.second_pass(extract.extracted(_cands(spark, sf), _terms(spark), _terms(spark)), second.withColumn("field", F.lit("Loans")).withColumn("previous", F.lit(None).cast("double")))


_RAW = choose("o_orderkey", ["1,234.50", "0", "N/A", "10 + 20.5", "₹ 5,000", "(12.50)", "12-34", "-7.25", "2 * 3", "abc", "-"])


@query(f"""WITH r AS (SELECT o_orderkey AS doc, {_RAW} AS s, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_custkey % 10 AS DOUBLE) / 10 END AS conf FROM orders)
 SELECT doc, CAST(CASE s WHEN '1,234.50' THEN 1234.5 WHEN '0' THEN CASE WHEN coalesce(conf, 0) <> 0 THEN 0.0 END WHEN '10 + 20.5' THEN 30.5 WHEN '₹ 5,000' THEN 5000.0 WHEN '(12.50)' THEN -12.5 WHEN '-7.25' THEN -7.25 WHEN '2 * 3' THEN 23.0 END AS DOUBLE) AS value, round(coalesce(conf, 0), 2) AS confidence,
 CASE WHEN conf IS NULL THEN 'not extracted' ELSE '' END AS evidence FROM r""")
def entry_normalised(spark, sf):
    rows = load(spark, sf, "orders").selectExpr("o_orderkey AS doc", f"{_RAW} AS value", "CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_custkey % 10 AS DOUBLE) / 10 END AS confidence", "CAST(NULL AS STRING) AS evidence")
    return extract.entries(rows)


_STRICT = choose("o_orderkey", ["1,335.12", "772,16", "(28.82)", "4", "0.00", "1,234", "Rs 12.50", "12.3.4", ""])


@query(f"SELECT doc, CASE s WHEN '1,335.12' THEN 1335.12 WHEN '772,16' THEN 772.16 WHEN '(28.82)' THEN -28.82 WHEN 'Rs 12.50' THEN 12.5 END::DOUBLE AS amount FROM (SELECT o_orderkey AS doc, {_STRICT} AS s FROM orders)")
def strict_amounts(spark, sf):
    return load(spark, sf, "orders").selectExpr("o_orderkey AS doc", f"{_STRICT} AS s").select("doc", extract.strict_amount(F.col("s")).alias("amount"))


_ROWTEXT = choose("o_orderkey", ["Share Capital (1,020.00) 55.5", "Loans | 12.50 -", "Note 4 Trade 1,000.25 2,000.50", "plain"])


@query(f"SELECT doc, CASE s WHEN 'plain' THEN 'plain' WHEN 'Loans | 12.50 -' THEN 'Loans' WHEN 'Share Capital (1,020.00) 55.5' THEN 'Share Capital' ELSE 'Note Trade' END AS label, CASE s WHEN 'plain' THEN 0.0 WHEN 'Loans | 12.50 -' THEN 12.5 WHEN 'Share Capital (1,020.00) 55.5' THEN 1075.5 ELSE 3000.75 END::DOUBLE AS total FROM (SELECT o_orderkey AS doc, {_ROWTEXT} AS s FROM orders)")
def label_and_amounts(spark, sf):
    rows = load(spark, sf, "orders").selectExpr("o_orderkey AS doc", f"{_ROWTEXT} AS s")
    return rows.select("doc", extract.without_amounts(F.col("s")).alias("label"), F.aggregate(extract.amounts_in(F.col("s")), F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("SELECT p_partkey, p_name AS name FROM part WHERE p_partkey % 2 = 0 AND (contains(lower(p_name), 'red') OR contains(lower(p_name), '1'))")
def synonym_filter(spark, sf):
    rows = load(spark, sf, "part").where("p_partkey % 2 = 0").select("p_partkey", F.col("p_name").alias("name"))
    return extract.synonym_lines(rows, ["1", "Red"])


@query("""SELECT o_orderkey AS doc, 'Entity type: ' || o_orderstatus || CASE o_orderstatus WHEN 'O' THEN chr(10) || 'open guide' WHEN 'F' THEN chr(10) || 'final guide' ELSE '' END || CASE WHEN o_orderkey % 2 = 0 THEN chr(10) || 'Notes: n' || CAST(o_custkey AS VARCHAR) ELSE '' END AS context FROM orders""")
def entity_contexts(spark, sf):
    docs = load(spark, sf, "orders").selectExpr("o_orderkey AS doc", "o_orderstatus AS entity_type", "CASE WHEN o_orderkey % 2 = 0 THEN concat(' n', CAST(o_custkey AS STRING), ' ') ELSE ' ' END AS notes")
    return extract.entity_context(docs, spark.createDataFrame([("O", "open guide"), ("F", "final guide")], "entity_type string, guide string"))


@query(f"SELECT doc, pos, label FROM ({_CANDS}) WHERE label <> '' AND NOT EXISTS (SELECT 1 FROM {_TERMS_SQL} WHERE length(term) >= 4 AND (contains(lower(trim(label)), lower(term)) OR contains(lower(term), lower(trim(label)))))")
def unmapped_candidates(spark, sf):
    return merge.unmapped(_cands(spark, sf), _terms(spark)).select("doc", "pos", "label")


@query("SELECT DISTINCT lower(trim(p_type)) AS label, first_value(p_name) OVER (PARTITION BY lower(trim(p_type)) ORDER BY p_partkey) AS name FROM part")
def first_unmapped_labels(spark, sf):
    rows = load(spark, sf, "part").select("p_partkey", F.col("p_type").alias("label"), F.col("p_name").alias("name"))
    return merge.first_of_labels(rows, [], ["p_partkey"]).select(F.lower(F.trim("label")).alias("label"), "name")


# ---- injection ------------------------------------------------------------
@query("""WITH m AS (SELECT p_partkey AS row_no, p_brand AS section, p_type AS field, CASE WHEN p_size % 4 = 0 THEN 1.5 END AS def, CASE WHEN p_size % 7 = 0 THEN '=H' || CAST(p_partkey AS VARCHAR) || '+SH1' END AS f FROM part WHERE p_partkey % 2 = 0),
 v AS (SELECT p_brand AS section, p_type AS field, CASE p_size % 5 WHEN 0 THEN '25' WHEN 1 THEN '2025' WHEN 2 THEN '2024-25' WHEN 3 THEN '2024-2025' ELSE '2023-24' END AS k, max(CASE WHEN p_size % 11 > 0 THEN p_retailprice END) AS value FROM part GROUP BY ALL),
 b AS (SELECT section, field, arg_min(value, CASE k WHEN '25' THEN 1 WHEN '2025' THEN 2 WHEN '2024-25' THEN 3 ELSE 4 END) AS value FROM v WHERE k <> '2023-24' AND value IS NOT NULL GROUP BY ALL),
 o AS (SELECT p_partkey AS row_no, p_retailprice * 2 AS value FROM part WHERE p_partkey % 9 = 0), c AS (SELECT p_partkey AS row_no, '=H' || CAST(p_partkey AS VARCHAR) || '*2' AS f FROM part WHERE p_partkey % 5 = 0),
 j AS (SELECT r.row_no, m.row_no IS NOT NULL AS mapped, o.value AS ov, m.f, b.value AS v, m.def, c.f AS cf FROM (SELECT p_partkey AS row_no FROM part) r LEFT JOIN m ON m.row_no = r.row_no LEFT JOIN b ON b.section = m.section AND b.field = m.field LEFT JOIN o ON o.row_no = r.row_no LEFT JOIN c ON c.row_no = r.row_no),
 z AS (SELECT *, CASE WHEN ov IS NOT NULL THEN 'override' WHEN f IS NOT NULL THEN 'formula' WHEN v IS NOT NULL THEN 'value' WHEN def IS NOT NULL THEN 'default' WHEN NOT mapped AND cf IS NOT NULL THEN 'copied' END AS origin FROM j)
 SELECT row_no, CASE origin WHEN 'override' THEN ov WHEN 'value' THEN v WHEN 'default' THEN def END AS value, CASE origin WHEN 'formula' THEN '=J' || CAST(row_no AS VARCHAR) || '+SH1' WHEN 'copied' THEN '=J' || CAST(row_no AS VARCHAR) || '*2' END AS formula, origin FROM z WHERE origin IS NOT NULL""")
def sheet_injection_rules(spark, sf):
    p = load(spark, sf, "part")
    sheet = p.where("p_partkey % 2 = 0").selectExpr("p_partkey AS row_no", "p_brand AS section", "p_type AS field", "CASE WHEN p_size % 4 = 0 THEN 1.5D END AS default", "CASE WHEN p_size % 7 = 0 THEN concat('=H', CAST(p_partkey AS STRING), '+SH1') END AS formula")
    values = p.selectExpr("p_brand AS section", "p_type AS field", "CASE p_size % 5 WHEN 0 THEN '25' WHEN 1 THEN '2025' WHEN 2 THEN '2024-25' WHEN 3 THEN '2024-2025' ELSE '2023-24' END AS year_key", "CASE WHEN p_size % 11 > 0 THEN p_retailprice END AS value")
    values = values.groupBy("section", "field", "year_key").agg(F.max("value").alias("value"))
    overrides = p.where("p_partkey % 9 = 0").selectExpr("p_partkey AS row_no", "p_retailprice * 2 AS value")
    formulas = p.where("p_partkey % 5 = 0").selectExpr("p_partkey AS row_no", "concat('=H', CAST(p_partkey AS STRING), '*2') AS formula")
    return extract.injected(sheet, values, overrides, 2025, formulas, "H", "J")


@query("""WITH c AS (SELECT n_name AS sheet, CAST(n_nationkey AS DOUBLE) AS a, CAST(n_regionkey + 1 AS DOUBLE) AS b FROM nation), v AS (SELECT sheet, a, b, a + b * 2 AS c3 FROM c)
 SELECT sheet, unnest([1, 2, 3, 4, 5, 6, 7, 8]) AS row_no, unnest([a, b, c3, (c3 - a) / b, 0.0, CASE WHEN a > b THEN a - b ELSE 0 END, 1.0, 0.0]) AS value FROM v""")
def formula_values(spark, sf):
    from finquill.functions.formulas import sheet_values

    formulas = ["=S1+S2*2", "=(S3-S1)/S2", "=S4/0", "=IF(S1>S2,S1-S2,0)", "=S99+1", "=SUM(S1:S2)"]

    def cell(row_no: int, number, formula: str | None = None):
        return F.struct(F.lit(row_no).alias("row_no"), F.lit(number).cast("double").alias("number") if number is None else number.cast("double").alias("number"), F.lit(formula).cast("string").alias("formula"))

    rows = [cell(1, F.col("n_nationkey")), cell(2, F.col("n_regionkey") + 1), *[cell(k, None, f) for k, f in enumerate(formulas, 3)]]
    cells = load(spark, sf, "nation").select(F.col("n_name").alias("sheet"), F.explode(F.array(*rows)).alias("c")).select("sheet", "c.*")
    return sheet_values(cells, "S")


_FILL = choose("l_partkey", ["FFFFFF00", "FFFFFFFF", "00000000", "ffd9e1f2"])


@query(f"SELECT sheet, row_no, string_agg(value, ' | ' ORDER BY col_no) AS cells FROM (SELECT l_orderkey AS sheet, l_linenumber AS row_no, l_partkey * 100 + l_suppkey % 100 AS col_no, CAST(l_partkey AS VARCHAR) AS value, upper({_FILL}) AS f FROM lineitem) WHERE f NOT IN ('FFFFFFFF', '00000000') GROUP BY sheet, row_no")
def coloured_rows(spark, sf):
    from finquill.sources.sinks import coloured_rows

    cells = load(spark, sf, "lineitem").selectExpr("l_orderkey AS sheet", "l_linenumber AS row_no", "l_partkey * 100 + l_suppkey % 100 AS col_no", "CAST(l_partkey AS STRING) AS value", f"{_FILL} AS fill_rgb")
    return coloured_rows(cells, ["FFFFFFFF", "00000000"])


@query("""WITH d AS (SELECT o_custkey, count(*) AS documents, sum(o_orderkey % 40) AS pages FROM orders GROUP BY o_custkey)
 SELECT o_custkey, documents, CAST(pages AS BIGINT) AS pages, CAST(pages * 2600 + documents * 190 * 2150 AS BIGINT) AS tokens, round((pages * 1700 * 0.15137::DOUBLE + pages * 900 * 0.60713::DOUBLE) / 1000000, 4) AS ocr_cost, NULL::DOUBLE AS extraction_cost, NULL::DOUBLE AS total_cost FROM d""")
def cost_by_prices(spark, sf):
    """The price of the extraction model is unknown, so it and the total are null."""
    from finquill.operators.registry import priced

    prices = spark.createDataFrame([("small", 0.15137, 0.60713), ("large", 2.5, 10.0)], "model string, input double, output double")
    docs = load(spark, sf, "orders").selectExpr("o_custkey", "o_orderkey % 40 AS pages")
    return priced(docs, ["o_custkey"], prices, "small", "another")


@query("WITH j AS (SELECT o_custkey, o_orderkey AS job_id, 100000 - o_orderkey AS made, CASE WHEN o_orderkey % 4 = 0 THEN 'running' WHEN o_orderkey % 4 = 1 THEN 'done' ELSE 'failed' END AS status, o_orderkey % 3 = 0 AS same FROM orders) SELECT o_custkey, arg_min(job_id, made) AS job_id FROM j WHERE status = 'running' OR (status = 'done' AND same) GROUP BY o_custkey")
def job_reuse_by_age(spark, sf):
    from finquill.operators.registry import reusable

    jobs = load(spark, sf, "orders").selectExpr("o_custkey", "o_orderkey AS job_id", "100000 - o_orderkey AS made", "CASE WHEN o_orderkey % 4 = 0 THEN 'running' WHEN o_orderkey % 4 = 1 THEN 'done' ELSE 'failed' END AS status", "CASE WHEN o_orderkey % 3 = 0 THEN array('b', 'a') ELSE array('a') END AS doc_ids")
    return reusable(jobs, "o_custkey", ["a", "b"], "made")


@query()
def old_label_matches(spark, sf):
    from finquill.functions.procedural import token_set_ratio

    rows = load(spark, sf, "lineitem").selectExpr("l_orderkey AS doc", f"{_POS} AS pos", f"{_LABEL} AS label")
    aliases = spark.createDataFrame([("Net Sales", "revenue from operations"), ("Share Capital", "share capital"), ("Trade Payables", "payables trade"), ("Deferred Tax Liabilities", "total current assets")], "field string, alias string")
    return extract.old_matches(rows, aliases, token_set_ratio("label", "alias")).select("doc", "pos", "label", "field")
