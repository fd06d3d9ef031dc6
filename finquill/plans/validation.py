"""Queries of checks, audits, documents and caches; the SQL is written by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from finquill.operators import audit, documents, validate
from finquill.plans.named import choose, query
from finquill.plans.statement import ST, load, statement

_O = "o_orderkey AS doc"


def _orders(spark, sf, *columns):
    return load(spark, sf, "orders").selectExpr(_O, *columns)


# ---- typed fields and totals ----------------------------------------------
_KEY = choose("o_orderkey", ["invoice_date", "grand_total", "vendor_name", "currency", "quantity", "debit", "date", "description", "balance", "notes"])
_VALUE = choose("o_custkey", ["2024-03-31", "1,234.50", "Acme", "INR", "", "not-a-date", "XYZ12", "12 Mar 2024", "₹1,000"])
_PART = choose("o_orderkey", ["document", "document", "document", "document", "line_item", "transaction", "transaction", "line_item", "transaction", "document"])
_FIELDS = f"SELECT o_orderkey AS doc, {_PART} AS part, {_KEY} AS key, {_VALUE} AS value, o_custkey % 4 <> 0 AS is_text FROM orders"


@query(f"""WITH f AS ({_FIELDS}), c AS (SELECT *, regexp_matches(value, '^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}$|^\\d{{1,2}} [A-Z][a-z]{{2}} \\d{{4}}$') AS d,
  regexp_matches(regexp_replace(value, '[,₹]', '', 'g'), '^\\d+(\\.\\d+)?$') AS n, value IN ('INR', 'Acme') AS cur FROM f WHERE value <> ''),
 i AS (SELECT doc, part, key, CASE WHEN part = 'document' AND key = 'invoice_date' AND NOT d THEN 0.3 WHEN part = 'document' AND key = 'grand_total' AND NOT n THEN 0.3 WHEN part = 'document' AND key = 'vendor_name' AND NOT is_text THEN 0.3
  WHEN part = 'document' AND key = 'currency' AND NOT cur THEN 0.4 WHEN part = 'line_item' AND key = 'quantity' AND NOT n THEN 0.5 WHEN key = 'description' AND NOT is_text THEN 0.5
  WHEN part = 'transaction' AND key IN ('debit', 'balance') AND NOT n THEN 0.4 WHEN part = 'transaction' AND key = 'date' AND NOT d THEN 0.4 END AS confidence FROM c)
 SELECT doc, part, key, 'invalid_type' AS status, CAST(confidence AS DOUBLE) AS confidence FROM i WHERE confidence IS NOT NULL""")
def typed_field_issues(spark, sf):
    return validate.typed_issues(load(spark, sf, "orders").selectExpr(_O, f"{_PART} AS part", f"{_KEY} AS key", f"{_VALUE} AS value", "o_custkey % 4 <> 0 AS is_text"))


_SUB, _TAX = "CAST(floor(o_totalprice) AS DOUBLE)", "CAST(o_orderkey % 50 AS DOUBLE)"
_TOTAL = "CAST(floor(o_totalprice) + o_orderkey % 50 + CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 4 ELSE 0 END AS DOUBLE)"


@query(f"SELECT o_orderkey AS doc, (sub <> 0 AND total <> 0 AND abs(sub + tax - total) > greatest(1.0, 1e-9 * greatest(abs(sub + tax), abs(total)))) AS mismatch FROM (SELECT o_orderkey, {_SUB} AS sub, {_TAX} AS tax, {_TOTAL} AS total FROM orders)")
def receipt_total_check(spark, sf):
    rows = _orders(spark, sf, f"{_SUB} AS sub", f"{_TAX} AS tax", f"{_TOTAL} AS total")
    return rows.select("doc", validate.amount_mismatch(F.col("sub"), F.col("tax"), F.col("total")).alias("mismatch"))


@query(f"""SELECT doc, (sub <> 0 AND total <> 0 AND abs(sub + tax - total) > 1.0) AS mismatch FROM (SELECT o_orderkey AS doc, {_SUB} AS sub, {_TOTAL} AS total,
  CASE WHEN o_custkey % 2 = 0 THEN CAST(o_orderkey % 50 AS DOUBLE) ELSE CAST(o_orderkey % 25 AS DOUBLE) * 2 END AS tax FROM orders)""")
def invoice_total_check(spark, sf):
    rows = _orders(spark, sf, f"{_SUB} AS sub", f"{_TOTAL} AS total", "CASE WHEN o_custkey % 2 = 0 THEN CAST(o_orderkey % 50 AS DOUBLE) ELSE 0.0D END AS tax", "CAST(o_orderkey % 25 AS DOUBLE) AS half")
    tax = validate.invoice_tax(F.col("tax"), F.col("half"), F.col("half"))
    return rows.select("doc", validate.amount_mismatch(F.col("sub"), tax, F.col("total")).alias("mismatch"))


@query("""WITH f AS (SELECT o_custkey AS doc, o_orderpriority AS field, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS value FROM orders), r AS (SELECT DISTINCT field FROM f WHERE field <> '3-MEDIUM'), h AS (SELECT DISTINCT doc, field FROM f WHERE value IS NOT NULL)
 SELECT d.doc, string_agg(r.field, ', ' ORDER BY r.field) AS missing FROM (SELECT DISTINCT doc FROM f) d CROSS JOIN r WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.doc = d.doc AND h.field = r.field) GROUP BY d.doc""")
def missing_fields(spark, sf):
    rows = load(spark, sf, "orders").selectExpr("o_custkey AS doc", "o_orderpriority AS field", "CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS value")
    return validate.missing_fields(rows, rows.select("field").distinct(), ["3-MEDIUM"])


@query(f"{ST} SELECT company, fy, coalesce(abs(current_assets + (total_assets - current_assets) * 0.8 - total_assets) / nullif(abs(total_assets), 0) <= 0.1, false) AS passed FROM st")
def assets_near_total(spark, sf):
    st = statement(spark, sf, ["current_assets", "total_assets"])
    return st.select("company", "fy", validate.assets_passed(F.col("current_assets"), (F.col("total_assets") - F.col("current_assets")) * 0.8, F.col("total_assets"), 0.1).alias("passed"))


_WARN = "SELECT o_custkey AS doc, CASE WHEN o_orderkey % 2 = 0 THEN 'sign_check' ELSE 'accounting_identity' END AS chk, CASE WHEN o_orderkey % 3 = 0 THEN 'high' ELSE 'medium' END AS severity FROM orders WHERE o_orderkey % 7 = 0"
_ISSUES = f"""SELECT doc, 'cma_data' AS field, chk AS status, CASE severity WHEN 'high' THEN 0.4 ELSE 0.6 END AS confidence FROM ({_WARN}) UNION ALL SELECT o_custkey, 'cma_data', 'unit_mismatch', 0.5 FROM orders WHERE o_orderkey % 11 = 0
 UNION ALL SELECT o_custkey, 'pnl.' || o_orderpriority, 'low_confidence', CAST(o_orderkey % 7 AS DOUBLE) / 10 FROM orders WHERE o_orderkey % 13 = 0"""


def _issues(spark, sf):
    o = load(spark, sf, "orders")
    warnings = o.where("o_orderkey % 7 = 0").selectExpr("o_custkey AS doc", "CASE WHEN o_orderkey % 2 = 0 THEN 'sign_check' ELSE 'accounting_identity' END AS check", "CASE WHEN o_orderkey % 3 = 0 THEN 'high' ELSE 'medium' END AS severity")
    low = o.where("o_orderkey % 13 = 0").selectExpr("o_custkey AS doc", "'pnl' AS section", "o_orderpriority AS field", "CAST(o_orderkey % 7 AS DOUBLE) / 10 AS confidence")
    return validate.issues_of(warnings, o.where("o_orderkey % 11 = 0").selectExpr("o_custkey AS doc"), low)


@query(f"SELECT doc, field, status, CAST(confidence AS DOUBLE) AS confidence FROM ({_ISSUES})")
def issue_mapping(spark, sf):
    return _issues(spark, sf)


@query(f"""WITH k AS (SELECT doc, CASE status WHEN 'low_confidence' THEN 2 WHEN 'unit_mismatch' THEN 3 ELSE 1 END AS k FROM ({_ISSUES}) UNION ALL SELECT o_custkey, 4 FROM orders WHERE o_orderkey % 17 = 0)
 SELECT doc, count(*) FILTER (k = 1) AS n_warnings, count(*) FILTER (k = 2) AS n_low_confidence, count(*) FILTER (k = 3) AS n_unit_warnings, count(*) FILTER (k = 4) AS n_passed FROM k GROUP BY doc""")
def validation_summary(spark, sf):
    return validate.summary(_issues(spark, sf), load(spark, sf, "orders").where("o_orderkey % 17 = 0").selectExpr("o_custkey AS doc"))


_PIXEL = "CAST((a.n_nationkey * a.n_nationkey * 7 + b.n_nationkey * 13 * (r_regionkey % 3) + CASE WHEN r_regionkey > 2 THEN a.n_nationkey * b.n_nationkey ELSE 0 END) % 256 AS INT)"
_GRID = f"SELECT CAST(r_regionkey AS INT) AS img, CAST(a.n_nationkey AS INT) AS y, CAST(b.n_nationkey AS INT) AS x, CASE WHEN r_regionkey = 0 THEN 128 ELSE {_PIXEL} END AS v FROM region CROSS JOIN nation a CROSS JOIN nation b"
_LAPLACE = f"""p AS ({_GRID}), q AS (SELECT c.img, coalesce(u.v, c.v) + coalesce(d.v, c.v) + coalesce(l.v, c.v) + coalesce(r.v, c.v) - 4 * c.v AS z FROM p c LEFT JOIN p u ON u.img = c.img AND u.x = c.x AND u.y = c.y - 1
 LEFT JOIN p d ON d.img = c.img AND d.x = c.x AND d.y = c.y + 1 LEFT JOIN p l ON l.img = c.img AND l.y = c.y AND l.x = c.x - 1 LEFT JOIN p r ON r.img = c.img AND r.y = c.y AND r.x = c.x + 1), s AS (SELECT img, var_pop(z) AS score FROM q GROUP BY img)"""


def _scores(spark, sf):
    n = load(spark, sf, "nation").select("n_nationkey")
    grid = load(spark, sf, "region").crossJoin(n.alias("a")).crossJoin(n.alias("b"))
    return validate.laplacian(grid.selectExpr("CAST(r_regionkey AS INT) AS img", "CAST(a.n_nationkey AS INT) AS y", "CAST(b.n_nationkey AS INT) AS x", f"CASE WHEN r_regionkey = 0 THEN 128 ELSE {_PIXEL} END AS v"))


@query(f"WITH {_LAPLACE} SELECT img, round(score, 3) AS score FROM s")
def laplacian_score(spark, sf):
    return _scores(spark, sf).select("img", F.round("score", 3).alias("score"))


@query(f"WITH {_LAPLACE} SELECT CAST(img % 2 AS INT) AS doc, count(*) AS checked_pages, bool_and(score < 15) AS blurry FROM s GROUP BY ALL")
def blur_verdict(spark, sf):
    return validate.blurry(_scores(spark, sf).withColumn("doc", F.col("img") % 2), ["doc"])


_SIDES = "SELECT company, fy, unnest(['current_assets', 'fixed', 'current_liabilities', 'equity']) AS field, unnest([current_assets, total_assets - current_assets, current_liabilities, total_assets - current_liabilities + CASE WHEN company < 'F' THEN 5 ELSE 0.1 END]) AS value FROM st"


@query(f"{ST} SELECT company, fy, round(sum(CASE WHEN field IN ('current_assets', 'fixed') THEN value END), 2) AS assets, round(sum(CASE WHEN field IN ('current_liabilities', 'equity') THEN value END), 2) AS liabilities, round(abs(sum(CASE WHEN field IN ('current_assets', 'fixed') THEN value ELSE -value END)), 2) AS difference, round(abs(sum(CASE WHEN field IN ('current_assets', 'fixed') THEN value ELSE -value END)), 2) < 0.15 AS balanced FROM ({_SIDES}) GROUP BY company, fy")
def balance_recomputed(spark, sf):
    st = statement(spark, sf, ["current_assets", "total_assets", "current_liabilities"]).withColumn("fixed", F.col("total_assets") - F.col("current_assets"))
    st = st.withColumn("equity", F.col("total_assets") - F.col("current_liabilities") + F.when(F.col("company") < "F", 5.0).otherwise(0.1))
    long = st.unpivot(["company", "fy"], ["current_assets", "fixed", "current_liabilities", "equity"], "field", "value")
    out = validate.balance_sums(long, ["current_assets", "fixed"], ["current_liabilities", "equity"])
    return out.withColumn("assets", F.round("assets", 2)).withColumn("liabilities", F.round("liabilities", 2))


# ---- audit ----------------------------------------------------------------
_TEXT = choose("o_custkey", ["Revenue 45,230.18 and (1,020.00) in 2024", "Sales 12.5, cost (88) note 4", "nothing here", "1,2,3 and 7.25.", "Total of 100,000.00 (12.75)"])


@query(f"""WITH t AS (SELECT o_orderkey AS doc, {_TEXT} AS text FROM orders), a AS (SELECT doc, unnest(list_concat(regexp_extract_all(text, '[\\d,]+\\.\\d+'), regexp_extract_all(text, '\\d+\\.\\d+'), regexp_extract_all(text, '[\\d,]+'))) AS x, 1 AS s FROM t
 UNION ALL SELECT doc, unnest(regexp_extract_all(text, '\\((\\d[\\d,]*\\.?\\d*)\\)', 1)), unnest([-1]) FROM t), b AS (SELECT DISTINCT doc, s * TRY_CAST(replace(x, ',', '') AS DOUBLE) AS n FROM a WHERE regexp_matches(x, '\\d'))
 SELECT t.doc, count(n) AS n_numbers, round(coalesce(sum(n), 0), 2) AS total FROM t LEFT JOIN b ON b.doc = t.doc GROUP BY t.doc""")
def ocr_numbers(spark, sf):
    rows = _orders(spark, sf, f"{_TEXT} AS text").withColumn("n", audit.numbers_in(F.col("text")))
    return rows.select("doc", F.size("n").cast("long").alias("n_numbers"), F.round(F.aggregate("n", F.lit(0.0), lambda s, x: s + x), 2).alias("total"))


_AMOUNT = "CASE WHEN o_orderkey % 2 = 0 THEN CAST(floor(o_totalprice) AS DOUBLE) ELSE CAST(floor(o_totalprice) AS DOUBLE) + 0.25 END"
_WITH_COMMAS = "format('{:,}', CAST(floor(v) AS BIGINT))"


@query(f"""SELECT doc, array_to_string(list_sort(list_distinct(CASE WHEN v = floor(v) THEN [printf('%.2f', v), {_WITH_COMMAS} || '.00', CAST(CAST(v AS BIGINT) AS VARCHAR), {_WITH_COMMAS}] ELSE [printf('%.2f', v), {_WITH_COMMAS} || '.25'] END)), '|') AS forms
 FROM (SELECT o_orderkey AS doc, {_AMOUNT} AS v FROM orders)""")
def value_renderings(spark, sf):
    return _orders(spark, sf, f"{_AMOUNT} AS v").select("doc", F.array_join(F.array_sort(audit.renderings(F.col("v"))), "|").alias("forms"))


_TRACED = f"""SELECT o_orderkey AS doc, {_TEXT} AS text, CASE CAST(o_orderkey % 6 AS INT) WHEN 0 THEN 45230.18D WHEN 1 THEN 12.46D WHEN 2 THEN 100000.0D WHEN 3 THEN 88.0D WHEN 4 THEN -1020.0D ELSE 3.5D END AS value,
 CASE WHEN o_orderkey % 10 = 0 THEN '=A1+A2' END AS formula, o_orderkey % 4 = 1 AS is_override, CASE WHEN o_orderkey % 9 = 0 THEN '[COMPUTED] a + b' END AS evidence"""


@query("""WITH r AS (""" + _TRACED.replace("D WHEN", " WHEN").replace("D ELSE 3.5D", " ELSE 3.5") + """ FROM orders), f AS (SELECT *, CASE WHEN abs(value) = 45230.18 THEN contains(text, '45,230.18') OR contains(text, '45230.18') WHEN abs(value) = 12.46 THEN contains(text, '12.46')
  WHEN value = 100000 THEN contains(text, '100000') OR contains(text, '100,000') WHEN value = 88 THEN contains(text, '88') WHEN value = -1020 THEN contains(text, '1020') OR contains(text, '1,020') ELSE contains(text, '3.50') END AS found,
  value = 12.46 AND contains(text, '12.5') AS near FROM r)
 SELECT doc, CASE WHEN formula IS NOT NULL THEN 'FORMULA' WHEN is_override AND found THEN 'OVERRIDE_VERIFIED' WHEN is_override THEN 'OVERRIDE_UNVERIFIED' WHEN found THEN 'VERIFIED' WHEN near THEN 'ROUNDING_MISMATCH' WHEN evidence IS NOT NULL THEN 'COMPUTED' ELSE 'NOT_FOUND' END AS status FROM f""")
def audit_trace(spark, sf):
    rows = load(spark, sf, "orders").selectExpr(_O, f"{_TEXT} AS text", "CASE CAST(o_orderkey % 6 AS INT) WHEN 0 THEN 45230.18D WHEN 1 THEN 12.46D WHEN 2 THEN 100000.0D WHEN 3 THEN 88.0D WHEN 4 THEN -1020.0D ELSE 3.5D END AS value", "CASE WHEN o_orderkey % 10 = 0 THEN '=A1+A2' END AS formula", "o_orderkey % 4 = 1 AS is_override", "CASE WHEN o_orderkey % 9 = 0 THEN '[COMPUTED] a + b' END AS evidence")
    return audit.trace(rows).select("doc", "status")


_FIELD = choose("o_orderkey", ["Total of the Current Assets", "Net Sales", "Interest on Term Loan", "for and & the"])


@query(f"SELECT doc, array_to_string(list_filter(string_split(lower(f), ' '), lambda w: w NOT IN ('of', 'the', 'a', 'an', 'in', 'on', 'for', 'and', '&', 'from', 'to', 'total', 'net')), ' ') AS words FROM (SELECT o_orderkey AS doc, {_FIELD} AS f FROM orders)")
def context_words(spark, sf):
    return _orders(spark, sf, f"{_FIELD} AS f").select("doc", F.array_join(audit.context_words(F.col("f")), " ").alias("words"))


@query(f"SELECT doc FROM (SELECT o_orderkey AS doc, {_TEXT} AS text FROM orders) WHERE regexp_matches(text, '(^|[^0-9])100,?000([^0-9]|$)')")
def value_search(spark, sf):
    rows = _orders(spark, sf, f"{_TEXT} AS text").withColumn("p", audit.value_pattern(F.lit(100000.0)))
    return rows.where(F.regexp_like("text", F.col("p"))).select("doc")


@query("""WITH m AS (SELECT o_orderkey AS row_no, o_orderpriority AS field, CAST(o_custkey AS VARCHAR) AS section FROM orders), v AS (SELECT CAST(o_custkey AS VARCHAR) AS section, o_orderpriority AS field, CAST(year(o_orderdate) AS VARCHAR) AS fy, max(o_totalprice) AS confidence FROM orders GROUP BY ALL)
 SELECT m.row_no, m.field, coalesce((SELECT confidence FROM v WHERE v.section = m.section AND v.field = m.field AND fy = '1996'), (SELECT confidence FROM v WHERE v.section = m.section AND v.field = m.field AND fy = '1995')) AS confidence FROM m""")
def row_confidence(spark, sf):
    o = load(spark, sf, "orders")
    sheet = o.selectExpr("o_orderkey AS row_no", "CAST(o_custkey AS STRING) AS section", "o_orderpriority AS field")
    values = o.groupBy(F.col("o_custkey").cast("string").alias("section"), F.col("o_orderpriority").alias("field"), F.year("o_orderdate").cast("string").alias("fy")).agg(F.max("o_totalprice").alias("confidence")).withColumn("evidence", F.lit("e"))
    return audit.with_confidence(sheet.select("row_no"), sheet, values, ["1996", "1995"]).select("row_no", "field", "confidence")


# ---- documents, caches, jobs, models --------------------------------------
_BODY = choose("o_custkey", ["Insufficient_Quota for you", "rate limit", "You exceeded your CURRENT quota", "credit balance is too low", ""])


@query(f"""SELECT doc, quota, CASE WHEN NOT quota AND attempt + 1 < 3 THEN CAST(2 * (attempt + 1) AS DOUBLE) END AS delay FROM (SELECT o_orderkey AS doc, o_orderkey % 3 AS attempt, CASE WHEN o_orderkey % 2 = 0 THEN 429 ELSE 500 END IN (402, 429) AND regexp_matches(lower({_BODY}), 'insufficient_quota|exceeded your current quota|run out of credits|balance is too low') AS quota FROM orders)""")
def quota_and_retry(spark, sf):
    rows = _orders(spark, sf, "CASE WHEN o_orderkey % 2 = 0 THEN 429 ELSE 500 END AS code", f"{_BODY} AS body", "o_orderkey % 3 AS attempt")
    rows = rows.withColumn("quota", documents.quota_exhausted(F.col("code"), F.col("body")))
    return rows.select("doc", "quota", documents.retry_delay(F.col("attempt"), F.col("quota"), 2.0).alias("delay"))


@query("""WITH m AS (SELECT * FROM (VALUES (1, 'Granite-Docling-258M'), (2, 'qwen2-vl'), (3, 'llama-3-8b'), (4, 'other')) AS m(ord, model)), a AS (SELECT * FROM (VALUES ('qwen2-vl', 'qwen2-vl'), ('granite-docling', 'Granite-Docling-258M'), ('my-llama', 'llama-3-8b'), ('LLAMA-3-8B-q4', 'llama-3-8b'), ('gpt', 'Granite-Docling-258M'), ('qwen9', 'qwen2-vl')) AS a(asked, model)) SELECT a.asked, m.model FROM a JOIN m USING (model)""")
def resolve_model(spark, sf):
    asked = spark.createDataFrame([(x,) for x in ("qwen2-vl", "granite-docling", "my-llama", "LLAMA-3-8B-q4", "gpt", "qwen9")], "asked string")
    models = spark.createDataFrame(list(enumerate(("Granite-Docling-258M", "qwen2-vl", "llama-3-8b", "other"), 1)), "ord int, model string")
    return documents.resolve_model(asked, models)


_CKEY = "substr(sha256(CAST(o_custkey AS VARCHAR) || 'm' || 'ocr_start_page=' || CAST(1 + o_orderkey % 3 AS VARCHAR) || o_orderpriority), 1, 32)"


@query(f"WITH k AS (SELECT o_orderkey AS doc, {_CKEY} AS key FROM orders), c AS (SELECT DISTINCT key FROM k WHERE doc % 4 = 0) SELECT k.doc, k.key, c.key IS NOT NULL AS hit FROM k LEFT JOIN c ON c.key = k.key")
def ocr_cache(spark, sf):
    rows = _orders(spark, sf, "o_custkey", "1 + o_orderkey % 3 AS start", "CAST(o_orderpriority AS BINARY) AS content")
    rows = rows.select("doc", documents.cache_key(F.col("o_custkey"), F.lit("m"), F.col("start"), F.col("content")).alias("key"))
    cache = rows.where("doc % 4 = 0").groupBy("key").agg(F.max("doc").alias("value"))
    return documents.read_through(rows, cache, "key").select("doc", "key", "hit")


@query("SELECT count(*) FILTER (o_orderkey % 5 = 0) AS n_cleared, (SELECT count(*) FROM orders WHERE o_orderkey % 5 <> 0) AS n_left FROM orders")
def cache_clear(spark, sf):
    left, n = documents.cleared(_orders(spark, sf), F.col("doc") % 5 == 0)
    return n.crossJoin(left.agg(F.count("*").alias("n_left")))


@query("SELECT DISTINCT o_orderpriority AS field, lower(o_clerk_like) AS term FROM (SELECT o_orderpriority, 'Term ' || CAST(o_custkey % 20 AS VARCHAR) AS o_clerk_like FROM orders WHERE o_orderkey % 3 = 2)")
def learned_terms_of_version(spark, sf):
    rows = load(spark, sf, "orders").selectExpr("o_orderpriority AS field", "concat('Term ', CAST(o_custkey % 20 AS STRING)) AS term", "CAST(o_orderkey % 3 AS INT) AS version")
    return documents.current_terms(rows, 2)


_FILE = choose("o_orderkey", ["a.pdf", "B.PDF", "c.docx", "d.pdf.zip", "pdf"])


@query(f"""SELECT doc, CASE WHEN NOT ends_with(lower(f), '.pdf') THEN 'unsupported_format' WHEN size = 0 THEN 'empty_document' WHEN s > e OR s < 1 THEN 'invalid_page_range' END AS error
 FROM (SELECT o_orderkey AS doc, {_FILE} AS f, o_custkey % 3 AS size, CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 7 - 1 END AS s, CASE WHEN o_custkey % 5 > 0 THEN o_custkey % 5 END AS e FROM orders)""")
def upload_guards(spark, sf):
    rows = _orders(spark, sf, f"{_FILE} AS f", "o_custkey % 3 AS size", "CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 7 - 1 END AS s", "CASE WHEN o_custkey % 5 > 0 THEN o_custkey % 5 END AS e")
    return rows.select("doc", documents.upload_error(F.col("f"), F.col("size"), F.col("s"), F.col("e")).alias("error"))


@query("SELECT o_orderkey AS doc, CAST(o_orderkey AS VARCHAR) || '.pdf: skipped (' || CASE o_orderstatus WHEN 'F' THEN 'failed' ELSE 'pending' END || ')' AS warning FROM orders WHERE o_orderstatus <> 'O'")
def skipped_documents(spark, sf):
    rows = _orders(spark, sf, "concat(CAST(o_orderkey AS STRING), '.pdf') AS filename", "CASE o_orderstatus WHEN 'O' THEN 'success' WHEN 'F' THEN 'failed' ELSE 'pending' END AS status")
    return documents.skipped(rows)


_CFY = "SELECT DISTINCT o_custkey AS company, CAST(year(o_orderdate) + CASE WHEN o_custkey % 3 = 0 THEN 20 ELSE 0 END AS VARCHAR) || '-x' AS fy FROM orders"


@query(f"""WITH f AS ({_CFY}), h AS (SELECT company, fy, CASE split_part(fy, '-', 1) WHEN '1995' THEN 1 WHEN '1996' THEN 2 WHEN '1997' THEN 3 END AS col FROM f), b AS (SELECT company, bool_or(col IS NOT NULL) AS fits, count(*) AS n FROM h GROUP BY company),
 r AS (SELECT h.*, fits, n, row_number() OVER (PARTITION BY company ORDER BY fy) AS i FROM h JOIN b USING (company)) SELECT company, fy, CAST(CASE WHEN fits THEN col ELSE i - greatest(0, n - 3) END AS INT) AS col FROM r WHERE CASE WHEN fits THEN col IS NOT NULL ELSE i > n - 3 END""")
def fy_columns(spark, sf):
    rows = load(spark, sf, "orders").selectExpr("o_custkey AS company", "concat(CAST(year(o_orderdate) + CASE WHEN o_custkey % 3 = 0 THEN 20 ELSE 0 END AS STRING), '-x') AS fy")
    return documents.year_columns(rows, [1995, 1996, 1997])


_NO = [f"CASE WHEN o_orderkey % 3 = {k} THEN concat('{p}', CAST(o_orderkey AS STRING)) WHEN o_orderkey % 2 = 0 THEN '' END AS {p}_number" for k, p in enumerate(("invoice", "receipt", "po"))]
_AMT = ["CASE WHEN o_orderkey % 2 = 0 THEN 0.0 ELSE CAST(o_custkey AS DOUBLE) END AS grand_total", "CASE WHEN o_orderkey % 5 = 0 THEN 0.0 ELSE CAST(o_custkey + 1 AS DOUBLE) END AS total"]


@query(f"SELECT doc, coalesce(nullif(invoice_number, ''), nullif(receipt_number, ''), nullif(po_number, '')) AS number, CASE WHEN grand_total <> 0 THEN grand_total WHEN total <> 0 THEN total END AS total FROM (SELECT o_orderkey AS doc, {', '.join(_NO + _AMT)} FROM orders)")
def document_summary(spark, sf):
    rows = _orders(spark, sf, *_NO, *[a.replace("0.0 ", "0.0D ") for a in _AMT])
    return rows.select("doc", documents.first_of(*[F.col(f"{p}_number") for p in ("invoice", "receipt", "po")]).alias("number"), documents.first_amount(F.col("grand_total"), F.col("total")).alias("total"))


@query("SELECT l_orderkey AS doc, 'part ' || CAST(l_partkey AS VARCHAR) AS \"Description\", l_quantity AS \"Qty\", l_tax AS \"Unit Price\", l_extendedprice AS \"Amount\" FROM lineitem")
def export_line_items(spark, sf):
    rows = load(spark, sf, "lineitem").selectExpr("l_orderkey AS doc", "concat('part ', CAST(l_partkey AS STRING)) AS description", "l_quantity AS quantity", "l_tax AS unit_price", "l_extendedprice AS amount")
    return rows.withColumnsRenamed({"description": "Description", "quantity": "Qty", "unit_price": "Unit Price", "amount": "Amount"})


@query("SELECT o_orderkey AS doc, greatest(0, least(coalesce(e, p), p) - s + 1) AS pages FROM (SELECT o_orderkey, o_custkey % 40 AS p, 1 + o_orderkey % 20 AS s, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 50 END AS e FROM orders)")
def effective_pages(spark, sf):
    rows = _orders(spark, sf, "o_custkey % 40 AS p", "1 + o_orderkey % 20 AS s", "CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 50 END AS e")
    return rows.select("doc", documents.effective_pages(F.col("s"), F.col("e"), F.col("p")).alias("pages"))


@query(f"{ST} SELECT company, 'net_sales' AS field, max(CASE WHEN fy = '1996-97' THEN net_sales END) AS current, max(CASE WHEN fy = '1995-96' THEN net_sales END) AS previous FROM st WHERE fy IN ('1996-97', '1995-96') GROUP BY company")
def extraction_from_merged(spark, sf):
    rows = statement(spark, sf, ["net_sales"]).select("company", F.lit("net_sales").alias("field"), "fy", F.col("net_sales").alias("value"))
    return documents.by_year(rows, F.lit("1996-97"), F.lit("1995-96"))


@query("WITH a AS (SELECT * FROM (VALUES ('1-URGENT', 'Net Sales'), ('2-HIGH', 'Total Assets')) AS a(f, alias)) SELECT o_orderkey AS doc, coalesce(alias, o_orderpriority) AS field FROM orders LEFT JOIN a ON f = o_orderpriority")
def field_aliases(spark, sf):
    aliases = spark.createDataFrame([("1-URGENT", "Net Sales"), ("2-HIGH", "Total Assets")], "field string, alias string")
    return documents.aligned(_orders(spark, sf, "o_orderpriority AS field"), aliases)


_EV = choose("event_id", ["upload", "start", "finish", "error"])


@query(f"""WITH e AS (SELECT user_id AS job_id, event_id AS seq, {_EV} AS event, CASE WHEN event_id % 8 = 3 THEN 'ocr_failure' END AS code FROM events), l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) = 1)
 SELECT job_id, CASE event WHEN 'error' THEN 'failed' WHEN 'finish' THEN 'completed' WHEN 'start' THEN 'processing' ELSE 'uploaded' END AS status, CASE WHEN event = 'error' THEN coalesce(code, 'processing_failure') END AS error_code FROM l""")
def job_states(spark, sf):
    return documents.job_states(load(spark, sf, "events").selectExpr("user_id AS job_id", "event_id AS seq", f"{_EV} AS event", "CASE WHEN event_id % 8 = 3 THEN 'ocr_failure' END AS code"))


@query("SELECT user_id AS company, count(*) AS n_jobs, min(event_id) AS first_job FROM events WHERE user_id % 10 = 3 GROUP BY user_id")
def jobs_by_company(spark, sf):
    rows = load(spark, sf, "events").where("user_id % 10 = 3").select(F.col("user_id").alias("company"), F.col("event_id").alias("job_id"))
    return rows.groupBy("company").agg(F.count("*").alias("n_jobs"), F.min("job_id").alias("first_job"))


_TPL = choose("l_partkey", ["Dues of micro enterprises and small enterprises", "Dues of creditors other than micro enterprises", "Trade payables", "MSME", "Other creditors"])
_TPV = "CASE WHEN l_suppkey % 4 > 0 THEN CAST(l_suppkey AS DOUBLE) END"
_TPP = "l_linenumber * 10000000 + l_partkey * 100 + l_suppkey % 100"


@query(f"""WITH t AS (SELECT l_orderkey AS doc, lower({_TPL}) AS label, {_TPV} AS value, {_TPP} AS pos FROM lineitem), k AS (SELECT *, CASE WHEN contains(label, 'other than') OR contains(label, 'other creditors') THEN 'o' WHEN contains(label, 'micro enterprises') OR contains(label, 'small enterprises') OR contains(label, 'msme') THEN 'm' END AS kind FROM t WHERE value IS NOT NULL)
 SELECT d.doc, arg_max(value, pos) FILTER (kind = 'm') AS msme, arg_max(value, pos) FILTER (kind = 'o') AS others, arg_max(value, pos) FILTER (kind = 'm') + arg_max(value, pos) FILTER (kind = 'o') AS total FROM (SELECT DISTINCT doc FROM t) d LEFT JOIN k ON k.doc = d.doc GROUP BY d.doc""")
def trade_payables(spark, sf):
    return documents.trade_payables(load(spark, sf, "lineitem").selectExpr("l_orderkey AS doc", f"{_TPL} AS label", f"{_TPV} AS value", f"{_TPP} AS pos"), ["doc"])


@query("SELECT company, value, doc_ord FROM (SELECT o_custkey AS company, o_totalprice AS value, o_orderkey AS doc_ord, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 3 <> 0, o_orderkey) AS r FROM orders) WHERE r = 1")
def first_primary(spark, sf):
    rows = load(spark, sf, "orders").selectExpr("o_custkey AS company", "o_totalprice AS value", "o_orderkey AS doc_ord", "o_orderkey % 3 = 0 AS is_primary")
    return documents.first_primary(rows, ["company"])


@query("SELECT c_custkey AS company, o_orderkey AS doc, '/store/' || CAST(c_custkey AS VARCHAR) || '/' || CAST(o_orderkey AS VARCHAR) || '.pdf' AS path FROM customer JOIN orders ON o_custkey = c_custkey")
def stored_documents(spark, sf):
    o, c = load(spark, sf, "orders"), load(spark, sf, "customer").select("c_custkey")
    return o.join(c, o.o_custkey == c.c_custkey).select(F.col("c_custkey").alias("company"), F.col("o_orderkey").alias("doc"), F.concat(F.lit("/store/"), F.col("c_custkey").cast("string"), F.lit("/"), F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("path"))


@query("SELECT doc_id, substr(text, 1, 300) AS evidence, length(substr(text, 1, 6000)) AS n_6000, length(substr(text, 1, 24000)) AS n_24000 FROM documents WHERE text IS NOT NULL")
def text_limits(spark, sf):
    """Prompt texts are cut to fixed lengths: the limit is the feature."""
    rows = load(spark, sf, "documents").where("text is not null")
    return rows.select("doc_id", F.substring("text", 1, 300).alias("evidence"), *[F.char_length(F.substring("text", 1, n)).cast("long").alias(f"n_{n}") for n in (6000, 24000)])
