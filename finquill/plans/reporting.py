"""Queries of the full report and of derived measures with their origin.

The SQL is written by hand: projections run over a long table of fields there, and each row of a
section is spelled out again with division guards of its own.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from finquill.operators import cascade, derive
from finquill.plans.named import choose, query
from finquill.plans.statement import FIELDS, ST, load, statement

YEARS = ["1995-96", "1996-97", "1997-98"]
BASE = [f for f in FIELDS if f != "creditors"] + ["creditors"]

_LIST, _NAMES = ", ".join(BASE), ", ".join(f"'{f}'" for f in BASE)
_FIVE = f"""{ST}, l AS (SELECT company, fy, unnest([{_NAMES}]) AS f, unnest([{_LIST}]) AS v FROM st),
 w AS (SELECT company, f, max(v) FILTER (fy = '1995-96') AS v1, max(v) FILTER (fy = '1996-97') AS v2, max(v) FILTER (fy = '1997-98') AS v3 FROM l GROUP BY company, f),
 r AS (SELECT *, coalesce(nullif(v3, 0), nullif(v2, 0), nullif(v1, 0), 0) AS base, list_filter([CASE WHEN v1 <> 0 AND v2 <> 0 THEN (v2 - v1) / abs(v1) END, CASE WHEN v2 <> 0 AND v3 <> 0 THEN (v3 - v2) / abs(v2) END], lambda x: x IS NOT NULL) AS rates FROM w),
 g AS (SELECT *, greatest(-0.5, least(CASE len(rates) WHEN 0 THEN 0.1 WHEN 1 THEN rates[1] ELSE (rates[1] + rates[2]) / 2 END, CASE WHEN f IN ('term_liabilities', 'intangibles', 'bank_borrowings') THEN 0.0 ELSE 0.5 END)) AS rate FROM r),
 p AS (SELECT *, round(base * (1 + rate), 4) AS a4, round(round(base * (1 + rate), 4) * (1 + rate), 4) AS a5 FROM g),
 s AS (SELECT p.company, p.f, p.v1, p.v2, p.v3, n.a4 AS n4, n.a5 AS n5, p.a4, p.a5, p.base, list_filter([p.v1 / nullif(nullif(n.v1, 0), NULL), p.v2 / nullif(n.v2, 0), p.v3 / nullif(n.v3, 0)], lambda x: x IS NOT NULL AND x <> 0) AS shares FROM p JOIN (SELECT * FROM p WHERE f = 'net_sales') n ON n.company = p.company),
 t AS (SELECT company, f, v1, v2, v3, CASE WHEN f IN ('cost_of_sales', 'raw_material', 'receivables', 'inventory', 'creditors') THEN round(CASE WHEN len(shares) = 0 THEN 0 ELSE list_sum(shares) / len(shares) END * n4, 4) WHEN f = 'variable_cost' THEN round(n4 * 0.85, 4) WHEN f = 'fixed_cost' THEN round(base * 1.09, 4) ELSE a4 END AS v4,
  CASE WHEN f IN ('cost_of_sales', 'raw_material', 'receivables', 'inventory', 'creditors') THEN round(CASE WHEN len(shares) = 0 THEN 0 ELSE list_sum(shares) / len(shares) END * n5, 4) WHEN f = 'variable_cost' THEN round(n5 * 0.85, 4) WHEN f = 'fixed_cost' THEN round(round(base * 1.09, 4) * 1.09, 4) ELSE a5 END AS v5 FROM s),
 u AS (SELECT company, f, unnest([1, 2, 3, 4, 5]) AS col, unnest([v1, v2, v3, v4, v5]) AS v FROM t),
 c AS (SELECT company, col, {", ".join(f"max(v) FILTER (f = '{f}') AS {f}" for f in BASE)} FROM u GROUP BY company, col),
 k AS (SELECT *, capital + reserves - intangibles AS tnw, current_liabilities + term_liabilities AS tol, pbt + interest + dep AS pbdit, total_assets - current_assets AS fixed, lag(net_sales) OVER (PARTITION BY company ORDER BY col) AS sales0, current_assets - current_liabilities AS nwc,
  current_liabilities - bank_borrowings AS sub_b, net_sales - variable_cost AS contrib, inventory + receivables AS ir, pat + dep AS accruals, net_sales - cost_of_sales - fixed_cost - interest AS op_after FROM c), z AS (SELECT *, lag(tnw) OVER (PARTITION BY company ORDER BY col) AS tnw0 FROM k)"""


def _columns(spark, sf):
    return cascade.five_columns(statement(spark, sf, BASE), YEARS, BASE)


def _section_sql(first: int, name: str, listed: list[tuple[str, str]]) -> str:
    """Rows of a section as one unnest; (row, expression over z)."""
    names = ", ".join("'" + n.replace("'", "''") + "'" for n, _ in listed)
    values = ", ".join(f"CAST({e} AS DOUBLE)" for _, e in listed)
    ords = ", ".join(str(first + k) for k in range(len(listed)))
    return f"{_FIVE} SELECT company, '{name}' AS section, row_ord, row, col, round(value, 6) AS value FROM (SELECT company, CAST(col AS INT) AS col, unnest([{ords}]) AS row_ord, unnest([{names}]) AS row, unnest([{values}]) AS value FROM z) WHERE value IS NOT NULL"


def _q(a: str, b: str, digits: int = 4) -> str:
    return f"round({a} / nullif({b}, 0), {digits})"


_PBT5 = "op_after + other_income"


@query(f"{_FIVE} SELECT company, CAST(col AS INT) AS col, {', '.join(f'round({f}, 4) AS {f}' for f in BASE)} FROM c")
def five_column_statement(spark, sf):
    return _columns(spark, sf).select("company", "col", *[F.round(f, 4).alias(f) for f in BASE])


@query(_section_sql(0, "operating", [("Gross Sales", "net_sales"), ("Growth in sales", _q("net_sales - sales0", "abs(sales0)").replace("net_sales - sales0 /", "(net_sales - sales0) /")), ("Raw materials", "raw_material"), ("Cost of Sales", "cost_of_sales"), ("Gross Profit", "net_sales - cost_of_sales"), ("Selling and administration", "fixed_cost"),
    ("Operating Profit before Interest", "net_sales - cost_of_sales - fixed_cost"), ("Interest", "interest"), ("Operating Profit after Interest", "op_after"), ("Other income", "other_income"), ("Profit before tax", _PBT5), ("Tax", f"CASE WHEN {_PBT5} > 0 THEN ({_PBT5}) * 0.25 ELSE 0 END"),
    ("Net Profit", "pat"), ("Dividend", "dividend"), ("Retained Profit", "pat - dividend"), ("Cash Accruals", "accruals")]))
def report_operating(spark, sf):
    return cascade.rows(_columns(spark, sf), "operating")


@query(_section_sql(16, "liabilities", [("Bank borrowings (A)", "bank_borrowings"), ("Creditors", "creditors"), ("Other current liabilities (B)", "sub_b"), ("Total Current Liabilities", "current_liabilities"), ("Total Term Liabilities", "term_liabilities"), ("Total Outside Liabilities", "tol"), ("Share Capital", "capital"), ("Reserves", "reserves"), ("Net Worth", "capital + reserves"), ("Total Liabilities", "tol + capital + reserves")]))
def report_liabilities(spark, sf):
    return cascade.rows(_columns(spark, sf), "liabilities")


@query(_section_sql(26, "assets", [("Receivables", "receivables"), ("Inventory", "inventory"), ("Total Current Assets", "current_assets"), ("Net Block", "fixed - intangibles"), ("Intangible Assets", "intangibles"), ("Total Assets", "total_assets")]))
def report_assets(spark, sf):
    return cascade.rows(_columns(spark, sf), "assets")


@query(_section_sql(32, "key_metrics", [("Tangible Net Worth", "tnw"), ("Net Working Capital", "nwc"), ("Opening TNW", "tnw0"), ("Plough back of profit", "pat"), ("Closing TNW", "tnw"), ("Current Ratio", _q("current_assets", "current_liabilities")), ("Debt/Equity", _q("term_liabilities", "tnw")), ("TOL/Equity", _q("tol", "tnw")), ("Current Assets/Tangible Assets", _q("current_assets", "total_assets", 6)), ("ROCE", _q("pbdit", "total_assets", 6)), ("Inventory+Receivables days", _q("ir * 365", "net_sales", 2))]))
def report_key_metrics(spark, sf):
    return cascade.rows(_columns(spark, sf), "key_metrics")


@query(_section_sql(43, "working_capital", [("Receivable days", _q("receivables * 365", "net_sales", 1)), ("Inventory days", _q("inventory * 365", "cost_of_sales", 1)), ("Creditor days", _q("creditors * 365", "cost_of_sales", 1)), ("Receivables to current assets (%)", _q("receivables * 100", "current_assets", 2)), ("Inventory to current assets (%)", _q("inventory * 100", "current_assets", 2)), ("Working capital gap", "current_assets - sub_b"), ("Net working capital", "nwc"), ("Bank finance to gap (%)", _q("bank_borrowings * 100", "current_assets - sub_b", 2))]))
def report_working_capital(spark, sf):
    return cascade.rows(_columns(spark, sf), "working_capital")


@query(_section_sql(51, "fund_flow", [("Long term sources", "capital + reserves + term_liabilities"), ("Long term uses", "fixed"), ("Long term surplus", "capital + reserves + term_liabilities - fixed"), ("Short term sources", "current_liabilities"), ("Short term uses", "current_assets"), ("Short term surplus", "-nwc")]))
def report_fund_flow(spark, sf):
    return cascade.rows(_columns(spark, sf), "fund_flow")


@query(_section_sql(57, "break_even", [("Sales", "net_sales"), ("Variable cost", "variable_cost"), ("Contribution", "contrib"), ("P/V ratio", _q("contrib", "net_sales")), ("Fixed cost", "fixed_cost"), ("Break-even sales", f"CASE WHEN contrib > 0 THEN {_q('fixed_cost * net_sales', 'contrib', 6)} END"), ("Cash break-even sales", f"CASE WHEN contrib > 0 THEN {_q('(fixed_cost - dep) * net_sales', 'contrib', 6)} END"), ("Margin of safety", f"CASE WHEN contrib > 0 THEN 1 - {_q('fixed_cost', 'contrib')} END")]))
def report_break_even(spark, sf):
    return cascade.rows(_columns(spark, sf), "break_even")


@query(_section_sql(65, "dscr", [("Cash accruals", "accruals"), ("Repayments", "repayment"), ("Net DSCR", _q("accruals", "repayment")), ("Gross DSCR", _q("(accruals + interest)", "repayment + interest")), ("Security cover", _q("(fixed - term_liabilities)", "fixed"))]))
def report_dscr(spark, sf):
    return cascade.rows(_columns(spark, sf), "dscr")


_RATIOS = [("Growth in Sales", _q("(net_sales - sales0)", "abs(sales0)")), ("Gross profit Ratio", _q("(net_sales - cost_of_sales)", "net_sales")), ("PBDIT", "pbdit"), ("PBDIT/sales", _q("pbdit", "net_sales")), ("Operating Profits/Sales", _q("(pbt + interest)", "net_sales")), ("PBT/Sales", _q("pbt", "net_sales")), ("PAT/Sales", _q("pat", "net_sales")), ("Cash Accruals/ Sales", _q("accruals", "net_sales")), ("Sales/Equity", _q("net_sales", "tnw")), ("Sales / TTA", _q("net_sales", "total_assets")), ("Interest Coverage (Interest/PBDIT)", _q("interest", "pbdit")), ("PBDIT / Interest (Times)", _q("pbdit", "interest")),
    ("Deferred Debt/ Equity", _q("term_liabilities", "tnw")), ("TOL/Equity", _q("tol", "tnw")), ("Current Ratio (CA / CL)", _q("current_assets", "current_liabilities")), ("Current Ratio excluding TL Instalments", _q("current_assets", "current_liabilities - repayment")), ("CA / TTA (%)", _q("current_assets", "total_assets", 6)), ("Inventory+Receivables as days of Net Sales", _q("ir * 365", "net_sales", 2)), ("Bank Borrowings/Current Assets", _q("bank_borrowings", "current_assets", 6)), ("RM content in sales", _q("raw_material", "net_sales")), ("ROCE", _q("pbdit", "total_assets", 6))]


@query("WITH base AS (" + _section_sql(70, "ratios", _RATIOS) + ") SELECT company, section, row_ord, row, col, CASE WHEN row = 'PBT/Sales' AND col = 2 AND company < 'F' THEN 0.5 ELSE value END AS value FROM base")
def report_ratios(spark, sf):
    """Of some companies the document itself gives a ratio, which wins."""
    columns = _columns(spark, sf)
    given = columns.where("col = 2 and company < 'F'").select("company", "col", F.lit("ratios").alias("section"), F.lit("PBT/Sales").alias("row"), F.lit(0.5).alias("value"))
    return cascade.rows(columns, "ratios", given)


@query(_section_sql(91, "indicators", [("Net Sales", "net_sales"), ("Operating Profit", "op_after"), ("(Net) Other income", "other_income"), ("PBDIT/Sales", _q("pbdit", "net_sales")), ("PBT/Sales", _q("pbt", "net_sales")), ("PAT", "pat"), ("PAT/Net Sales", _q("pat", "net_sales")), ("Cash Accruals", "accruals"), ("Cash Accruals/Sales", _q("accruals", "net_sales")), ("Paid up Capital (PUC)", "capital"), ("TNW", "tnw"), ("Adjusted TNW", "tnw"), ("TOL/TNW", _q("tol", "tnw")), ("TOL/Adjusted TNW", _q("tol", "tnw")), ("C/R", _q("current_assets", "current_liabilities")),
    ("C/R excluding T/L instalments", _q("current_assets", "current_liabilities - repayment")), ("Net Sales/TTA (Times)", _q("net_sales", "total_assets")), ("PBT/TTA (%)", _q("pbt", "total_assets")), ("Operating costs/sales(%)", _q("(cost_of_sales + fixed_cost)", "net_sales", 6)), ("Bank Finance / Current Assets (%)", _q("bank_borrowings", "current_assets", 6)), ("Inv + Rec. /N.S. (DAYS)", _q("ir * 365", "net_sales", 2)), ("NWC / CA (%)", _q("nwc", "current_assets", 6))]))
def report_indicators(spark, sf):
    return cascade.rows(_columns(spark, sf), "indicators")


@query(f"{_FIVE} SELECT company, row, round(avg(nullif(round(v, 6), 0)), 4) AS average FROM (SELECT company, unnest(['Gross DSCR', 'Net DSCR']) AS row, unnest([{_q('(accruals + interest)', 'repayment + interest')}, {_q('accruals', 'repayment')}]) AS v FROM z) WHERE v IS NOT NULL GROUP BY company, row")
def dscr_averages(spark, sf):
    return cascade.averages(cascade.rows(_columns(spark, sf), "dscr"), ["Net DSCR", "Gross DSCR"])


@query(f"""{_FIVE}, b AS (SELECT *, lag(pat) OVER (PARTITION BY company ORDER BY col) AS pat0, max(reserves) FILTER (col = 3) OVER (PARTITION BY company) AS last FROM c)
 SELECT company, CAST(col AS INT) AS col, round(CASE WHEN col > 3 THEN last + sum(CASE WHEN col > 3 THEN pat0 ELSE 0 END) OVER w ELSE reserves END, 4) AS reserves, round(sum(dep) OVER w, 4) AS accumulated_depreciation FROM b WINDOW w AS (PARTITION BY company ORDER BY col)""")
def running_balances(spark, sf):
    return cascade.running_balances(_columns(spark, sf)).select("company", "col", F.round("reserves", 4).alias("reserves"), F.round("accumulated_depreciation", 4).alias("accumulated_depreciation"))


@query("SELECT n_name AS company, CAST(col AS INT) AS col, caption FROM nation, (VALUES (1, 'Audited 1995-96'), (2, 'Audited 1996-97'), (3, 'Audited 1997-98'), (4, 'Projected 1998-99'), (5, 'Projected 1999-00')) AS h(col, caption)")
def report_headings(spark, sf):
    return cascade.headings(load(spark, sf, "nation").select(F.col("n_name").alias("company")), YEARS)


@query("SELECT o_custkey AS company, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 10, o_orderkey) AS INT) AS place, o_orderpriority AS label, CAST(o_orderkey % 50 AS INT) AS page, CAST(o_orderkey AS VARCHAR) AS current_value, NULL AS previous_value, 'Balance Sheet' AS source FROM orders WHERE o_orderkey % 4 = 0")
def unmapped_appendix(spark, sf):
    items = load(spark, sf, "orders").where("o_orderkey % 4 = 0").selectExpr("o_custkey AS company", "o_orderkey % 10 AS doc_ord", "o_orderkey AS pos", "o_orderpriority AS label", "CAST(o_orderkey % 50 AS INT) AS page", "CAST(o_orderkey AS STRING) AS current_value", "CAST(NULL AS STRING) AS previous_value", "'Balance Sheet' AS source_statement")
    return cascade.unmapped_appendix(items)


_GIVEN = choose("length(company)", ["0", "1", "2"])


@query(f"""{ST}, g AS (SELECT *, CASE WHEN company < 'J' THEN 123.5 END AS net_worth, CASE WHEN company < 'C' THEN 7.0 END AS current_ratio FROM st),
 a AS (SELECT *, coalesce(net_worth, capital + reserves) AS nw, pat + dep AS ca, pat - dividend AS rp, net_sales - variable_cost AS con FROM g), b AS (SELECT *, nw - intangibles AS tnw FROM a)
 SELECT company, fy, field, round(value, 4) AS value, confidence, computed FROM (SELECT company, fy, unnest(['net_worth', 'current_ratio', 'cash_accruals', 'tangible_net_worth', 'debt_equity', 'rm_content', 'total_receivable_days', 'dep_adjustments', 'transfer_to_reserves', 'break_even_sales', 'retained_cash']) AS field,
  unnest([nw, coalesce(current_ratio, round(current_assets / nullif(current_liabilities, 0), 2)), ca, tnw, round(term_liabilities / nullif(tnw, 0), 2), round(raw_material / nullif(net_sales, 0), 4), round(receivables * 365 / nullif(net_sales + other_income, 0), 1), dep, 0.0, CASE WHEN con > 0 THEN round(fixed_cost / nullif(con / nullif(net_sales, 0), 0), 1) END, ca - dividend]) AS value,
  unnest([CASE WHEN net_worth IS NULL THEN 0.92 END, CASE WHEN current_ratio IS NULL THEN 0.92 END, 0.92, 0.92, 0.92, 0.92, 0.92, 0.92, 0.92, 0.92, 0.92])::DOUBLE AS confidence, unnest([net_worth IS NULL, current_ratio IS NULL, true, true, true, true, true, true, true, true, true]) AS computed FROM b) WHERE value IS NOT NULL""")
def derived_with_origin(spark, sf):
    st = statement(spark, sf).withColumn("net_worth", F.when(F.col("company") < "J", 123.5)).withColumn("current_ratio", F.when(F.col("company") < "C", 7.0))
    out = derive.derive_long(st, ["company", "fy"])
    wanted = ["net_worth", "current_ratio", "cash_accruals", "tangible_net_worth", "debt_equity", "rm_content", "total_receivable_days", "dep_adjustments", "transfer_to_reserves", "break_even_sales", "retained_cash"]
    computed = F.coalesce(F.col("evidence").startswith("[COMPUTED] "), F.lit(False))
    return out.where(F.col("field").isin(*wanted)).select("company", "fy", "field", F.round("value", 4).alias("value"), "confidence", computed.alias("computed"))
