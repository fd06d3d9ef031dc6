"""The report's statements of the pseudo companies, with given and computed values mixed.

Which totals a company's document gives depends on the length of its name.  The SQL is written by hand: five columns by
lists, then a level of totals at a time; of the operator it shares nothing but the labels it compares.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from finquill.functions.scalars import fy_label
from finquill.operators import statements
from finquill.plans.named import query
from finquill.plans.statement import ST, load, statement

#: catalogue's field, measure, which companies give it (of length(company) % 2, 3, 4 or 5), and its name in the SQL.
GIVEN = [
    ("sales/Net Sales", "net_sales", "true", "sale"),
    ("cost_of_sales/Freight & Handling Expenses", "raw_material", "true", "freight"),
    ("cost_of_sales/Depreciation", "dep", "true", "dep"),
    ("cost_of_sales/Total Cost of Sales", "cost_of_sales", "length(company) % 2 = 0", "cos_given"),
    ("profitability/Selling Expenses", "fixed_cost", "true", "selling"),
    ("interest/Interest on TL", "interest", "true", "int_tl"),
    ("other_income_expenses/Other Income", "other_income", "length(company) % 3 = 1", "other_income"),
    ("pnl/Profit before Tax", "pbt", "length(company) % 4 = 1", "pbt_given"),
    ("pnl/Net Profit/Loss (PAT)", "pat", "length(company) % 3 = 0", "pat_given"),
    ("current_liabilities/Short Term loans from Applicant Bank", "bank_borrowings", "true", "bank_loans"),
    ("current_liabilities/Sundry Creditors (Trade)", "creditors", "true", "creditors"),
    ("current_liabilities/Installments of term Loan", "repayment", "true", "instalments"),
    ("current_liabilities/Other Current Liabilities Sub Total", "other_cl", "length(company) % 5 = 0", "sub_b_given"),
    ("term_liabilities/Term Loan from Bank", "term_liabilities", "true", "term_bank"),
    ("net_worth/Capital", "capital", "true", "capital"),
    ("net_worth/Other reserves", "reserves", "true", "reserves"),
    ("current_assets/Domestic Receivables", "receivables", "true", "receivables"),
    ("current_assets/Total Current Assets", "current_assets", "length(company) % 4 = 0", "current_given"),
    ("fixed_assets/Gross Block", "total_assets", "true", "gross_block"),
    ("fixed_assets/Accumulated Depreciation", "intangibles", "true", "dep_to_date"),
    ("fund_flow/Increase in Term Liability", "dividend", "true", "term_up"),
    ("dscr/Repayment Obligations of TL", "repayment", "true", "repayment"),
]


def given(spark, sf):
    """(company, section, field, col, value)."""
    # the last three years of all orders, a row each
    last = Window.orderBy(F.desc("fy"))
    years = load(spark, sf, "orders").select(fy_label(F.col("o_orderdate")).alias("fy")).distinct().withColumn("col", 4 - F.row_number().over(last)).where("col > 0")
    rows = statement(spark, sf, sorted({m for _, m, _, _ in GIVEN})).join(years, "fy")
    cells = [F.when(F.expr(wanted), F.struct(F.lit(f.split("/")[0]).alias("section"), F.lit(f.split("/", 1)[1]).alias("field"), F.col(m).alias("value"))) for f, m, wanted, _ in GIVEN]
    return rows.select("company", "col", F.explode(F.array_compact(F.array(*cells))).alias("c")).select("company", "c.section", "c.field", "col", "c.value")


def _rate(v: str, most: float) -> str:
    """Average growth of a list of three, held to half down and ``most`` up; a tenth where none is known."""
    steps = ", ".join(f"CASE WHEN {v}[{k}] <> 0 AND {v}[{k + 1}] <> 0 THEN ({v}[{k + 1}] - {v}[{k}]) / abs({v}[{k}]) END" for k in (1, 2))
    return f"greatest(-0.5, least(coalesce(list_avg([{steps}]), 0.1), {most}))"


_GROWING = [("sale", 0.5), ("dep", 0.0), ("int_tl", 0.0), ("instalments", 0.0), ("term_bank", 0.0), ("repayment", 0.0)]
_BY_SALES = ["freight", "selling", "creditors", "receivables"]
_ALONE = [n for *_, n in GIVEN if n not in _BY_SALES and n not in dict(_GROWING)]


def _share(v: str) -> str:
    return f"coalesce(list_avg([{', '.join(f'CASE WHEN {v}[{k}] <> 0 AND sale[{k}] <> 0 THEN {v}[{k}] / sale[{k}] END' for k in (1, 2, 3))}]), 0)"


def _lag(x: str) -> str:
    return f"lag({x}) OVER (PARTITION BY company ORDER BY col)"


_CORE = f"""{ST}, yr AS (SELECT fy, 4 - row_number() OVER (ORDER BY fy DESC) AS yc FROM (SELECT DISTINCT fy FROM st) QUALIFY yc > 0),
  b AS (SELECT company, {", ".join(f"[max(CASE WHEN yc = 1 AND {w} THEN {m} END), max(CASE WHEN yc = 2 AND {w} THEN {m} END), max(CASE WHEN yc = 3 AND {w} THEN {m} END)] AS {n}" for _, m, w, n in GIVEN)}
    FROM st JOIN yr USING (fy) GROUP BY company),
  g1 AS (SELECT *, {", ".join(f"{_rate(n, most)} AS {n}_g" for n, most in _GROWING)} FROM b),
  g2 AS (SELECT *, sale[1] * sale[2] * sale[3] <> 0 AS steady, {", ".join(f"round({'coalesce(nullif(sale[3], 0), nullif(sale[2], 0), nullif(sale[1], 0), 0)' if n == 'sale' else f'coalesce({n}[3], 0)'} * (1 + {n}_g), 4) AS {n}_4" for n, _ in _GROWING)} FROM g1),
  g3 AS (SELECT *, {", ".join(f"round({n}_4 * (1 + {n}_g), 4) AS {n}_5" for n, _ in _GROWING)} FROM g2),
  g4 AS (SELECT *, {", ".join(f"CASE WHEN steady THEN round({_share(n)} * sale_4, 4) END AS {n}_4, CASE WHEN steady THEN round({_share(n)} * sale_5, 4) END AS {n}_5" for n in _BY_SALES)} FROM g3),
  c AS (SELECT company, steady, unnest(range(1, 6)) AS col, {", ".join(f"unnest([{n}[1], {n}[2], {n}[3], {n}_4, {n}_5]) AS {n}" for n in (*dict(_GROWING), *_BY_SALES))}, {", ".join(f"unnest([{n}[1], {n}[2], {n}[3], NULL, NULL]) AS {n}" for n in _ALONE)} FROM g4),
  l1 AS (SELECT *, round(coalesce(sale, 0), 4) AS income, coalesce(cos_given, round(coalesce(freight, 0) + coalesce(dep, 0), 4)) AS cos, round(coalesce(int_tl, 0), 4) AS interest, nullif(round(coalesce(other_income, 0), 4), 0) AS non_op FROM c),
  l2 AS (SELECT *, round(income - cos, 4) AS gross_profit, round(cos + coalesce(selling, 0), 4) AS cost, round(coalesce(non_op, 0), 4) AS net_non_op FROM l1),
  l3 AS (SELECT *, round(income - cost, 4) AS op_before FROM l2),
  l4 AS (SELECT *, round(op_before - interest, 4) AS op_after FROM l3),
  l5 AS (SELECT *, coalesce(pbt_given, round(op_after + net_non_op, 4)) AS pbt FROM l4),
  l6 AS (SELECT *, CASE WHEN pbt > 0 THEN round(pbt * 0.25, 4) END AS tax FROM l5),
  l7 AS (SELECT *, coalesce(pat_given, round(pbt - coalesce(tax, 0), 4)) AS pat FROM l6),
  l8 AS (SELECT *, round(pat + coalesce(dep, 0), 4) AS accruals, round(pbt + interest + coalesce(dep, 0), 4) AS pbdit, max(CASE WHEN col = 3 THEN reserves END) OVER (PARTITION BY company) AS last_reserves,
      max(CASE WHEN col = 3 THEN dep_to_date END) OVER (PARTITION BY company) AS last_dep, sum(CASE WHEN col > 3 THEN dep END) OVER (PARTITION BY company ORDER BY col) AS dep_ahead, {_lag("income")} AS income_before,
      {_lag("pat")} AS pat_before FROM l7),
  l9 AS (SELECT *, CASE WHEN col > 3 THEN round(coalesce(last_reserves, 0) + sum(CASE WHEN col > 3 THEN pat_before END) OVER (PARTITION BY company ORDER BY col), 4) ELSE reserves END AS reserve, CASE WHEN col > 3 THEN round(coalesce(last_dep, 0) + dep_ahead, 4) ELSE dep_to_date END AS to_date,
      CASE WHEN col IN (2, 3) THEN round((income - income_before) / abs(nullif(income_before, 0)), 6) END AS rise, coalesce(sub_b_given, round(coalesce(creditors, 0) + coalesce(instalments, 0), 4)) AS sub_b,
      coalesce(current_given, round(coalesce(receivables, 0), 4)) AS current_assets, round(coalesce(bank_loans, 0), 4) AS sub_a, round(coalesce(term_bank, 0), 4) AS term_total FROM l8),
  l10 AS (SELECT *, round(sub_a + sub_b, 4) AS current_total, round(coalesce(gross_block, 0) - coalesce(to_date, 0), 4) AS net_block, round(coalesce(capital, 0) + coalesce(reserve, 0) + pat, 4) AS worth,
      CASE WHEN col > 3 THEN round((sum(CASE WHEN col < 4 THEN coalesce(nullif(rise, 0), CASE WHEN col > 1 THEN 0.1 END) END) OVER (PARTITION BY company)) / 2, 4) ELSE rise END AS growth,
      round(pat + coalesce(dep, 0) + coalesce(term_up, 0), 4) AS sources, round(interest + coalesce(repayment, 0), 4) AS total_repayment, round(term_total + coalesce(instalments, 0), 4) AS loan FROM l9),
  l11 AS (SELECT *, round(current_total + term_total, 4) AS outside, round(current_assets + net_block, 4) AS total_assets, round(accruals / nullif(total_repayment, 0), 4) AS net_dscr, round((accruals + interest) / nullif(total_repayment, 0), 4) AS gross_dscr FROM l10),
  r AS (SELECT *, round(outside + worth, 4) AS total_liabilities, CASE WHEN col = 1 THEN round(avg(nullif(net_dscr, 0)) OVER (PARTITION BY company), 4) END AS net_mean, CASE WHEN col = 1 THEN round(avg(nullif(gross_dscr, 0)) OVER (PARTITION BY company), 4) END AS gross_mean FROM l11)"""


def _sql(sections: dict[str, list[tuple[str, str]]]) -> str:
    cells = ", ".join("{{'section': '{}', 'row': '{}', 'value': CAST({} AS DOUBLE)}}".format(s, label.replace("'", "''"), e) for s, rows in sections.items() for label, e in rows)
    return f"{_CORE} SELECT company, x.section AS section, x.\"row\" AS \"row\", CAST(col AS INT) AS col, round(x.value, 6) AS value FROM (SELECT company, col, unnest([{cells}]) AS x FROM r) WHERE x.value IS NOT NULL"


def _share_of(a: str) -> str:
    return f"round({a} / nullif(income, 0), 6)"


# fields that no document gives go on at a share (of sales that are known in all years) or a value of 0
_BY_SHARE, _AHEAD = "CASE WHEN col > 3 AND steady THEN 0 END", "CASE WHEN col > 3 THEN 0 END"
_OPERATING = [
    ("i. Domestic Sale", "sale"), ("Total Gross Sales", "income"), ("Total Income", "income"), ("Growth in sales", "growth"), ("a. Freight & Handling Expenses", "freight"), ("b. Vehicle Running expenses", _BY_SHARE), ("Depreciation ", "dep"),
    ("Others expenses", "0"), *[("Sub Total", "cos")] * 4, ("Cost of Production ", "cos"), ("Sub Total ( Total Cost of Sales)", "cos"), ("Gross profit", "gross_profit"), ("Gross Profit/ Sales", _share_of("gross_profit")), ("Selling Expenses", "selling"),
    ("Administrative Expenses", _BY_SHARE), ("Sub Total ", "cost"), ("Operating Profit before interest ", "op_before"), ("b.Interest on TL ", "int_tl"), ("Total Interest", "interest"), ("Operating Profit after Interest", "op_after"), ("Other Income", "other_income"),
    ("Sub Total", "non_op"), ("Net of other non operating Income/Expenses", "net_non_op"), ("Profit before Tax /Loss (PBT)", "pbt"), ("Provision for Taxes", "tax"), ("Net Profit/Loss (PAT)", "pat"), ("Cash Accruals", "accruals"), ("Retained Profit ", "pat"),
    ("Retained Cash Profits", "accruals"), ("RM Content in sales", _share_of("nullif(cos, 0)")), ("PBDIT ", "pbdit"), ("PBDIT/Sales", _share_of("pbdit")), ("Operating Profits/Sales", _share_of("op_before")), ("PBT/Sales", _share_of("pbt")), ("PAT/Sales", _share_of("pat")),
    ("Cash Accruals/ Sales", _share_of("accruals")),
]
_LIABILITIES = [
    ("Short Term loans from Applicant Bank  ", "bank_loans"), ("Sub Total (A)", "sub_a"), ("Sundry Creditors (Trade)", "creditors"), ("Advance Payment from Customers", _BY_SHARE), ("Installments of term Loan/ DPGs/ Deposits/ debentures due within next year", "instalments"),
    ("Other Current Liabilities & Provisions (due with in one year)", _BY_SHARE), ("Sub Total (B)", "sub_b"), ("TOTAL CURRENT LIABILITIES", "current_total"), ("Term Loan from Bank(Less next Year Instalments)", "term_bank"), ("TOTAL TERM LIABILITIES", "term_total"),
    ("TOTAL OF OUTSIDE LIABILITIES ", "outside"), ("Share Capital", "capital"), ("General Reserve", "reserve"), ("Surplus (+) or deficit (-) in Profit & Loss a/c", "pat"), ("NET WORTH", "worth"), ("TOTAL LIABILITIES (18+24)", "total_liabilities"),
]
_ASSETS = [
    ("Cash & Bank Balances", _BY_SHARE), ("Domestic Receivables including BP/BD", "receivables"), ("Stock in Process", "0"), ("Finished Goods", "0"), ("Advances to Suppliers/Transport", _BY_SHARE), ("Other Current Assets (specify major items)", _BY_SHARE), ("TOTAL CURRENT ASSETS", "current_assets"),
    ("Gross Block (Land & Building Machinery", "gross_block"), ("Depreciation to Date", "to_date"), ("Net Block", "net_block"), ("Deferred Receivables(Maturng after a year)", _AHEAD), ("Deferred Tax Asset (net)", _AHEAD), ("Advance Tax/TDS", _AHEAD),
    ("TOTAL OTHER NON CURRENT ASSETS", "0"), ("Total Intangible Assets", "0"), ("TOTAL ASSETS", "total_assets"),
]
_FLOWS = [
    ("Profit after Tax", "pat"), ("Depreciation", "dep"), ("Increase in Term Liability", "term_up"), ("LONG TERM SOURCES TOTAL", "sources"), ("LONG TERM USES TOTAL", "0"), ("Surplus/ Deficit", "sources"), ("Long Term Sources", "sources"), ("Long Term Uses", "0"), ("Surplus /Deficit (i-ii)", "sources"),
]
_DSCR = [
    ("Cash accruals", "accruals"), ("Interest on TL / Deffered Loans", "interest"), ("Repayment Obligations of TL", "repayment"), ("Total Repayment", "total_repayment"), ("Net Debt Service Coverage Ratio (DSCR)", "net_dscr"), ("Gross Debt Service Coverage Ratio (DSCR)", "gross_dscr"),
    ("Average Net DSCR", "net_mean"), ("Average Gross DSCR", "gross_mean"), ("Net Block", "net_block"), ("Term Loan outstanding (including instalments)", "loan"), ("Security Cover avilable (NB-TL/NB)", "round((net_block - loan) / nullif(net_block, 0), 4)"),
]


def _rows(spark, sf, *sections: str):
    return statements.statement(given(spark, sf), sections).select("company", "section", "row", "col", F.round("value", 6).alias("value"))


@query(_sql({"operating": _OPERATING}))
def statement_operating(spark, sf):
    return _rows(spark, sf, "operating")


@query(_sql({"liabilities": _LIABILITIES, "assets": _ASSETS}))
def statement_balance(spark, sf):
    return _rows(spark, sf, "liabilities", "assets")


@query(_sql({"fund_flow": _FLOWS, "dscr": _DSCR}))
def statement_flows(spark, sf):
    return _rows(spark, sf, "fund_flow", "dscr")
