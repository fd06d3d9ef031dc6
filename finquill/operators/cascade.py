"""The full report: five columns a company (three years and two projected ones) and its sections.

Every base field is projected by its own rule in a few wide steps over one row per company; sections are
expressions over the five columns, a value given by the document wins over a computed one, and only
the opening balances and growth look at the column before.  Null inputs make null rows, which go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finquill.operators.derive import to_sql
from finquill.operators.report import average_growth

COLUMNS = 5
#: Fields that are projected other than by their average growth.
DECLINING = ("term_liabilities", "intangibles", "bank_borrowings")
BY_SALES = ("cost_of_sales", "raw_material", "receivables", "inventory", "creditors")
#: Variable cost of projected years as a share of sales, and the yearly growth of fixed cost.
VARIABLE_SHARE, FIXED_GROWTH = 0.85, 1.09

_EQUITY = "(capital + reserves - coalesce(intangibles, 0))"
_LIABILITIES = "(current_liabilities + term_liabilities)"
_PBDIT = "(pbt + interest + dep)"
# Fixed values: (section, row, expression); ratio(a, b, digits) is null where b is null or 0.  All rows read one profit after tax, "pat".
ROWS: tuple[tuple[str, str, str], ...] = (
    ("operating", "Gross Sales", "net_sales"),
    ("operating", "Growth in sales", "ratio(net_sales - before_sales, abs(before_sales), 4)"),
    ("operating", "Raw materials", "raw_material"),
    ("operating", "Cost of Sales", "cost_of_sales"),
    ("operating", "Gross Profit", "net_sales - cost_of_sales"),
    ("operating", "Selling and administration", "fixed_cost"),
    ("operating", "Operating Profit before Interest", "net_sales - cost_of_sales - fixed_cost"),
    ("operating", "Interest", "interest"),
    ("operating", "Operating Profit after Interest", "net_sales - cost_of_sales - fixed_cost - interest"),
    ("operating", "Other income", "other_income"),
    ("operating", "Profit before tax", "net_sales - cost_of_sales - fixed_cost - interest + other_income"),
    ("operating", "Tax", "greatest(net_sales - cost_of_sales - fixed_cost - interest + other_income, 0) * 0.25"),
    ("operating", "Net Profit", "pat"),
    ("operating", "Dividend", "dividend"),
    ("operating", "Retained Profit", "pat - coalesce(dividend, 0)"),
    ("operating", "Cash Accruals", "pat + dep"),
    ("liabilities", "Bank borrowings (A)", "bank_borrowings"),
    ("liabilities", "Creditors", "creditors"),
    ("liabilities", "Other current liabilities (B)", "current_liabilities - bank_borrowings"),
    ("liabilities", "Total Current Liabilities", "current_liabilities"),
    ("liabilities", "Total Term Liabilities", "term_liabilities"),
    ("liabilities", "Total Outside Liabilities", "current_liabilities + term_liabilities"),
    ("liabilities", "Share Capital", "capital"),
    ("liabilities", "Reserves", "reserves"),
    ("liabilities", "Net Worth", "capital + reserves"),
    ("liabilities", "Total Liabilities", "current_liabilities + term_liabilities + capital + reserves"),
    ("assets", "Receivables", "receivables"),
    ("assets", "Inventory", "inventory"),
    ("assets", "Total Current Assets", "current_assets"),
    ("assets", "Net Block", "total_assets - current_assets - coalesce(intangibles, 0)"),
    ("assets", "Intangible Assets", "intangibles"),
    ("assets", "Total Assets", "total_assets"),
    ("key_metrics", "Tangible Net Worth", _EQUITY),
    ("key_metrics", "Net Working Capital", "current_assets - current_liabilities"),
    ("key_metrics", "Opening TNW", "before_equity"),
    ("key_metrics", "Plough back of profit", "pat"),
    ("key_metrics", "Closing TNW", _EQUITY),
    ("key_metrics", "Current Ratio", "ratio(current_assets, current_liabilities, 4)"),
    ("key_metrics", "Debt/Equity", f"ratio(term_liabilities, {_EQUITY}, 4)"),
    ("key_metrics", "TOL/Equity", f"ratio({_LIABILITIES}, {_EQUITY}, 4)"),
    ("key_metrics", "Current Assets/Tangible Assets", "ratio(current_assets, total_assets, 6)"),
    ("key_metrics", "ROCE", f"ratio({_PBDIT}, total_assets, 6)"),
    ("key_metrics", "Inventory+Receivables days", "ratio((inventory + receivables) * 365, net_sales, 2)"),
    ("working_capital", "Receivable days", "ratio(receivables * 365, net_sales, 1)"),
    ("working_capital", "Inventory days", "ratio(inventory * 365, cost_of_sales, 1)"),
    ("working_capital", "Creditor days", "ratio(creditors * 365, cost_of_sales, 1)"),
    ("working_capital", "Receivables to current assets (%)", "ratio(receivables * 100, current_assets, 2)"),
    ("working_capital", "Inventory to current assets (%)", "ratio(inventory * 100, current_assets, 2)"),
    ("working_capital", "Working capital gap", "current_assets - (current_liabilities - bank_borrowings)"),
    ("working_capital", "Net working capital", "current_assets - current_liabilities"),
    ("working_capital", "Bank finance to gap (%)", "ratio(bank_borrowings * 100, current_assets - (current_liabilities - bank_borrowings), 2)"),
    ("fund_flow", "Long term sources", "capital + reserves + term_liabilities"),
    ("fund_flow", "Long term uses", "total_assets - current_assets"),
    ("fund_flow", "Long term surplus", "capital + reserves + term_liabilities - (total_assets - current_assets)"),
    ("fund_flow", "Short term sources", "current_liabilities"),
    ("fund_flow", "Short term uses", "current_assets"),
    ("fund_flow", "Short term surplus", "current_liabilities - current_assets"),
    ("break_even", "Sales", "net_sales"),
    ("break_even", "Variable cost", "variable_cost"),
    ("break_even", "Contribution", "net_sales - variable_cost"),
    ("break_even", "P/V ratio", "ratio(net_sales - variable_cost, net_sales, 4)"),
    ("break_even", "Fixed cost", "fixed_cost"),
    ("break_even", "Break-even sales", "case when net_sales > variable_cost then ratio(fixed_cost * net_sales, net_sales - variable_cost, 6) end"),
    ("break_even", "Cash break-even sales", "case when net_sales > variable_cost then ratio((fixed_cost - dep) * net_sales, net_sales - variable_cost, 6) end"),
    ("break_even", "Margin of safety", "case when net_sales > variable_cost then 1 - ratio(fixed_cost, net_sales - variable_cost, 4) end"),
    ("dscr", "Cash accruals", "pat + dep"),
    ("dscr", "Repayments", "repayment"),
    ("dscr", "Net DSCR", "ratio(pat + dep, repayment, 4)"),
    ("dscr", "Gross DSCR", "ratio(pat + dep + interest, repayment + interest, 4)"),
    ("dscr", "Security cover", "ratio(total_assets - current_assets - term_liabilities, total_assets - current_assets, 4)"),
    ("ratios", "Growth in Sales", "ratio(net_sales - before_sales, abs(before_sales), 4)"),
    ("ratios", "Gross profit Ratio", "ratio(net_sales - cost_of_sales, net_sales, 4)"),
    ("ratios", "PBDIT", _PBDIT),
    ("ratios", "PBDIT/sales", f"ratio({_PBDIT}, net_sales, 4)"),
    ("ratios", "Operating Profits/Sales", "ratio(pbt + interest, net_sales, 4)"),
    ("ratios", "PBT/Sales", "ratio(pbt, net_sales, 4)"),
    ("ratios", "PAT/Sales", "ratio(pat, net_sales, 4)"),
    ("ratios", "Cash Accruals/ Sales", "ratio(pat + dep, net_sales, 4)"),
    ("ratios", "Sales/Equity", f"ratio(net_sales, {_EQUITY}, 4)"),
    ("ratios", "Sales / TTA", "ratio(net_sales, total_assets, 4)"),
    ("ratios", "Interest Coverage (Interest/PBDIT)", f"ratio(interest, {_PBDIT}, 4)"),
    ("ratios", "PBDIT / Interest (Times)", f"ratio({_PBDIT}, interest, 4)"),
    ("ratios", "Deferred Debt/ Equity", f"ratio(term_liabilities, {_EQUITY}, 4)"),
    ("ratios", "TOL/Equity", f"ratio({_LIABILITIES}, {_EQUITY}, 4)"),
    ("ratios", "Current Ratio (CA / CL)", "ratio(current_assets, current_liabilities, 4)"),
    ("ratios", "Current Ratio excluding TL Instalments", "ratio(current_assets, current_liabilities - coalesce(repayment, 0), 4)"),
    ("ratios", "CA / TTA (%)", "ratio(current_assets, total_assets, 6)"),
    ("ratios", "Inventory+Receivables as days of Net Sales", "ratio((inventory + receivables) * 365, net_sales, 2)"),
    ("ratios", "Bank Borrowings/Current Assets", "ratio(bank_borrowings, current_assets, 6)"),
    ("ratios", "RM content in sales", "ratio(raw_material, net_sales, 4)"),
    ("ratios", "ROCE", f"ratio({_PBDIT}, total_assets, 6)"),
    ("indicators", "Net Sales", "net_sales"),
    ("indicators", "Operating Profit", "net_sales - cost_of_sales - fixed_cost - interest"),
    ("indicators", "(Net) Other income", "other_income"),
    ("indicators", "PBDIT/Sales", f"ratio({_PBDIT}, net_sales, 4)"),
    ("indicators", "PBT/Sales", "ratio(pbt, net_sales, 4)"),
    ("indicators", "PAT", "pat"),
    ("indicators", "PAT/Net Sales", "ratio(pat, net_sales, 4)"),
    ("indicators", "Cash Accruals", "pat + dep"),
    ("indicators", "Cash Accruals/Sales", "ratio(pat + dep, net_sales, 4)"),
    ("indicators", "Paid up Capital (PUC)", "capital"),
    ("indicators", "TNW", _EQUITY),
    ("indicators", "Adjusted TNW", _EQUITY),
    ("indicators", "TOL/TNW", f"ratio({_LIABILITIES}, {_EQUITY}, 4)"),
    ("indicators", "TOL/Adjusted TNW", f"ratio({_LIABILITIES}, {_EQUITY}, 4)"),
    ("indicators", "C/R", "ratio(current_assets, current_liabilities, 4)"),
    ("indicators", "C/R excluding T/L instalments", "ratio(current_assets, current_liabilities - coalesce(repayment, 0), 4)"),
    ("indicators", "Net Sales/TTA (Times)", "ratio(net_sales, total_assets, 4)"),
    ("indicators", "PBT/TTA (%)", "ratio(pbt, total_assets, 4)"),
    ("indicators", "Operating costs/sales(%)", "ratio(cost_of_sales + fixed_cost, net_sales, 6)"),
    ("indicators", "Bank Finance / Current Assets (%)", "ratio(bank_borrowings, current_assets, 6)"),
    ("indicators", "Inv + Rec. /N.S. (DAYS)", "ratio((inventory + receivables) * 365, net_sales, 2)"),
    ("indicators", "NWC / CA (%)", "ratio(current_assets - current_liabilities, current_assets, 6)"),
)


def five_columns(statement: DataFrame, years: list[str], fields: list[str]) -> DataFrame:
    """(company, col 1..5, fields): the three years and two projected ones.

    Growth fields go on at their average growth, held to half up or down; declining ones never
    grow; fields by sales keep their average share of sales; variable cost is a share of projected
    sales, fixed cost grows by a fixed rate.
    """
    wide = statement.groupBy("company").agg(*[F.max(F.when(F.col("fy") == y, F.col(f))).alias(f"{f}_{k}") for f in fields for k, y in enumerate(years, 1)])

    def known(f: str) -> list[Column]:
        return [F.col(f"{f}_{k}") for k in (1, 2, 3)]

    def base(f: str) -> Column:
        v = known(f)
        return F.coalesce(*[F.nullif(x, F.lit(0.0)) for x in reversed(v)], F.lit(0.0))

    def share(f: str) -> Column:
        parts = F.array_compact(F.array(*[F.when((a != 0) & (s != 0), F.try_divide(a, s)) for a, s in zip(known(f), known("net_sales"), strict=True)]))
        return F.coalesce(F.try_divide(F.aggregate(parts, F.lit(0.0), lambda t, x: t + x), F.size(parts)), F.lit(0.0))

    growing = [f for f in fields if f not in BY_SALES and f not in ("variable_cost", "fixed_cost")]
    wide = wide.withColumns({f"{f}_g": F.greatest(F.lit(-0.5), F.least(average_growth(*known(f)), F.lit(0.0 if f in DECLINING else 0.5))) for f in growing})
    wide = wide.withColumns({f"{f}_4": F.round(base(f) * (1 + F.col(f"{f}_g")), 4) for f in growing})
    wide = wide.withColumns({f"{f}_5": F.round(F.col(f"{f}_4") * (1 + F.col(f"{f}_g")), 4) for f in growing})
    by_sales = {f"{f}_{k}": F.round(share(f) * F.col(f"net_sales_{k}"), 4) for f in fields if f in BY_SALES for k in (4, 5)}
    by_sales |= {f"variable_cost_{k}": F.round(F.col(f"net_sales_{k}") * VARIABLE_SHARE, 4) for k in (4, 5)}
    wide = wide.withColumns(by_sales | {"fixed_cost_4": F.round(base("fixed_cost") * FIXED_GROWTH, 4)})
    wide = wide.withColumn("fixed_cost_5", F.round(F.col("fixed_cost_4") * FIXED_GROWTH, 4))
    cells = F.array(*[F.struct(F.lit(k).alias("col"), *[F.col(f"{f}_{k}").alias(f) for f in fields]) for k in range(1, COLUMNS + 1)])
    return wide.select("company", F.explode(cells).alias("c")).select("company", "c.*")


def rows(columns: DataFrame, section: str | None = None, given: DataFrame | None = None) -> DataFrame:
    """(company, section, row_ord, row, col, value) of one section or all; ``given`` (company, col, section, row, value) wins."""
    w = Window.partitionBy("company").orderBy("col")
    frame = columns.withColumn("before_sales", F.lag("net_sales").over(w)).withColumn("before_equity", F.lag(F.expr(_EQUITY)).over(w))
    listed = [(k, s, r, to_sql(e, "try_divide({a}, {b})")) for k, (s, r, e) in enumerate(ROWS) if section in (None, s)]
    cells = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(k).alias("row_ord"), F.lit(r).alias("row"), F.expr(e).cast("double").alias("value")) for k, s, r, e in listed])
    out = frame.select("company", "col", F.explode(cells).alias("c")).select("company", "c.section", "c.row_ord", "c.row", "col", "c.value")
    if given is not None:
        out = out.join(given.select("company", "col", "section", "row", F.col("value").alias("__given")), ["company", "col", "section", "row"], "left").withColumn("value", F.coalesce("__given", "value")).drop("__given")
    return out.where("value is not null").select("company", "section", "row_ord", "row", "col", F.round("value", 6).alias("value"))


def averages(found: DataFrame, names: list[str]) -> DataFrame:
    """The average of a row over its columns that aren't 0."""
    return found.where(F.col("row").isin(*names)).groupBy("company", "row").agg(F.round(F.avg(F.nullif("value", F.lit(0.0))), 4).alias("average"))


def running_balances(columns: DataFrame) -> DataFrame:
    """Reserves of projected columns grow by the profits before them, accumulated depreciation by each column's own."""
    up = Window.partitionBy("company").orderBy("col").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.max(F.when(F.col("col") == 3, F.col("reserves"))).over(Window.partitionBy("company"))
    profits = F.sum(F.when(F.col("col") > 3, F.col("pat_before")).otherwise(0.0)).over(up)
    out = columns.withColumn("pat_before", F.lag("pat").over(Window.partitionBy("company").orderBy("col")))
    out = out.withColumn("reserves", F.when(F.col("col") > 3, last + profits).otherwise(F.col("reserves")))
    return out.withColumn("accumulated_depreciation", F.sum("dep").over(up)).drop("pat_before")


def headings(companies: DataFrame, years: list[str]) -> DataFrame:
    """The captions of a report: the company, audited years, and the projected ones after the last."""
    start = int(years[-1].split("-")[0])
    projected = [f"{y}-{(y + 1) % 100:02d}" for y in (start + 1, start + 2)]
    captions = [f"Audited {y}" for y in years] + [f"Projected {y}" for y in projected]
    cells = F.array(*[F.struct(F.lit(k).alias("col"), F.lit(c).alias("caption")) for k, c in enumerate(captions, 1)])
    return companies.select("company", F.explode(cells).alias("c")).select("company", "c.col", "c.caption")


def unmapped_appendix(items: DataFrame) -> DataFrame:
    """(company, place, label, page, current_value, previous_value, source) of items that no field took, in document order."""
    place = F.row_number().over(Window.partitionBy("company").orderBy("doc_ord", "pos"))
    return items.select("company", place.alias("place"), "label", "page", "current_value", "previous_value", F.col("source_statement").alias("source"))
