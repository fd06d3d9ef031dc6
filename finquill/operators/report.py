"""Growth, projections and report sections over one row per company and three years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_GROWTH = 0.10


def year_vector(long: DataFrame, keys: list[str], years: list[str]) -> DataFrame:
    """v1, v2, v3 of the years given, by conditional sums (one aggregate, no pivot job)."""
    return long.groupBy(*keys).agg(*[F.max(F.when(F.col("fy") == fy, F.col("value"))).alias(f"v{k}") for k, fy in enumerate(years, 1)])


def _rate(a: Column, b: Column) -> Column:
    return F.when((a != 0) & (b != 0), F.try_divide(b - a, F.abs(a)))


def average_growth(v1: Column, v2: Column, v3: Column) -> Column:
    """Mean of the known yearly rates; without one, DEFAULT_GROWTH."""
    a, b = _rate(v1, v2), _rate(v2, v3)
    n = a.isNotNull().cast("int") + b.isNotNull().cast("int")
    return F.coalesce(F.try_divide(F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)), n), F.lit(DEFAULT_GROWTH))


def _base(v1: Column, v2: Column, v3: Column) -> Column:
    return F.coalesce(F.nullif(v3, F.lit(0.0)), F.nullif(v2, F.lit(0.0)), F.nullif(v1, F.lit(0.0)), F.lit(0.0))


def project(df: DataFrame, low: float = -0.5, high: float = 0.5) -> DataFrame:
    """growth, p1 and p2: two further years at the average growth, held to [low, high]."""
    v = [F.col(f"v{k}") for k in (1, 2, 3)]
    df = df.withColumn("growth", F.greatest(F.lit(low), F.least(average_growth(*v), F.lit(high))))
    df = df.withColumn("p1", F.round(_base(*v) * (1 + F.col("growth")), 4))
    return df.withColumn("p2", F.round(F.col("p1") * (1 + F.col("growth")), 4))


def project_declining(df: DataFrame) -> DataFrame:
    """Growth held to [-0.5, 0]: flat unless it falls."""
    return project(df, -0.5, 0.0)


def project_by_share(df: DataFrame) -> DataFrame:
    """p1 and p2 as the average share in sales (s1, s2, s3) of projected sales (sp1, sp2)."""
    parts = [F.when((F.col(f"v{k}") != 0) & (F.col(f"s{k}") != 0), F.try_divide(F.col(f"v{k}"), F.col(f"s{k}"))) for k in (1, 2, 3)]
    n = sum((p.isNotNull().cast("int") for p in parts[1:]), parts[0].isNotNull().cast("int"))
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0.0)))
    share = F.coalesce(F.try_divide(total, n), F.lit(0.0))
    return df.withColumn("share", share).withColumn("p1", F.round(F.col("share") * F.col("sp1"), 4)).withColumn("p2", F.round(F.col("share") * F.col("sp2"), 4))


def growth_by_year(long: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("fy")
    before = F.lag("value").over(w)
    return long.withColumn("growth", F.round(F.try_divide(F.col("value") - before, F.abs(before)), 4))


#: Report sections: (section, row, expression over a statement with derived measures).  Totals
#: take the extracted value where there is one; here they are computed.
SECTIONS: tuple[tuple[str, str, str], ...] = (
    ("operating", "net_sales", "net_sales"),
    ("operating", "cost_of_sales", "cost_of_sales"),
    ("operating", "gross_profit", "net_sales - cost_of_sales"),
    ("operating", "expenses", "fixed_cost"),
    ("operating", "operating_profit", "net_sales - cost_of_sales - fixed_cost"),
    ("operating", "interest", "interest"),
    ("operating", "profit_before_tax", "net_sales - cost_of_sales - fixed_cost - interest"),
    ("operating", "tax_at_25", "round(greatest(net_sales - cost_of_sales - fixed_cost - interest, 0) * 0.25, 4)"),
    ("liabilities", "current_liabilities", "current_liabilities"),
    ("liabilities", "outside_liabilities", "current_liabilities + term_liabilities"),
    ("liabilities", "total_liabilities", "current_liabilities + term_liabilities + capital + reserves"),
    ("assets", "current_assets", "current_assets"),
    ("assets", "net_block", "total_assets - current_assets - intangibles"),
    ("assets", "total_assets", "total_assets"),
    ("working_capital", "gap", "current_assets - creditors - other_cl"),
    ("working_capital", "net_working_capital", "current_assets - current_liabilities"),
    ("working_capital", "receivable_days", "ratio(receivables * 365, net_sales, 1)"),
    ("working_capital", "creditor_days", "ratio(creditors * 365, cost_of_sales, 1)"),
    ("fund_flow", "sources", "capital + reserves + term_liabilities"),
    ("fund_flow", "uses", "total_assets - current_assets"),
    ("fund_flow", "surplus", "capital + reserves + term_liabilities - total_assets + current_assets"),
    ("break_even", "contribution", "net_sales - variable_cost"),
    ("break_even", "pv_ratio", "ratio(net_sales - variable_cost, net_sales, 4)"),
    ("break_even", "break_even_sales", "case when net_sales > variable_cost then ratio(fixed_cost, (net_sales - variable_cost) / nullif(net_sales, 0), 1) end"),
    ("break_even", "fixed_next_year", "round(fixed_cost * 1.09, 4)"),
    ("dscr", "cash_accruals", "pat + dep"),
    ("dscr", "net_dscr", "ratio(pat + dep, repayment, 4)"),
    ("dscr", "gross_dscr", "ratio(pat + dep + interest, repayment + interest, 4)"),
    ("dscr", "security_cover", "ratio(total_assets - current_assets - intangibles - term_liabilities, total_assets - current_assets - intangibles, 4)"),
    ("ratios", "current_ratio", "ratio(current_assets, current_liabilities, 2)"),
    ("ratios", "debt_equity", "ratio(term_liabilities, capital + reserves - intangibles, 2)"),
    ("ratios", "gross_margin", "ratio(net_sales - cost_of_sales, net_sales, 4)"),
    ("ratios", "net_margin", "ratio(pat, net_sales, 4)"),
    ("ratios", "asset_turnover", "ratio(net_sales, total_assets, 4)"),
    ("ratios", "interest_cover", "ratio(pbt + interest, interest, 4)"),
    ("indicators", "pat_to_net_worth", "ratio(pat, capital + reserves, 4)"),
    ("indicators", "tangible_net_worth", "capital + reserves - intangibles"),
    ("indicators", "cash_accruals", "pat + dep"),
    ("indicators", "tol_to_tnw", "ratio(current_liabilities + term_liabilities, capital + reserves - intangibles, 2)"),
)


def section(statement: DataFrame, name: str) -> DataFrame:
    """Rows (keys, row_ord, row, value) of a section; rows without a value go."""
    from finquill.operators.derive import to_sql

    rows = [(k, row, to_sql(e, "try_divide({a}, {b})")) for k, (s, row, e) in enumerate(SECTIONS) if s == name]
    cells = F.array(*[F.struct(F.lit(k).alias("row_ord"), F.lit(row).alias("row"), F.expr(e).cast("double").alias("value")) for k, row, e in rows])
    return statement.select("company", "fy", F.explode(cells).alias("c")).select("company", "fy", "c.row_ord", "c.row", F.round("c.value", 4).alias("value")).where("value is not null")


def section_sql(name: str) -> str:
    """The same for an SQL engine."""
    from finquill.operators.derive import to_sql

    parts = [f"SELECT company, fy, {k} AS row_ord, '{row}' AS row, round(CAST({to_sql(e)} AS DOUBLE), 4) AS value FROM st" for k, (s, row, e) in enumerate(SECTIONS) if s == name]
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE value IS NOT NULL"
