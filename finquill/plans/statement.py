"""Pseudo statements of the driver tables: a company is a nation, a year is an Indian financial year.

The measures are sums of integer cents, so they are equal in every engine whatever the
order of addition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finquill.functions.scalars import fy_label

#: field -> cents of a line (l_* columns), as an expression that Spark and DuckDB share.
CENTS = {
    "net_sales": "round(l_extendedprice * 100)",
    "cost_of_sales": "round(l_extendedprice * 55)",
    "variable_cost": "round(l_extendedprice * 60)",
    "fixed_cost": "round(l_extendedprice * 20)",
    "interest": "round(l_extendedprice * l_tax * 50)",
    "dep": "round(l_extendedprice * l_discount * 40)",
    "pbt": "round(l_extendedprice * (0.2 - l_tax) * 100)",
    "pat": "round(l_extendedprice * (0.15 - l_tax) * 100)",
    "dividend": "round(l_quantity * 100)",
    "capital": "round(l_quantity * 5000)",
    "reserves": "round(l_extendedprice * 15)",
    "intangibles": "round(l_quantity * 300)",
    "receivables": "round(l_extendedprice * l_discount * 100)",
    "creditors": "round(l_extendedprice * l_tax * 100)",
    "other_cl": "round(l_quantity * 200)",
    "current_assets": "round(l_extendedprice * 40)",
    "current_liabilities": "round(l_extendedprice * 25)",
    "term_liabilities": "round(l_extendedprice * 30)",
    "total_assets": "round(l_extendedprice * 73)",
    "repayment": "round(l_quantity * 400)",
    "raw_material": "round(l_extendedprice * 35)",
    "bank_borrowings": "round(l_extendedprice * 12)",
    "other_income": "round(l_quantity * 50)",
    "inventory": "round(l_extendedprice * 18)",
}
FIELDS = list(CENTS)

STATEMENT_SQL = f"""
    SELECT n_name AS company, fy, {", ".join(f"CAST(sum(CAST({e} AS BIGINT)) AS DOUBLE) / 100 AS {f}" for f, e in CENTS.items())}
    FROM (SELECT o_orderkey, n_name, {{fy}} AS fy FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) o
    JOIN lineitem ON l_orderkey = o.o_orderkey GROUP BY n_name, fy
"""
FY_SQL = (
    "CAST(year({0}) - CASE WHEN month({0}) < 4 THEN 1 ELSE 0 END AS VARCHAR) || '-' || "
    "lpad(CAST((year({0}) - CASE WHEN month({0}) < 4 THEN 1 ELSE 0 END + 1) % 100 AS VARCHAR), 2, '0')"
)
ST = "WITH st AS (" + STATEMENT_SQL.format(fy=FY_SQL.format("o_orderdate")) + ")"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def statement(spark: SparkSession, sf_dir: str, fields: list[str] = FIELDS) -> DataFrame:
    """company, fy and the fields asked for; only the columns they need are read.

    Lines are summed by order before they meet the orders' names, so what is shuffled
    for the join is a row per order, and a second aggregate adds a few sums per company and
    year.  Customers and nations join on the order side.
    """
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", fy_label(F.col("o_orderdate")).alias("fy"))
    names = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(load(spark, sf_dir, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    orders = orders.join(names, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("n_name").alias("company"), "fy")
    lines = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(*[F.sum(F.expr(CENTS[f]).cast("bigint")).alias(f) for f in fields])
    met = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return met.groupBy("company", "fy").agg(*[(F.sum(f).cast("double") / 100).alias(f) for f in fields])
