"""Command lines: ``python -m finquill.cli extract|document|report|query`` over folders that Spark reads.

extract  pages (Parquet: doc, page, text) and terms (Parquet: field, term) to one row a document and field
document whole scanned documents: the same inputs, with tables, statements and notes of the pages, and a summary below output-summary
report   statements (Parquet: company, fy and the base fields) to the long report of five columns
query    a named query over a folder of tables
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def extract_documents(pages: DataFrame, terms: DataFrame) -> DataFrame:
    """Fields of documents by the rule extractor: prose lines with amounts are candidates, a term's first match is the value."""
    from finquill.operators import extract, tables
    from finquill.operators import pages as paging

    lines = pages.select("doc", "page", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("pos", F.col("page") * 100_000 + F.col("line_no"))
    lines = paging.outside_tables(lines, ["doc", "page"], "line_no", "line").where(~paging.is_prose_skipped(F.col("line")))
    return extract.extracted(tables.prose_candidates(lines, ["doc", "page", "pos"], "line"), terms, terms)


def report_of(statement: DataFrame, years: list[str]) -> DataFrame:
    from finquill.operators import cascade

    fields = [c for c in statement.columns if c not in ("company", "fy")]
    return cascade.rows(cascade.five_columns(statement, years, fields))


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="finquill")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("extract")
    one.add_argument("pages")
    one.add_argument("terms")
    four = commands.add_parser("document")
    four.add_argument("pages")
    four.add_argument("terms")
    two = commands.add_parser("report")
    two.add_argument("statements")
    two.add_argument("--years", nargs=3, required=True)
    three = commands.add_parser("query")
    three.add_argument("name")
    three.add_argument("tables")
    for p in (one, two, three, four):
        p.add_argument("output")
    given = parser.parse_args(arguments)
    spark = spark or SparkSession.builder.getOrCreate()
    if given.command == "extract":
        out = extract_documents(spark.read.parquet(given.pages), spark.read.parquet(given.terms))
    elif given.command == "document":
        from finquill.operators import extraction
        from finquill.sources import steps

        pages, terms = spark.read.parquet(given.pages), spark.read.parquet(given.terms)
        extraction.document_fields(pages, terms, terms).write.mode("overwrite").parquet(given.output)
        fields = spark.read.parquet(given.output)
        extraction.document_summary(pages, fields).write.mode("overwrite").parquet(f"{given.output.rstrip('/')}-summary")
        steps.clear(spark)
        return
    elif given.command == "report":
        out = report_of(spark.read.parquet(given.statements), given.years)
    else:
        from finquill.plans.every import Q

        out = Q[given.name](spark, given.tables)
    out.write.mode("overwrite").parquet(given.output)


if __name__ == "__main__":
    main()
