"""Adapters, sinks, formulas, repairs, settings and edge cases of the core operators."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from finquill import cli, errors
from finquill.functions import formulas, procedural
from finquill.operators import cascade, documents, extract, pages, tables, validate
from finquill.settings import Settings
from finquill.sources import adapters, files, sinks


def test_formulas():
    cells = {1: 2.0, 2: "=S1*3", 3: "=(S2-S1)/4", 4: "=S4+1", 5: "=S6", 6: "=S5", 7: "=IF(S1>1,S2,S3)", 8: "=__import__('os')", 9: "=S1/0", 10: None, 11: "text"}
    got = formulas.evaluate(cells, "S")
    assert got[2] == 6.0 and got[3] == 1.0 and got[4] == 1.0 and got[7] == 6.0
    assert all(got[k] == 0.0 for k in (5, 6, 8, 9, 10, 11))
    chain = {1: 1.0} | {k: f"=S{k - 1}+1" for k in range(2, 3000)}
    assert formulas.evaluate(dict(reversed(chain.items())), "S")[2999] == 2999.0


def test_inner_quotes_and_notes():
    assert json.loads(procedural.repaired('{"a": "say "hi" now", "b": 1}')) == {"a": 'say "hi" now', "b": 1}
    assert [n["note"] for n in procedural.notes_of("see Schedule IV, Note No. 21 and <b>Note 4</b> - x")] == ["IV", "21", "4", "4", "4"]
    assert procedural.notes_of(None) == []


def test_adapters_and_retries(spark):
    rows = [("a.pdf", b"one\x0ctwo\x0cthree"), ("b.png", b"only"), ("c.pdf", b"")]

    def read(path, content):
        if not content:
            raise errors.OcrFailure(path)
        return content.decode().split("\x0c")

    got = adapters.read_pages(spark.createDataFrame(rows, "path string, content binary"), read, start_page=2)
    assert sorted((r.path, r.page, r.text, r.error_code) for r in got.collect() if r.page) == [("a.pdf", 2, "two", None), ("a.pdf", 3, "three", None), ("b.png", 1, "only", None)]
    assert [r.error_code for r in got.where("page is null").collect()] == ["ocr_failure"]
    assert {r.path: r.markdown for r in adapters.markdown(got).collect()} == {"a.pdf": "two\n\nthree", "b.png": "only"}
    waited, calls = [], []

    def flaky(quota):
        calls.append(1)
        raise errors.QuotaExceeded if quota else errors.ModelTimeout

    for quota, error, n in ((False, errors.ModelTimeout, 3), (True, errors.QuotaExceeded, 1)):
        calls.clear()
        with pytest.raises(error):
            adapters.with_retries(flaky, 3, 2.0, waited.append)(quota)
        assert len(calls) == n
    assert waited == [2.0, 4.0] and len(errors.CODES) == 8


def test_broken_archives_and_workbooks(spark):
    good, empty = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(good, "w") as z:
        z.writestr("x/a.pdf", b"pdf")
        z.writestr("b.txt", b"no")
        z.writestr("c.pdf", b"")
    with zipfile.ZipFile(empty, "w") as z:
        z.writestr("b.txt", b"no")
    df = spark.createDataFrame([("g", good.getvalue()), ("e", empty.getvalue()), ("broken", b"PK nothing"), ("null", None)], "path string, content binary")
    got = sorted((r.path, r.member, r.error_code) for r in files.zip_members(df).collect())
    assert got == [("broken", None, "unsupported_format"), ("e", None, "unsupported_format"), ("g", "x/a.pdf", None), ("null", None, "unsupported_format")]
    assert files.workbook_cells(df.where("path = 'broken'")).count() == 0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id int, term string")
    path = (tmp_path / "terms").as_uri()
    sinks.append(df, path)
    sinks.append(df, path)
    assert spark.read.parquet(path).count() == 2
    registry = (tmp_path / "registry").as_uri()
    sinks.replace(df, registry)
    sinks.replace(df.unionByName(df), registry)
    assert spark.read.json(registry).count() == 2
    sinks.backup(spark, registry, (tmp_path / "copy").as_uri())
    assert spark.read.json((tmp_path / "copy").as_uri()).count() == 2
    with pytest.raises(FileExistsError):
        sinks.backup(spark, registry, (tmp_path / "copy").as_uri())
    sinks.write_log(df.select("term"), (tmp_path / "log").as_uri())
    assert [r.value for r in spark.read.text((tmp_path / "log").as_uri()).collect()] == ["a"]
    sheets = sinks.document_sheets("bank_statement", df, df, df, {"t": df})
    assert list(sheets) == ["Document Summary", "Transactions", "Table 1", "Validation Report"]
    content = spark.createDataFrame([("b", sinks.workbook(sheets))], "path string, content binary")
    assert files.workbook_cells(content).where("value = 'a'").count() == 4


def test_settings(spark):
    assert Settings.of(spark).ocr_start_page == 1
    spark.conf.set("spark.finquill.provider", "remote")
    spark.conf.set("spark.finquill.remote.max_retries", "5")
    try:
        assert Settings.of(spark).max_retries == 5 and Settings.of(spark).provider == "remote"
    finally:
        spark.conf.unset("spark.finquill.provider")
    with pytest.raises(ValueError):
        Settings(ocr_start_page=0)


def test_command_line(spark, tmp_path):
    paths = [str(tmp_path / n) for n in ("pages", "terms", "out", "st", "rep")]
    spark.createDataFrame([(1, 1, "Net Sales 1,200.50 1,100.00\nDate : 1 2"), (1, 2, "Share Capital 10.00"), (2, 1, None)], "doc int, page int, text string").write.parquet(paths[0])
    spark.createDataFrame([("Sales", "net sales"), ("Capital", "share capital"), ("Loans", "borrowings")], "field string, term string").write.parquet(paths[1])
    cli.main(["extract", *paths[:3]], spark)
    got = {(r.doc, r.field): (r.current, r.previous) for r in spark.read.parquet(paths[2]).collect()}
    assert got == {(1, "Sales"): (1200.5, 1100.0), (1, "Capital"): (10.0, None), (1, "Loans"): (None, None)}


def test_null_and_empty_inputs(spark):
    one = spark.createDataFrame([(None,), ("",)], "t string")
    row = one.select(F.array_join(pages.page_types(F.col("t")), "|").alias("a"), pages.statement_type(pages.page_types(F.col("t")), F.col("t")).alias("b"), F.size(pages.years_in(F.col("t"))).alias("c"), pages.year_of_filename(F.col("t"))[0].alias("d"), extract.strict_amount(F.col("t")).alias("e"), pages.is_prose_skipped(F.col("t")).alias("f")).collect()
    assert [tuple(r) for r in row] == [("Other", "Balance Sheet", 0, None, None, True)] * 2
    cells = spark.createDataFrame([(1, 0, 0, None), (1, 0, 1, "2025"), (1, 3, 0, "Label"), (1, 3, 1, "5")], "doc int, row_no int, col_no int, text string")
    roles = tables.column_roles(cells, ["doc"], F.lit(2025), F.lit(2024))
    assert roles.collect()[0].asDict() == {"doc": 1, "current_col": 1, "previous_col": -1, "label_col": 0, "note_col": -1}
    assert tables.column_roles(cells.limit(0), ["doc"], F.lit(2025), F.lit(2024)).count() == 0
    flat = spark.createDataFrame([(1, 0, 0, 7)], "img int, y int, x int, v int")
    assert validate.laplacian(flat).collect()[0].score == 0.0 and validate.laplacian(flat.limit(0)).count() == 0
    assert extract.hints(spark.createDataFrame([], "doc int, pos long, page int, label string, current_value string, previous_value string"), spark.createDataFrame([("a", "b")], "field string, term string")).count() == 0
    assert documents.resolve_model(spark.createDataFrame([("m",)], "asked string"), spark.createDataFrame([], "ord int, model string")).count() == 0
    assert {s for s, _, _ in cascade.ROWS} == {"operating", "liabilities", "assets", "key_metrics", "working_capital", "fund_flow", "break_even", "dscr", "ratios", "indicators"}


def test_blur_of_sharp_and_mixed_pages(spark):
    rows = [(i, y, x, 128 if i == 0 else 255 * ((x + y) % 2)) for i in (0, 1) for y in range(8) for x in range(8)]
    scores = validate.laplacian(spark.createDataFrame(rows, "img int, y int, x int, v int"))
    got = {r.img: r.score for r in scores.collect()}
    assert got[0] == 0.0 and got[1] > 15.0
    assert [r.blurry for r in validate.blurry(scores.withColumn("doc", F.lit(1)), ["doc"]).collect()] == [False]
