"""The blueprint's fixtures on single operators."""

import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from finquill.functions import procedural, scalars
from finquill.operators import derive, merge, quality, registry, report, sequence, text
from finquill.sources import files, sinks


def one(df, column):
    return [r[0] for r in df.select(column).collect()]


def test_merge_prefers_known_primary_confident_first(spark):
    rows = [("f", "2023-24", 1.0, 0.99, 1, False), ("f", "2023-24", 2.0, 0.5, 2, True), ("f", "2023-24", 3.0, 0.5, 3, True), ("f", "unknown", 4.0, 0.9, 4, True), ("g", "2023-24", None, 0.9, 1, True)]
    df = spark.createDataFrame(rows, "field string, fy string, value double, confidence double, doc_ord int, is_primary boolean")
    assert [(r.field, r.value) for r in merge.best_of_documents(df, ["field", "fy"]).collect()] == [("f", 2.0)]


def test_chunk_merge_never_takes_zero_confidence(spark):
    df = spark.createDataFrame([("a", 1.0, 0.0, 0), ("b", 2.0, 0.5, 1), ("b", 3.0, 0.5, 0)], "field string, value double, confidence double, chunk_ord int")
    assert [(r.field, r.value) for r in merge.best_of_chunks(df, ["field"]).collect()] == [("b", 3.0)]


def test_labels_and_unmapped(spark):
    items = spark.createDataFrame([("Custom Item A", 1), ("custom item a", 2), ("Net Sales", 3), (" ", 4)], "label string, doc int")
    assert sorted(one(merge.first_of_labels(items, [], ["doc"]), "doc")) == [1, 3]
    terms = spark.createDataFrame([("net sales",), ("abc",)], "term string")
    assert sorted(one(merge.unmapped(items, terms), "doc")) == [1, 2]


def test_derived_levels(spark):
    base = dict.fromkeys("capital reserves pat dep pbt interest net_sales cost_of_sales receivables intangibles current_assets current_liabilities term_liabilities total_assets creditors other_cl variable_cost fixed_cost dividend net_worth".split(), 10.0)
    base |= {"net_worth": None, "dividend": None, "net_sales": 0.0}
    df = spark.createDataFrame([tuple(base.values())], ", ".join(f"{k} double" for k in base))
    r = derive.derive(df).collect()[0]
    assert (r.net_worth, r.cash_accruals, r.retained_profit, r.pbdit, r.gross_margin, r.current_ratio) == (20.0, 20.0, 10.0, 30.0, None, 1.0)


def test_projection(spark):
    df = spark.createDataFrame([("a", 100.0, 110.0, 121.0), ("b", None, None, 50.0), ("c", 10.0, 100.0, 1000.0)], "company string, v1 double, v2 double, v3 double")
    got = {r.company: (round(r.growth, 4), r.p1) for r in report.project(df).collect()}
    assert got == {"a": (0.1, 133.1), "b": (0.1, 55.0), "c": (0.5, 1500.0)}
    assert {r.company: r.p2 for r in report.project_declining(df).collect()} == {"a": 121.0, "b": 50.0, "c": 1000.0}


def test_identity_and_profit(spark):
    df = spark.createDataFrame([("ok", "y", 1000.0, 300.0, 400.0, 300.0), ("bad", "y", 1000.0, 400.0, 400.0, 300.0)], "company string, fy string, total_assets double, current_liabilities double, term_liabilities double, net_worth double")
    assert {r.company: r.severity for r in quality.accounting_identity(df).collect()} == {"ok": "passed", "bad": "high"}


@pytest.mark.parametrize(("balances", "wrong"), [((100, 150, 130), 0), ((100, 140, 120), 1), ((130, 150, 100), 0)])
def test_balance_progression(spark, balances, wrong):
    moves = {(100, 150, 130): ((100, 0), (50, 0), (0, 20)), (100, 140, 120): ((100, 0), (50, 0), (0, 20)), (130, 150, 100): ((0, 20), (50, 0), (100, 0))}[balances]
    rows = [(1, i, b * 100, c * 100, d * 100) for i, (b, (c, d)) in enumerate(zip(balances, moves, strict=True), 1)]
    df = spark.createDataFrame(rows, "account int, idx int, balance bigint, credit bigint, debit bigint")
    assert quality.balance_progression(df, "account").count() == wrong


def test_repeats_and_confidence(spark):
    df = spark.createDataFrame([(1, "coffee", None), (2, "coffee", None), (3, "tea", 1.0)], "idx int, what string, debit double")
    assert one(quality.repeated_rows(df, ["what", "debit"], ["idx"]), "idx") == [2]


def test_islands_continuations_and_as_of(spark):
    rows = spark.createDataFrame([(1, 0, 5), (1, 1, 8), (1, 2, 40)], "k int, o int, top int")
    assert [r.row_group for r in sequence.islands(rows, ["k"], ["o"], "top", 10).orderBy("o").collect()] == [0, 0, 1]
    rows = spark.createDataFrame([(1, i, c) for i, c in enumerate("abbbab")], "k int, o int, c string")
    got = sequence.merge_continuations(rows, ["k"], ["o"], F.col("c") == "b").orderBy("o").collect()
    assert [r.consumed for r in got] == [False, True, False, True, False, True]
    left = spark.createDataFrame([(1, 5, "x"), (1, 1, "y"), (2, 5, "z")], "k int, at int, id string")
    right = spark.createDataFrame([(1, 2, "n1"), (1, 5, "n2")], "k int, at int, note string")
    assert {r.id: r.last_note for r in sequence.as_of(left, right, ["k"], "at", "note").collect()} == {"x": "n2", "y": None, "z": None}


@pytest.mark.parametrize(("low", "high", "kept"), [(3, 5, [3, 4, 5]), (3, None, [3, 4, 5, 6]), (50, 60, [1, 2, 3, 4, 5, 6])])
def test_trim(spark, low, high, kept):
    rows = spark.createDataFrame([(1, p) for p in range(1, 7)], "doc int, page int")
    got = sequence.trim_range(rows, ["doc"], "page", F.lit(low), F.lit(high).cast("int"))
    assert sorted(one(got, "page")) == kept


def test_texts(spark):
    docs = spark.createDataFrame([(1, "x" * 6000), (2, "x" * 6001), (3, "")], "doc_id int, text string")
    assert sorted((r.doc_id, r.chunk_idx, len(r.chunk)) for r in text.chunks(docs).collect()) == [(1, 0, 6000), (2, 0, 6000), (2, 1, 1501), (3, 0, 0)]
    rows = spark.createDataFrame([(1, i) for i in range(20)], "doc int, idx int")
    assert sorted(one(text.spread(rows, ["doc"], "idx", F.lit(20), 5), "idx")) == [0, 4, 8, 12, 16]
    assert sorted(one(text.spread(rows.where("idx < 3"), ["doc"], "idx", F.lit(3), 8), "idx")) == [0, 1, 2]
    kind, confidence = text.document_kind(F.col("t"))
    df = spark.createDataFrame([("Tax Invoice GSTIN 1",), ("hello",)], "t string")
    assert [tuple(r) for r in df.select(kind, confidence).collect()] == [("invoice", 0.85), ("unknown", 0.2)]


@pytest.mark.parametrize(("text_", "ok"), [("2026-06-08", True), ("08/06/2026", True), ("08-06-2026", True), ("Jun 08, 2026", True), ("08 Jun 2026", True), ("not-a-date", False), ("2026-13-45", False), ("", False)])
def test_dates(spark, text_, ok):
    assert spark.range(1).select(scalars.is_date(F.lit(text_))).collect()[0][0] is ok


def test_scalars(spark):
    def of(c):
        return spark.range(1).select(c).collect()[0][0]

    assert [of(scalars.parse_amount(F.lit(x))) for x in ("₹1,000.00", "(1,234.5)", "12d", "nan", "-3")] == [1000.0, -1234.5, None, None, -3.0]
    assert of(scalars.slugify(F.lit(" Café  & Co_Ltd "))) == "café-co-ltd"
    assert of(scalars.slugify(F.lit("!!"))) == "unknown-company"
    assert of(scalars.fy_label(F.lit(dt.datetime(2024, 3, 31)))) == "2023-24"
    assert [of(scalars.is_currency(F.lit(x))) for x in ("INR", "₹", "XYZ12", "123")] == [True, True, False, False]
    assert of(scalars.candidate_term(F.lit("Freight & Handling Income | 45,230.18 [page 3]"))) == "freight & handling income"


@pytest.mark.parametrize(("raw", "want"), [('{"a": 1, "b": {"c": 2', '{"a": 1, "b": {"c": 2}}'), ('{"value": 1,234.5}', '{"value": 1234.5}'), ('x {"a": "b, c"}', '{"a": "b, c"}'), ("no", None), (None, None)])
def test_json_repair(raw, want):
    assert procedural.repaired(raw) == want


def test_registry(spark):
    jobs = spark.createDataFrame([(1, "c", "done", ["b", "a"]), (2, "c", "running", ["x"]), (3, "d", "failed", ["a", "b"])], "job_id int, company string, status string, doc_ids array<string>")
    assert [tuple(r) for r in registry.reusable(jobs, "company", ["a", "b"]).collect()] == [("c", 1)]


def test_files_and_workbook(spark, tmp_path):
    (tmp_path / "in").mkdir()
    with zipfile.ZipFile(tmp_path / "in" / "a.ZIP", "w") as z:
        z.writestr("x.pdf", b"1")
        z.writestr("y.txt", b"1")
        z.writestr("empty.pdf", b"")
    (tmp_path / "in" / "b.doc").write_bytes(b"1")
    found = files.uploads(spark, str(tmp_path / "in"))
    assert sorted((r.path.rsplit("/", 1)[1], r.error_code) for r in found.collect()) == [("a.ZIP", None), ("b.doc", "unsupported_format")]
    zips = spark.read.format("binaryFile").load(str(tmp_path / "in" / "a.ZIP"))
    assert one(files.zip_members(zips), "member") == ["x.pdf"]
    book = sinks.workbook({"Report": spark.createDataFrame([("a<b", 1.5, "=B2*2")], "label string, value double, formula string")})
    assert zipfile.is_zipfile(io.BytesIO(book))
    assert ("sheet1", "B2", "1.5", None) in files.cells_of(book) and ("sheet1", "C2", None, "B2*2") in files.cells_of(book)
    pages = files.page_texts(spark.createDataFrame([("d", "\n=== Page 1 ===\nA\n=== Page 2 ===\nB")], "doc_id string, text string"))
    assert [(r.page, r.text) for r in pages.orderBy("page").collect()] == [(1, "A"), (2, "B")]


def test_stream_of_uploads(spark, tmp_path):
    from finquill.streaming.uploads import new_uploads, run_available

    (tmp_path / "up").mkdir()
    line = '{"company_slug": "%s", "doc_id": "%s", "sha256": "s", "uploaded_at": "2026-01-01T00:00:00Z"}\n'
    (tmp_path / "up" / "1.json").write_text(line % ("A ", "1") + line % ("a", "2") + line % ("b", "3"))
    seen = []
    run_available(new_uploads(spark, str(tmp_path / "up")), str(tmp_path / "cp"), lambda df, _: seen.extend(r.company_slug for r in df.collect()))
    assert sorted(seen) == ["a", "b"]
