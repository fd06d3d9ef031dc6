"""Candidates of whole pages, containment joins, and results written between steps."""

import random

from pyspark.sql import functions as F

from finquill import cli
from finquill.functions.markup import grid, known_labels, markdown_to_html
from finquill.operators import candidates, extraction
from finquill.operators.containment import both_ways, containing
from finquill.sources import steps

PAGES = [
    (1, 1, "Balance Sheet as at March 31, 2024 of it\nEquity and liabilities, current assets\n| Particulars | 31 March 2024 | 31 March 2023 | Note |\n|---|---|---|---|\n| Trade Payables | 1,234.50 | 999.00 | 4 |\n"
     "| Share Capital | (5.00) | - | 2 |\nCurrent liabilities\nOther payables due 12.50 11.00\nCash in hand 7.00\nDate: 12.00 13.00"),
    (1, 2, "Independent auditor's report of nothing\nSome label 1.00 2.00"),
    (2, 1, "<p>Statement of Profit and Loss, profit before tax</p> Note 7 - x\n<table><tr><th>Particulars</th><th>2022</th><th>2021</th></tr>"
     "<tr><td>Share Capital Reserves and Surplus Trade Payables Other Income Finance Costs Total Income</td><td></td><td></td></tr>"
     "<tr><td></td><td>1.00 2.00</td><td>3.00 4.00</td></tr><tr><td></td><td>5.00</td><td>6.00</td></tr><tr><td rowspan=2>x</td><td>8.0</td></tr></table>"),
    (2, 2, "Balance Sheet and total assets\n<table><tr><td rowspan='many'>a</td></tr></table><table></table>"),
    (3, 1, None),
    (3, 2, ""),
]


def _pages(spark):
    return spark.createDataFrame(PAGES, "doc int, page int, text string")


def test_candidates_of_pages(spark):
    got = {(r.doc, r.page, r.kind, r.row_no, r.item_no): r for r in candidates.page_candidates(_pages(spark)).collect()}
    seen = {k: (r.label, r.current_value, r.previous_value, r.note_number) for k, r in got.items()}
    assert seen == {
        (1, 1, "table", 1, 0): ("Trade Payables", "1,234.50", "999.00", ""),
        (1, 1, "table", 2, 0): ("Share Capital", "(5.00)", "-", ""),
        (1, 1, "line", 4, 0): ("Other payables due", "12.50", "11.00", ""),
        (1, 1, "line", 5, 0): ("Cash in hand", "7.00", None, ""),
        # labels of one cell go to the rows below it, as many as a row has values
        (2, 1, "table", 2, 0): ("Share Capital", "1.00", "3.00", "7"),
        (2, 1, "table", 2, 1): ("Reserves and Surplus", "2.00", "4.00", "7"),
        (2, 1, "table", 3, 0): ("Trade Payables", "5.00", "6.00", "7"),
        (2, 1, "table", 4, 0): ("Other Income", "8.0", None, "7"),
    }
    assert got[1, 1, "line", 4, 0].context_path == "Balance Sheet > Current Liabilities > Other payables due"
    meta = {r.doc: (r.current_fy, r.previous_fy, r.pages_processed, r.pages_rejected) for r in candidates.document_metadata(_pages(spark)).collect()}
    assert meta == {1: ("2023-24", "2022-23", 2, 1), 2: ("unknown", "unknown", 2, 0), 3: ("unknown", "unknown", 2, 0)}


def test_no_pages(spark):
    none = _pages(spark).limit(0)
    assert candidates.page_candidates(none).count() == 0 and candidates.document_metadata(none).count() == 0


def test_fields_of_documents(spark):
    terms = spark.createDataFrame([("payables", "trade payables"), ("cash", "cash at bank"), ("capital", "share capital")], "field string, term string")
    learned = spark.createDataFrame([("cash", "cash in hand"), ("payables", "other payables")], "field string, term string")
    fields = extraction.document_fields(_pages(spark), terms, terms, learned)
    got = {(r.doc, r.field): (r.current, r.previous, r.from_second) for r in fields.collect()}
    assert got[1, "payables"] == (1234.5, 999.0, False) and got[1, "cash"] == (7.0, None, True) and got[2, "capital"] == (1.0, 3.0, False)
    assert got[3, "cash"] == (None, None, False) and len(got) == 9
    rows = {r.doc: (r.pages_rejected, r.found, r.total, r.coverage) for r in extraction.document_summary(_pages(spark), fields).collect()}
    assert rows == {1: (1, 3, 3, 100.0), 2: (0, 2, 3, 66.7), 3: (0, 0, 3, 0.0)}
    assert steps.clear(spark) == 1 and steps.clear(spark) == 0


def test_document_command(spark, tmp_path):
    pages, terms, out = (str(tmp_path / n) for n in ("pages", "terms", "out"))
    _pages(spark).write.parquet(pages)
    spark.createDataFrame([("payables", "trade payables")], "field string, term string").write.parquet(terms)
    cli.main(["document", pages, terms, out], spark)
    assert {r.doc: r.current for r in spark.read.parquet(out).collect()} == {1: 1234.5, 2: 5.0, 3: None}
    assert {r.doc: r.coverage for r in spark.read.parquet(f"{out}-summary").collect()} == {1: 100.0, 2: 100.0, 3: 0.0}


def test_markup():
    texts, inherited = grid("<table><tr><td rowspan=2>a</td><td colspan=2>b\nc</td></tr><tr><td>d</td></tr></table>")
    assert texts == [["a", "b c", "b c"], ["a", "d"]] and inherited == [[False] * 3, [True, False]]
    assert markdown_to_html("x\n|a|b|\n|--|--|\n|1|2|\ny") == "x\n<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>\ny"
    assert known_labels("other long-term liabilities and TRADE payables") == ["Other Long-Term Liabilities", "Trade Payables"] and known_labels(None) == []


def test_containment_against_all_pairs(spark):
    r = random.Random(1)

    def word(n):
        return "".join(r.choice("abcé ") for _ in range(n))

    texts = [(i, word(r.randint(0, 14))) for i in range(150)] + [(900, None), (901, ""), (None, "abcab"), (1, "abc abc")]
    terms = [(word(r.randint(0, 5)),) for _ in range(100)] + [(None,), ("",), ("abc",), ("abc",)]
    a, b = spark.createDataFrame(texts, "id int, __needle string"), spark.createDataFrame(terms, "term string")
    found = containing(a, ["id"], "__needle", b, "term")
    got = [tuple(x) for x in found.collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, t) for i, x in texts for (t,) in terms if None not in (x, t) and t in x}
    pairs = both_ways(a, "__needle", b, "term")
    assert {tuple(x) for x in pairs.collect()} == {(x, t) for _, x in texts for (t,) in terms if None not in (x, t) and (t in x or x in t)}
    assert "NestedLoop" not in pairs._jdf.queryExecution().toString()
    assert containing(a.limit(0), ["id"], "__needle", b, "term").count() == 0
    assert containing(a.where(F.length("__needle") > 0), ["id"], "__needle", b.limit(0), "term").count() == 0


def test_pages_are_parsed_once(spark):
    # all paths read what one parse wrote; before, each of them parsed the pages again
    for got in (candidates.page_candidates(_pages(spark)), candidates.document_metadata(_pages(spark), candidates.parsed(_pages(spark)))):
        assert "MapInArrow" not in got._jdf.queryExecution().optimizedPlan().toString()
    meta = {tuple(r) for r in got.collect()}
    assert meta == {tuple(r) for r in candidates.document_metadata(_pages(spark)).collect()}
    steps.clear(spark)


def test_bare_tables_have_the_grid_of_the_parser(monkeypatch):
    from finquill.functions import markup

    rng = random.Random(3)
    cells = ["a", " b\n c ", "", "1,2 ", "&amp;", "x<br>y", "é", "\t"]
    for _ in range(300):
        rows = ["".join(f"<{t}>{rng.choice(cells)}</{rng.choice((t, 'td'))}>" for t in rng.choices(("td", "th"), k=rng.randint(0, 3))) for _ in range(rng.randint(0, 4))]
        html = f"<table>{''.join(f'<tr>{r}</tr>' for r in rows)}</table>"
        quick = grid(html)
        with monkeypatch.context() as m:
            m.setattr(markup, "_BARE", markup.re.compile("(?!)"))
            assert quick == grid(html)


def test_types_by_hits_are_those_by_text(spark):
    from finquill.operators.pages import AUDIT_PAGES, NOTE_PHRASES, PAGE_TYPES, page_types, statement_type
    from finquill.operators.text import is_rejected_page

    rng = random.Random(4)
    words = [w.title() for x in PAGE_TYPES.values() for w in x] + AUDIT_PAGES[:1] + NOTE_PHRASES * 9 + ["revenue from operations", "independent auditor", "plain"]
    rows = [(k, 0, " ".join(rng.sample(words, rng.randint(0, 4)))) for k in range(300)]
    pages = spark.createDataFrame(rows, "doc int, page int, text string")
    types, first = page_types(F.col("text")), F.get(page_types(F.col("text")), 0)
    want = F.when(first.isin("Balance Sheet", "Statement of Profit and Loss", "Cash Flow Statement"), first).when(first == "Notes to Accounts", statement_type(types, F.col("text"))).otherwise("Other")
    expected = {r.doc: (r.r, r.s) for r in pages.select("doc", is_rejected_page(F.col("text")).alias("r"), want.alias("s")).collect()}
    assert {r.doc: (r.rejected, r.source_statement) for r in candidates.parse(pages).collect()} == expected


def test_fields_are_found_without_sorting_documents(spark):
    terms = spark.createDataFrame([("payables", "trade payables")], "field string, term string")
    learned = spark.createDataFrame([("cash", "cash in hand")], "field string, term string")
    catalogue = spark.createDataFrame([("payables",), ("cash",), ("other",)], "field string")
    pages = _pages(spark).withColumn("doc", F.when(F.col("doc") > 1, F.col("doc")))
    fields = extraction.document_fields(pages, terms, catalogue, learned)
    plan = fields._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("candidates-") <= 1
    got = {(r.doc, r.field): (r.current, r.previous, r.from_second) for r in fields.collect()}
    # null documents are one document, in the second pass too
    assert got[None, "payables"] == (1234.5, 999.0, False) and got[None, "cash"] == (7.0, None, True) and got[None, "other"] == (None, None, False) and len(got) == 9
    steps.clear(spark)


def test_repeated_pages_give_repeated_rows(spark):
    once = [tuple(r) for r in candidates.page_candidates(_pages(spark)).collect()]
    twice = [tuple(r) for r in candidates.page_candidates(_pages(spark).unionAll(_pages(spark))).collect()]
    assert sorted(map(str, once * 2)) == sorted(map(str, twice))
    steps.clear(spark)


def test_facts_are_those_of_the_expressions(spark):
    from finquill.functions.scalars import numeric_tokens
    from finquill.operators import page_facts
    from finquill.operators.pages import is_prose_skipped, section_of, years_in

    rng = random.Random(5)
    some = ["(1,234.50)", "-", "–5", "12", "1234", "5%", "Note 3", "note no. 12", "nil", "a", "7.5.", "1,", "(3", "", " ", "é", "٣", "x-1", "12 of 40"]
    cells = [(k, " ".join(rng.choices(some, k=rng.randint(1, 3)))) for k in range(300)]
    for r in spark.createDataFrame(cells, "k int, c string").withColumn("v", numeric_tokens(F.col("c"))).collect():
        note, blank = page_facts._NOTE_CELL.fullmatch(r.c), r.c.strip(" ") in page_facts.EMPTY_CELLS
        assert page_facts.amounts_of(r.c) == ("" if note or blank else " ".join(r.v)), r.c
    parts = ["Year ended March 31, 2024", "31st mar 2023", "for the year ended on 2009 or 2019", "non-current assets", "Other income", "page 3", "Place: x", "short", "director", "operating  activities", "nothing here", "1,200.50", "(3)", "current liabilities"]
    lines = [(k, " ".join(rng.choices(parts, k=rng.randint(1, 3)))) for k in range(300)]
    made = spark.createDataFrame(lines, "k int, c string").select("k", "c", years_in(F.col("c")).alias("y"), (~is_prose_skipped(F.col("c"))).alias("kept"), section_of(F.col("c")).alias("s")).orderBy("k").collect()
    section, want = None, []
    for r in made:
        assert page_facts.years_of(r.c.lower()) == r.y
        section = r.s if r.kept and r.s else section
        if r.kept and r.c[-1] in "0123456789.,)-":
            want.append((r.k, r.c, section))
    assert want and page_facts.prose_lines(lines) == want
