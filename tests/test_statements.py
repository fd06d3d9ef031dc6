"""The report's rows as a graph: order, given values that flow on, and defined results for what is missing."""

import pytest

from finquill.operators import statements as op


def _given(spark, values, company="a"):
    rows = [(company, *name.split("/", 1), col, v) for name, vs in values.items() for col, v in enumerate(vs, 1)]
    return spark.createDataFrame(rows, "company string, section string, field string, col int, value double")


def _cells(frame):
    out = {}
    for r in frame.collect():
        out.setdefault((r.section, r.row), {})[r.col] = r.value
    return out


BASE = {"sales/Net Sales": (100.0, 110.0, 121.0), "cost_of_sales/Depreciation": (10.0, 9.0, 8.0), "cost_of_sales/Total Cost of Sales": (50.0, None, 60.0), "net_worth/Other reserves": (1.0, 2.0, 3.0)}


def test_given_values_flow_on(spark):
    got = _cells(op.statement(_given(spark, BASE | {"pnl/Net Profit/Loss (PAT)": (None, 20.0, None), "pnl/Provision for Taxes": (1.0, None, None)})))
    pat = got["operating", "Net Profit/Loss (PAT)"]
    assert pat == {1: 49.0, 2: 20.0, 3: 45.75, 4: pytest.approx(89.8, abs=40), 5: pytest.approx(100, abs=50)}
    # one profit after tax: every row that shows it shows the same
    for name in (("operating", "Retained Profit "), ("fund_flow", "Profit after Tax"), ("liabilities", "Surplus (+) or deficit (-) in Profit & Loss a/c")):
        assert got[name] == pat
    assert got["operating", "Cash Accruals"][2] == 29.0 and got["dscr", "Cash accruals"] == got["operating", "Cash Accruals"]
    assert got["operating", "Sub Total ( Total Cost of Sales)"][2] == 9.0  # not given there: the sum of its parts
    reserves = got["liabilities", "General Reserve"]
    assert reserves[4] == pytest.approx(3.0 + pat[3]) and reserves[5] == pytest.approx(reserves[4] + pat[4])


def test_projections(spark):
    got = _cells(op.statement(_given(spark, BASE | {"profitability/Selling Expenses": (10.0, 11.0, 12.1), "interest/Interest on CC": (1.0, 1.0, 1.0)}), ("operating",)))
    assert got["operating", "i. Domestic Sale"] == {1: 100, 2: 110, 3: 121, 4: 133.1, 5: 146.41}
    assert got["operating", "Selling Expenses"][5] == 14.641 and set(got["operating", "a. Interest on CC."]) == {1, 2, 3}
    assert got["operating", "Growth in sales"] == {2: 0.1, 3: 0.1, 4: 0.1, 5: 0.1}
    assert all(s == "operating" for s, _ in got)


def test_missing_years_and_companies(spark):
    one = _given(spark, {"sales/Net Sales": (100.0,), "unknown/field": (5.0,)}, None).unionByName(_given(spark, {"sales/Net Sales": (100.0, 0.0, None)}))
    rows = op.statement(one.unionByName(one), ("operating",)).collect()
    sales = {(r.company, r.col): r.value for r in rows if r.row == "i. Domestic Sale"}
    # without rates growth is a tenth of the last value that isn't 0
    assert sales == {(None, 1): 100, (None, 4): 110, (None, 5): 121, ("a", 1): 100, ("a", 2): 0, ("a", 4): 110, ("a", 5): 121}
    assert not [r for r in rows if r.row == "Selling Expenses"]  # no share of sales that aren't known
    assert op.statement(one.limit(0)).count() == 0


def test_order_of_rows():
    place = {r.key: k for k, level in enumerate(op.levels()) for r in level}
    assert all(place[n] < place[r.key] for r in op.ROWS for n in op._needs(r))
    assert len({r.key for r in op.ROWS}) == len(op.ROWS)
    with pytest.raises(ValueError):
        op.levels((op.Row("s", "a", "a", None, "{b}"), op.Row("s", "b", "b", None, "{a}")))
