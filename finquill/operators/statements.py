"""The statements of the report, row by row, as a graph in which a given value wins and flows on.

A row has a name of its own, the field that may give its value, a rule for the two projected
columns, and a formula over other rows.  In each of the five columns (three audited years, two
projected ones) the value is the given one, else the projected one, else what the formula makes of the rows it names,
whichever of these were given or computed.  So there is one profit after tax, and every later row reads it.

``statement`` orders the rows by what they name and computes a level of them at a time, in
one row a company with an array of five values per row of the report: no joins and no loop over
companies.  Rows without any value are left out, and so are single values that are null.

Values of fields come as (company, section, field, col, value), col from 1; a field that is given twice counts with its
greatest value; null companies are one company; unknown fields are ignored.  Numbers are rounded half away from zero.
"""

from __future__ import annotations

import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finquill.operators.report import average_growth

COLUMNS = 5
_NAME = re.compile(r"\{(\w+)([!<]?)\}")


class Row(NamedTuple):
    section: str
    key: str
    label: str
    field: str | None = None  # section/field of the catalogue that gives the value
    formula: str | None = None  # {x}: a row, null as 0; {x!}: null stays null; {x<}: the column before
    projection: str | None = None  # growth, decline, sales, none, or sum:row (last column plus that row)
    digits: int = 4


def _plain(section: str, labels: dict[str, str]) -> list[Row]:
    """Rows that have a value only if the document gives one under their own name."""
    return [Row(section, key, label, f"{section}/{label.strip()}") for key, label in labels.items()]


def _sum(*keys: str) -> str:
    return " + ".join(f"{{{k}}}" for k in keys)


def _share(a: str, b: str) -> str:
    return f"try_divide({{{a}!}}, nullif({{{b}}}, 0))"


# The report's rows in order, with their labels and the catalogue's fields.
OPERATING = [
    Row("operating", "sale", "i. Domestic Sale", "sales/Net Sales", projection="growth"),
    Row("operating", "export", "ii.Export Sale", "sales/Export Sale"),
    Row("operating", "gross", "Total Gross Sales", None, "coalesce(nullif({sale!}, 0), nullif({gross_given!}, 0), 0)"),
    Row("operating", "net_other", "Net Other Income", "other_income_expenses/Net of other non operating Income/Expenses", projection="none"),
    Row("operating", "income", "Total Income", None, _sum("gross", "net_other")),
    Row("operating", "growth", "Growth in sales", None, None, "mean_growth", 6),
    Row("operating", "freight", "a. Freight & Handling Expenses", "cost_of_sales/Freight & Handling Expenses", projection="sales"),
    Row("operating", "vehicle", "b. Vehicle Running expenses", "cost_of_sales/Vehicle Running Expenses", projection="sales"),
    *_plain("operating", {"spares_imported": "c. Stores & Spares (Imported)", "spares": "d. Stores & Spares (Indigenous)", "power": "Power & Fuel", "labour": "Direct Labour", "repairs": "Repairs and maintainance", "other_mfg": "Other Mfg. Expenses"}),
    Row("operating", "dep", "Depreciation ", "cost_of_sales/Depreciation", projection="decline"),
    Row("operating", "others", "Others expenses", None, "0.0"),
    *_plain("operating", {"insurance": "Insurance", "transport": "Transport Expenses"}),
    Row("operating", "cos", "Sub Total", "cost_of_sales/Total Cost of Sales", _sum("freight", "vehicle", "dep")),
    Row("operating", "cos_2", "Sub Total", None, "{cos!}"),
    *_plain("operating", {"opening_process": "Add: Opening Stock in Process"}),
    Row("operating", "cos_3", "Sub Total", None, "{cos!}"),
    *_plain("operating", {"closing_process": "Deduct : Closing Stock in Process"}),
    Row("operating", "production", "Cost of Production ", None, "{cos!}"),
    *_plain("operating", {"opening_finished": "Add: Opening Stock of Finished Goods"}),
    Row("operating", "cos_4", "Sub Total", None, "{cos!}"),
    *_plain("operating", {"closing_finished": "Deduct : Closing Stock OF Finished Goods"}),
    Row("operating", "cos_total", "Sub Total ( Total Cost of Sales)", None, "{cos!}"),
    Row("operating", "gross_profit", "Gross profit", "profitability/Gross profit", "{income} - {cos_total}"),
    Row("operating", "gross_share", "Gross Profit/ Sales", None, _share("gross_profit", "income"), digits=6),
    Row("operating", "selling", "Selling Expenses", "profitability/Selling Expenses", projection="sales"),
    Row("operating", "admin", "Administrative Expenses", "profitability/Administrative Expenses", projection="sales"),
    Row("operating", "cost", "Sub Total ", None, _sum("cos_total", "selling", "admin")),
    Row("operating", "op_before", "Operating Profit before interest ", "profitability/Operating Profit before interest", "{income} - {cost}"),
    Row("operating", "int_cc", "a. Interest on CC.", "interest/Interest on CC", projection="none"),
    Row("operating", "int_tl", "b.Interest on TL ", "interest/Interest on TL", projection="decline"),
    Row("operating", "int_other", "c.Other interests ", "interest/Other interests", projection="none"),
    Row("operating", "interest", "Total Interest", "interest/Total Interest", _sum("int_cc", "int_tl", "int_other")),
    Row("operating", "op_after", "Operating Profit after Interest", "profitability/Operating Profit after interest", "{op_before} - {interest}"),
    Row("operating", "dividends_got", "Interest/Dividend/Royalties etc..", "other_income_expenses/Interest/Dividend/Royalties", projection="none"),
    Row("operating", "other_income", "Other Income", "other_income_expenses/Other Income", projection="none"),
    Row("operating", "non_op", "Sub Total", "other_income_expenses/Net of other non operating Income/Expenses", "nullif({dividends_got} + {other_income}, 0)"),
    *_plain("operating", {"fees": "Processing fees"}),
    Row("operating", "non_op_cost", "Sub Total", None, "nullif({fees}, 0)"),
    Row("operating", "net_non_op", "Net of other non operating Income/Expenses", "other_income_expenses/Net of other non operating Income/Expenses", "{non_op} - {non_op_cost}"),
    Row("operating", "pbt", "Profit before Tax /Loss (PBT)", "pnl/Profit before Tax", "{op_after} + {net_non_op}"),
    Row("operating", "tax", "Provision for Taxes", "pnl/Provision for Taxes", "case when {pbt} > 0 then {pbt} * 0.25 end"),
    Row("operating", "pat", "Net Profit/Loss (PAT)", "pnl/Net Profit/Loss (PAT)", "{pbt!} - {tax}"),
    Row("operating", "accruals", "Cash Accruals", "pnl/Cash Accruals", "{pat!} + {dep}"),
    *_plain("operating", {"dividend": "Dividend paid + IT on Dividend"}),
    Row("operating", "retained", "Retained Profit ", None, "{pat!} - {dividend}"),
    Row("operating", "retained_cash", "Retained Cash Profits", None, "{accruals!} - {dividend}"),
    Row("operating", "rm_content", "RM Content in sales", "pnl/RM Content in sales", "try_divide(nullif({cos_total!}, 0), nullif({income}, 0))", digits=6),
    Row("operating", "pbdit", "PBDIT ", "pnl/PBDIT", _sum("pbt", "interest", "dep")),
    *(Row("operating", f"{k}_share", label, f"pnl/{label.strip()}", _share(k, "income"), digits=6) for k, label in {"pbdit": "PBDIT/Sales", "op_before": "Operating Profits/Sales", "pbt": "PBT/Sales", "pat": "PAT/Sales", "accruals": "Cash Accruals/ Sales"}.items()),
]

LIABILITIES = [
    Row("liabilities", "bank_loans", "Short Term loans from Applicant Bank  ", "current_liabilities/Short Term loans from Applicant Bank"),
    Row("liabilities", "other_banks", "Short Term loans From Other banks ", "current_liabilities/Short Term Borrowings from Others", projection="none"),
    *_plain("liabilities", {"overdraft": "Clean OD"}),
    Row("liabilities", "sub_a", "Sub Total (A)", "current_liabilities/Short Term Borrowings Bank Total", _sum("bank_loans", "other_banks", "overdraft")),
    *_plain("liabilities", {"from_others": "Short Term Borrowings from Others"}),
    Row("liabilities", "creditors", "Sundry Creditors (Trade)", "current_liabilities/Sundry Creditors (Trade)", projection="sales"),
    Row("liabilities", "advances_got", "Advance Payment from Customers", "current_liabilities/Advance Payment from Customers", projection="sales"),
    *_plain("liabilities", {"tax_provision": "Net Provision for Taxation (if positive)", "dividend_payable": "Dividend Payable"}),
    Row("liabilities", "statutory", "Other Statutory Liab. (Due within one Year)", "current_liabilities/Other Statutory Liabilities", projection="none"),
    *_plain("liabilities", {"overdue": "Overdue Term Liabilities"}),
    Row("liabilities", "instalments", "Installments of term Loan/ DPGs/ Deposits/ debentures due within next year", "current_liabilities/Installments of term Loan", projection="decline"),
    Row("liabilities", "other_current", "Other Current Liabilities & Provisions (due with in one year)", "current_liabilities/Other Current Liabilities & Provisions", projection="sales"),
    Row("liabilities", "other_current_b", "Other current Liabilities ", "current_liabilities/Other current Liabilities", projection="none"),
    Row("liabilities", "provisions", "Provision for Others", "current_liabilities/Short Term Provisions", projection="none"),
    Row("liabilities", "sub_b", "Sub Total (B)", "current_liabilities/Other Current Liabilities Sub Total", _sum("creditors", "advances_got", "statutory", "instalments", "other_current")),
    Row("liabilities", "current_total", "TOTAL CURRENT LIABILITIES", "current_liabilities/Total Current Liabilities", _sum("sub_a", "sub_b")),
    *_plain("liabilities", {"debentures": "Debentures (not maturing within one Year)", "preference": "Preference Shares (redeemable after 1 year)"}),
    Row("liabilities", "term_bank", "Term Loan from Bank(Less next Year Instalments)", "term_liabilities/Term Loan from Bank", projection="decline"),
    *_plain("liabilities", {"term_other_banks": "Term Loan from Other Banks/Inst.(Ecl. Instal.due next Yr.)"}),
    Row("liabilities", "term_other", "Other term Liabilities", "term_liabilities/Other Term Liabilities"),
    Row("liabilities", "directors", "Unsecured Loans from Directors", "term_liabilities/Unsecured Loans from Directors"),
    Row("liabilities", "deposits_got", "Security Deposits", "fixed_assets/Security Deposits"),
    Row("liabilities", "unsecured", "Unsecured Loans", "term_liabilities/Unsecured Loans", projection="none"),
    Row("liabilities", "long_provisions", "Long Term Provisions", "term_liabilities/Long Term provisions", projection="none"),
    Row("liabilities", "term_total", "TOTAL TERM LIABILITIES", "term_liabilities/Total Term Liabilities", _sum("term_bank", "term_other")),
    Row("liabilities", "outside", "TOTAL OF OUTSIDE LIABILITIES ", "term_liabilities/Total Outside Liabilities", _sum("current_total", "term_total")),
    Row("liabilities", "capital", "Share Capital", "net_worth/Capital"),
    Row("liabilities", "reserves", "General Reserve", "net_worth/Other reserves", projection="before:pat"),
    *_plain("liabilities", {"revaluation": "Revaluation Reserve", "adjustments": "Adjustments for previous Year costs", "other_reserves": "Other reserves (excluding Provisions)", "others_worth": "Others"}),
    Row("liabilities", "premium", "Share Premium", "net_worth/Share Premium"),
    Row("liabilities", "surplus", "Surplus (+) or deficit (-) in Profit & Loss a/c", None, "{pat!}"),
    Row("liabilities", "worth", "NET WORTH", "net_worth/Net Worth", _sum("capital", "reserves", "others_worth", "surplus")),
    Row("liabilities", "total_liabilities", "TOTAL LIABILITIES (18+24)", None, _sum("outside", "worth")),
]

ASSETS = [
    Row("assets", "cash", "Cash & Bank Balances", "current_assets/Cash & Bank Balances", projection="sales"),
    *_plain("assets", {"securities": "Govt. & other Trustee securities"}),
    Row("assets", "fixed_deposits", "Fixed Deposits with Banks", "current_assets/Fixed Deposits with Banks"),
    Row("assets", "receivables", "Domestic Receivables including BP/BD", "current_assets/Domestic Receivables", projection="sales"),
    *_plain("assets", {"unbilled": "Unbilled receivables", "export_receivables": "Export Receivables including BP/BD)"}),
    Row("assets", "deferred", "Deferred receivables(due within one year)", "current_assets/Deferred receivables", projection="none"),
    Row("assets", "refunds", "Refund Dues from Government Authorities", "current_assets/Refund Dues", projection="none"),
    *_plain("assets", {"raw_material": "Indigenous Rawmaterial"}),
    Row("assets", "in_process", "Stock in Process", None, "0.0"),
    Row("assets", "finished", "Finished Goods", None, "0.0"),
    Row("assets", "advances", "Advances to Suppliers/Transport", "current_assets/Advances to Suppliers", projection="sales"),
    *_plain("assets", {"tax_advance": "Net Advance Payment of Taxes (if positive)"}),
    Row("assets", "other_current_assets", "Other Current Assets (specify major items)", "current_assets/Other Current Assets", projection="sales"),
    Row("assets", "prepaid", "Prepaid expenses", "current_assets/Prepaid Expenses"),
    Row("assets", "emd", "Deposits-EMD & Fixed Deposits", "current_assets/Deposits EMD"),
    Row("assets", "current_assets", "TOTAL CURRENT ASSETS", "current_assets/Total Current Assets", _sum("cash", "fixed_deposits", "receivables", "unbilled", "advances", "other_current_assets")),
    Row("assets", "gross_block", "Gross Block (Land & Building Machinery", "fixed_assets/Gross Block"),
    Row("assets", "cwip", "Add Capital expenditure in wirk-in-process", "fixed_assets/Capital Work in Progress", projection="none"),
    Row("assets", "dep_to_date", "Depreciation to Date", "fixed_assets/Accumulated Depreciation", projection="plus:dep"),
    Row("assets", "net_block", "Net Block", "fixed_assets/Net Block", "{gross_block} + {cwip} - {dep_to_date}"),
    Row("assets", "investments", "Investment in Others", "fixed_assets/Non Current Investments"),
    Row("assets", "deferred_long", "Deferred Receivables(Maturng after a year)", "fixed_assets/Deferred Receivables", projection="decline"),
    Row("assets", "deposits", "Security Deposits ", "fixed_assets/Security Deposits"),
    Row("assets", "deferred_tax", "Deferred Tax Asset (net)", "fixed_assets/Deferred Tax Asset", projection="decline"),
    Row("assets", "advance_tax", "Advance Tax/TDS", "fixed_assets/Advance Tax", projection="decline"),
    Row("assets", "long_deposits", "Fixed Deposits (More Than One Year)", "fixed_assets/Long Term Fixed Deposits"),
    Row("assets", "other_assets", "TOTAL OTHER NON CURRENT ASSETS", "fixed_assets/Total Other Non Current Assets", _sum("investments", "deferred_long", "deposits", "deferred_tax", "advance_tax", "long_deposits")),
    Row("assets", "intangible", "Total Intangible Assets", None, "0.0"),
    Row("assets", "total_assets", "TOTAL ASSETS", "intangibles/Total Assets", _sum("current_assets", "net_block", "other_assets", "intangible")),
]

FUND_FLOW = [
    Row("fund_flow", "ff_pat", "Profit after Tax", None, "{pat!}"),
    Row("fund_flow", "ff_dep", "Depreciation", None, "{dep!}"),
    *_plain("fund_flow", {"ff_written_off": "Intangibles written off", "ff_capital_up": "Increase in capital and reserves"}),
    Row("fund_flow", "ff_term_up", "Increase in Term Liability", "fund_flow/Increase in Term Liability", projection="none"),
    Row("fund_flow", "ff_fixed_down", "i.  Decrease in Fixed Assets", "fund_flow/Decrease in Fixed Assets", projection="none"),
    Row("fund_flow", "ff_other_down", "ii. Decrease in Other non current assets", "fund_flow/Decrease in Other Non-Current Assets", projection="none"),
    Row("fund_flow", "ff_sources", "LONG TERM SOURCES TOTAL", None, _sum("ff_pat", "ff_dep", "ff_term_up", "ff_fixed_down", "ff_other_down")),
    *_plain("fund_flow", {"ff_loss": "Net Loss", "ff_intangibles_up": "Increase in Intangibles"}),
    Row("fund_flow", "ff_capital_down", "Decrease in Capi.and Reserves/ Share Buybacks", "fund_flow/Decrease in Capital and Reserves", projection="none"),
    Row("fund_flow", "ff_term_down", "Decrease in Term Liabilities", "fund_flow/Decrease in Term Liabilities", projection="none"),
    Row("fund_flow", "ff_fixed_up", "i.  Increase in Fixed Assets", "fund_flow/Increase in Fixed Assets", projection="none"),
    Row("fund_flow", "ff_other_up", "Increase in non-Current Assets", "fund_flow/Increase in Non-Current Assets", projection="none"),
    *_plain("fund_flow", {"ff_dividend": "Dividend paid"}),
    Row("fund_flow", "ff_uses", "LONG TERM USES TOTAL", None, _sum("ff_loss", "ff_term_down", "ff_fixed_up", "ff_other_up")),
    Row("fund_flow", "ff_surplus", "Surplus/ Deficit", None, "{ff_sources} - {ff_uses}"),
    Row("fund_flow", "ff_sources_2", "Long Term Sources", None, "{ff_sources!}"),
    Row("fund_flow", "ff_uses_2", "Long Term Uses", None, "{ff_uses!}"),
    Row("fund_flow", "ff_surplus_2", "Surplus /Deficit (i-ii)", None, "{ff_surplus!}"),
]

DSCR = [
    Row("dscr", "ds_accruals", "Cash accruals", None, "{accruals!}"),
    Row("dscr", "ds_interest", "Interest on TL / Deffered Loans", None, "{interest!}"),
    Row("dscr", "ds_repayment", "Repayment Obligations of TL", "dscr/Repayment Obligations of TL", projection="decline"),
    Row("dscr", "ds_total", "Total Repayment", None, _sum("ds_interest", "ds_repayment")),
    Row("dscr", "ds_net", "Net Debt Service Coverage Ratio (DSCR)", "dscr/Net Debt Service Coverage Ratio", "try_divide({ds_accruals!}, nullif({ds_total}, 0))"),
    Row("dscr", "ds_gross", "Gross Debt Service Coverage Ratio (DSCR)", "dscr/Gross Debt Service Coverage Ratio", "try_divide({ds_accruals} + {ds_interest}, nullif({ds_total}, 0))"),
    Row("dscr", "ds_net_mean", "Average Net DSCR", None, None, "mean:ds_net"),
    Row("dscr", "ds_gross_mean", "Average Gross DSCR", None, None, "mean:ds_gross"),
    Row("dscr", "ds_block", "Net Block", None, "{net_block!}"),
    Row("dscr", "ds_loan", "Term Loan outstanding (including instalments)", "dscr/Term Loan Outstanding", _sum("term_total", "instalments")),
    Row("dscr", "ds_cover", "Security Cover avilable (NB-TL/NB)", None, "try_divide({ds_block!} - {ds_loan!}, nullif({ds_block}, 0))"),
]

ROWS = (*OPERATING, *LIABILITIES, *ASSETS, *FUND_FLOW, *DSCR)
#: What a row's formula may name besides rows: a second field for the same thing.
_GIVEN_ONLY = (Row("", "gross_given", "", "sales/Total Gross Sales"),)


def _needs(row: Row) -> set[str]:
    found = {m[1] for m in _NAME.finditer(row.formula or "")}
    rule = row.projection or ""
    if rule == "sales":
        found |= {"sale", "gross"}
    elif rule == "mean_growth":
        found.add("income")
    elif ":" in rule:
        found.add(rule.split(":")[1])
    return found


def levels(rows: tuple[Row, ...] = ROWS) -> list[list[Row]]:
    """Rows in levels: each names only rows of levels before it; an error if rows name each other in a circle."""
    left = {r.key: r for r in (*_GIVEN_ONLY, *rows)}
    out: list[list[Row]] = []
    done: set[str] = set()
    while left:
        ready = [r for r in left.values() if _needs(r) <= done]
        if not ready:
            raise ValueError(f"rows that name each other, or an unknown one: {sorted(left)}")
        out.append(ready)
        done |= {r.key for r in ready}
        left = {k: r for k, r in left.items() if k not in done}
    return out


def _at(key: str, k: int) -> Column:
    return F.get(F.col(f"__{key}"), k) if k >= 0 else F.lit(None).cast("double")


def _formula(row: Row) -> Column:
    """Given values, else the formula, in each column: one lambda over the columns' numbers."""

    def name(m: re.Match) -> str:
        value = f"get(__{m[1]}, {'k - 1' if m[2] == '<' else 'k'})"
        return value if m[2] else f"coalesce({value}, 0.0D)"

    made = f"round(cast({_NAME.sub(name, row.formula)} as double), {row.digits})"
    given = "get(try_element_at(__given, '{}'), k)".format(row.field.replace("'", "\\'")) if row.field else "cast(null as double)"
    return F.expr(f"transform(sequence(0, {COLUMNS - 1}), k -> coalesce({given}, {made}))")


def _projected(row: Row, given: Column) -> tuple[Column, Column] | None:
    """Values of the fourth and fifth column."""
    null = F.lit(None).cast("double")
    v = [F.get(given, k) for k in range(3)]
    zero = F.lit(0.0)
    rule = row.projection
    if rule in ("growth", "decline"):
        rate = F.greatest(F.lit(-0.5), F.least(average_growth(*v), F.lit(0.5 if rule == "growth" else 0.0)))
        base = F.coalesce(*[F.nullif(x, zero) for x in reversed(v)], zero) if rule == "growth" else F.coalesce(v[2], zero)
        first = F.round(base * (1 + rate), 4)
        return first, F.round(first * (1 + rate), 4)
    if rule == "sales":
        sales = [_at("gross", k) for k in range(3)]
        parts = F.array_compact(F.array(*[F.try_divide(F.nullif(a, zero), F.nullif(s, zero)) for a, s in zip(v, sales, strict=True)]))
        share = F.coalesce(F.try_divide(F.aggregate(parts, zero, lambda t, x: t + x), F.size(parts)), zero)
        all_known = reduce(lambda a, b: a & b, [F.coalesce(s, zero) != 0 for s in sales])
        return tuple(F.when(all_known, F.round(share * F.coalesce(_at("sale", k), zero), 4)) for k in (3, 4))
    if rule and rule.startswith(("plus:", "before:")):  # goes on by another row's own value, or by that of the column before
        kind, other = rule.split(":")
        step = [F.coalesce(_at(other, k - (kind == "before")), zero) for k in (3, 4)]
        first = F.round(F.coalesce(v[2], zero) + step[0], 4)
        return first, F.round(first + step[1], 4)
    return (null, null) if rule == "none" else None


def _values(row: Row) -> Column:
    """The five values of a row."""
    given = F.try_element_at(F.col("__given"), F.lit(row.field)) if row.field else F.lit(None).cast("array<double>")
    rule = row.projection or ""
    if rule == "mean_growth":
        income = [_at("income", k) for k in range(3)]
        rates = [F.round(F.try_divide(b - a, F.abs(F.nullif(a, F.lit(0.0)))), 6) for a, b in zip(income, income[1:], strict=False)]
        mean = F.round((F.coalesce(F.nullif(rates[0], F.lit(0.0)), F.lit(0.1)) + F.coalesce(F.nullif(rates[1], F.lit(0.0)), F.lit(0.1))) / 2, 4)
        return F.array(F.lit(None).cast("double"), *rates, mean, mean)
    if rule.startswith("mean:"):
        known = F.filter(F.col(f"__{rule.split(':')[1]}"), lambda x: x != 0)
        mean = F.round(F.try_divide(F.aggregate(known, F.lit(0.0), lambda t, x: t + x), F.size(known)), 4)
        return F.array(mean, *[F.lit(None).cast("double")] * 4)
    if row.formula:
        return _formula(row)

    def five(v: Column) -> Column:
        ahead = _projected(row, v) or (F.lit(None).cast("double"),) * 2
        return F.array(*[F.get(v, k) for k in range(3)], *[F.coalesce(F.get(v, k), ahead[k - 3]) for k in (3, 4)])

    # bound once, and kept out of generated code, which has a limit of size for a whole level
    return F.get(F.transform(F.array(given), five), 0)


def statement(given: DataFrame, sections: tuple[str, ...] | None = None) -> DataFrame:
    """(company, section, row_ord, row, col, value) of all sections or some; ``given`` is (company, section, field, col, value)."""
    five = F.array(*[F.max(F.when(F.col("col") == k, F.col("value").cast("double"))) for k in range(1, COLUMNS + 1)])
    fields = given.where("section is not null and field is not null").groupBy("company", F.concat_ws("/", "section", "field").alias("name")).agg(five.alias("v"))
    wide = fields.groupBy("company").agg(F.map_from_entries(F.collect_list(F.struct("name", "v"))).alias("__given"))
    for level in levels():
        wide = wide.withColumns({f"__{r.key}": _values(r) for r in level})
    wanted = [(k, r) for k, r in enumerate(ROWS) if sections is None or r.section in sections]
    names = F.array(*[F.struct(F.lit(r.section).alias("section"), F.lit(k).alias("row_ord"), F.lit(r.label).alias("row")) for k, r in wanted])
    out = wide.select("company", F.posexplode(F.array(*[F.col(f"__{r.key}") for _, r in wanted])).alias("__k", "__v"))
    out = out.select("company", F.get(names, F.col("__k")).alias("c"), F.posexplode("__v").alias("col", "value")).where("value is not null")
    return out.select("company", "c.section", "c.row_ord", "c.row", (F.col("col") + 1).alias("col"), "value")
