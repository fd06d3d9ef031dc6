"""Derived measures: a formula fills a field that has no value, level by level."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (target, formula) in order; a formula reads what earlier ones have filled.  ratio(a, b, digits)
#: is null where b is null or 0.
LEVELS: tuple[tuple[str, str], ...] = (
    ("net_worth", "capital + reserves"),
    ("cash_accruals", "pat + dep"),
    ("retained_profit", "pat - coalesce(dividend, 0)"),
    ("retained_cash", "cash_accruals - coalesce(dividend, 0)"),
    ("pbdit", "pbt + interest + dep"),
    ("operating_profit", "pbt + interest"),
    ("gross_profit", "net_sales - cost_of_sales"),
    ("gross_margin", "ratio(gross_profit, net_sales, 4)"),
    ("pbdit_margin", "ratio(pbdit, net_sales, 4)"),
    ("operating_margin", "ratio(operating_profit, net_sales, 4)"),
    ("pbt_margin", "ratio(pbt, net_sales, 4)"),
    ("pat_margin", "ratio(pat, net_sales, 4)"),
    ("cash_margin", "ratio(cash_accruals, net_sales, 4)"),
    ("receivable_days", "ratio(receivables * 365, net_sales, 1)"),
    ("tangible_net_worth", "net_worth - coalesce(intangibles, 0)"),
    ("net_working_capital", "current_assets - current_liabilities"),
    ("current_ratio", "ratio(current_assets, current_liabilities, 2)"),
    ("nwc_share", "ratio(net_working_capital * 100, current_assets, 2)"),
    ("debt_equity", "ratio(term_liabilities, tangible_net_worth, 2)"),
    ("tol_equity", "ratio(current_liabilities + term_liabilities, tangible_net_worth, 2)"),
    ("roce", "ratio(pbdit, total_assets, 4)"),
    ("wc_gap", "current_assets - creditors - coalesce(other_cl, 0)"),
    ("contribution", "net_sales - variable_cost"),
    ("break_even_sales", "case when contribution > 0 then ratio(fixed_cost, contribution / nullif(net_sales, 0), 1) end"),
    ("cash_break_even", "case when contribution > 0 then ratio(fixed_cost - dep, contribution / nullif(net_sales, 0), 1) end"),
    ("rm_content", "ratio(raw_material, net_sales, 4)"),
    ("total_receivable_days", "ratio(receivables * 365, net_sales + coalesce(other_income, 0), 1)"),
    ("dep_adjustments", "dep"),
    ("transfer_to_reserves", "0 * net_sales"),
)
_SYNTAX = {"ratio", "coalesce", "nullif", "case", "when", "then", "end"}
#: Confidence of a value that a formula filled in.
COMPUTED = 0.92


def to_sql(formula: str, divide: str = "{a} / nullif({b}, 0)") -> str:
    """ratio(a, b, d) written out for an engine."""
    out = formula
    while (at := out.find("ratio(")) >= 0:
        depth, parts, start = 0, [], at + 6
        for i in range(at + 6, len(out)):
            c = out[i]
            if c == "(":
                depth += 1
            elif c == ")" and depth == 0:
                parts.append(out[start:i])
                break
            elif c == ")":
                depth -= 1
            elif c == "," and depth == 0:
                parts.append(out[start:i])
                start = i + 1
        out = out[:at] + f"round({divide.format(a=f'({parts[0]})', b=f'({parts[1]})')},{parts[2]})" + out[i + 1 :]
    return out


def _levels() -> list[list[tuple[str, str]]]:
    """LEVELS by depth: formulas of one level read base fields and earlier levels only."""
    depth: dict[str, int] = {}
    for target, formula in LEVELS:
        depth[target] = 1 + max((depth[t] for t in depth if re.search(rf"\b{t}\b", formula)), default=0)
    return [[(t, f) for t, f in LEVELS if depth[t] == d] for d in range(1, max(depth.values()) + 1)]


def derive(wide: DataFrame) -> DataFrame:
    """All LEVELS over a frame with a column per field (missing fields are null); one projection a level.

    A target that has a value keeps it; only nulls are filled.  Fields that the frame lacks are null.
    """
    words = {w for _, f in LEVELS for w in re.findall(r"[a-z_]+", f)} - {t for t, _ in LEVELS} - _SYNTAX
    lacking = sorted(words - set(wide.columns))
    wide = wide.withColumns({w: F.lit(None).cast("double") for w in lacking})
    for level in _levels():
        made = {}
        for target, formula in level:
            value: Column = F.expr(to_sql(formula, "try_divide({a}, {b})"))
            made[target] = F.coalesce(F.col(target), value) if target in wide.columns else value
        wide = wide.withColumns(made)
    return wide.drop(*lacking)


def derive_long(wide: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, field, value, confidence, evidence) of all targets that have a value after ``derive``.

    A given value has no confidence of its own here (null); a computed one has COMPUTED and says
    from which formula it comes.
    """
    given = {t: F.col(t).isNotNull() if t in wide.columns else F.lit(False) for t, _ in LEVELS}
    marked = wide.withColumns({f"__given_{t}": g for t, g in given.items()})
    done = derive(marked)
    cells = F.array(*[
        F.struct(F.lit(t).alias("field"), F.col(t).cast("double").alias("value"), F.when(~F.col(f"__given_{t}"), COMPUTED).alias("confidence"), F.when(~F.col(f"__given_{t}"), F.lit(f"[COMPUTED] {f}")).alias("evidence"))
        for t, f in LEVELS
    ])
    return done.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.*").where("value is not null")


def to_long(wide: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    return wide.unpivot(keys, fields, "field", "value")
