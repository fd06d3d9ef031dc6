"""Values of spreadsheet formulas of one column, by a small evaluator of arithmetic (never ``eval``)."""

from __future__ import annotations

import ast
import operator
import re

import pandas as pd
from pyspark.sql import DataFrame

_OPERATORS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv}
_COMPARE = {ast.Gt: operator.gt, ast.Lt: operator.lt, ast.GtE: operator.ge, ast.LtE: operator.le, ast.Eq: operator.eq, ast.NotEq: operator.ne}


def _number(node: ast.AST) -> float:
    if isinstance(node, ast.Expression):
        return _number(node.body)
    if isinstance(node, ast.Constant) and isinstance(node.value, int | float):
        return float(node.value)
    if isinstance(node, ast.BinOp) and type(node.op) in _OPERATORS:
        return _OPERATORS[type(node.op)](_number(node.left), _number(node.right))
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.UAdd | ast.USub):
        return _number(node.operand) * (-1 if isinstance(node.op, ast.USub) else 1)
    if isinstance(node, ast.Compare) and len(node.ops) == 1 and type(node.ops[0]) in _COMPARE:
        return float(_COMPARE[type(node.ops[0])](_number(node.left), _number(node.comparators[0])))
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id == "IF" and len(node.args) == 3:
        return _number(node.args[1] if _number(node.args[0]) else node.args[2])
    raise ValueError("not arithmetic")


def evaluate(cells: dict[int, float | str | None], column: str) -> dict[int, float]:
    """The value of each row of a column: numbers, formulas over the same column, IF; all else and every error is 0.

    References are followed without recursion in Python, so long chains are fine; a cell that refers
    to itself is 0.
    """
    reference = re.compile(rf"\b{column}(\d+)\b", re.IGNORECASE)
    known: dict[int, float] = {}

    def needs(row: int) -> list[int]:
        value = cells.get(row)
        return [int(r) for r in reference.findall(value)] if isinstance(value, str) and value.startswith("=") else []

    def value_of(row: int) -> float:
        value = cells.get(row)
        if isinstance(value, int | float):
            return float(value)
        if not isinstance(value, str) or not value.startswith("="):
            return 0.0
        text = reference.sub(lambda m: f"({known.get(int(m[1]), 0.0)!r})", value[1:].strip())
        try:
            return float(_number(ast.parse(text.replace("<>", "!="), mode="eval")))
        except (ValueError, SyntaxError, ZeroDivisionError, OverflowError, RecursionError):
            return 0.0

    for start in cells:
        stack, open_rows = [start], set()
        while stack:
            row = stack[-1]
            if row in known:
                stack.pop()
                continue
            waiting = [r for r in needs(row) if r not in known and r not in open_rows and r != row]
            if row in open_rows or not waiting:
                known[row] = value_of(row)
                stack.pop()
            else:
                open_rows.add(row)
                stack += waiting
    return {row: known[row] for row in cells}


def sheet_values(cells: DataFrame, column: str) -> DataFrame:
    """(sheet, row_no, value) of cells (sheet, row_no, number, formula); a sheet's column is one bounded group."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        given = {int(r): f if isinstance(f, str) else None if pd.isna(n) else float(n) for r, n, f in zip(rows.row_no, rows.number, rows.formula, strict=True)}
        found = evaluate(given, column)
        return pd.DataFrame({"sheet": rows.sheet.iloc[0], "row_no": list(found), "value": list(found.values())})

    kind = cells.schema["sheet"].dataType.simpleString()
    return cells.groupBy("sheet").applyInPandas(run, f"sheet {kind}, row_no int, value double")
