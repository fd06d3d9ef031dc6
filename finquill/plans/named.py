"""Named queries: Q holds the callables (spark, sf_dir) -> DataFrame, SQL the statements that give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def choose(key: str, values: list[str]) -> str:
    """An expression that both engines read: one of ``values`` by the remainder of ``key``."""
    quoted = [v.replace("'", "''") for v in values]
    return f"CASE CAST(({key}) % {len(values)} AS INT) " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(quoted)) + " END"


def words_table(groups: dict[str, list[str]]) -> str:
    """Fixed words as rows (ord, name, word) of an SQL statement."""
    rows = [(k, name, w) for k, (name, words) in enumerate(groups.items()) for w in words]
    return "(VALUES " + ", ".join("({}, '{}', '{}')".format(k, n.replace("'", "''"), w.replace("'", "''")) for k, n, w in rows) + ") AS words(ord, name, word)"
