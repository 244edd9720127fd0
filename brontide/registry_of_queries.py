"""Collects queries and their SQL by name."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with the SQL that must give the same rows."""

    def add(f: Callable) -> Callable:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(spark, rows: str, columns: str):
    """A literal table; `rows` and `columns` are written the same way in every engine."""
    return spark.sql(f"SELECT * FROM (VALUES {rows}) AS t({columns})")


class Derived:
    """Columns worked out from a table's, by expressions that mean the same in every engine: the rows an operator meets, in Spark and in SQL."""

    def __init__(self, base: str, **columns: str):
        self.base, self.columns = base, columns
        self.sql = "(SELECT " + ", ".join(f"{e} AS {c}" for c, e in columns.items()) + f" FROM {base})"

    def __call__(self, spark, sf_dir: str):
        return table(spark, sf_dir, self.base).selectExpr(*(f"{e} AS {c}" for c, e in self.columns.items()))


def in_turn(key: str, *options: str) -> str:
    """One of the options, by the key's remainder."""
    return f"CASE {key} % {len(options)} " + " ".join(f"WHEN {i} THEN {o}" for i, o in enumerate(options)) + " END"
