"""Queries whose projection is one text for Spark and for the SQL that checks it."""

from __future__ import annotations

from pathloom.fixtures import WITH
from pathloom.registry import Build, query


def portable(name: str, source: Build, sql: str, columns: dict[str, str], where: str = "", extra: str = "", spark_columns: dict[str, str] | None = None) -> None:
    """Register ``source`` with these columns; ``sql`` is its FROM clause over the fixture's tables."""
    mine = columns | (spark_columns or {})
    listed = ", ".join(f"{e} AS {n}" for n, e in columns.items())
    oracle = f"{WITH}{', ' + extra if extra else ''} SELECT {listed} FROM {sql}{' WHERE ' + where if where else ''}"

    @query(name, oracle)
    def build(spark, sf_dir):
        df = source(spark, sf_dir)
        df = df.where(where) if where else df
        return df.selectExpr(*(f"{e} AS {n}" for n, e in mine.items()))
