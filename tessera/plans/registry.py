"""Registered queries and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Literal:
    """A small table given in the code, as a DataFrame and as SQL; values are None, numbers, truth values and strings."""

    def __init__(self, columns: str, *rows: tuple):
        self.columns, self.rows = columns, rows

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), self.columns)

    @property
    def sql(self) -> str:
        names, kinds = zip(*(c.split() for c in self.columns.split(", ")))
        kinds = [{"string": "VARCHAR", "long": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]"}[k] for k in kinds]

        def one(v) -> str:
            if v is None:
                return "NULL"
            if isinstance(v, list):
                return "[" + ", ".join(map(one, v)) + "]"
            return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

        values = ", ".join("(" + ", ".join(f"CAST({one(v)} AS {k})" for v, k in zip(row, kinds)) + ")" for row in self.rows)
        return f"(SELECT * FROM (VALUES {values}) AS t({', '.join(names)}))"
