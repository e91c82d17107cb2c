"""Queries of the library (its ``llm`` subpackage has its own registry), with their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_SQL_TYPE = {"long": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
DIGITS = 6


def query(name: str, columns: str, sql: str | None = None, uses: str = ""):
    """Register a query: its result columns (``name:type``; doubles are rounded), and its SQL over the views it uses."""
    kinds = [c.split(":") for c in columns.split()]

    def put(make: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, d: str) -> DataFrame:
            df = make(spark, d)
            return df.select(*[F.round(F.col(c).cast("double"), DIGITS).alias(c) if t == "double" else F.col(c).cast(t).alias(c) for c, t in kinds])

        QUERIES[name] = run
        if sql:
            shown = ", ".join(f"round(CAST({c} AS DOUBLE), {DIGITS}) AS {c}" if t == "double" else f"CAST({c} AS {_SQL_TYPE[t]}) AS {c}" for c, t in kinds)
            made = [f"{v} AS ({views.SQL[v]})" for v in uses.split()]
            ORACLES[name] = ("WITH RECURSIVE " + ", ".join(made) + " " if made else "") + f"SELECT {shown} FROM ({sql}) AS result"
        return make

    return put


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return QUERIES["palette_report_cover"](spark, d)


from rasterlake.plans import catalogue  # noqa: E402, F401  registers the queries
