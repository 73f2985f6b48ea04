"""How queries are registered: by name, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, dates: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Registers a query and its SQL; columns named in dates are compared as text."""

    def add(f: Query) -> Query:
        def as_text(spark: SparkSession, sf: str) -> DataFrame:
            return f(spark, sf).withColumns({d: F.col(d).cast("string") for d in dates})

        QUERIES[f.__name__] = as_text if dates else f
        if sql:
            SQL[f.__name__] = f"SELECT * REPLACE ({', '.join(f'CAST({d} AS VARCHAR) AS {d}' for d in dates)}) FROM ({sql})" if dates else sql
        return f

    return add
