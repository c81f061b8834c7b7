"""Registry of named queries with their comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a Spark query and, where SQL can express it, the equivalent DuckDB text."""
    def wrap(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


def rounded(df: DataFrame, digits: int = 6, **over: int) -> DataFrame:
    """Round every double column (sums of doubles depend on row order in the last bits)."""
    from pyspark.sql import functions as F
    return df.select(*[
        (F.round(F.col(f"`{c}`"), over.get(c, digits)) + F.lit(0.0)).alias(c)
        if t == "double" else F.col(f"`{c}`")
        for c, t in df.dtypes])


def sql(prefix: str, select: str, doubles: str = "", digits: int = 6) -> str:
    """``select`` over the prefix CTEs with the named columns rounded (``name`` or ``name:4``)."""
    if not doubles:
        return f"{prefix} {select}"
    parts = []
    for item in doubles.split():
        name, _, d = item.partition(":")
        parts.append(f'round(CAST("{name}" AS DOUBLE), {d or digits}) + 0.0::DOUBLE AS "{name}"')
    return f"{prefix} SELECT * REPLACE ({', '.join(parts)}) FROM ({select})"
