"""Helpers shared by query modules: typed, rounded outputs on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPARK_TYPES = {"i": "int", "l": "bigint", "d": "double", "s": "string", "t": "date"}
SQL_TYPES = {"i": "INTEGER", "l": "BIGINT", "d": "DOUBLE", "s": "VARCHAR", "t": "DATE"}


def typed(df: DataFrame, cols: list[tuple[str, str]], digits: int = 6) -> DataFrame:
    """Select ``cols`` [(name, kind)] with explicit types; doubles rounded."""
    out = []
    for name, kind in cols:
        c = F.col(name).cast(SPARK_TYPES[kind])
        if kind == "d":
            c = F.round(c, digits)
        out.append(c.alias(name))
    return df.select(*out)


def typed_sql(cols: list[tuple[str, str]], digits: int = 6, prefix: str = "") -> str:
    """SQL select list matching :func:`typed`."""
    parts = []
    for name, kind in cols:
        e = f"CAST({prefix}{name} AS {SQL_TYPES[kind]})"
        if kind == "d":
            e = f"(ROUND({e}, {digits}) + 0.0)"  # + 0.0 turns -0.0 into 0.0
        parts.append(f"{e} AS {name}")
    return ", ".join(parts)
