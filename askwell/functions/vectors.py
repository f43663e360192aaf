"""X11 cosine similarity as a Catalyst expression over array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def cosine(a: Column | str, b: Column | str) -> Column:
    """dot(a, b) / (|a| |b|); 0.0 when either norm is 0 (reference rule)."""
    a = (F.col(a) if isinstance(a, str) else a).cast("array<double>")
    b = (F.col(b) if isinstance(b, str) else b).cast("array<double>")
    denom = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(denom == 0, F.lit(0.0)).otherwise(_dot(a, b) / denom)


def sql_cosine(a: str, b: str) -> str:
    """Same rule in DuckDB."""
    a, b = f"CAST({a} AS DOUBLE[])", f"CAST({b} AS DOUBLE[])"
    denom = f"(sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"
    return f"CASE WHEN {denom} = 0 THEN 0.0 ELSE list_dot_product({a}, {b}) / {denom} END"
