"""Exact decimal rounding that gives the same digits in Spark and in DuckDB.

PostgreSQL's ``ROUND(x::numeric, n)`` rounds an exact value half away from
zero.  Averages and ratios computed as doubles differ between engines in the
last bits, and rounding a mean that is exactly ``.xx5`` then flips a digit.
Every ratio here is therefore computed from exact integers:

    round_half_up(num / den, d) = ((2 * num * 10^d + den) div (2 * den)) * 10^-d

for ``num >= 0`` and ``den > 0`` (all callers use non-negative counts and
amounts).  ``den = 0`` gives NULL, like ``x / NULLIF(0, 0)``.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

_D38 = "decimal(38,0)"


def _unit(digits: int) -> Column:
    return F.lit(Decimal(1).scaleb(-digits)) if digits else F.lit(Decimal(1))


def round_ratio(num: Column, den: Column, digits: int) -> Column:
    """``ROUND(num / den, digits)`` exactly, as ``decimal(38, digits)``."""
    n = num.cast(_D38)
    d = den.cast(_D38)
    top = n * F.lit(2 * 10**digits).cast(_D38) + d
    bottom = d * F.lit(2).cast(_D38)
    # exact integer division of non-negative decimals: (a - a mod b) / b
    quotient = ((top - F.pmod(top, bottom)) / bottom).cast(_D38)
    value = (quotient * _unit(digits)).cast(f"decimal(38,{digits})")
    return F.when(d == 0, F.lit(None).cast(f"decimal(38,{digits})")).otherwise(value)


def cents(amount: Column) -> Column:
    """Money with two decimals as an exact integer number of cents."""
    return (amount * F.lit(100)).cast(_D38)


def money(amount: Column) -> Column:
    """Money output type shared by both engines."""
    return amount.cast("decimal(38,2)")


# ---- the same rules as DuckDB SQL text, for the oracle ----------------------


def sql_round_ratio(num: str, den: str, digits: int) -> str:
    unit = "1" if digits == 0 else "0." + "0" * (digits - 1) + "1"
    return (
        f"CAST(CAST((2 * CAST({num} AS HUGEINT) * {10**digits} + CAST({den} AS HUGEINT))"
        f" // NULLIF(2 * CAST({den} AS HUGEINT), 0) AS DECIMAL(38,0)) * {unit}"
        f" AS DECIMAL(38,{digits}))"
    )


def sql_cents(amount: str) -> str:
    return f"CAST(({amount}) * 100 AS HUGEINT)"


def sql_money(amount: str) -> str:
    return f"CAST({amount} AS DECIMAL(38,2))"
