"""Tenor-curve interpolation and unit conversions as SQL text / Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import TENOR_DAYS

D3M, D6M, D1Y = (float(TENOR_DAYS[t]) for t in ("3m", "6m", "1y"))


def interpolate_rate_sql(dte: str, r3: str, r6: str, r1: str) -> str:
    """Decimal rate for ``dte`` from 3m/6m/1y yields in percent.

    Flat below 91 days at the 3m rate, linear between the pillars, flat at
    or beyond 365 days at the 1y rate.
    """
    a, b, c = f"({r3}) / 100e0", f"({r6}) / 100e0", f"({r1}) / 100e0"
    return (
        f"(CASE WHEN {dte} < {D3M}e0 THEN {a}"
        f" WHEN {dte} < {D6M}e0 THEN {a} + ({dte} - {D3M}e0) / ({D6M}e0 - {D3M}e0) * ({b} - {a})"
        f" WHEN {dte} < {D1Y}e0 THEN {b} + ({dte} - {D6M}e0) / ({D1Y}e0 - {D6M}e0) * ({c} - {b})"
        f" ELSE {c} END)"
    )


def interpolate_rate(dte: str = "dte", r3: str = "rate_3m", r6: str = "rate_6m",
                     r1: str = "rate_1y") -> Column:
    return F.expr(interpolate_rate_sql(dte, r3, r6, r1))


def par_price_to_yield_sql(value: str, tenor_days: str) -> str:
    """Convert a bond par price to an annualised yield in percent."""
    return f"((100e0 - {value}) / 100e0) * (365e0 / {tenor_days}) * 100e0"


def years_sql(dte: str) -> str:
    return f"({dte}) / 365e0"
