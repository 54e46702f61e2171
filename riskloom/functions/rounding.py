"""Decimal rounding of displayed values.

Prices and PnL are decimal quantities, so display rounding is done on the
decimal value (half away from zero), not on the nearest binary double:
``round_dec(20024.885, 2) = 20024.89``.  Going through DECIMAL(38, 6) first
makes Spark and the SQL oracle agree on every value with at most six
decimals, ties included.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 6


def round_dec(c: Column | str, digits: int) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast(f"decimal(38,{SCALE})"), digits).cast("double")


def round_dec_sql(x: str, digits: int) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(38,{SCALE})), {digits}) AS DOUBLE)"
