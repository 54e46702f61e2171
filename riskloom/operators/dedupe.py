"""Deterministic de-duplication (keep-first / keep-last) and set helpers.

``dropDuplicates`` keeps an arbitrary row per key.  Here the winner is the
row with the smallest (keep="first") or largest (keep="last") *arrival
order* tuple, computed as ``min``/``max`` of a struct in a ``groupBy``.  An
aggregate, unlike a ``row_number`` window, combines map-side before the
shuffle, so one key holding a third of the rows still leaves each map task
with one row per key instead of sending the whole hot group to one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedupe(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    keep: str = "first",
    count_col: str | None = None,
) -> DataFrame:
    """One row per ``keys``: the earliest (or latest) by ``order``.

    Null keys group together (as in pandas).  ``count_col`` adds how many
    input rows the key had, so the number of dropped rows comes out of the
    same pass (``dedupe_count``).
    """
    if keep not in ("first", "last"):
        raise ValueError("keep must be 'first' or 'last'")
    keys = list(keys)
    at = {c: f"_w._o{i}" for i, c in reversed(list(enumerate(order)))}  # carried once, as rank and as value
    payload = [c for c in df.columns if c not in keys and c not in at]
    ranked = F.struct(
        *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
        *([F.struct(*payload).alias("_p")] if payload else []),
    )
    pick = F.min(ranked) if keep == "first" else F.max(ranked)
    aggs = [pick.alias("_w")]
    if count_col:
        aggs.append(F.count(F.lit(1)).alias(count_col))
    out = df.groupBy(*keys).agg(*aggs)
    cols = [F.col(c) if c in keys else F.col(at.get(c, f"_w._p.`{c}`")).alias(c) for c in df.columns]
    if count_col:
        cols.append(F.col(count_col))
    return out.select(*cols)


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[str], **kw) -> DataFrame:
    return dedupe(df, keys, order, "first", **kw)


def dedupe_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], **kw) -> DataFrame:
    return dedupe(df, keys, order, "last", **kw)


def dedupe_exact(df: DataFrame) -> DataFrame:
    """Whole-row distinct."""
    return df.distinct()


def dedupe_count(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows_in, distinct_keys, rows_dropped in one aggregate pass."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.sum("n").alias("rows_in"),
        F.count(F.lit(1)).alias("distinct_keys"),
        (F.sum("n") - F.count(F.lit(1))).alias("rows_dropped"),
    )


def union_append(existing: DataFrame, new: DataFrame) -> DataFrame:
    """existing + new by column name (missing columns become null)."""
    return existing.unionByName(new, allowMissingColumns=True)


def symbol_set_difference(df: DataFrame, allowed: DataFrame, col: str = "symbol") -> DataFrame:
    """Distinct values of ``col`` in ``df`` that are not in ``allowed``."""
    return df.select(col).distinct().join(allowed.select(col), col, "left_anti")
