"""Join operators.

Broadcast policy: which side of a join is broadcast is left to the planner,
which compares the sides' bytes with its threshold (AQE again with measured
bytes), so nothing runs while a plan is built and no join changes at a row
count.  Only sides with a bound of their own carry a hint: configuration (lot
periods, strike steps, aliases: tens of rows) and calendars (one row per date
or year).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def pivot_tenors(gbond: DataFrame, value: str = "yield_pct") -> DataFrame:
    """(trade_date, tenor, yield) -> one row per date with rate_3m/6m/1y.

    Turns the three tenor joins of the chain build into one.
    """
    t = F.lower(F.col("tenor"))
    return gbond.groupBy("trade_date").agg(
        F.max(F.when(t == "3m", F.col(value))).alias("rate_3m"),
        F.max(F.when(t == "6m", F.col(value))).alias("rate_6m"),
        F.max(F.when(t == "1y", F.col(value))).alias("rate_1y"),
    )


def market_inputs(spot: DataFrame, div_yield: DataFrame, gbond: DataFrame) -> DataFrame:
    """One (trade_date, symbol) dimension with spot, div_yield and the three
    tenor yields.  Inner joins: a day missing any input has no row (parity
    with the source system; see ``unmatched_market_data``)."""
    rates = _rates(gbond)
    s = spot.select("trade_date", "symbol", F.col("close").alias("spot"))
    y = div_yield.select("trade_date", "symbol", "div_yield")
    return s.join(y, ["trade_date", "symbol"]).join(rates, "trade_date")


def _rates(gbond: DataFrame) -> DataFrame:
    """One row per date that has all three tenors: calendar-sized."""
    return pivot_tenors(gbond).filter(
        F.col("rate_3m").isNotNull() & F.col("rate_6m").isNotNull() & F.col("rate_1y").isNotNull())


def curate_join(contracts: DataFrame, spot: DataFrame, div_yield: DataFrame, gbond: DataFrame) -> DataFrame:
    """contracts ⋈ spot ⋈ dividend yield on (trade_date, symbol) ⋈ rates on trade_date.

    The three dimensions are calendar-sized (one row per date, or per date and
    index) and broadcast: the big contract table is not shuffled, and keeps the
    partitioning by contract that de-duplication left.
    """
    s = spot.select("trade_date", "symbol", F.col("close").alias("spot"))
    y = div_yield.select("trade_date", "symbol", "div_yield")
    return (contracts.join(F.broadcast(s), ["trade_date", "symbol"]).join(F.broadcast(y), ["trade_date", "symbol"])
            .join(F.broadcast(_rates(gbond)), "trade_date"))


def unmatched_market_data(contracts: DataFrame, spot: DataFrame, div_yield: DataFrame,
                          gbond: DataFrame) -> DataFrame:
    """Contract rows the inner curate join drops, with the first missing input."""
    s = spot.select("trade_date", "symbol").withColumn("_s", F.lit(True))
    y = div_yield.select("trade_date", "symbol").withColumn("_y", F.lit(True))
    r = _rates(gbond).select("trade_date").withColumn("_r", F.lit(True))
    j = (contracts.join(s, ["trade_date", "symbol"], "left").join(y, ["trade_date", "symbol"], "left")
         .join(F.broadcast(r), "trade_date", "left"))
    reason = (F.when(F.col("_s").isNull(), "no_spot").when(F.col("_y").isNull(), "no_div_yield")
              .when(F.col("_r").isNull(), "no_rates"))
    return j.withColumn("reason", reason).filter(F.col("reason").isNotNull()).drop("_s", "_y", "_r")


def _month(c: Column) -> Column:
    return (F.year(c) * 12 + F.month(c)).cast("int")


def interval_join(df: DataFrame, periods: DataFrame, key: str, values: Sequence[str], date_col: str = "trade_date") -> DataFrame:
    """Left join of each row to the period [start_date, end_date | open] of its ``key`` that contains its date.

    For schedules of any size, without a hint: a closed period becomes one row per
    month, so the join is an equi-join on (key, month) with the dates as residual; a
    row has one month, and periods of a key never overlap, so no row meets two.  An
    open period is the only one of its key and joins on the key.  The planner
    broadcasts a small schedule and merges a large one (AQE splits hot keys).
    """
    closed = periods.where("end_date is not null and end_date >= start_date").select(
        F.col(key).alias("_k"), F.col("start_date").alias("_s"), F.col("end_date").alias("_e"), *[F.col(v).alias(f"_c_{v}") for v in values],
        F.explode(F.sequence(_month(F.col("start_date")), _month(F.col("end_date")))).alias("_m"))
    opened = periods.where("end_date is null").select(F.col(key).alias("_ok"), F.col("start_date").alias("_os"),
                                                      *[F.col(v).alias(f"_o_{v}") for v in values])
    d = df.withColumn("_month", _month(F.col(date_col)))
    d = d.join(closed, (F.col(key) == F.col("_k")) & (F.col("_month") == F.col("_m")) & F.col(date_col).between(F.col("_s"), F.col("_e")), "left")
    d = d.join(opened, (F.col(key) == F.col("_ok")) & (F.col(date_col) >= F.col("_os")), "left")
    return d.select(*[F.col(c) for c in df.columns if c not in values], *[F.coalesce(f"_c_{v}", f"_o_{v}").alias(v) for v in values])


def lot_size_asof(df: DataFrame, lots: DataFrame, date_col: str = "trade_date",
                  default: int = 1, configuration: bool = True) -> DataFrame:
    """Interval join: lot size whose [start, end|open] contains ``date_col``.

    ``configuration`` says that the schedule is configuration (tens of rows): a
    broadcast hash join on symbol with the range as residual condition.  Otherwise
    ``interval_join`` takes a schedule of any size.  No match -> ``default`` and
    ``lot_size_missing = true``.  Periods never overlap (``lot_size_overlaps``)
    so there is at most one match.
    """
    if configuration:
        lt = lots.select(F.col("symbol").alias("_ls_symbol"), F.col("start_date").alias("_ls_start"),
                         F.col("end_date").alias("_ls_end"), F.col("lot_size").alias("_ls_lot"))
        cond = ((F.col("symbol") == F.col("_ls_symbol")) & (F.col("_ls_start") <= F.col(date_col))
                & (F.col("_ls_end").isNull() | (F.col("_ls_end") >= F.col(date_col))))
        j = df.join(F.broadcast(lt), cond, "left")
    else:
        j = interval_join(df, lots.withColumnRenamed("lot_size", "_ls_lot"), "symbol", ["_ls_lot"], date_col)
    return j.withColumns({
        "lot_size": F.coalesce(F.col("_ls_lot"), F.lit(default)).cast("int"),
        "lot_size_missing": F.col("_ls_lot").isNull(),
    }).drop("_ls_symbol", "_ls_start", "_ls_end", "_ls_lot")


def missing_lot_sizes(df: DataFrame, lots: DataFrame, date_col: str = "trade_date") -> DataFrame:
    """Strict lookup: the rows without a lot period, with the reason.

    ``unknown_symbol``: the schedule does not have the symbol at all;
    ``no_period``: it has, but no period contains the date.
    """
    known = lots.select(F.col("symbol").alias("_known")).distinct()
    j = lot_size_asof(df, lots, date_col).filter("lot_size_missing")
    j = j.join(F.broadcast(known), F.col("symbol") == F.col("_known"), "left")
    reason = F.when(F.col("_known").isNull(), "unknown_symbol").otherwise("no_period")
    return j.withColumn("reason", reason).drop("_known", "lot_size", "lot_size_missing")


def strike_interval_lookup(df: DataFrame, steps: DataFrame, date_col: str = "trade_date", configuration: bool = True) -> DataFrame:
    """Strike grid step valid for (symbol, date); NULL if none.  ``configuration`` as in ``lot_size_asof``."""
    if not configuration:
        return interval_join(df, steps, "symbol", ["strike_step"], date_col)
    st = steps.select(F.col("symbol").alias("_si_symbol"), F.col("start_date").alias("_si_start"),
                      F.col("end_date").alias("_si_end"), "strike_step")
    cond = ((F.col("symbol") == F.col("_si_symbol")) & (F.col("_si_start") <= F.col(date_col))
            & (F.col("_si_end").isNull() | (F.col("_si_end") >= F.col(date_col))))
    return df.join(F.broadcast(st), cond, "left").drop("_si_symbol", "_si_start", "_si_end")


def last_n_dates(df: DataFrame, n: int, date_col: str = "trade_date", as_of=None) -> DataFrame:
    """The ``n`` most recent distinct dates (<= as_of): a top-k, so bounded."""
    d = df.select(date_col).distinct()
    if as_of is not None:
        d = d.filter(F.col(date_col) <= F.lit(as_of))
    return d.orderBy(F.col(date_col).desc()).limit(n)


def join_last_n_dates(df: DataFrame, n: int, date_col: str = "trade_date", as_of=None) -> DataFrame:
    """Rows of ``df`` on its last ``n`` distinct dates (left-semi, n-row side broadcast)."""
    return df.join(F.broadcast(last_n_dates(df, n, date_col, as_of)), date_col, "left_semi")


def with_prev_trading_date(df: DataFrame, calendar: DataFrame, date_col: str = "trade_date") -> DataFrame:
    """Add ``prev_date``: the previous date of the global calendar."""
    from pyspark.sql import Window

    cal = calendar.select(date_col).distinct()
    cal = cal.withColumn("prev_date", F.lag(date_col).over(Window.orderBy(date_col)))
    return df.join(F.broadcast(cal), date_col, "left")


def new_keys_anti(candidates: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Candidate rows whose key is not yet in ``existing`` (left-anti)."""
    return candidates.join(existing.select(*keys).distinct(), list(keys), "left_anti")


def is_trading_day(df: DataFrame, calendar: DataFrame, date_col: str = "trade_date",
                   out: str = "is_trading_day") -> DataFrame:
    cal = calendar.select(F.col(date_col)).distinct().withColumn(out, F.lit(True))
    return df.join(F.broadcast(cal), date_col, "left").withColumn(
        out, F.coalesce(F.col(out), F.lit(False)))


def join_contract(positions: DataFrame, market: DataFrame, keys: Sequence[str],
                  market_cols: Sequence[str]) -> DataFrame:
    """Left join positions to a market table unique on ``keys``.

    Unmatched positions keep NULL market columns (-> ``no_data`` later).
    Both sides can be large: the planner picks sort-merge, AQE splits skew.
    If the market side carries ``strike_key`` (the bucketed curated chain),
    the equi-join uses it in place of the DOUBLE strike, so the bucketed
    layout is used and only the positions are shuffled; exact strike
    equality stays as a residual condition.
    """
    keys = list(keys)
    if "strike" in keys and "strike_key" in market.columns:
        from ..sources.writers import strike_key
        ekeys = ["strike_key" if k == "strike" else k for k in keys]
        m = market.select(*ekeys, F.col("strike").alias("_m_strike"), *market_cols) \
            .withColumn("_matched", F.lit(True))
        p = positions.withColumn("strike_key", strike_key())
        cond = [p[k] == m[k] for k in ekeys] + [F.abs(p["strike"] - m["_m_strike"]) == 0.0]
        j = p.join(m, cond, "left")
        j = j.select(*[p[c] for c in p.columns if c != "strike_key"], *[m[c] for c in market_cols],
                     m["_matched"])
    else:
        m = market.select(*keys, *market_cols).withColumn("_matched", F.lit(True))
        j = positions.join(m, keys, "left")
    return j.withColumn("_matched", F.coalesce(F.col("_matched"), F.lit(False)))
