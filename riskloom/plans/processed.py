"""Processed layer: raw feeds -> clean, typed, de-duplicated tables.

Every builder is ``raw DataFrame -> processed DataFrame``; nothing runs
until a sink or an action.  Keep-first for derivatives (corrections never
win), which is the source system's policy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..dims import SYMBOLS, symbol_alias_df
from ..operators.clean import fill_null_yield, normalise_symbol, par_price_to_yield, split_instruments
from ..operators.dedupe import dedupe
from ..schemas import KEEP_POLICY, KEYS

# Arrival order of fixture rows (l_orderkey, l_linenumber alone are not unique).
ARRIVAL_ORDER = ["l_orderkey", "l_linenumber", "l_extendedprice"]

OPTION_COLUMNS = [
    "trade_date", "symbol", "expiry_date", "strike", "option_type", "open", "high", "low",
    "close", "settle", "contracts", "open_interest", "chg_in_oi", "dte",
]
FUTURES_COLUMNS = [c for c in OPTION_COLUMNS if c not in ("strike", "option_type")]


def _shape(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    return df.select(*columns, *[c for c in order if c not in columns])


def _keep(table: str, df: DataFrame, order: list[str]) -> DataFrame:
    """One row per key of the table, by its policy (first or last arrival)."""
    return dedupe(df, KEYS[table], order, KEEP_POLICY[table])


def processed_options(raw_options: DataFrame, order: list[str] = ARRIVAL_ORDER) -> DataFrame:
    """Options rows, one per contract key, earliest arrival wins."""
    d = _keep("options", _shape(raw_options, OPTION_COLUMNS, order), order)
    return d.select(*OPTION_COLUMNS)


def processed_futures(raw_futures: DataFrame, order: list[str] = ARRIVAL_ORDER) -> DataFrame:
    d = _keep("futures", _shape(raw_futures, FUTURES_COLUMNS, order), order)
    return d.select(*FUTURES_COLUMNS)


def processed_index_yield(raw: DataFrame) -> DataFrame:
    """trade_date, symbol, div_yield (percent, NULL filled with 0.0), div_yield_filled."""
    return fill_null_yield(raw.select("trade_date", "symbol", "div_yield"))


def processed_gbond(raw: DataFrame) -> DataFrame:
    """trade_date, tenor, yield_pct, open, high, low, change_pct.

    Par prices are converted to yields, then the per-tenor % change is
    recomputed from the corrected series (lag over tenor, ordered by date;
    first row NULL).  Windowed by tenor: three partitions of one row per
    date each — calendar-sized, not data-sized.
    """
    d = raw.select(
        "trade_date", F.lower(F.trim(F.col("tenor"))).alias("tenor"),
        F.col("price").alias("yield_pct"),
        # a feed of bare prices has no range of its own
        *[F.col(c) if c in raw.columns else F.col("price").alias(c) for c in ("open", "high", "low")],
    )
    d = par_price_to_yield(d)
    w = Window.partitionBy("tenor").orderBy("trade_date")
    prev = F.lag("yield_pct").over(w)
    return d.withColumn("change_pct", (F.col("yield_pct") / prev - 1.0) * 100.0)


def processed_trade_calendar(options: DataFrame, futures: DataFrame) -> DataFrame:
    """Distinct (trade_date, symbol) that have any derivatives row; rows of repeated keys may be among them."""
    return (options.select("trade_date", "symbol")
            .unionByName(futures.select("trade_date", "symbol")).distinct())


# ---------------------------------------------------------------------------
# From landed files.  Readers add the arrival columns (file, block, row).
# ---------------------------------------------------------------------------


def known_derivatives(typed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed exchange rows of both instruments -> (options, futures) rows with
    known symbols and readable dates; repeated keys are kept."""
    d = typed.withColumn("symbol", F.upper(F.trim("symbol"))).filter(
        F.col("symbol").isin(SYMBOLS) & F.col("trade_date").isNotNull() & F.col("expiry_date").isNotNull())
    return split_instruments(d)


def processed_derivatives(typed: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Typed exchange rows of both instruments -> (options, futures): known
    symbols and readable dates only, one row per key."""
    opt, fut = known_derivatives(typed)
    return processed_options(opt, order), processed_futures(fut, order)


def processed_index_spot(raw: DataFrame, order: list[str]) -> DataFrame:
    """All-index close rows (Date, Index, OHLC) -> trade_date, symbol, open, high, low, close."""
    d = raw.select(F.col("Date").alias("trade_date"), F.col("Index").alias("symbol"), F.col("Open").alias("open"),
                   F.col("High").alias("high"), F.col("Low").alias("low"), F.col("Close").alias("close"), *order)
    mapped, _ = normalise_symbol(d.filter("trade_date is not null"), symbol_alias_df(raw.sparkSession))
    return _keep("index_spot", mapped, order).drop(*order)


def processed_vix(raw: DataFrame, order: list[str]) -> DataFrame:
    """Volatility-index rows (Date, VIX_Close) -> trade_date, close."""
    d = raw.select(F.col("Date").alias("trade_date"), F.col("VIX_Close").alias("close"), *order)
    return _keep("vix", d.filter("trade_date is not null and close is not null"), order).drop(*order)


def processed_index_yield_rows(raw: DataFrame, order: list[str]) -> DataFrame:
    """Dividend-yield rows (trade_date, symbol, div_yield), keep-last, NULL filled."""
    d = raw.filter("trade_date is not null").withColumn("symbol", F.upper(F.trim("symbol")))
    return processed_index_yield(_keep("index_yield", d.select("trade_date", "symbol", "div_yield", *order), order))


def processed_gbond_rows(raw: DataFrame, order: list[str]) -> DataFrame:
    """Tenor rows (date, tenor, price, open, high, low), keep-last, par prices
    converted and the change recomputed."""
    d = raw.withColumnRenamed("date", "trade_date").filter("trade_date is not null and price is not null")
    d = d.withColumn("tenor", F.lower(F.trim("tenor")))
    d = _keep("gbond", d.select("trade_date", "tenor", "price", "open", "high", "low", *order), order)
    return processed_gbond(d)


def processed_lot_size(raw: DataFrame, order: list[str]) -> DataFrame:
    """Lot periods (symbol, start_date, end_date, lot_size), one per (symbol, start)."""
    d = raw.withColumn("symbol", F.upper(F.trim("symbol"))).filter("start_date is not null and lot_size > 0")
    return _keep("lot_size", d.select("symbol", "start_date", "end_date", "lot_size", *order), order).drop(*order)
