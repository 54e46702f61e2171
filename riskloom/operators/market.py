"""Market read queries and their aggregations (chain, smile, indices, yields).

The source system answers these for one (symbol, date, expiry) request at
a time.  Here each takes an optional *requests* DataFrame and answers all
requests in one plan (a left-semi join); with no requests it answers for
every key present.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounding import round_dec

from ..dims import DISPLAY_NAMES, SYMBOLS
from .joins import join_last_n_dates, pivot_tenors

CHAIN_KEY = ["symbol", "trade_date", "expiry_date"]


def _for_requests(df: DataFrame, requests: DataFrame | None, keys) -> DataFrame:
    if requests is None:
        return df
    return df.join(requests.select(*keys).distinct(), list(keys), "left_semi")


def option_chain(chain: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """Chain rows for the requested (symbol, trade_date, expiry), by strike, type."""
    return _for_requests(chain, requests, CHAIN_KEY).orderBy(*CHAIN_KEY, "strike", "option_type")


def chain_stats(chain: DataFrame) -> DataFrame:
    """row_count, iv_computed_count, iv_avg (NULL if no IV) per chain."""
    return chain.groupBy(*CHAIN_KEY).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count("iv").alias("iv_computed_count"),
        F.avg("iv").alias("iv_avg"),
    )


def expiries(chain: DataFrame) -> DataFrame:
    """Distinct expiries per (symbol, trade_date), sorted."""
    return chain.select("symbol", "trade_date", "expiry_date").distinct().orderBy(
        "symbol", "trade_date", "expiry_date")


def distinct_sorted(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols).distinct().orderBy(*cols)


def iv_smile(chain: DataFrame) -> DataFrame:
    """strike x {CE, PE} implied vol per chain; strikes with no IV dropped."""
    d = chain.filter(F.col("iv").isNotNull())
    return d.groupBy(*CHAIN_KEY, "strike").agg(
        F.max(F.when(F.col("option_type") == "CE", F.col("iv"))).alias("iv_ce"),
        F.max(F.when(F.col("option_type") == "PE", F.col("iv"))).alias("iv_pe"),
    )


def delta_by_strike(chain: DataFrame) -> DataFrame:
    return chain.filter(F.col("delta").isNotNull()).select(*CHAIN_KEY, "strike", "option_type", "delta")


def vix_by_date(vix: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    return _for_requests(vix, requests, ["trade_date"]).select("trade_date", F.col("close").alias("vix_value"))


def symbol_order_col(col: str = "symbol"):
    """Custom symbol order (NIFTY, BANKNIFTY, FINNIFTY, MIDCPNIFTY)."""
    expr = F.when(F.col(col) == SYMBOLS[0], 1)
    for i, s in enumerate(SYMBOLS[1:], start=2):
        expr = expr.when(F.col(col) == s, i)
    return expr


def display_name_col(col: str = "symbol"):
    m = F.create_map(*[x for k, v in DISPLAY_NAMES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[F.col(col)], F.col(col))


def index_change(spot: DataFrame) -> DataFrame:
    """Close vs the close on the previous *global* trading date.

    The calendar (distinct dates) gets its ``lag`` in a tiny window, then is
    joined back twice; a symbol missing on the previous date falls back to
    its own close (change 0), and a zero previous close gives 0 %.
    """
    s = spot.filter(F.col("symbol").isin(SYMBOLS))
    cal = s.select("trade_date").distinct().withColumn(
        "prev_date", F.lag("trade_date").over(Window.orderBy("trade_date")))
    cal = F.broadcast(cal)  # one row per trading date
    prev = s.select(F.col("trade_date").alias("prev_date"), "symbol", F.col("close").alias("prev_close"))
    j = s.join(cal, "trade_date").join(prev, ["prev_date", "symbol"], "left")
    pc = F.coalesce(F.col("prev_close"), F.col("close"))
    chg = F.col("close") - pc
    pct = F.when((pc.isNull()) | (pc == 0), F.lit(0.0)).otherwise(chg / pc * 100.0)
    return j.select(
        "trade_date", "symbol", display_name_col().alias("display_name"),
        round_dec("open", 2).alias("open"), round_dec("high", 2).alias("high"),
        round_dec("low", 2).alias("low"), round_dec("close", 2).alias("close"),
        round_dec(chg, 2).alias("change"), round_dec(pct, 2).alias("change_pct"),
        symbol_order_col().alias("sym_order"),
    )


def market_yields(gbond: DataFrame) -> DataFrame:
    """3M/6M/1Y yields per date, 2 dp; 0 is treated as missing."""
    p = pivot_tenors(gbond)
    z = lambda c: F.when(F.col(c).isNull() | (F.col(c) == 0), None).otherwise(round_dec(c, 2))
    return p.select("trade_date", z("rate_3m").alias("y_3m"), z("rate_6m").alias("y_6m"),
                    z("rate_1y").alias("y_1y"))


def market_chart(spot: DataFrame, n: int = 30, as_of=None) -> DataFrame:
    """Closes of the four symbols on the last ``n`` trading dates."""
    s = spot.filter(F.col("symbol").isin(SYMBOLS))
    if as_of is not None:
        s = s.filter(F.col("trade_date") <= F.lit(as_of))
    return join_last_n_dates(s, n).select("trade_date", "symbol", round_dec("close", 2).alias("close")) \
        .orderBy("trade_date", "symbol")


def chart_pivot(spot: DataFrame) -> DataFrame:
    """date x symbol matrix of closes (fixed, known pivot values)."""
    return spot.groupBy("trade_date").pivot("symbol", SYMBOLS).agg(F.max("close"))


def sparkline_range(spot: DataFrame) -> DataFrame:
    """Per symbol min/max close padded by 10% of the range (1% of min if flat)."""
    g = spot.groupBy("symbol").agg(F.min("close").alias("min_close"), F.max("close").alias("max_close"))
    pad = F.when(F.col("max_close") == F.col("min_close"), F.col("min_close") * 0.01).otherwise(
        (F.col("max_close") - F.col("min_close")) * 0.1)
    return g.select("symbol", "min_close", "max_close", (F.col("min_close") - pad).alias("y_lo"),
                    (F.col("max_close") + pad).alias("y_hi"))


def market_context(index_rows: DataFrame, positions: DataFrame) -> DataFrame:
    """Market summary rows of the symbols each portfolio holds on the date."""
    held = positions.select("portfolio_id", "trade_date", F.upper(F.trim("symbol")).alias("symbol")).distinct()
    return index_rows.join(held, ["trade_date", "symbol"], "inner")


def _year(df: DataFrame, col: str = "trade_date"):
    """The partition column where the table has it, else the year of the date."""
    return F.col("year") if "year" in df.columns else F.year(col).alias("year")


def on_latest_date(df: DataFrame, col: str = "trade_date") -> DataFrame:
    """Rows of the last date: the last year's partition, then the date."""
    last = df.agg(F.max("year")).scalar()
    latest = df.filter(F.col("year") == last).agg(F.max(col)).scalar()
    return df.filter((F.col("year") == last) & (F.col(col) == latest))


def since_last_closed_year(df: DataFrame, col: str = "trade_date") -> DataFrame:
    """Rows after the last date stored before the last year, by partitions."""
    last = df.agg(F.max("year")).scalar()
    closed = df.filter(F.col("year") < last).agg(F.max("year")).scalar()
    mark = df.filter(F.col("year") == closed).agg(F.max(col)).scalar()
    return df.filter((F.col("year") >= F.year(mark)) & (F.col(col) > mark))


def latest_date(df: DataFrame, col: str = "trade_date") -> DataFrame:
    return df.agg(F.max(col).alias("latest_date"))


def latest_date_by_year(df: DataFrame, col: str = "trade_date") -> DataFrame:
    return df.groupBy(_year(df, col)).agg(F.max(col).alias("latest_date"))


def available_years(df: DataFrame, col: str = "trade_date") -> DataFrame:
    return df.select(_year(df, col)).distinct().orderBy("year")


def null_iv_summary(chain: DataFrame) -> DataFrame:
    """Per year: total rows, rows with NULL IV, and their share in %."""
    g = chain.groupBy(_year(chain)).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("iv").isNull()).alias("null_iv"))
    return g.withColumn("null_pct", F.when(F.col("total") > 0, F.col("null_iv") / F.col("total") * 100.0)
                        .otherwise(F.lit(0.0)))


def iv_audit_by_symbol(chain: DataFrame) -> DataFrame:
    """rows, rows with IV, avg IV % (2 dp), avg delta (4 dp) of calls per symbol."""
    c = chain.filter(F.col("option_type") == "CE")
    return c.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.count("iv").alias("rows_with_iv"),
        round_dec(F.avg("iv") * 100.0, 2).alias("avg_iv_pct"), round_dec(F.avg("delta"), 4).alias("avg_delta"),
    )


def row_coverage(df: DataFrame, by: str = "symbol") -> DataFrame:
    """Rows per symbol plus a TOTAL row (a rollup on one column)."""
    return df.rollup(by).agg(F.count(F.lit(1)).alias("rows")).select(
        F.coalesce(F.col(by), F.lit("TOTAL")).alias(by), "rows")


def bond_daily_change(gbond: DataFrame) -> DataFrame:
    """Per tenor, the change of price against the previous date in %, 2 dp
    (calendar-sized windows)."""
    w = Window.partitionBy("tenor").orderBy("trade_date")
    d = gbond.select("trade_date", "tenor", "price", F.lag("price").over(w).alias("_prev"))
    change = F.when(F.col("_prev") != 0, F.round((F.col("price") - F.col("_prev")) / F.col("_prev") * 100.0, 2))
    return d.select("trade_date", "tenor", "price", change.alias("change_pct"))
