"""Market views derived from the driver's TPC-H-like tables.

The engine works on option/futures/index/bond data.  For tests and
benchmarks those are *derived* from ``orders`` and ``lineitem`` with a
fixed recipe, so that every query's work grows with the input tables.
The recipe exists twice: as DataFrame code (what the engine runs) and as
SQL text (``FIXTURE_CTES``, what the DuckDB oracle runs).  Both follow the
same arithmetic so results can be compared value by value.

Positions: every option and futures contract row becomes a position held in
portfolio ``l_suppkey % 25`` (no row is sampled away).
"""

from __future__ import annotations

import functools
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dims import SYMBOLS

# ---------------------------------------------------------------------------
# Fixed values of the fixture recipe
# ---------------------------------------------------------------------------

# Lot-size periods shifted into the fixture's date range (1995-2001), with a
# gap (BANKNIFTY 1999-04-28..05-31) and late starts (FINNIFTY, MIDCPNIFTY).
FIXTURE_LOT_PERIODS = [
    ("NIFTY", "1995-01-01", "1997-04-29", 75),
    ("NIFTY", "1997-04-30", "2000-04-25", 50),
    ("NIFTY", "2000-04-26", None, 25),
    ("BANKNIFTY", "1995-01-01", "1996-05-03", 20),
    ("BANKNIFTY", "1996-05-04", "1999-04-27", 25),
    ("BANKNIFTY", "1999-06-01", None, 15),
    ("FINNIFTY", "1997-01-11", "2000-04-25", 40),
    ("FINNIFTY", "2000-04-26", None, 25),
    ("MIDCPNIFTY", "1998-01-24", None, 75),
]
N_PORTFOLIOS = 25
TENORS = [("3m", 91), ("6m", 182), ("1y", 365)]

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _with_prices(df: DataFrame) -> DataFrame:
    """The driver tables hold one price per row: open, high, low and close copy
    settle, and the change in open interest is 0."""
    return df.withColumns({**{c: F.col("settle") for c in ("open", "high", "low", "close")},
                           "chg_in_oi": F.lit(0).cast("bigint")})



class Market:
    """Lazily derived market views over one ``sf_dir``.

    Each property returns a lazy DataFrame; nothing is collected.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    DERIVED = ("daily", "spot", "div_yield_raw", "gbond_raw", "vix", "contracts", "options", "futures", "positions")

    def use_ingest(self, daily_by_symbol: DataFrame) -> None:
        """Re-base every derived view on the stored daily aggregates (same values,
        no second scan of ``orders``).  Contract rows are not stored: scanning
        ``lineitem`` again moves nothing."""
        for name in self.DERIVED:
            self.__dict__.pop(name, None)
        self.__dict__["daily_by_symbol"] = daily_by_symbol

    @functools.cached_property
    def sym(self) -> DataFrame:
        return self.spark.createDataFrame(
            list(enumerate(SYMBOLS)), "sym_id int, symbol string"
        )

    @functools.cached_property
    def daily_by_symbol(self) -> DataFrame:
        """One pass over ``orders``: every per-(date, symbol) aggregate the
        index, dividend, bond and volatility views need (ingest layer)."""
        o = self.table("orders").select(
            F.to_date("o_orderdate").alias("trade_date"),
            (F.col("o_custkey") % 4).cast("int").alias("sym_id"),
            "o_orderkey", "o_totalprice",
        ).join(F.broadcast(self.sym), "sym_id")
        return o.groupBy("trade_date", "symbol").agg(
            F.max_by("o_totalprice", "o_orderkey").alias("px_last_key"),
            F.max("o_totalprice").alias("px_max"),
            F.min("o_totalprice").alias("px_min"),
            F.min_by("o_totalprice", "o_orderkey").alias("px_first_key"),
            F.min("o_orderkey").alias("min_orderkey"),
        )

    @functools.cached_property
    def daily(self) -> DataFrame:
        """Per-date aggregates, re-aggregated from the per-symbol ones."""
        return self.daily_by_symbol.groupBy("trade_date").agg(
            F.min("min_orderkey").alias("min_orderkey"), F.max("px_max").alias("px_max"))

    @functools.cached_property
    def spot(self) -> DataFrame:
        """Index OHLC per (trade_date, symbol)."""
        return self.daily_by_symbol.select(
            "trade_date", "symbol",
            (F.lit(20000.0) + F.col("px_last_key") / 100.0).alias("open"),
            (F.lit(20000.0) + F.col("px_max") / 100.0).alias("high"),
            (F.lit(20000.0) + F.col("px_min") / 100.0).alias("low"),
            (F.lit(20000.0) + F.col("px_first_key") / 100.0).alias("close"),
        )

    @functools.cached_property
    def div_yield_raw(self) -> DataFrame:
        """Dividend yield in percent; every 17th is missing."""
        m = F.col("min_orderkey")
        return self.daily_by_symbol.select(
            "trade_date", "symbol",
            F.when(m % 17 == 0, F.lit(None).cast("double")).otherwise(F.lit(0.8) + (m % 90) / 100.0)
            .alias("div_yield"),
        )

    @functools.cached_property
    def gbond_raw(self) -> DataFrame:
        """Bond quotes per (trade_date, tenor); on the 13th they are par prices."""
        d = self.daily.select("trade_date", (F.lit(5.5) + (F.col("min_orderkey") % 100) / 100.0).alias("y"))
        # three tenors per date: a fixed-size generator, not a join
        tenors = F.array(*[F.struct(F.lit(t).alias("tenor"), F.lit(n).alias("days"))
                           for t, n in TENORS])
        d = d.select("trade_date", "y", F.inline(tenors))
        price = F.when(
            F.dayofmonth("trade_date") == 13, F.lit(100.0) - F.col("y") * F.col("days") / 365.0
        ).otherwise(F.col("y") + F.col("days") / 2000.0)
        return d.select("trade_date", "tenor", price.alias("price"))

    @functools.cached_property
    def vix(self) -> DataFrame:
        return self.daily.select("trade_date", (F.lit(10.0) + F.col("px_max") / 25000.0).alias("close"))

    @functools.cached_property
    def bhav(self) -> DataFrame:
        """Raw daily derivatives rows (options and futures, with duplicates)."""
        li = self.table("lineitem")
        fut = F.col("l_linenumber") == 7
        trade_date = F.to_date("l_shipdate")
        dte = F.col("l_quantity").cast("int") * 8 - 8
        li = li.withColumn("sym_id", (F.col("l_suppkey") % 4).cast("int")).join(
            F.broadcast(self.sym), "sym_id"
        )
        return li.select(
            F.when(fut, "FUTIDX").otherwise("OPTIDX").alias("instrument"),
            "symbol",
            trade_date.alias("trade_date"),
            dte.alias("dte"),
            F.date_add(trade_date, dte).alias("expiry_date"),
            F.when(fut, F.lit(0.0))
            .otherwise(F.lit(50.0) * F.floor((F.lit(20000.0) + (F.col("l_partkey") % 81) * 60.0) / 50.0))
            .alias("strike"),
            F.when(fut, "XX").when(F.col("l_linenumber") % 2 == 0, "CE").otherwise("PE").alias("option_type"),
            F.floor("l_extendedprice").cast("bigint").alias("open_interest"),
            F.col("l_quantity").cast("bigint").alias("contracts"),
            "l_discount", "l_tax", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
            "l_extendedprice",
        )

    @functools.cached_property
    def contracts(self) -> DataFrame:
        """Raw contract rows on days with an index level, with their settle
        price (options and futures in one pass over ``lineitem``)."""
        s = self.spot.select("trade_date", "symbol", F.col("close").alias("spot"))
        b = self.bhav.join(F.broadcast(s), ["trade_date", "symbol"])  # calendar-sized: one row per date and index
        intrinsic = F.greatest(
            F.when(F.col("option_type") == "CE", F.col("spot") - F.col("strike"))
            .otherwise(F.col("strike") - F.col("spot")),
            F.lit(0.0),
        )
        opt_settle = F.when(F.col("l_discount") == 0.0, F.lit(0.0)).otherwise(
            intrinsic + F.col("spot") * (F.lit(0.01) + F.col("l_tax")) * F.sqrt((F.col("dte") + 1) / 365.0)
        )
        fut_settle = F.col("spot") * (F.lit(1.0) + F.col("l_tax") * F.col("dte") / 365.0)
        return b.withColumn("settle", F.when(F.col("instrument") == "FUTIDX", fut_settle).otherwise(opt_settle))

    @functools.cached_property
    def options(self) -> DataFrame:
        return _with_prices(self.contracts.filter(F.col("instrument") == "OPTIDX"))

    @functools.cached_property
    def futures(self) -> DataFrame:
        return _with_prices(self.contracts.filter(F.col("instrument") == "FUTIDX"))

    @functools.cached_property
    def lot_size(self) -> DataFrame:
        from .dims import lot_size_df

        return lot_size_df(self.spark, FIXTURE_LOT_PERIODS)

    @functools.cached_property
    def positions(self) -> DataFrame:
        """Every contract row as a signed position (see module doc)."""
        u = self.options.unionByName(self.futures)
        strike = F.when(
            (F.col("option_type") != "XX") & (F.col("l_partkey") % 11 == 0), F.col("strike") + 1.0
        ).otherwise(F.col("strike"))
        qty = F.when(F.col("l_linenumber") < 4, F.col("l_linenumber") - 4).otherwise(F.col("l_linenumber") - 3)
        return u.select(
            (F.col("l_suppkey") % N_PORTFOLIOS).cast("int").alias("portfolio_id"),
            "symbol", "trade_date", "expiry_date", strike.alias("strike"), "option_type",
            qty.cast("int").alias("quantity"),
            F.date_add("trade_date", -5).alias("entry_date"),
            (F.lit(1.0) + F.col("spot") * F.col("l_tax")).alias("entry_price"),
            "l_orderkey", "l_linenumber", "l_extendedprice",
        )


# ---------------------------------------------------------------------------
# The same recipe as SQL text, for the DuckDB oracle.
# ---------------------------------------------------------------------------


def _lot_values() -> str:
    rows = []
    for s, a, b, n in FIXTURE_LOT_PERIODS:
        bb = "NULL" if b is None else f"'{b}'"
        rows.append(f"('{s}','{a}',{bb},{n})")
    return ",".join(rows)


FIXTURE_CTES: list[tuple[str, str]] = [
    ("sym", "SELECT * FROM (VALUES " + ",".join(f"({i},'{s}')" for i, s in enumerate(SYMBOLS))
     + ") AS t(sym_id, symbol)"),
    ("spot", """SELECT CAST(o_orderdate AS DATE) AS trade_date, s.symbol,
  20000e0+max_by(o_totalprice,o_orderkey)/100e0 AS open, 20000e0+max(o_totalprice)/100e0 AS high,
  20000e0+min(o_totalprice)/100e0 AS low, 20000e0+min_by(o_totalprice,o_orderkey)/100e0 AS close
FROM orders JOIN sym s ON CAST(o_custkey%4 AS INT)=s.sym_id GROUP BY 1,2"""),
    ("div_yield_raw", """SELECT CAST(o_orderdate AS DATE) AS trade_date, s.symbol,
  CASE WHEN min(o_orderkey)%17=0 THEN NULL ELSE 0.8e0+(min(o_orderkey)%90)/100e0 END AS div_yield
FROM orders JOIN sym s ON CAST(o_custkey%4 AS INT)=s.sym_id GROUP BY 1,2"""),
    ("gbond_raw", """SELECT d.trade_date, t.tenor,
  CASE WHEN day(d.trade_date)=13 THEN 100e0-d.y*t.days/365e0 ELSE d.y+t.days/2000e0 END AS price
FROM (SELECT CAST(o_orderdate AS DATE) AS trade_date, 5.5e0+(min(o_orderkey)%100)/100e0 AS y FROM orders GROUP BY 1) d
CROSS JOIN (VALUES ('3m',91),('6m',182),('1y',365)) AS t(tenor,days)"""),
    ("vix", "SELECT CAST(o_orderdate AS DATE) AS trade_date, 10e0+max(o_totalprice)/25000e0 AS close FROM orders GROUP BY 1"),
    ("bhav", """SELECT CASE WHEN l_linenumber=7 THEN 'FUTIDX' ELSE 'OPTIDX' END AS instrument, s.symbol,
  CAST(l_shipdate AS DATE) AS trade_date, CAST(l_quantity AS INT)*8-8 AS dte,
  CAST(l_shipdate AS DATE)+(CAST(l_quantity AS INT)*8-8) AS expiry_date,
  CASE WHEN l_linenumber=7 THEN 0e0 ELSE 50e0*floor((20000e0+(l_partkey%81)*60e0)/50e0) END AS strike,
  CASE WHEN l_linenumber=7 THEN 'XX' WHEN l_linenumber%2=0 THEN 'CE' ELSE 'PE' END AS option_type,
  CAST(floor(l_extendedprice) AS BIGINT) AS open_interest, CAST(l_quantity AS BIGINT) AS contracts,
  l_discount, l_tax, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
FROM lineitem JOIN sym s ON CAST(l_suppkey%4 AS INT)=s.sym_id"""),
    ("options", """SELECT b.*, p.close AS spot, CASE WHEN l_discount=0e0 THEN 0e0 ELSE
  greatest(CASE WHEN option_type='CE' THEN p.close-strike ELSE strike-p.close END,0e0)
  +p.close*(0.01e0+l_tax)*sqrt((dte+1)/365e0) END AS settle
FROM bhav b JOIN spot p ON b.trade_date=p.trade_date AND b.symbol=p.symbol WHERE instrument='OPTIDX'"""),
    ("futures", """SELECT b.*, p.close AS spot, p.close*(1e0+l_tax*dte/365e0) AS settle
FROM bhav b JOIN spot p ON b.trade_date=p.trade_date AND b.symbol=p.symbol WHERE instrument='FUTIDX'"""),
    ("lot_size", "SELECT symbol, CAST(s AS DATE) AS start_date, CAST(e AS DATE) AS end_date, "
     "CAST(lot_size AS INT) AS lot_size FROM (VALUES " + _lot_values() + ") AS t(symbol,s,e,lot_size)"),
    ("positions", f"""SELECT CAST(l_suppkey%{N_PORTFOLIOS} AS INT) AS portfolio_id, symbol, trade_date, expiry_date,
  CASE WHEN option_type<>'XX' AND l_partkey%11=0 THEN strike+1e0 ELSE strike END AS strike, option_type,
  CAST(CASE WHEN l_linenumber<4 THEN l_linenumber-4 ELSE l_linenumber-3 END AS INT) AS quantity,
  trade_date+(-5) AS entry_date, 1e0+spot*l_tax AS entry_price, l_orderkey, l_linenumber, l_extendedprice
FROM (SELECT * FROM options UNION ALL BY NAME SELECT * FROM futures) u"""),
]


# ---------------------------------------------------------------------------
# Raw (text) feeds in the exchange layouts, derived from the views above,
# with the dirt the cleaning operators exist for.
# ---------------------------------------------------------------------------

# Fixed fixture constants of the raw feeds.
UNKNOWN_SYMBOL = "NIFTYIT"          # outside the universe (every l_suppkey % 10 == 9)
MISSING_TEXT = "-"                  # non-numeric OPEN/HIGH/LOW (every l_partkey % 13 == 0)
NA_TEXT = "NA"                      # non-numeric CONTRACTS (every l_partkey % 17 == 0)
OTHER_INDEX = "Nifty IT"            # an index outside the universe in the all-index file


def raw_bhav_legacy(m: Market, order: list[str] | None = None, where=None) -> DataFrame:
    """Legacy-layout text rows (one per raw contract row, duplicates kept).

    Trap columns: mixed EXPIRY formats (ISO on even line numbers, dd-MON-yyyy
    otherwise), '-' prices, 'NA' volumes, blank futures strikes, and an
    unknown symbol.  ``order`` sorts the rows by these columns, while they are
    still numbers: a sort of the text rows would move several times the bytes.
    ``where`` keeps the contract rows it is true for, before they become text.
    """
    u = m.options.unionByName(m.futures)
    u = u if where is None else u.where(where)
    u = u.orderBy(*order) if order else u
    s = lambda c: F.col(c).cast("string")
    iso = F.date_format("expiry_date", "yyyy-MM-dd")
    mon = F.upper(F.date_format("expiry_date", "dd-MMM-yyyy"))
    dash = F.col("l_partkey") % 13 == 0
    return u.select(
        F.date_format("trade_date", "yyyy-MM-dd").alias("TradDt"),
        F.when(F.col("instrument") == "FUTIDX", "IDF").otherwise("IDO").alias("InstrmntType"),
        F.when(F.col("l_suppkey") % 10 == 9, F.lit(UNKNOWN_SYMBOL)).otherwise(F.col("symbol")).alias("Symbl"),
        F.when(F.col("l_linenumber") % 2 == 0, iso).otherwise(mon).alias("XpryDt"),
        F.when(F.col("option_type") == "XX", F.lit("")).otherwise(s("strike")).alias("StrkPric"),
        F.when(F.col("option_type") == "XX", F.lit(None).cast("string")).otherwise(F.col("option_type")).alias("OptnTyp"),
        *[F.when(dash, F.lit(MISSING_TEXT)).otherwise(s("settle")).alias(c) for c in ("OpnPric", "HghPric", "LwPric")],
        s("settle").alias("ClsPric"), s("settle").alias("SttlmPric"),
        F.when(F.col("l_partkey") % 17 == 0, F.lit(NA_TEXT)).otherwise(s("contracts")).alias("TtlTradgVol"),
        s("open_interest").alias("OpnIntrst"), F.lit("0").alias("ChngInOpnIntrst"),
        "l_orderkey", "l_linenumber", "l_extendedprice",
    )


def raw_index_close(m: Market) -> DataFrame:
    """All-index close rows: the four indices under their long names, the
    volatility index, and one index outside the universe."""
    from .dims import DISPLAY_NAMES, VIX_INDEX_NAME
    names = F.create_map(*[x for k, v in DISPLAY_NAMES.items() for x in (F.lit(k), F.lit(v))])
    s = lambda c: F.col(c).cast("string")
    spot = m.spot.select(names[F.col("symbol")].alias("Index Name"),
                         F.date_format("trade_date", "dd-MM-yyyy").alias("Index Date"),
                         s("open").alias("Open Index Value"), s("high").alias("High Index Value"),
                         s("low").alias("Low Index Value"), s("close").alias("Closing Index Value"))
    other = spot.filter(F.col("Index Name") == DISPLAY_NAMES["NIFTY"]).withColumn("Index Name", F.lit(OTHER_INDEX))
    vix = m.vix.select(F.lit(VIX_INDEX_NAME).alias("Index Name"),
                       F.date_format("trade_date", "dd-MM-yyyy").alias("Index Date"),
                       *[F.lit("-").alias(c) for c in ("Open Index Value", "High Index Value", "Low Index Value")],
                       s("close").alias("Closing Index Value"))
    return spot.unionByName(other).unionByName(vix)
