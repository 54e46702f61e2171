"""Registered queries: sources/sinks, cleaning, filters, validation, set
operations, freshness and incremental modes (inventory 2.A-2.C, 2.D rest,
2.H, 2.M, 2.N)."""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import functions as F

from . import fixtures as FX
from .catalog import ctx, register
from .dims import SYMBOLS
from .functions.curve import interpolate_rate_sql
from .operators import clean as CL
from .operators import freshness as FR
from .operators import joins as JN
from .operators import quality as QA
from .operators.dedupe import dedupe_first, symbol_set_difference, union_append
from .oracle import iv_ctes, with_ctes
from .schemas import OPTIONS_KEY
from .sources import readers as RD
from .sources import writers as WR
from .streaming import incremental as INC

# ---------------------------------------------------------------------------
# Raw derivatives text feed -> typed rows (2.B cleaning operators)
# ---------------------------------------------------------------------------

# What the typed raw feed must contain, computed directly from the views.
RAW_TYPED_SQL = f"""SELECT trade_date,
  CASE WHEN l_suppkey % 10 = 9 THEN '{FX.UNKNOWN_SYMBOL}' ELSE symbol END AS symbol,
  expiry_date, CASE WHEN option_type = 'XX' THEN 0e0 ELSE strike END AS strike,
  CASE WHEN option_type = 'XX' THEN NULL ELSE option_type END AS option_type,
  CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE settle END AS open, settle,
  CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE contracts END AS contracts, open_interest,
  CASE WHEN option_type = 'XX' THEN 'FUTIDX' ELSE 'OPTIDX' END AS instrument,
  l_orderkey, l_linenumber, l_extendedprice
FROM bhav_typed"""
_RAW = [("raw_typed", RAW_TYPED_SQL)]


def _typed_with_ids(spark, sf_dir):
    """Raw text feed typed by the cleaning operators, arrival ids kept."""
    raw = FX.raw_bhav_legacy(ctx(spark, sf_dir).market)
    return _type_raw(raw)


IDS = ["l_orderkey", "l_linenumber", "l_extendedprice"]


def _type_raw(raw):
    """Legacy text columns -> typed processed columns + arrival ids.

    rename_columns -> parse_dates / try_cast (coerce_numeric, cast_nullable_int)
    -> strike_coerce_zero -> classify_instrument, one projection.
    """
    b = raw.withColumnsRenamed({k: v for k, v in RD.LEGACY_RENAME.items() if k in raw.columns})
    b = CL.reindex_columns(b, RD.INGEST_COLUMNS + IDS).withColumnsRenamed(RD.PROCESSED_RENAME)
    strike = CL.strike_coerce_zero("strike")
    return b.select(
        CL.parse_date("trade_date").alias("trade_date"), F.trim("symbol").alias("symbol"),
        CL.parse_date("expiry_date").alias("expiry_date"), strike.alias("strike"),
        F.upper(F.trim("option_type")).alias("option_type"),
        F.col("open").try_cast("double").alias("open"), F.col("settle").try_cast("double").alias("settle"),
        F.col("contracts").try_cast("bigint").alias("contracts"),
        F.col("open_interest").try_cast("bigint").alias("open_interest"),
        F.when(strike == 0.0, "FUTIDX").otherwise("OPTIDX").alias("instrument"),
        F.col("l_orderkey").try_cast("bigint").alias("l_orderkey"),
        F.col("l_linenumber").try_cast("int").alias("l_linenumber"),
        F.col("l_extendedprice").try_cast("double").alias("l_extendedprice"))


@register("rename_columns", with_ctes(
    "SELECT trade_date, symbol, expiry_date, strike, option_type, settle, open_interest FROM raw_typed", _RAW))
def q_rename_columns(spark, sf_dir):
    """Legacy exchange layout renamed to ingest then processed names."""
    t = _typed_with_ids(spark, sf_dir)
    return t.select("trade_date", "symbol", "expiry_date", "strike", "option_type", "settle", "open_interest")


@register("parse_dates", with_ctes("SELECT l_orderkey, l_linenumber, l_extendedprice, trade_date, expiry_date FROM raw_typed", _RAW))
def q_parse_dates(spark, sf_dir):
    """Mixed ISO / dd-MON-yyyy expiry text -> DATE."""
    return _typed_with_ids(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_extendedprice",
                                                 "trade_date", "expiry_date")


@register("coerce_numeric", with_ctes("SELECT l_orderkey, l_linenumber, l_extendedprice, open, settle FROM raw_typed", _RAW))
def q_coerce_numeric(spark, sf_dir):
    """'-' prices -> NULL (try_cast under ANSI mode)."""
    return _typed_with_ids(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_extendedprice", "open", "settle")


@register("cast_nullable_int", with_ctes("SELECT l_orderkey, l_linenumber, l_extendedprice, contracts, open_interest FROM raw_typed", _RAW))
def q_cast_nullable_int(spark, sf_dir):
    return _typed_with_ids(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_extendedprice", "contracts",
                                                 "open_interest")


@register("strike_coerce_zero", with_ctes("SELECT l_orderkey, l_linenumber, l_extendedprice, strike, option_type FROM raw_typed", _RAW))
def q_strike_coerce_zero(spark, sf_dir):
    return _typed_with_ids(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_extendedprice", "strike",
                                                 "option_type")


@register("classify_instrument", with_ctes("SELECT instrument, count(*) AS rows FROM raw_typed GROUP BY 1", _RAW))
def q_classify_instrument(spark, sf_dir):
    return _typed_with_ids(spark, sf_dir).groupBy("instrument").agg(F.count(F.lit(1)).alias("rows"))


@register("split_instruments", with_ctes(
    "SELECT 'options' AS branch, count(*) AS rows FROM raw_typed WHERE instrument = 'OPTIDX' UNION ALL "
    "SELECT 'futures', count(*) FROM raw_typed WHERE instrument = 'FUTIDX'", _RAW))
def q_split_instruments(spark, sf_dir):
    t = _typed_with_ids(spark, sf_dir)
    o, f = CL.split_instruments(t)
    return o.agg(F.count(F.lit(1)).alias("rows")).select(F.lit("options").alias("branch"), "rows").unionByName(
        f.agg(F.count(F.lit(1)).alias("rows")).select(F.lit("futures").alias("branch"), "rows"))


@register("compute_dte", with_ctes(
    "SELECT l_orderkey, l_linenumber, l_extendedprice, CAST(datediff('day', trade_date, expiry_date) AS INT) AS dte FROM raw_typed", _RAW))
def q_compute_dte(spark, sf_dir):
    t = _typed_with_ids(spark, sf_dir)
    return t.select("l_orderkey", "l_linenumber", "l_extendedprice", CL.compute_dte().alias("dte"))


@register("extract_year", with_ctes("SELECT CAST(year(trade_date) AS INT) AS year, count(*) AS rows FROM raw_typed GROUP BY 1", _RAW))
def q_extract_year(spark, sf_dir):
    return _typed_with_ids(spark, sf_dir).groupBy(CL.extract_year().alias("year")).agg(F.count(F.lit(1)).alias("rows"))


@register("reindex_columns", with_ctes(
    "SELECT trade_date, symbol, settle, CAST(NULL AS DOUBLE) AS vwap, CAST(NULL AS VARCHAR) AS series FROM raw_typed", _RAW))
def q_reindex_columns(spark, sf_dir):
    """Project to a canonical list; columns the feed lacks come back NULL."""
    t = _typed_with_ids(spark, sf_dir)
    return CL.reindex_columns(t, ["trade_date", "symbol", "settle", "vwap", "series"],
                              {"vwap": "double", "series": "string"})


@register("drop_columns", with_ctes(
    "SELECT trade_date, symbol, expiry_date, strike, option_type, dte, spot, div_yield, rate FROM c_base"))
def q_drop_columns(spark, sf_dir):
    """Curated build step that drops the three tenor rates after interpolation."""
    from .operators.joins import curate_join
    from .operators.pricing import with_rate
    p = ctx(spark, sf_dir).processed
    j = with_rate(curate_join(p.options, p.spot, p.index_yield, p.gbond))
    j = CL.drop_columns(j, ["rate_3m", "rate_6m", "rate_1y"])
    return j.select("trade_date", "symbol", "expiry_date", "strike", "option_type", "dte", "spot", "div_yield", "rate")


@register("clean_headers", with_ctes(
    "SELECT symbol AS SYMBL, CASE WHEN l_linenumber % 2 = 0 THEN strftime(expiry_date, '%Y-%m-%d') "
    "ELSE upper(strftime(expiry_date, '%d-%b-%Y')) END AS XPRYDT, settle AS STTLMPRIC FROM raw_typed", _RAW))
def q_clean_headers(spark, sf_dir):
    """Header cleanup on the raw feed: padded names, stripped and upper-cased."""
    raw = FX.raw_bhav_legacy(ctx(spark, sf_dir).market)
    padded = raw.toDF(*[f" {c} " for c in raw.columns])
    return CL.clean_headers(padded, "upper").select("SYMBL", "XPRYDT", F.col("STTLMPRIC").try_cast("double").alias("STTLMPRIC"))


@register("trim_upper", with_ctes(
    "SELECT portfolio_id, upper(trim(symbol)) AS symbol, upper(trim(option_type)) AS option_type, quantity FROM positions"))
def q_trim_upper(spark, sf_dir):
    """Position symbols/types arrive padded and lower-cased; normalised here."""
    p = ctx(spark, sf_dir).positions
    messy = p.select("portfolio_id", F.concat(F.lit("  "), F.lower("symbol"), F.lit(" ")).alias("symbol"),
                     F.lower("option_type").alias("option_type"), "quantity")
    return CL.trim_upper(messy, ["symbol", "option_type"])


@register("strip_percent", with_ctes(
    "SELECT trade_date, tenor, price * 1000e0 AS change_pct FROM gbond_raw"))
def q_strip_percent(spark, sf_dir):
    """'6,155.50%' text -> 6155.5 (format with separators, then strip)."""
    g = ctx(spark, sf_dir).market.gbond_raw
    txt = g.select("trade_date", "tenor", F.concat(F.format_number(F.col("price") * 1000.0, 2), F.lit("%")).alias("chg"))
    return txt.select("trade_date", "tenor", CL.strip_percent("chg").alias("change_pct"))


@register("fill_null_yield", with_ctes("SELECT trade_date, symbol, div_yield, div_yield_filled FROM p_yield"))
def q_fill_null_yield(spark, sf_dir):
    return CL.fill_null_yield(ctx(spark, sf_dir).market.div_yield_raw)


@register("fill_null_report", with_ctes(
    "SELECT count(*) AS filled_rows, list_sort(list(DISTINCT symbol)) AS symbols, min(trade_date) AS first_date, "
    "max(trade_date) AS last_date FROM div_yield_raw WHERE div_yield IS NULL"))
def q_fill_null_report(spark, sf_dir):
    return CL.fill_null_report(ctx(spark, sf_dir).market.div_yield_raw)


# ---------------------------------------------------------------------------
# 2.C filters and validation
# ---------------------------------------------------------------------------


@register("filter_symbol_universe", with_ctes(
    "SELECT symbol, count(*) AS rows FROM raw_typed WHERE symbol IN ('NIFTY','BANKNIFTY','FINNIFTY','MIDCPNIFTY') "
    "GROUP BY symbol", _RAW))
def q_filter_symbol_universe(spark, sf_dir):
    t = _typed_with_ids(spark, sf_dir)
    return t.filter(F.col("symbol").isin(SYMBOLS)).groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"))


@register("unknown_symbols", with_ctes(
    "SELECT CAST(year(trade_date) AS INT) AS year, list_sort(list(DISTINCT symbol)) AS unknown_symbols FROM raw_typed "
    "WHERE symbol NOT IN ('NIFTY','BANKNIFTY','FINNIFTY','MIDCPNIFTY') GROUP BY 1", _RAW))
def q_unknown_symbols(spark, sf_dir):
    return QA.unknown_symbols(_typed_with_ids(spark, sf_dir))


@register("symbol_set_difference", with_ctes(
    "SELECT DISTINCT symbol FROM raw_typed WHERE symbol NOT IN ('NIFTY','BANKNIFTY','FINNIFTY','MIDCPNIFTY')", _RAW))
def q_symbol_set_difference(spark, sf_dir):
    allowed = spark.createDataFrame([(s,) for s in SYMBOLS], "symbol string")
    return symbol_set_difference(_typed_with_ids(spark, sf_dir), allowed)


def _index_close(spark, sf_dir):
    return FX.raw_index_close(ctx(spark, sf_dir).market)


@register("filter_vix_row", with_ctes("SELECT trade_date, close AS vix_close FROM vix"))
def q_filter_vix_row(spark, sf_dir):
    raw = _index_close(spark, sf_dir)
    v = raw.filter(F.col("Index Name") == "India VIX")
    return v.select(CL.parse_date("Index Date").alias("trade_date"),
                    F.col("Closing Index Value").try_cast("double").alias("vix_close"))


@register("normalise_symbol", with_ctes("SELECT trade_date, symbol, close FROM p_spot"))
def q_normalise_symbol(spark, sf_dir):
    """Long index names -> symbols via the alias dimension; unknown names
    (another index, the volatility index) are rejected."""
    from .dims import symbol_alias_df
    raw = _index_close(spark, sf_dir).select(
        F.col("Index Name").alias("symbol"), CL.parse_date("Index Date").alias("trade_date"),
        F.col("Closing Index Value").try_cast("double").alias("close"))
    mapped, _rejected = CL.normalise_symbol(raw, symbol_alias_df(spark))
    return mapped.select("trade_date", "symbol", "close")


@register("filter_weekdays", with_ctes("SELECT DISTINCT trade_date FROM bhav WHERE isodow(trade_date) < 6"))
def q_filter_weekdays(spark, sf_dir):
    b = ctx(spark, sf_dir).market.bhav
    return b.select("trade_date").distinct().filter(F.weekday("trade_date") < 5)


@register("filter_date_eq", with_ctes(
    "SELECT * FROM chain WHERE trade_date = (SELECT max(trade_date) FROM chain)"))
def q_filter_date_eq(spark, sf_dir):
    """Chain on one date (the latest): one year's partition, compared on the raw
    DATE column so the predicate reaches the Parquet scan."""
    from .operators.market import on_latest_date
    return on_latest_date(ctx(spark, sf_dir).chain_years).drop("year")


@register("filter_point", with_ctes(
    f"SELECT c.* FROM chain c WHERE EXISTS (SELECT 1 FROM positions p WHERE p.symbol = c.symbol AND "
    "p.trade_date = c.trade_date AND p.expiry_date = c.expiry_date AND p.strike = c.strike AND "
    "p.option_type = c.option_type)"))
def q_filter_point(spark, sf_dir):
    """Exact-contract lookups for every position at once (left-semi)."""
    c = ctx(spark, sf_dir)
    keys = ["symbol", "trade_date", "expiry_date", "strike", "option_type"]
    return c.chain_view.join(c.positions.select(*keys), keys, "left_semi")


@register("filter_since", with_ctes(
    "SELECT * FROM chain WHERE trade_date > (SELECT max(trade_date) FROM chain WHERE year(trade_date) < "
    "(SELECT max(year(trade_date)) FROM chain))"))
def q_filter_since(spark, sf_dir):
    """Rows after the watermark of everything stored before the last year."""
    from .operators.market import since_last_closed_year
    return since_last_closed_year(ctx(spark, sf_dir).chain_years).drop("year")


@register("validate_schema", with_ctes(
    "SELECT 'null_' || k AS rule, n FROM (SELECT 'trade_date' AS k, count(*) FILTER (WHERE trade_date IS NULL) AS n "
    "FROM p_options UNION ALL SELECT 'symbol', count(*) FILTER (WHERE symbol IS NULL) FROM p_options UNION ALL "
    "SELECT 'expiry_date', count(*) FILTER (WHERE expiry_date IS NULL) FROM p_options UNION ALL "
    "SELECT 'strike', count(*) FILTER (WHERE strike IS NULL) FROM p_options UNION ALL "
    "SELECT 'option_type', count(*) FILTER (WHERE option_type IS NULL) FROM p_options) x"))
def q_validate_schema(spark, sf_dir):
    from .schemas import REQUIRED
    p = ctx(spark, sf_dir).processed.options
    return QA.validate_schema(p, REQUIRED["options"], OPTIONS_KEY)


@register("validate_tenor_domain", with_ctes(
    "SELECT trade_date, tenor, price AS yield_pct, 'yield_above_threshold' AS rule FROM gbond_raw WHERE price > 15e0"))
def q_validate_tenor_domain(spark, sf_dir):
    """On the raw quotes (before par-price correction) the 13th-of-month
    rows break the yield domain."""
    g = ctx(spark, sf_dir).market.gbond_raw.withColumnRenamed("price", "yield_pct")
    return QA.validate_tenor_domain(g)


# hand-made bad positions (FIXTURES: "make bad rows by hand")
BAD_POSITIONS = [
    (900, "NIFTY", dt.date(1998, 3, 26), 20000.0, "CE", 0, dt.date(1998, 3, 10), 120.5),
    (900, "SENSEX", dt.date(1998, 3, 26), 20000.0, "CE", 1, dt.date(1998, 3, 10), 120.5),
    (900, "NIFTY", dt.date(1998, 3, 26), 20000.0, "CA", 1, dt.date(1998, 3, 10), 120.5),
    (900, "NIFTY", dt.date(1998, 3, 26), 20000.0, "PE", -1, dt.date(1998, 3, 10), 0.0),
    (900, "NIFTY", dt.date(1998, 3, 26), -5.0, "PE", 2, dt.date(1998, 3, 10), 10.0),
    (900, "NIFTY", dt.date(1998, 3, 26), 0.0, "CE", 2, dt.date(1998, 3, 10), 10.0),
    (900, "NIFTY", dt.date(1998, 3, 1), 20000.0, "PE", 2, dt.date(1998, 3, 10), 10.0),
    (900, None, dt.date(1998, 3, 26), 20000.0, "PE", 2, None, 10.0),
]
_BAD_SQL = ("SELECT * FROM (VALUES " + ",".join(
    "(" + ",".join("NULL" if v is None else (f"DATE '{v}'" if isinstance(v, dt.date) else
                                             (f"{v!r}e0" if isinstance(v, float) else
                                              (f"'{v}'" if isinstance(v, str) else str(v)))) for v in r) + ")"
    for r in BAD_POSITIONS) + ") AS t(portfolio_id, symbol, expiry_date, strike, option_type, quantity, entry_date, entry_price)")


def _positions_with_bad(spark, sf_dir):
    p = ctx(spark, sf_dir).positions.select("portfolio_id", "symbol", "expiry_date", "strike", "option_type",
                                             "quantity", "entry_date", "entry_price")
    bad = spark.createDataFrame(BAD_POSITIONS, p.schema)
    return p.unionByName(bad)


_POS_ALL = [("pos_all", "SELECT portfolio_id, symbol, expiry_date, strike, option_type, quantity, entry_date, "
             f"entry_price FROM positions UNION ALL {_BAD_SQL}")]


def _rules_sql(rules: list[tuple[str, str]]) -> str:
    parts = [f"SELECT portfolio_id, symbol, expiry_date, strike, option_type, quantity, '{n}' AS rule FROM pos_all "
             f"WHERE coalesce({c}, false)" for n, c in rules]
    return " UNION ALL ".join(parts)


_BASE_RULES = [
    ("unknown_symbol", "NOT coalesce(upper(trim(symbol)) IN ('NIFTY','BANKNIFTY','FINNIFTY','MIDCPNIFTY'), false)"),
    ("unknown_option_type", "NOT coalesce(upper(trim(option_type)) IN ('CE','PE','XX'), false)"),
    ("zero_quantity", "quantity = 0"),
    ("non_positive_entry_price", "entry_price <= 0"),
]
_STRICT_RULES = _BASE_RULES + [(f"null_{c}", f"{c} IS NULL") for c in
                               ["symbol", "expiry_date", "strike", "option_type", "quantity", "entry_date",
                                "entry_price"]] + [
    ("negative_strike", "strike < 0"),
    ("option_zero_strike", "upper(trim(option_type)) IN ('CE','PE') AND strike = 0"),
    ("expiry_before_entry", "expiry_date < entry_date"),
]


@register("validate_positions", with_ctes(_rules_sql(_BASE_RULES), _POS_ALL))
def q_validate_positions(spark, sf_dir):
    return QA.validate_positions(_positions_with_bad(spark, sf_dir))


@register("validate_positions_strict", with_ctes(_rules_sql(_STRICT_RULES), _POS_ALL))
def q_validate_positions_strict(spark, sf_dir):
    return QA.validate_positions(_positions_with_bad(spark, sf_dir), strict=True)


BAD_REQUESTS = [("NIFTY", dt.date(1998, 3, 26), dt.date(1998, 3, 20), 252),
                ("SENSEX", dt.date(1998, 3, 26), dt.date(1998, 4, 30), 252),
                ("NIFTY", dt.date(1998, 3, 26), dt.date(1998, 4, 30), 5000)]


@register("validate_request", with_ctes(
    "SELECT symbol, trade_date, expiry_date, lookback, rule FROM (SELECT *, 'expiry_before_trade_date' AS rule FROM r "
    "WHERE coalesce(expiry_date < trade_date, false) UNION ALL SELECT *, 'lookback_out_of_range' FROM r WHERE "
    "NOT coalesce(lookback BETWEEN 10 AND 1260, false) UNION ALL SELECT *, 'unknown_symbol' FROM r WHERE "
    "NOT coalesce(symbol IN ('NIFTY','BANKNIFTY','FINNIFTY','MIDCPNIFTY'), false)) x",
    [("r", "SELECT DISTINCT symbol, trade_date, expiry_date, 252 AS lookback FROM chain UNION ALL SELECT * FROM (VALUES "
      + ",".join(f"('{s}', DATE '{a}', DATE '{b}', {n})" for s, a, b, n in BAD_REQUESTS)
      + ") AS t(symbol, trade_date, expiry_date, lookback)")]))
def q_validate_request(spark, sf_dir):
    """Chain/VaR requests as a table (every chain key + three bad ones)."""
    ch = ctx(spark, sf_dir).chain_view
    req = ch.select("symbol", "trade_date", "expiry_date").distinct().withColumn("lookback", F.lit(252))
    bad = spark.createDataFrame(BAD_REQUESTS, req.schema)
    return QA.validate_request(req.unionByName(bad))


@register("run_counts", with_ctes(
    "SELECT 'processed_options' AS dataset, count(*) AS rows, count(*) FILTER (WHERE settle IS NULL) AS null_settle, "
    "count(*) FILTER (WHERE contracts IS NULL) AS null_contracts FROM p_options"))
def q_run_counts(spark, sf_dir):
    """Row and NULL counters of a sink, taken in the pass that writes it."""
    df = QA.run_counts(ctx(spark, sf_dir).processed.options, "processed_options", ["settle", "contracts"])
    WR.write_table(df, _out(spark, sf_dir, "run_counts"))
    return QA.counters(df)


# ---------------------------------------------------------------------------
# 2.D remaining joins, 2.H set operations
# ---------------------------------------------------------------------------

# Strike-grid periods shifted into the fixture's date range.
FIXTURE_STRIKE_INTERVALS = [
    ("NIFTY", "1995-01-01", None, 50),
    ("BANKNIFTY", "1995-01-01", None, 100),
    ("FINNIFTY", "1997-01-11", "1998-10-18", 100),
    ("FINNIFTY", "1998-10-19", None, 50),
    ("MIDCPNIFTY", "1998-01-24", "1998-12-31", 50),
    ("MIDCPNIFTY", "1999-01-01", None, 25),
]


@register("strike_interval_lookup", with_ctes(
    "SELECT c.trade_date, c.symbol, c.expiry_date, c.strike, c.option_type, s.strike_step FROM chain c "
    "LEFT JOIN (SELECT symbol, CAST(a AS DATE) AS start_date, CAST(b AS DATE) AS end_date, CAST(n AS INT) AS strike_step "
    "FROM (VALUES " + ",".join(f"('{s}','{a}',{('NULL' if b is None else repr(b))},{n})"
                              for s, a, b, n in FIXTURE_STRIKE_INTERVALS)
    + ") AS t(symbol, a, b, n)) s ON c.symbol = s.symbol AND s.start_date <= c.trade_date "
    "AND (s.end_date IS NULL OR s.end_date >= c.trade_date)"))
def q_strike_interval_lookup(spark, sf_dir):
    from .dims import interval_df
    steps = interval_df(spark, FIXTURE_STRIKE_INTERVALS, "strike_step")
    ch = ctx(spark, sf_dir).chain_view.select("trade_date", "symbol", "expiry_date", "strike", "option_type")
    return JN.strike_interval_lookup(ch, steps)


@register("prev_date_scalar", with_ctes(
    "SELECT s.trade_date, s.symbol, s.close, c.prev_date FROM p_spot s JOIN (SELECT trade_date, "
    "lag(trade_date) OVER (ORDER BY trade_date) AS prev_date FROM (SELECT DISTINCT trade_date FROM p_spot) d) c "
    "ON s.trade_date = c.trade_date"))
def q_prev_date_scalar(spark, sf_dir):
    s = ctx(spark, sf_dir).processed.spot.select("trade_date", "symbol", "close")
    return JN.with_prev_trading_date(s, s)


_LOT_HITS_SQL = """SELECT DISTINCT l.symbol, l.start_date, l.end_date, l.lot_size FROM bhav_typed b JOIN lot_size l
  ON b.symbol = l.symbol AND l.start_date <= b.trade_date AND (l.end_date IS NULL OR l.end_date >= b.trade_date)"""


def _lot_events(spark, sf_dir):
    """Lot periods seen in the data: every contract row picks its period."""
    c = ctx(spark, sf_dir)
    lots = c.processed.lot_size
    rows = c.market.contracts.select("symbol", "trade_date")
    lt = lots.select(F.col("symbol").alias("_s"), "start_date", "end_date", "lot_size")
    cond = ((F.col("symbol") == F.col("_s")) & (F.col("start_date") <= F.col("trade_date"))
            & (F.col("end_date").isNull() | (F.col("end_date") >= F.col("trade_date"))))
    return rows.join(F.broadcast(lt), cond).select("symbol", "start_date", "end_date", "lot_size").distinct()


@register("new_events_anti", with_ctes(
    f"SELECT * FROM ({_LOT_HITS_SQL}) e WHERE NOT EXISTS (SELECT 1 FROM lot_size s WHERE s.end_date IS NOT NULL "
    "AND s.symbol = e.symbol AND s.start_date = e.start_date)"))
def q_new_events_anti(spark, sf_dir):
    """Lot events seen in the data but not processed yet (the stored table
    holds only the closed periods)."""
    lots = ctx(spark, sf_dir).processed.lot_size
    return JN.new_keys_anti(_lot_events(spark, sf_dir), lots.filter(F.col("end_date").isNotNull()),
                            ["symbol", "start_date"])


_CAL_SQL = "SELECT DISTINCT trade_date, symbol FROM (SELECT trade_date, symbol FROM p_options UNION ALL SELECT trade_date, symbol FROM p_futures) u"


@register("incremental_by_key", with_ctes(
    f"SELECT c.* FROM ({_CAL_SQL}) c WHERE NOT EXISTS (SELECT 1 FROM ({_CAL_SQL}) s WHERE dayofyear(s.trade_date) <= 300 "
    "AND s.trade_date = c.trade_date AND s.symbol = c.symbol)"))
def q_incremental_by_key(spark, sf_dir):
    """Trade-calendar keys not stored yet (stored: days 1-300 of each year)."""
    from .plans.processed import processed_trade_calendar
    p = ctx(spark, sf_dir).processed
    cal = processed_trade_calendar(p.options, p.futures)
    return INC.incremental_by_key(cal, cal.filter(F.dayofyear("trade_date") <= 300), ["trade_date", "symbol"])


@register("unmatched_market_data", with_ctes(
    "SELECT b.trade_date, b.symbol, b.expiry_date, b.strike, b.option_type, b.l_orderkey, b.l_linenumber, "
    "CASE WHEN s.symbol IS NULL THEN 'no_spot' WHEN y.symbol IS NULL THEN 'no_div_yield' ELSE 'no_rates' END AS reason "
    "FROM (SELECT * FROM bhav WHERE instrument = 'OPTIDX') b "
    "LEFT JOIN p_spot s ON b.trade_date = s.trade_date AND b.symbol = s.symbol "
    "LEFT JOIN p_yield y ON b.trade_date = y.trade_date AND b.symbol = y.symbol "
    "LEFT JOIN (SELECT trade_date FROM p_rates WHERE rate_3m IS NOT NULL AND rate_6m IS NOT NULL AND rate_1y IS NOT NULL) r "
    "ON b.trade_date = r.trade_date WHERE s.symbol IS NULL OR y.symbol IS NULL OR r.trade_date IS NULL"))
def q_unmatched_market_data(spark, sf_dir):
    """Raw option rows the inner market join would silently drop, with why."""
    c = ctx(spark, sf_dir)
    b = c.market.bhav.filter(F.col("instrument") == "OPTIDX").select(
        "trade_date", "symbol", "expiry_date", "strike", "option_type", "l_orderkey", "l_linenumber")
    p = c.processed
    return JN.unmatched_market_data(b, p.spot, p.index_yield, p.gbond)


@register("is_trading_day", with_ctes(
    "SELECT CAST(d AS DATE) AS trade_date, CAST(d AS DATE) IN (SELECT trade_date FROM p_spot) AS is_trading_day "
    "FROM generate_series((SELECT min(trade_date) FROM p_spot), (SELECT max(trade_date) FROM p_spot), "
    "INTERVAL 1 DAY) AS g(d)"))
def q_is_trading_day(spark, sf_dir):
    """Every calendar day of the covered range flagged against the calendar
    (the day range is calendar-sized, generated on one row)."""
    s = ctx(spark, sf_dir).processed.spot
    days = s.agg(F.explode(F.sequence(F.min("trade_date"), F.max("trade_date"))).alias("trade_date"))
    return JN.is_trading_day(days, s)


@register("union_append", with_ctes("SELECT * FROM p_options"))
def q_union_append(spark, sf_dir):
    """Stored years + the new year's raw rows, appended then de-duplicated:
    equals the full processed table."""
    from .plans.processed import processed_options
    c = ctx(spark, sf_dir)
    stored = c.processed.options
    last = stored.agg(F.max(F.year("trade_date"))).scalar()
    old = stored.filter(F.year("trade_date") < last)
    new = processed_options(c.market.options.filter(F.year("trade_date") >= last))
    return dedupe_first(union_append(old, new).withColumn("_seq", F.lit(0)), OPTIONS_KEY, ["_seq"]).drop("_seq")


MANUAL_POSITIONS = [(0, "NIFTY", dt.date(1998, 3, 26), 20000.0, "CE", 2, dt.date(1998, 3, 10), 120.5),
                    (0, "NIFTY", dt.date(1998, 3, 26), 20050.0, "PE", -1, dt.date(1998, 3, 10), 95.25),
                    (0, "NIFTY", dt.date(1998, 3, 30), 0.0, "XX", 1, dt.date(1998, 3, 10), 22150.0)]


@register("union_positions", with_ctes(
    "SELECT portfolio_id, symbol, expiry_date, strike, option_type, quantity, entry_date, entry_price, 'upload' AS source "
    "FROM positions UNION ALL SELECT *, 'manual' FROM (VALUES " + ",".join(
        f"({a}, '{b}', DATE '{c}', {d!r}e0, '{e}', {f}, DATE '{g}', {h!r}e0)" for a, b, c, d, e, f, g, h in MANUAL_POSITIONS)
    + ") AS t(portfolio_id, symbol, expiry_date, strike, option_type, quantity, entry_date, entry_price)"))
def q_union_positions(spark, sf_dir):
    """Uploaded and manually entered positions, validated separately, combined."""
    p = ctx(spark, sf_dir).positions.select("portfolio_id", "symbol", "expiry_date", "strike", "option_type",
                                             "quantity", "entry_date", "entry_price")
    manual = spark.createDataFrame(MANUAL_POSITIONS, p.schema)
    return p.withColumn("source", F.lit("upload")).unionByName(manual.withColumn("source", F.lit("manual")))


# ---------------------------------------------------------------------------
# 2.A sources and sinks (written under the shared checkpoint folder)
# ---------------------------------------------------------------------------


def _out(spark, sf_dir, name):
    return os.path.join(ctx(spark, sf_dir).layers.root, "io", name)


@register("scan_parquet_glob", with_ctes(
    "SELECT trade_date, symbol, expiry_date, strike, option_type, settle FROM p_options"))
def q_scan_parquet_glob(spark, sf_dir):
    """The year-partitioned processed table read as one glob (no partition
    discovery: every file under the folder)."""
    layers = ctx(spark, sf_dir).layers
    layers.options_years  # stored on first use
    root = os.path.join(layers.root, "processed", "options")
    return RD.scan_parquet_glob(spark, root).select("trade_date", "symbol", "expiry_date", "strike",
                                                    "option_type", "settle")


@register("discover_tables", with_ctes(" UNION ALL ".join(
    f"SELECT 'v_{t}' AS view_name, count(*) AS n_rows FROM {t}" for t in FX.TABLES)))
def q_discover_tables(spark, sf_dir):
    """Folder scan -> view registry; one row count per discovered view."""
    tables = RD.discover_tables(spark, sf_dir)
    out = None
    for name, df in tables.items():
        d = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("view_name"), "n_rows")
        out = d if out is None else out.unionByName(d)
    return out


@register("column_pruned_max", with_ctes("SELECT CAST(max(l_shipdate) AS DATE) AS latest_date FROM lineitem"))
def q_column_pruned_max(spark, sf_dir):
    """Reads only the date column (ReadSchema: l_shipdate)."""
    li = ctx(spark, sf_dir).market.table("lineitem")
    return li.agg(F.to_date(F.max("l_shipdate")).alias("latest_date"))


@register("write_year_partitioned", with_ctes("SELECT CAST(year(trade_date) AS INT) AS year, count(*) AS rows FROM chain GROUP BY 1"))
def q_write_year_partitioned(spark, sf_dir):
    """Rows per year partition of the stored curated chain (partition column)."""
    return ctx(spark, sf_dir).chain_years.groupBy("year").agg(F.count(F.lit(1)).alias("rows"))


@register("dim_from_config", with_ctes(
    "SELECT t.symbol, l.start_date, l.end_date, l.lot_size FROM (SELECT DISTINCT symbol FROM bhav_typed) t "
    "LEFT JOIN lot_size l ON t.symbol = l.symbol"))
def q_dim_from_config(spark, sf_dir):
    """The configured lot periods as a dimension for every traded symbol
    (a traded symbol without periods keeps one all-NULL row: the error case)."""
    c = ctx(spark, sf_dir)
    traded = c.market.contracts.select("symbol").distinct()
    return traded.join(F.broadcast(c.market.lot_size), "symbol", "left").select(
        "symbol", "start_date", "end_date", "lot_size")


@register("write_single_table", with_ctes(_CAL_SQL))
def q_write_single_table(spark, sf_dir):
    """The processed trade calendar (a small dimension) written as one file.
    Repeated keys have the same date and symbol, so rows are not de-duplicated first."""
    from .plans.processed import processed_trade_calendar
    m = ctx(spark, sf_dir).market
    path = _out(spark, sf_dir, "trade_calendar_single")
    WR.write_single_table(processed_trade_calendar(m.options, m.futures), path)
    return spark.read.parquet(path)


@register("export_csv", with_ctes(
    "SELECT symbol, trade_date, expiry_date, count(*) AS row_count, count(iv) AS iv_computed_count FROM chain GROUP BY 1, 2, 3"))
def q_export_csv(spark, sf_dir):
    from .operators.market import chain_stats
    path = _out(spark, sf_dir, "chain_stats_csv")
    WR.export_csv(chain_stats(ctx(spark, sf_dir).chain_view).drop("iv_avg"), path)
    return spark.read.option("header", True).schema(
        "symbol string, trade_date date, expiry_date date, row_count bigint, iv_computed_count bigint").csv(path)


@register("read_positions_csv", with_ctes(
    "SELECT symbol, expiry_date, strike, option_type, quantity, entry_date, entry_price FROM positions"))
def q_read_positions_csv(spark, sf_dir):
    path = _out(spark, sf_dir, "positions_csv")
    p = ctx(spark, sf_dir).positions.select("symbol", "expiry_date", "strike", "option_type", "quantity",
                                             "entry_date", "entry_price")
    WR.export_csv(p, path)
    return RD.read_positions_csv(spark, path)


def _landed_bhav(spark, sf_dir, layout: str) -> str:
    """Write the raw feed as CSV in one exchange layout; returns the folder."""
    path = _out(spark, sf_dir, f"bhav_{layout}")
    layout = layout.split("_")[0]
    raw = FX.raw_bhav_legacy(ctx(spark, sf_dir).market).drop("l_orderkey", "l_linenumber", "l_extendedprice")
    if layout == "udiff":
        inv = {v: k for k, v in RD.UDIFF_RENAME.items()}
        legacy_to_ingest = {k: v for k, v in RD.LEGACY_RENAME.items() if k in raw.columns}
        raw = raw.withColumnsRenamed(legacy_to_ingest)
        raw = raw.withColumnsRenamed({c: inv[c] for c in raw.columns if c in inv}).withColumnRenamed(
            "TIMESTAMP", "TradDt").drop("InstrmntType")
    raw.write.mode("overwrite").option("header", True).csv(path)
    return path


_RAW_READ_SQL = with_ctes(
    "SELECT trade_date, symbol, expiry_date, strike, option_type, open, settle, contracts, open_interest, instrument "
    "FROM raw_typed", _RAW)


@register("read_bhavcopy_legacy", _RAW_READ_SQL)
def q_read_bhavcopy_legacy(spark, sf_dir):
    """Landed legacy-layout CSV -> typed rows."""
    ing = RD.read_bhavcopy_legacy(spark, _landed_bhav(spark, sf_dir, "legacy"))
    return RD.type_bhav(ing).select("trade_date", "symbol", "expiry_date", "strike", "option_type", "open", "settle",
                                    "contracts", "open_interest", "instrument")


@register("read_bhavcopy_udiff", _RAW_READ_SQL)
def q_read_bhavcopy_udiff(spark, sf_dir):
    """Landed new-layout CSV -> the same typed rows."""
    ing = RD.read_bhavcopy_udiff(spark, _landed_bhav(spark, sf_dir, "udiff"))
    return RD.type_bhav(ing).select("trade_date", "symbol", "expiry_date", "strike", "option_type", "open", "settle",
                                    "contracts", "open_interest", "instrument")


@register("read_index_close_csv", with_ctes(
    "SELECT trade_date AS Date, CASE symbol WHEN 'NIFTY' THEN 'Nifty 50' WHEN 'BANKNIFTY' THEN 'Nifty Bank' "
    "WHEN 'FINNIFTY' THEN 'Nifty Financial Services' ELSE 'Nifty Midcap Select' END AS Index, open AS Open, "
    "high AS High, low AS Low, close AS Close FROM p_spot"))
def q_read_index_close_csv(spark, sf_dir):
    """One scan of the landed all-index files; the index rows (spot side)."""
    path = _out(spark, sf_dir, "index_close")
    _index_close(spark, sf_dir).write.mode("overwrite").option("header", True).csv(path)
    spot, _vix = RD.read_index_close_csv(spark, path)
    return spot.drop(*RD.ARRIVAL)


@register("read_tenor_csvs", with_ctes("SELECT trade_date AS date, tenor, price FROM gbond_raw"))
def q_read_tenor_csvs(spark, sf_dir):
    """One landed CSV folder per tenor (dd-MM-yyyy dates, '1,234.50%' changes)."""
    g = ctx(spark, sf_dir).market.gbond_raw
    paths = {}
    for tenor in ("3m", "6m", "1y"):
        p = _out(spark, sf_dir, f"gbond_{tenor}")
        (g.filter(F.col("tenor") == tenor)
         .select(F.date_format("trade_date", "dd-MM-yyyy").alias(" Date"), F.col("price").cast("string").alias("Price"),
                 F.col("price").cast("string").alias("Open"), F.col("price").cast("string").alias("High"),
                 F.col("price").cast("string").alias("Low"),
                 F.concat(F.format_number(F.col("price") * 1000.0, 2), F.lit("%")).alias("Change %"))
         .write.mode("overwrite").option("header", True).csv(p))
        paths[tenor] = p
    return RD.read_tenor_csvs(spark, paths).select("date", "tenor", "price")


def _land(spark, sf_dir, name):
    """Every feed as landed CSV files, the exchange rows in arrival order."""
    from .plans.daily import Landing
    m = ctx(spark, sf_dir).market
    root = _out(spark, sf_dir, name)

    def put(df, feed):
        path = os.path.join(root, feed)
        df.write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)
        return path
    raw = FX.raw_bhav_legacy(m, IDS).drop(*IDS)
    g = m.gbond_raw.select("tenor", F.date_format("trade_date", "dd-MM-yyyy").alias("Date"),
                           *[F.col("price").cast("string").alias(c) for c in ("Price", "Open", "High", "Low")],
                           F.lit("0%").alias("Change %"))
    return Landing(
        bhav_legacy=put(raw, "bhav"), index_close=put(FX.raw_index_close(m), "index"),
        index_yield=put(m.div_yield_raw, "yield"),
        gbond={t: put(g.filter(F.col("tenor") == t).drop("tenor"), f"gbond_{t}") for t in ("3m", "6m", "1y")},
        lot_size=put(m.lot_size, "lots"))


_FILES = _RAW + [
    ("f_opt", "SELECT trade_date, symbol, expiry_date, strike, option_type, open, settle, contracts, open_interest, "
     "CAST(datediff('day', trade_date, expiry_date) AS INT) AS dte FROM (SELECT *, row_number() OVER (PARTITION BY trade_date, symbol, "
     "expiry_date, strike, option_type ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS rn FROM raw_typed "
     f"WHERE instrument = 'OPTIDX' AND symbol <> '{FX.UNKNOWN_SYMBOL}') x WHERE rn = 1"),
    ("f_fut", "SELECT trade_date, symbol, expiry_date, open, settle, contracts, open_interest, "
     "CAST(datediff('day', trade_date, expiry_date) AS INT) AS dte FROM (SELECT *, row_number() OVER (PARTITION BY trade_date, symbol, "
     "expiry_date ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS rn FROM raw_typed "
     f"WHERE instrument = 'FUTIDX' AND symbol <> '{FX.UNKNOWN_SYMBOL}') x WHERE rn = 1")]
_FILE_TABLES = {
    "options": "SELECT * FROM f_opt",
    "futures": "SELECT * FROM f_fut",
    "index_spot": "SELECT * FROM p_spot",
    "vix": "SELECT * FROM p_vix",
    "index_yield": "SELECT * FROM p_yield",
    "gbond": "SELECT trade_date, tenor, yield_pct, was_par_price, change_pct FROM p_gbond",
    "lot_size": "SELECT symbol, start_date, end_date, lot_size FROM lot_size",
    "trade_calendar": "SELECT DISTINCT trade_date, symbol FROM f_opt UNION SELECT DISTINCT trade_date, symbol FROM f_fut",
}


def _file_table(name):
    def q(spark, sf_dir):
        from .plans.daily import processed_tables
        df = processed_tables(spark, _land(spark, sf_dir, f"files_{name}"))[name]
        cols = {"options": ["trade_date", "symbol", "expiry_date", "strike", "option_type", "open", "settle", "contracts", "open_interest", "dte"],
                "futures": ["trade_date", "symbol", "expiry_date", "open", "settle", "contracts", "open_interest", "dte"],
                "gbond": ["trade_date", "tenor", "yield_pct", "was_par_price", "change_pct"]}.get(name, df.columns)
        return df.select(*cols)
    q.__doc__ = f"Processed {name} from landed files."
    return q


for _name, _sql in _FILE_TABLES.items():
    register(f"processed_{_name}_from_files", with_ctes(_sql, _FILES))(_file_table(_name))


_F_KEY = "f.trade_date = i.trade_date AND f.symbol = i.symbol AND f.expiry_date = i.expiry_date AND f.strike = i.strike AND f.option_type = i.option_type"
_CURATED_FILES = _FILES + [
    ("f_base", f"SELECT o.*, m.spot, m.div_yield, {interpolate_rate_sql('o.dte', 'm.rate_3m', 'm.rate_6m', 'm.rate_1y')} AS rate, "
     "o.dte / 365e0 AS t_years, m.div_yield / 100e0 AS q FROM f_opt o JOIN p_mkt m ON o.trade_date = m.trade_date AND o.symbol = m.symbol"),
    *iv_ctes("f_base", "fiv")]


@register("curated_from_files", with_ctes(
    "SELECT f.trade_date, f.symbol, f.expiry_date, f.strike, f.option_type, f.open, f.settle, f.dte, f.spot, f.div_yield, f.rate, i.iv "
    f"FROM f_base f LEFT JOIN fiv_out i ON {_F_KEY}", _CURATED_FILES))
def q_curated_from_files(spark, sf_dir):
    """Landed files -> processed -> curated in one job: the whole option chain."""
    from .plans.daily import run_daily
    root = _out(spark, sf_dir, "daily_job")
    run_daily(spark, _land(spark, sf_dir, "files_daily"), root, mode="full")
    got = spark.read.parquet(os.path.join(root, "curated", "option_chain"))
    return got.select("trade_date", "symbol", "expiry_date", "strike", "option_type", "open", "settle", "dte", "spot",
                      "div_yield", "rate", "iv")


@register("audit_derivatives_feed", with_ctes(
    "SELECT count(*) AS rows, count(*) FILTER (WHERE settle IS NULL) AS null_CLOSE, count(*) FILTER (WHERE settle IS NULL) AS null_SETTLE_PR, "
    "count(*) FILTER (WHERE expiry_date IS NULL) AS null_EXPIRY_DT, count(*) FILTER (WHERE instrument = 'FUTIDX') AS null_STRIKE_PR, "
    "count(*) FILTER (WHERE option_type IS NULL) AS null_OPTION_TYP, count(*) FILTER (WHERE settle = 0) AS zero_close FROM raw_typed", _RAW))
def q_audit_derivatives_feed(spark, sf_dir):
    """NULL and zero audit of the landed exchange rows, before typing."""
    ing = RD.read_bhavcopy_legacy(spark, _landed_bhav(spark, sf_dir, "legacy_audit"))
    return QA.audit_feed(ing)


@register("bond_daily_change", with_ctes(
    "SELECT trade_date, tenor, price, CASE WHEN prev IS NOT NULL AND prev <> 0 THEN round((price - prev) / prev * 100e0, 2) END AS change_pct "
    "FROM (SELECT *, lag(price) OVER (PARTITION BY tenor ORDER BY trade_date) AS prev FROM gbond_raw) x"))
def q_bond_daily_change(spark, sf_dir):
    """Daily bond change in %, on price, 2 dp."""
    from .operators.market import bond_daily_change
    return bond_daily_change(ctx(spark, sf_dir).market.gbond_raw)


@register("missing_lot_sizes", with_ctes(
    "SELECT p.portfolio_id, p.symbol, p.trade_date, p.quantity, CASE WHEN p.symbol IN (SELECT symbol FROM lot_size) "
    "THEN 'no_period' ELSE 'unknown_symbol' END AS reason FROM pos_lot p WHERE p.lot_size_missing"))
def q_missing_lot_sizes(spark, sf_dir):
    """Strict lot lookup: positions without a lot period, and why."""
    c = ctx(spark, sf_dir)
    return JN.missing_lot_sizes(c.positions, c.processed.lot_size).select(
        "portfolio_id", "symbol", "trade_date", "quantity", "reason")


MANIFEST = {"model": "black-scholes-merton", "day_count": 365, "interpolation": "linear-3-pillar", "lookback": 252, "driver_symbol": "NIFTY"}


def _manifest_sql():
    from . import oracle as O
    from .queryset import _PNL_R
    params = ", ".join(f"'{k}': {v!r}" for k, v in MANIFEST.items())
    cols = ["portfolio_id", "trade_date", "scenario_count", "var_95", "var_99", "cvar_95", "cvar_99", "mean_pnl", "min_pnl", "max_pnl"]
    row = ", ".join(f"'{c}': {c}" for c in cols)
    return with_ctes(f"SELECT CAST(to_json({{'params': {{{params}}}, 'summary': {{{row}}}}}) AS VARCHAR) AS value FROM ({O.var_cvar_sql('r')}) v", _PNL_R)


@register("run_manifest", _manifest_sql())
def q_run_manifest(spark, sf_dir):
    """One JSON audit line per portfolio of a VaR run (parameters + summary)."""
    from .queryset import q_portfolio_var
    m = WR.run_manifest(q_portfolio_var(spark, sf_dir), MANIFEST)
    WR.write_manifest(m, _out(spark, sf_dir, "manifest"))
    return m


# ---------------------------------------------------------------------------
# 2.M freshness
# ---------------------------------------------------------------------------


def _datasets(spark, sf_dir):
    c = ctx(spark, sf_dir)
    m, p = c.market, c.processed
    empty = p.vix.limit(0)
    return {
        ("ingest", "derivatives"): FX.raw_bhav_legacy(m).select(F.col("TradDt").alias("TIMESTAMP")),
        ("ingest", "index_spot"): m.spot.select(F.col("trade_date").alias("Date")),
        ("ingest", "index_yield"): m.div_yield_raw.select(F.date_format("trade_date", "yyyy-MM-dd").alias("DATE")),
        ("ingest", "gbond"): m.gbond_raw.select(F.col("trade_date").alias("date")),
        ("ingest", "events"): m.table("events").select(F.col("ts").alias("date")),
        ("processed", "options"): p.options, ("processed", "futures"): p.futures, ("processed", "vix"): p.vix,
        ("processed", "lot_size"): p.lot_size, ("processed", "empty"): empty,
        ("curated", "option_chain"): c.chain_view, ("curated", "futures"): c.futures,
    }


_LATEST_SQL = """SELECT 'ingest' AS layer, 'derivatives' AS dataset, max(trade_date) AS latest_date FROM bhav_typed
UNION ALL SELECT 'ingest', 'index_spot', max(trade_date) FROM spot
UNION ALL SELECT 'ingest', 'index_yield', max(trade_date) FROM div_yield_raw
UNION ALL SELECT 'ingest', 'gbond', max(trade_date) FROM gbond_raw
UNION ALL SELECT 'ingest', 'events', CAST(max(ts) AS DATE) FROM events
UNION ALL SELECT 'processed', 'options', max(trade_date) FROM p_options
UNION ALL SELECT 'processed', 'futures', max(trade_date) FROM p_futures
UNION ALL SELECT 'processed', 'vix', max(trade_date) FROM p_vix
UNION ALL SELECT 'processed', 'lot_size', CAST(NULL AS DATE)
UNION ALL SELECT 'processed', 'empty', CAST(NULL AS DATE)
UNION ALL SELECT 'curated', 'option_chain', max(trade_date) FROM chain
UNION ALL SELECT 'curated', 'futures', max(trade_date) FROM cfut"""


@register("latest_by_dataset", with_ctes(_LATEST_SQL))
def q_latest_by_dataset(spark, sf_dir):
    return FR.latest_by_dataset(_datasets(spark, sf_dir))


@register("expected_date", with_ctes(f"SELECT max(latest_date) AS expected_date FROM ({_LATEST_SQL}) x"))
def q_expected_date(spark, sf_dir):
    return FR.latest_by_dataset(_datasets(spark, sf_dir)).agg(F.max("latest_date").alias("expected_date"))


def _sync_sql(date_from: str | None, date_to: str | None) -> str:
    lat = "latest_date" if date_from is None else f"CASE WHEN latest_date >= DATE '{date_from}' THEN latest_date END"
    exp = "max(l) OVER ()" if date_to is None else f"least(max(l) OVER (), DATE '{date_to}')"
    return (f"SELECT layer, dataset, l AS latest_date, e AS expected_date, CASE WHEN l IS NULL THEN 'NO DATA' "
            f"WHEN l >= e THEN 'IN SYNC' ELSE 'OUT OF SYNC' END AS status, CAST(datediff('day', l, e) AS INT) AS days_behind "
            f"FROM (SELECT layer, dataset, l, {exp} AS e FROM (SELECT layer, dataset, {lat} AS l FROM ({_LATEST_SQL}) a) b) c")


@register("sync_report", with_ctes(_sync_sql(None, None)))
def q_sync_report(spark, sf_dir):
    return FR.sync_report(FR.latest_by_dataset(_datasets(spark, sf_dir)))


WINDOW = ("2001-01-01", "2001-06-30")


@register("window_filter", with_ctes(_sync_sql(*WINDOW)))
def q_window_filter(spark, sf_dir):
    """Sync report restricted to a [from, to] window (stale -> NO DATA, expected clamped)."""
    return FR.sync_report(FR.latest_by_dataset(_datasets(spark, sf_dir)), *WINDOW)


# ---------------------------------------------------------------------------
# 2.N incremental and streaming
# ---------------------------------------------------------------------------

_OPT_COLS = "trade_date, symbol, expiry_date, strike, option_type, settle"


@register("incremental_hwm", with_ctes(
    f"SELECT {_OPT_COLS} FROM p_options o LEFT JOIN (SELECT year(trade_date) AS y, max(trade_date) AS hwm FROM p_options "
    "WHERE dayofyear(trade_date) <= 300 GROUP BY 1) h ON year(o.trade_date) = h.y WHERE h.hwm IS NULL OR o.trade_date > h.hwm"))
def q_incremental_hwm(spark, sf_dir):
    """Stored: each year up to day 300; new batch: everything -> only rows
    past each year's mark survive."""
    p = ctx(spark, sf_dir).options_years
    stored = p.filter(F.dayofyear("trade_date") <= 300)
    return INC.incremental_hwm(p, stored).select(*[c.strip() for c in _OPT_COLS.split(",")])


@register("incremental_hwm_min2", with_ctes(
    f"SELECT {_OPT_COLS} FROM p_options o LEFT JOIN (SELECT coalesce(a.y, b.y) AS y, least(a.h, b.h) AS hwm FROM "
    "(SELECT year(trade_date) AS y, max(trade_date) AS h FROM p_options WHERE dayofyear(trade_date) <= 300 GROUP BY 1) a "
    "FULL JOIN (SELECT year(trade_date) AS y, max(trade_date) AS h FROM p_futures WHERE dayofyear(trade_date) <= 250 "
    "GROUP BY 1) b ON a.y = b.y) h ON year(o.trade_date) = h.y WHERE h.hwm IS NULL OR o.trade_date > h.hwm"))
def q_incremental_hwm_min2(spark, sf_dir):
    """Options lag futures: the smaller mark wins so the laggard catches up."""
    p = ctx(spark, sf_dir).processed
    a = p.options.filter(F.dayofyear("trade_date") <= 300)
    b = p.futures.filter(F.dayofyear("trade_date") <= 250)
    return INC.incremental_hwm_min2(p.options, a, b).select(*[c.strip() for c in _OPT_COLS.split(",")])


@register("upsert_partitioned", with_ctes(f"SELECT {_OPT_COLS} FROM p_options"))
def q_upsert_partitioned(spark, sf_dir):
    """Store days 1-300 of every year, then upsert the whole processed batch
    (keep-first: stored rows win); the table equals the full processed table."""
    p = ctx(spark, sf_dir).processed.options
    path = _out(spark, sf_dir, "upsert_options")
    first = p.filter(F.dayofyear("trade_date") <= 300).withColumn("_seq", F.lit(0))
    WR.write_year_partitioned(first, path, OPTIONS_KEY)
    INC.upsert_partitioned(spark, p.withColumn("_seq", F.lit(1)), path, OPTIONS_KEY, ["_seq"], "first")
    return spark.read.parquet(path).select(*[c.strip() for c in _OPT_COLS.split(",")])


@register("rebuild_full", with_ctes(f"SELECT {_OPT_COLS} FROM p_options"))
def q_rebuild_full(spark, sf_dir):
    from .plans.processed import processed_options
    c = ctx(spark, sf_dir)
    path = _out(spark, sf_dir, "rebuild_options")
    INC.rebuild_full(lambda: processed_options(c.market.options), path, OPTIONS_KEY)
    return spark.read.parquet(path).select(*[x.strip() for x in _OPT_COLS.split(",")])


@register("idempotency", with_ctes(f"SELECT {_OPT_COLS}, CAST(NULL AS VARCHAR) AS _side FROM p_options WHERE false"))
def q_idempotency(spark, sf_dir):
    """Upserting the same batch twice changes nothing: the diff is empty."""
    p = ctx(spark, sf_dir).processed.options
    path = _out(spark, sf_dir, "idem_options")
    b = p.withColumn("_seq", F.lit(0))
    WR.write_year_partitioned(b, path, OPTIONS_KEY, rebalance=False)  # dealt out by key
    snap = _out(spark, sf_dir, "idem_snapshot")
    spark.read.parquet(path).write.mode("overwrite").parquet(snap)
    INC.upsert_partitioned(spark, b, path, OPTIONS_KEY, ["_seq"], "first")
    diff = INC.same_rows_by_year(spark.read.parquet(snap), spark.read.parquet(path))
    return diff.select(*[c.strip() for c in _OPT_COLS.split(",")], "_side")


@register("stream_landing_files", with_ctes(
    "SELECT trade_date, symbol, expiry_date, strike, option_type, settle FROM (SELECT *, row_number() OVER "
    "(PARTITION BY trade_date, symbol, expiry_date, strike, option_type ORDER BY l_orderkey, l_linenumber, "
    "l_extendedprice) AS rn FROM raw_typed WHERE instrument = 'OPTIDX') x WHERE rn = 1", _RAW))
def q_stream_landing_files(spark, sf_dir):
    """Raw feed landed as one CSV folder per month, year after year, the columns of every
    other month in another order; an availableNow stream reads each file by its own header,
    drops repeated records, types, and upserts (keep-first by arrival) every micro-batch into
    the year-partitioned options table."""
    from .streaming.landing import run_landing_to_table
    root = _out(spark, sf_dir, "landing")
    m = ctx(spark, sf_dir).market
    cols = FX.raw_bhav_legacy(m).columns
    odd = F.pmod(F.hash("_m"), F.lit(2)) == 1
    year = F.year("trade_date")
    years = sorted((r[0] for r in m.options.unionByName(m.futures).select(year).distinct().collect()), key=lambda y: y or 0)
    for y in years:  # the stream takes files in order of time, so a micro-batch holds a year or two
        raw = FX.raw_bhav_legacy(m, where=year.eqNullSafe(F.lit(y))).withColumn("_m", F.substring("TradDt", 1, 7))
        for name, part, order in (("a", raw.where(odd), cols), ("b", raw.where(~odd), cols[::-1])):
            (part.select(*order, "_m").write.mode("overwrite" if y == years[0] else "append").partitionBy("_m")
             .option("header", True).option("compression", "gzip").csv(os.path.join(root, "files", name)))
    table = os.path.join(root, "table")

    def transform(batch):
        t = _type_raw(batch)
        return t.filter(F.col("instrument") == "OPTIDX").select(
            "trade_date", "symbol", "expiry_date", "strike", "option_type", "settle", *IDS)

    run_landing_to_table(spark, os.path.join(root, "files"), cols, table, os.path.join(root, "checkpoint"),
                         transform, OPTIONS_KEY, ["l_orderkey", "l_linenumber", "l_extendedprice"], stored_first=False)
    return spark.read.parquet(table).select("trade_date", "symbol", "expiry_date", "strike", "option_type", "settle")


