"""Table schemas, keys and de-duplication policies."""

from __future__ import annotations

from pyspark.sql import types as T

OPTIONS_KEY = ["trade_date", "symbol", "expiry_date", "strike", "option_type"]
FUTURES_KEY = ["trade_date", "symbol", "expiry_date"]
SPOT_KEY = ["trade_date", "symbol"]
YIELD_KEY = ["trade_date", "symbol"]
GBOND_KEY = ["trade_date", "tenor"]
VIX_KEY = ["trade_date"]
LOT_KEY = ["symbol", "start_date"]
CALENDAR_KEY = ["trade_date", "symbol"]

KEYS = {
    "options": OPTIONS_KEY, "futures": FUTURES_KEY, "option_chain": OPTIONS_KEY, "curated_futures": FUTURES_KEY,
    "index_spot": SPOT_KEY, "vix": VIX_KEY, "index_yield": YIELD_KEY, "gbond": GBOND_KEY, "lot_size": LOT_KEY,
    "trade_calendar": CALENDAR_KEY,
}

# keep policy per table: derivatives keep the first arrival, upserted
# market feeds keep the last.
KEEP_POLICY = {
    "options": "first", "futures": "first", "option_chain": "first", "curated_futures": "first",
    "index_spot": "last", "vix": "last", "index_yield": "last", "gbond": "last",
    "lot_size": "first", "trade_calendar": "first",
}

CURATED_OPTION_COLUMNS = [
    "trade_date", "symbol", "expiry_date", "strike", "option_type", "open", "high", "low",
    "close", "settle", "contracts", "open_interest", "chg_in_oi", "dte", "spot", "div_yield",
    "rate", "iv", "delta", "gamma", "vega", "theta", "rho",
]
CURATED_FUTURES_COLUMNS = [
    "trade_date", "symbol", "expiry_date", "open", "high", "low", "close", "settle",
    "contracts", "open_interest", "chg_in_oi", "dte", "spot", "div_yield", "rate",
    "theoretical_price", "basis", "delta",
]

_D = T.DoubleType()
_S = T.StringType()
_DT = T.DateType()
_L = T.LongType()
_I = T.IntegerType()


def struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nl) for n, t, nl in fields])


PROCESSED_OPTIONS = struct(
    ("trade_date", _DT, False), ("symbol", _S, False), ("expiry_date", _DT, False),
    ("strike", _D, False), ("option_type", _S, False), ("open", _D, True), ("high", _D, True),
    ("low", _D, True), ("close", _D, True), ("settle", _D, True), ("contracts", _L, True),
    ("open_interest", _L, True), ("chg_in_oi", _L, True), ("dte", _I, True),
)

POSITIONS = struct(
    ("symbol", _S, True), ("expiry_date", _DT, True), ("strike", _D, True),
    ("option_type", _S, True), ("quantity", _I, True), ("entry_date", _DT, True),
    ("entry_price", _D, True),
)

REQUIRED = {
    "options": PROCESSED_OPTIONS.fieldNames(),
    "futures": [c for c in PROCESSED_OPTIONS.fieldNames() if c not in ("strike", "option_type")],
    "index_spot": ["trade_date", "symbol", "open", "high", "low", "close"],
    "vix": ["trade_date", "close"],
    "index_yield": ["trade_date", "symbol", "div_yield"],
    "gbond": ["trade_date", "tenor", "yield_pct", "open", "high", "low", "change_pct"],
    "lot_size": ["symbol", "start_date", "end_date", "lot_size"],
    "trade_calendar": ["trade_date", "symbol"],
    "option_chain": CURATED_OPTION_COLUMNS,
    "curated_futures": CURATED_FUTURES_COLUMNS,
    "positions": ["symbol", "expiry_date", "strike", "option_type", "quantity", "entry_date",
                  "entry_price"],
}
