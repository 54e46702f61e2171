"""Small dimension tables built from configuration literals.

Everything here is a few dozen rows at most and is therefore safe to
broadcast: the sizes are fixed by configuration, not by the data.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the source system's configuration)
# ---------------------------------------------------------------------------

# Index universe, in display order.
SYMBOLS = ["NIFTY", "BANKNIFTY", "FINNIFTY", "MIDCPNIFTY"]

# Long display name per symbol.
DISPLAY_NAMES = {
    "NIFTY": "Nifty 50",
    "BANKNIFTY": "Nifty Bank",
    "FINNIFTY": "Nifty Financial Services",
    "MIDCPNIFTY": "Nifty Midcap Select",
}

# Source spellings of the index names -> internal symbol.
SYMBOL_ALIASES = {
    "NIFTY": "NIFTY",
    "BANKNIFTY": "BANKNIFTY",
    "FINNIFTY": "FINNIFTY",
    "MIDCPNIFTY": "MIDCPNIFTY",
    "Nifty 50": "NIFTY",
    "Nifty Bank": "BANKNIFTY",
    "Nifty Financial Services": "FINNIFTY",
    "Nifty Fin Service": "FINNIFTY",
    "Nifty Midcap Select": "MIDCPNIFTY",
    "NIFTY BANK": "BANKNIFTY",
    "NIFTY FIN SERVICE": "FINNIFTY",
    "NIFTY MID SELECT": "MIDCPNIFTY",
}

# Exchange lot-size periods: (symbol, start, end or None = open, lot size).
LOT_PERIODS = [
    ("NIFTY", "2019-01-01", "2021-04-29", 75),
    ("NIFTY", "2021-04-30", "2024-04-25", 50),
    ("NIFTY", "2024-04-26", "2024-11-19", 25),
    ("NIFTY", "2024-11-20", "2025-10-27", 75),
    ("NIFTY", "2025-10-28", None, 65),
    ("BANKNIFTY", "2019-01-01", "2020-05-03", 20),
    ("BANKNIFTY", "2020-05-04", "2023-04-27", 25),
    ("BANKNIFTY", "2023-04-28", "2024-11-19", 15),
    ("BANKNIFTY", "2024-11-20", "2025-04-24", 30),
    ("BANKNIFTY", "2025-04-25", "2025-10-27", 35),
    ("BANKNIFTY", "2025-10-28", None, 30),
    ("FINNIFTY", "2021-01-11", "2024-04-25", 40),
    ("FINNIFTY", "2024-04-26", "2024-11-19", 25),
    ("FINNIFTY", "2024-11-20", "2025-10-27", 65),
    ("FINNIFTY", "2025-10-28", None, 60),
    ("MIDCPNIFTY", "2022-01-24", "2024-04-25", 75),
    ("MIDCPNIFTY", "2024-04-26", "2024-11-19", 50),
    ("MIDCPNIFTY", "2024-11-20", "2025-04-24", 120),
    ("MIDCPNIFTY", "2025-04-25", "2025-10-27", 140),
    ("MIDCPNIFTY", "2025-10-28", None, 120),
]

# Strike grid step per symbol and period.
STRIKE_INTERVALS = [
    ("NIFTY", "2019-01-01", None, 50),
    ("BANKNIFTY", "2019-01-01", None, 100),
    ("FINNIFTY", "2021-01-11", "2022-10-18", 100),
    ("FINNIFTY", "2022-10-19", None, 50),
    ("MIDCPNIFTY", "2022-01-24", "2022-12-31", 50),
    ("MIDCPNIFTY", "2023-01-01", None, 25),
]

# Government-bond tenors and their day counts.
TENOR_DAYS = {"3m": 91, "6m": 182, "1y": 365}

# A bond "yield" above this many percent is really a par price.
PAR_PRICE_THRESHOLD = 15.0

# Option types: calls, puts, and the futures marker.
OPTION_TYPES = ["CE", "PE"]
POSITION_TYPES = ["CE", "PE", "XX"]

# Name of the volatility index row in the all-index close file.
VIX_INDEX_NAME = "India VIX"

# ---------------------------------------------------------------------------

INTERVAL_SCHEMA = T.StructType(
    [
        T.StructField("symbol", T.StringType(), False),
        T.StructField("start_date", T.DateType(), False),
        T.StructField("end_date", T.DateType(), True),
        T.StructField("lot_size", T.IntegerType(), False),
    ]
)


def _d(s: str | None) -> _dt.date | None:
    return None if s is None else _dt.date.fromisoformat(s)


def interval_df(spark: SparkSession, rows, value_name: str = "lot_size") -> DataFrame:
    data = [(s, _d(a), _d(b), int(v)) for s, a, b, v in rows]
    df = spark.createDataFrame(data, INTERVAL_SCHEMA)
    return df.withColumnRenamed("lot_size", value_name) if value_name != "lot_size" else df


def lot_size_df(spark: SparkSession, rows=None) -> DataFrame:
    """Lot-size periods as a dimension (``dim_from_config``)."""
    return interval_df(spark, rows if rows is not None else LOT_PERIODS)


def strike_interval_df(spark: SparkSession) -> DataFrame:
    return interval_df(spark, STRIKE_INTERVALS, "strike_step")


def symbol_alias_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        sorted(SYMBOL_ALIASES.items()), "alias string, symbol string"
    )


def symbol_dim(spark: SparkSession) -> DataFrame:
    """symbol, display order (1-based), long name."""
    return spark.createDataFrame(
        [(s, i + 1, DISPLAY_NAMES[s]) for i, s in enumerate(SYMBOLS)],
        "symbol string, sym_order int, display_name string",
    )


def tenor_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TENOR_DAYS.items()), "tenor string, tenor_days int")
