"""The daily feeds of the landing stream: derivatives (both exchange layouts), index closes, bond tenors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.clean import parse_date
from ..schemas import OPTIONS_KEY
from ..sources.readers import INDEX_CLOSE_COLUMNS, LEGACY_RENAME, UDIFF_RENAME, standardise_bhav, type_bhav
from .landing import ARRIVAL, Feed, named

#: Source column -> ingest column of both layouts; a file has the columns of one of them.
BHAV_RENAME = {**LEGACY_RENAME, **UDIFF_RENAME, "TradDt": "TIMESTAMP"}
BOND_COLUMNS = ["Date", "Price", "Open", "High", "Low"]


def derivatives(records: DataFrame) -> DataFrame:
    """Typed contract rows, options and futures, from files of either layout."""
    sources = list(dict.fromkeys([*BHAV_RENAME, *BHAV_RENAME.values()]))
    own = named(records, sources)
    return type_bhav(standardise_bhav(own, BHAV_RENAME))


def index_closes(records: DataFrame) -> DataFrame:
    d = named(records, INDEX_CLOSE_COLUMNS)
    num = lambda c: F.col(f"`{c} Index Value`").try_cast("double")
    return d.select(parse_date("`Index Date`").alias("trade_date"), F.col("`Index Name`").alias("index_name"),
                    num("Open").alias("open"), num("High").alias("high"), num("Low").alias("low"), num("Closing").alias("close"), *ARRIVAL)


def bonds(records: DataFrame) -> DataFrame:
    """The tenor is the name of the file's folder, after its last underscore."""
    d = named(records, BOND_COLUMNS)
    return d.select(parse_date("Date").alias("trade_date"),
                    F.lower(F.regexp_extract("_file", r"([^/_]+)/[^/]*$", 1)).alias("tenor"),
                    *[F.col(c).try_cast("double").alias(c.lower()) for c in BOND_COLUMNS[1:]], *ARRIVAL)


def exchange_feeds(root: str) -> list[Feed]:
    """Feeds into tables below ``root``."""
    return [
        Feed("derivatives", ["XpryDt", "StrkPric", "ClsPric"], derivatives, f"{root}/derivatives", OPTIONS_KEY),
        Feed("index_closes", ["Index Name", "Index Date", "Closing Index Value"], index_closes, f"{root}/index", ["trade_date", "index_name"], keep="last"),
        Feed("bonds", BOND_COLUMNS, bonds, f"{root}/bonds", ["trade_date", "tenor"], keep="last"),
    ]
