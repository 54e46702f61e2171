"""The daily job: landed files -> processed -> curated tables, full or incremental.

``mode="full"`` recomputes every year.  ``mode="incremental"`` finds, per
year, the latest stored date (high-water mark) and runs the market join,
IV solve and Greeks only for processed rows after it, then upserts them.
``late="upsert"`` takes instead every processed row that is not stored with
the same values, whatever its date, so late rows of closed years and
corrections are derived and replace what is stored (keep-last).  Both end with
the freshness report.
"""

from __future__ import annotations

import dataclasses
import os

from pyspark.sql import DataFrame, SparkSession

from .. import storage
from ..operators.freshness import latest_by_dataset, sync_report
from ..operators.quality import fail_fast, validate_schema, validate_tenor_domain
from ..schemas import FUTURES_KEY, KEEP_POLICY, KEYS, OPTIONS_KEY, REQUIRED
from ..sources import readers as RD
from ..streaming.incremental import incremental_hwm, late_rows, rebuild_full, upsert_partitioned
from . import processed as P
from .curated import ProcessedLayer, curated_futures, curated_option_chain
from .processed import FUTURES_COLUMNS, OPTION_COLUMNS


@dataclasses.dataclass
class Landing:
    """Folders of landed files; a feed that is not there is None."""

    bhav_legacy: str | None = None
    bhav_udiff: str | None = None
    index_close: str | None = None
    index_yield: str | None = None
    gbond: dict[str, str] | None = None
    lot_size: str | None = None


def processed_tables(spark: SparkSession, landing: Landing) -> dict[str, DataFrame]:
    """The processed tables of the landed files, as lazy plans."""
    out: dict[str, DataFrame] = {}
    order = RD.ARRIVAL
    if landing.bhav_legacy or landing.bhav_udiff:
        typed = RD.type_bhav(RD.read_bhavcopy(spark, landing.bhav_legacy, landing.bhav_udiff))
        out["options"], out["futures"] = P.processed_derivatives(typed, order)
        # dates and symbols are the same before de-duplication, and need no shuffle of the rows
        out["trade_calendar"] = P.processed_trade_calendar(*P.known_derivatives(typed))
    if landing.index_close:
        spot, vix = RD.read_index_close_csv(spark, landing.index_close)
        out["index_spot"], out["vix"] = P.processed_index_spot(spot, order), P.processed_vix(vix, order)
    if landing.index_yield:
        out["index_yield"] = P.processed_index_yield_rows(RD.read_index_yield_csv(spark, landing.index_yield), order)
    if landing.gbond:
        out["gbond"] = P.processed_gbond_rows(RD.read_tenor_csvs(spark, landing.gbond), order)
    if landing.lot_size:
        out["lot_size"] = P.processed_lot_size(RD.read_lot_size_csv(spark, landing.lot_size), order)
    return out


def checked(name: str):
    """Validation of a table about to be stored: required columns, no NULL
    key, tenor domain; a violation is an error and nothing is stored."""
    def check(df: DataFrame) -> None:
        fail_fast(validate_schema(df, REQUIRED[name], KEYS[name]).filter("n > 0"))
        if name == "gbond":
            fail_fast(validate_tenor_domain(df))
    return check


def store(df: DataFrame, root: str, name: str, mode: str, late: str = "hwm") -> None:
    """Store a table: all of it, or only its new (``hwm``) or changed (``upsert``) rows."""
    spark = df.sparkSession
    path, keys = os.path.join(root, name), KEYS[name]
    date = "start_date" if name == "lot_size" else "trade_date"
    if mode == "full" or not storage.has_data(spark, path):
        rebuild_full(lambda: df, path, keys, date, check=checked(name))
        return
    stored = spark.read.parquet(path)
    policy = "last" if late == "upsert" else KEEP_POLICY[name]
    new = late_rows(df, stored, keys) if late == "upsert" else incremental_hwm(df, stored, date)
    upsert_partitioned(spark, new, path, keys, keep=policy, date_col=date, check=checked(name))


def run_processed(spark: SparkSession, landing: Landing, root: str, mode: str = "incremental",
                  late: str = "hwm") -> ProcessedLayer:
    """Landed files -> validated processed tables under ``root``; the stored layer."""
    for name, df in processed_tables(spark, landing).items():
        store(df, root, name, mode, late)

    def read(name: str) -> DataFrame:
        return spark.read.parquet(os.path.join(root, name)).drop("year")
    return ProcessedLayer(options=read("options"), futures=read("futures"), spot=read("index_spot"),
                          index_yield=read("index_yield"), gbond=read("gbond"), vix=read("vix"), lot_size=read("lot_size"))


def run_daily(spark: SparkSession, landing: Landing, root: str, mode: str = "incremental", late: str = "hwm") -> DataFrame:
    """The whole job: landed files -> processed -> curated; returns the freshness report."""
    layer = run_processed(spark, landing, os.path.join(root, "processed"), mode, late)
    return run_curated(spark, layer, os.path.join(root, "curated"), mode, late)


def run_curated(spark: SparkSession, processed: ProcessedLayer, out_root: str, mode: str = "incremental",
                late: str = "hwm") -> DataFrame:
    """Build / update ``out_root/option_chain`` and ``out_root/futures``;
    returns the freshness report of the two tables."""
    chain_path = os.path.join(out_root, "option_chain")
    fut_path = os.path.join(out_root, "futures")
    have = storage.has_data(spark, chain_path) and storage.has_data(spark, fut_path)
    if mode == "full" or not have:
        rebuild_full(lambda: curated_option_chain(processed), chain_path, OPTIONS_KEY, check=checked("option_chain"))
        rebuild_full(lambda: curated_futures(processed), fut_path, FUTURES_KEY, check=checked("curated_futures"))
    else:
        stored_c = spark.read.parquet(chain_path)
        stored_f = spark.read.parquet(fut_path)
        if late == "upsert":
            new_o = late_rows(processed.options, stored_c, OPTIONS_KEY, OPTION_COLUMNS)
            new_f = late_rows(processed.futures, stored_f, FUTURES_KEY, FUTURES_COLUMNS)
        else:
            new_o = incremental_hwm(processed.options, stored_c)
            new_f = incremental_hwm(processed.futures, stored_f)
        keep = "last" if late == "upsert" else "first"
        p2 = dataclasses.replace(processed, options=new_o, futures=new_f)
        upsert_partitioned(spark, curated_option_chain(p2), chain_path, OPTIONS_KEY, keep=keep)
        upsert_partitioned(spark, curated_futures(p2), fut_path, FUTURES_KEY, keep=keep)
    report = latest_by_dataset({
        ("processed", "options"): processed.options, ("processed", "futures"): processed.futures,
        ("curated", "option_chain"): spark.read.parquet(chain_path),
        ("curated", "futures"): spark.read.parquet(fut_path),
    })
    return sync_report(report)
