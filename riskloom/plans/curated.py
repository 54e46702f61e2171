"""Curated layer: option chain with rate, IV and Greeks; futures with fair value.

One lazy plan per table::

    processed options ─┐
    spot ⋈ yield ⋈ pivot(gbond) ── size-checked broadcast ──┴─ join ─> rate ─> IV (Arrow) ─> Greeks

No shuffle of the big contract table is needed for the market join; the
processed layer already guarantees one row per contract key, so no second
de-duplication shuffle is needed either.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..fixtures import Market
from ..operators.joins import curate_join
from ..operators.pricing import curate_greeks, futures_fair_value, with_rate
from ..schemas import CURATED_FUTURES_COLUMNS, CURATED_OPTION_COLUMNS
from . import processed as P


@dataclass
class ProcessedLayer:
    options: DataFrame
    futures: DataFrame
    spot: DataFrame
    index_yield: DataFrame
    gbond: DataFrame
    vix: DataFrame
    lot_size: DataFrame

    @classmethod
    def from_market(cls, m: Market) -> "ProcessedLayer":
        return cls(
            options=P.processed_options(m.options),
            futures=P.processed_futures(m.futures),
            spot=m.spot,
            index_yield=P.processed_index_yield(m.div_yield_raw),
            gbond=P.processed_gbond(m.gbond_raw),
            vix=m.vix,
            lot_size=m.lot_size,
        )


def curated_rates(contracts: DataFrame, p: ProcessedLayer) -> DataFrame:
    """contracts ⋈ market inputs, plus the interpolated decimal ``rate``."""
    j = curate_join(contracts, p.spot, p.index_yield, p.gbond)
    return with_rate(j).drop("rate_3m", "rate_6m", "rate_1y")


def curated_option_chain(p: ProcessedLayer) -> DataFrame:
    return curate_greeks(curated_rates(p.options, p)).select(*CURATED_OPTION_COLUMNS)


def curated_futures(p: ProcessedLayer) -> DataFrame:
    return futures_fair_value(curated_rates(p.futures, p)).select(*CURATED_FUTURES_COLUMNS)
