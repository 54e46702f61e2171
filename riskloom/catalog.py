"""Registry of named queries: Spark implementation + oracle SQL.

Each query is ``fn(spark, sf_dir) -> DataFrame`` over the whole input
tables; ``oracle`` is DuckDB SQL over the same parquet tables (or None for
operators that are not SQL-expressible and get a rows-only check).
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .fixtures import Market
from .plans.curated import ProcessedLayer

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass
class Query:
    name: str
    fn: QueryFn
    oracle: str | None


REGISTRY: dict[str, Query] = {}


def register(name: str, oracle: str | None):
    def deco(fn):
        REGISTRY[name] = Query(name, fn, oracle)
        return fn
    return deco


class Context:
    """Per-(session, sf_dir) lazily built layers shared by the queries."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self.market = Market(spark, sf_dir)
        self._pnl: dict[tuple[int, str | None], DataFrame] = {}

    @functools.cached_property
    def layers(self):
        """Processed + curated tables: views, and copies stored on first use."""
        from .plans.layers import materialize
        return materialize(self.spark, self.sf_dir, self.market)

    @property
    def raw_processed(self) -> ProcessedLayer:
        """Processed layer as a lazy plan over the raw fixture (not persisted)."""
        return ProcessedLayer.from_market(self.market)

    @property
    def processed(self) -> ProcessedLayer:
        return self.layers.processed

    @property
    def chain(self) -> DataFrame:
        """The stored chain."""
        return self.layers.chain

    @property
    def chain_view(self) -> DataFrame:
        """The chain as a plan over the raw tables, for queries that read it once."""
        return self.layers.chain_view

    @property
    def chain_years(self) -> DataFrame:
        """The chain with its partition column: filters on ``year`` prune files."""
        return self.layers.chain_years

    @property
    def options_years(self) -> DataFrame:
        return self.layers.options_years

    @property
    def chain_keyed(self) -> DataFrame:
        return self.layers.chain_keyed

    @property
    def futures(self) -> DataFrame:
        return self.layers.futures

    @property
    def positions(self) -> DataFrame:
        return self.layers.positions

    def scenario_vectors(self, lookback: int, driver: str | None) -> DataFrame:
        """Scenario PnL of every portfolio and valuation date, one array each, stored on first use."""
        from .operators.var import scenario_vectors
        from .sources.writers import write_table
        key = (lookback, driver)
        if key not in self._pnl:
            path = f"{self.layers.root}/risk/pnl_{lookback}_{driver or 'own'}"
            write_table(scenario_vectors(self.positions, self.layers.chain_joined, self.futures, self.processed.lot_size,
                                         self.processed.spot, lookback, driver), path)
            self._pnl[key] = self.spark.read.parquet(path)
        return self._pnl[key]

    def scenario_pnl(self, lookback: int, driver: str | None) -> DataFrame:
        """The same, one row per scenario."""
        from .operators.var import flat_pnl
        return flat_pnl(self.scenario_vectors(lookback, driver))


_CTX: dict[tuple[str, str], Context] = {}


def ctx(spark: SparkSession, sf_dir: str) -> Context:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CTX:
        _CTX[key] = Context(spark, sf_dir)
    return _CTX[key]


def _load() -> None:
    from . import queryset, queryset_ingest, queryset_pricing  # noqa: F401  (register everything)


def queries() -> dict[str, QueryFn]:
    _load()
    return {n: q.fn for n, q in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {n: q.oracle for n, q in REGISTRY.items() if q.oracle is not None}
