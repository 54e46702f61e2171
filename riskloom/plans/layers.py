"""Layers: processed and curated tables as views, stored where a read needs the files.

A query that reads a large table once gets it as a plan over the raw tables, pruned
to the columns it uses: writing and re-reading the table would move more bytes than
that.  Reads that prune by year, and the opt-in bucketed chain, use a table that is
written on first use under the shared folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import functools
import hashlib
import os
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..fixtures import Market
from ..schemas import CURATED_OPTION_COLUMNS, OPTIONS_KEY
from ..session import scratch_path
from ..sources.writers import (ensure_bucketed_table, strike_key, write_bucketed_year_table, write_table,
                               write_year_partitioned)
from .curated import ProcessedLayer, curated_futures, curated_option_chain
from .processed import OPTION_COLUMNS

_RUN = uuid.uuid4().hex[:12]
_LOCK = threading.Lock()
_BUILT: dict[str, tuple | None] = {}  # folder of a stored table -> schema and buckets of the bucketed chain

# The curated chain is bucketed on the contract key (strike as an integer
# key) so position -> chain joins shuffle only the position side.
CHAIN_BUCKET_KEY = ["symbol", "trade_date", "expiry_date", "strike_key", "option_type"]
BUCKETS_CONF = "spark.riskloom.chain.buckets"


def layer_root(spark: SparkSession, sf_dir: str) -> str:
    h = hashlib.sha1(os.path.abspath(sf_dir).encode()).hexdigest()[:10]
    return scratch_path(spark, f"riskloom-layers/{_RUN}/{h}")


class Layers:
    """The layers of one ``sf_dir``: views over the raw tables, and stored copies made on first use.

    ``processed``, ``positions``, ``chain_view`` and ``futures`` are lazy plans, so a query
    moves and computes only the columns it reads, and no query pays for tables it does not
    read.  Stored are the calendar-sized ``daily_by_symbol`` and, when first asked for,
    ``options_years`` and ``chain_years`` (year-partitioned, for reads that prune by year).
    """

    def __init__(self, spark: SparkSession, sf_dir: str, market: Market | None = None):
        self.spark = spark
        self.root = layer_root(spark, sf_dir)
        m = market or Market(spark, sf_dir)
        m.use_ingest(self._stored("ingest/daily_by_symbol", lambda path: write_table(m.daily_by_symbol, path)))
        self.processed = ProcessedLayer.from_market(m)
        self.positions = m.positions
        self.chain_view = curated_option_chain(self.processed)
        self.futures = curated_futures(self.processed)

    def _stored(self, name: str, write) -> DataFrame:
        path = os.path.join(self.root, name)
        with _LOCK:
            if path not in _BUILT:
                write(path)
                _BUILT[path] = None
        return self.spark.read.parquet(path)

    @functools.cached_property
    def options_years(self) -> DataFrame:
        """Processed options + their partition column, stored."""
        d = self._stored("processed/options", lambda path: write_year_partitioned(self.processed.options, path, OPTIONS_KEY, rebalance=False))
        return d.select(*OPTION_COLUMNS, "year")

    @functools.cached_property
    def chain_years(self) -> DataFrame:
        """The chain + its partition column, stored."""
        # opt-in: bucket the chain on the contract key (worth it when a large
        # chain is joined to positions many times; at small scale the bucketed
        # write and fixed-width scans cost more than the shuffle they save)
        n = self._buckets
        if n > 0:
            return self._bucketed(n).select(*CURATED_OPTION_COLUMNS, "year")
        d = self._stored("curated/option_chain", lambda path: write_year_partitioned(self.chain_view, path, OPTIONS_KEY, rebalance=False))
        return d.select(*CURATED_OPTION_COLUMNS, "year")

    @property
    def chain(self) -> DataFrame:
        """The stored chain."""
        return self.chain_years.select(*CURATED_OPTION_COLUMNS)

    @property
    def chain_keyed(self) -> DataFrame:
        """The stored chain with ``year``, and with ``strike_key`` if it is bucketed."""
        n = self._buckets
        return self._bucketed(n) if n > 0 else self.chain_years

    @property
    def chain_joined(self) -> DataFrame:
        """The chain for one join on the contract key: the bucketed table if it is opted for, else the view."""
        n = self._buckets
        return self._bucketed(n) if n > 0 else self.chain_view

    @property
    def _buckets(self) -> int:
        return int(self.spark.conf.get(BUCKETS_CONF, "0") or 0)

    def _bucketed(self, n: int) -> DataFrame:
        path = os.path.join(self.root, "curated", "option_chain")
        table = "riskloom_chain_" + os.path.basename(os.path.dirname(self.root)) + "_" + os.path.basename(self.root)
        with _LOCK:
            have = _BUILT.get(path)
            if have is None or have[1] != n:
                write_bucketed_year_table(self.chain_view.withColumn("strike_key", strike_key()), table, path, CHAIN_BUCKET_KEY, n)
                _BUILT[path] = (self.spark.table(table).schema, n)
            ensure_bucketed_table(self.spark, table, path, _BUILT[path][0], CHAIN_BUCKET_KEY, n)
        return self.spark.table(table)


def materialize(spark: SparkSession, sf_dir: str, market: Market | None = None) -> Layers:
    """The layers over ``sf_dir``; what they store is written when it is first read."""
    return Layers(spark, sf_dir, market)
