"""Layers: a query pays only for what it reads."""
import os

import pytest

import __spark_entry__ as E
from riskloom import storage
from riskloom.operators.dedupe import dedupe
from riskloom.plans import layers as L


@pytest.fixture
def fresh(spark, monkeypatch):
    from riskloom import catalog
    monkeypatch.setattr(L, "_RUN", "test-" + os.urandom(6).hex())
    monkeypatch.setattr(catalog, "_CTX", {})
    return spark


def _stored(spark, sf):
    root = L.layer_root(spark, sf)
    return {f"{a}/{b}" for a, _, is_dir in storage.children(spark, root) if is_dir
            for b, _, _ in storage.children(spark, os.path.join(root, a))}


def test_queries_store_only_what_they_read(fresh, sf_small):
    assert E.queries()["norm_pdf"](fresh, sf_small).count() > 0
    assert _stored(fresh, sf_small) == {"ingest/daily_by_symbol"}
    E.queries()["latest_date_by_year"](fresh, sf_small)
    assert _stored(fresh, sf_small) == {"ingest/daily_by_symbol", "curated/option_chain"}


def test_market_join_shuffles_contracts_once(fresh, sf_small):
    before = fresh.conf.get("spark.sql.autoBroadcastJoinThreshold")
    fresh.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")  # as if the calendar were beyond the threshold
    try:
        p = E.queries()["iv_valid"](fresh, sf_small)._jdf.queryExecution().executedPlan().toString()
    finally:
        fresh.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in p and p.count("Exchange hashpartitioning(trade_date") <= 2


def test_dedupe_order_columns_are_carried_once(spark):
    d = spark.createDataFrame([(1, 2, "b", None), (1, 1, "a", 5), (1, None, "c", 6), (None, 3, "d", 7)], "k int, o int, v string, w int")
    got = lambda keep: {tuple(r) for r in dedupe(d, ["k"], ["o"], keep).collect()}
    assert got("first") == {(1, None, "c", 6), (None, 3, "d", 7)}
    assert got("last") == {(1, 2, "b", None), (None, 3, "d", 7)}
    assert [tuple(r) for r in dedupe(d.select("k", "o"), ["k"], ["o"]).where("k = 1").collect()] == [(1, None)]


def test_trade_calendar_file_needs_no_deduplicated_rows(spark, sf_small, monkeypatch):
    """Dates and symbols are the same before de-duplication, whose arrival order is then not read."""
    import __spark_entry__ as E
    from riskloom.sources import writers as W
    plans, write = [], W.write_single_table

    def seen(df, path):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        write(df, path)
    monkeypatch.setattr(W, "write_single_table", seen)
    rows = E.queries()["write_single_table"](spark, sf_small).collect()
    assert rows and "l_shipdate" in plans[0] and "l_extendedprice" not in plans[0]
