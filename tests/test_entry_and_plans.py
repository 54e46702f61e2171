"""Driver contract, end-to-end queries on sf0.001 vs DuckDB, plan shape."""
import math

import pytest

import __spark_entry__ as E
from riskloom.catalog import ctx
from riskloom.schemas import CURATED_OPTION_COLUMNS


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == CURATED_OPTION_COLUMNS
    assert df.count() > 0


def test_registry_consistent():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 130


ORACLE_SAMPLE = ["curate_greeks", "portfolio_risk", "portfolio_var", "dedupe_first", "index_change",
                 "shock_grid", "upsert_partitioned", "stream_landing_files", "sync_report"]


@pytest.mark.parametrize("name", ORACLE_SAMPLE)
def test_oracle_agreement(spark, sf_small, name):
    from tools.check_oracle import close, duck, key, norm
    sdf = E.queries()[name](spark, sf_small)
    srows = sorted([tuple(norm(v) for v in r) for r in sdf.collect()], key=key)
    rel = duck(sf_small).sql(E.oracle_sql()[name])
    idx = [rel.columns.index(c) for c in sdf.columns]
    drows = sorted([tuple(norm(r[i]) for i in idx) for r in rel.fetchall()], key=key)
    assert len(srows) == len(drows)
    assert all(close(a, b) for a, b in zip(srows, drows))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_chain_plan_has_no_python_node_and_broadcast_dims(spark, sf_small):
    from riskloom.plans.curated import curated_option_chain
    p = _plan(curated_option_chain(ctx(spark, sf_small).processed))
    assert "Python" not in p and "Arrow" not in p
    assert "BroadcastHashJoin" in p
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_year_predicate_prunes_partitions(spark, sf_small):
    from pyspark.sql import functions as F
    ch = ctx(spark, sf_small).chain
    import os
    root = os.path.join(ctx(spark, sf_small).layers.root, "curated", "option_chain")
    df = spark.read.parquet(root).filter((F.col("year") == 1998) & (F.col("trade_date") >= "1998-06-01"))
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in p and "PushedFilters: [IsNotNull(trade_date)" in p
    assert ch.count() > 0


def test_registered_queries_prune_by_year(spark, sf_small):
    q = E.queries()
    for name in ("filter_date_eq", "filter_since"):
        q[name](spark, sf_small).count()
        p = q[name](spark, sf_small)._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        assert "PartitionFilters: [isnotnull(year" in p, name
    for name in ("latest_date_by_year", "available_years", "incremental_hwm"):
        assert "year(trade_date" not in _plan(q[name](spark, sf_small)).split("HashAggregate")[1], name


def test_var_plan_has_no_cartesian(spark, sf_small):
    p = _plan(E.queries()["portfolio_var"](spark, sf_small))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "Exchange" not in p  # one array per portfolio and date: VaR is a projection
    from riskloom.operators import var as V
    c = ctx(spark, sf_small)
    p = _plan(V.scenario_vectors(c.positions, c.chain_keyed, c.futures, c.processed.lot_size, c.processed.spot))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert p.count("MapInArrow") == 1 and "Generate explode" not in p  # no row per leg and scenario


def test_position_join_shuffles_only_positions(spark, sf_small):
    """With the chain bucketed on the contract key (opt-in layout), joining
    positions to it adds an exchange on the position side only."""
    import uuid

    from riskloom.operators import portfolio as PF
    from riskloom.plans.layers import CHAIN_BUCKET_KEY
    from riskloom.session import scratch_path
    from riskloom.sources.writers import strike_key, write_bucketed_year_table
    c = ctx(spark, sf_small)
    name = "riskloom_chain_test_" + uuid.uuid4().hex[:8]
    write_bucketed_year_table(c.chain.withColumn("strike_key", strike_key()), name,
                              scratch_path(spark, name), CHAIN_BUCKET_KEY, 8)
    keyed = spark.table(name)
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        o, _ = PF.resolve_positions(PF.net_positions(c.positions), keyed, c.futures, c.processed.lot_size)
        p = _plan(o)
        plain, _ = PF.resolve_positions(PF.net_positions(c.positions), c.chain, c.futures, c.processed.lot_size)
        cols = sorted(o.columns)
        assert cols == sorted(plain.columns)
        key = lambda r: tuple("" if v is None else str(v) for v in r)
        assert sorted(o.select(*cols).collect(), key=key) == sorted(plain.select(*cols).collect(), key=key)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)
    assert "SortMergeJoin" in p and "Bucketed: true" in p
    chain_scan = [ln for ln in p.split("\n") if name in ln]
    assert chain_scan and all("Exchange" not in ln for ln in chain_scan)
    assert p.count("Exchange hashpartitioning(symbol") == 1
