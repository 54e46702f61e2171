import datetime as dt

import pytest
from pyspark.sql import functions as F

from riskloom.dims import lot_size_df
from riskloom.fixtures import FIXTURE_LOT_PERIODS
from riskloom.operators.dedupe import dedupe, dedupe_count
from riskloom.operators.joins import lot_size_asof
from riskloom.operators.quality import lot_size_gaps, lot_size_overlaps, validate_positions
from riskloom.operators.freshness import sync_report


def test_dedupe_first_last_deterministic(spark):
    rows = [("a", 1, 3, "x3"), ("a", 1, 1, "x1"), ("a", 1, 2, "x2"), (None, 2, 5, "n5"), (None, 2, 4, "n4")]
    df = spark.createDataFrame(rows, "k string, j int, seq int, v string").repartition(3)
    first = {(r.k, r.j): r.v for r in dedupe(df, ["k", "j"], ["seq"], "first").collect()}
    last = {(r.k, r.j): r.v for r in dedupe(df, ["k", "j"], ["seq"], "last").collect()}
    assert first == {("a", 1): "x1", (None, 2): "n4"}
    assert last == {("a", 1): "x3", (None, 2): "n5"}
    c = dedupe_count(df, ["k", "j"]).collect()[0]
    assert (c.rows_in, c.distinct_keys, c.rows_dropped) == (5, 2, 3)


def test_lot_size_asof_bounds_gap_and_default(spark):
    lots = lot_size_df(spark, FIXTURE_LOT_PERIODS)
    pos = spark.createDataFrame([
        ("NIFTY", dt.date(1997, 4, 29)), ("NIFTY", dt.date(1997, 4, 30)), ("NIFTY", dt.date(2030, 1, 1)),
        ("BANKNIFTY", dt.date(1999, 5, 15)), ("FINNIFTY", dt.date(1996, 1, 1)),
    ], "symbol string, trade_date date")
    out = {(r.symbol, r.trade_date): (r.lot_size, r.lot_size_missing) for r in lot_size_asof(pos, lots).collect()}
    assert out[("NIFTY", dt.date(1997, 4, 29))] == (75, False)
    assert out[("NIFTY", dt.date(1997, 4, 30))] == (50, False)
    assert out[("NIFTY", dt.date(2030, 1, 1))] == (25, False)
    assert out[("BANKNIFTY", dt.date(1999, 5, 15))] == (1, True)
    assert out[("FINNIFTY", dt.date(1996, 1, 1))] == (1, True)


def test_lot_checks(spark):
    lots = lot_size_df(spark, FIXTURE_LOT_PERIODS)
    gaps = lot_size_gaps(lots).collect()
    assert [(g.symbol, g.issue) for g in gaps] == [("BANKNIFTY", "gap")]
    assert lot_size_overlaps(lots).count() == 0
    bad = lot_size_df(spark, FIXTURE_LOT_PERIODS + [("NIFTY", "1999-01-01", "1998-12-01", 10)])
    assert {r.issue for r in lot_size_overlaps(bad).collect()} == {"end_before_start"}


def test_building_a_plan_runs_no_job(spark, sf_small):
    """Joins are planned without counting their sides first."""
    from riskloom.catalog import ctx
    from riskloom.plans.curated import curated_option_chain
    p = ctx(spark, sf_small).processed
    sc = spark.sparkContext
    sc.setJobGroup("plan-only", "")
    try:
        curated_option_chain(p)
        assert list(sc.statusTracker().getJobIdsForGroup("plan-only")) == []
    finally:
        sc._jsc.clearJobGroup()


def test_large_lots_do_not_overflow(spark):
    from riskloom.operators.portfolio import net_positions
    rows = [(1, "NIFTY", dt.date(2024, 1, 2), dt.date(2024, 1, 25), 1.0, "CE", 2_000_000_000)] * 2
    df = spark.createDataFrame(rows, "portfolio_id int, symbol string, trade_date date, expiry_date date, strike double, option_type string, quantity int")
    assert net_positions(df).first().quantity == 4_000_000_000


def test_validate_positions_rules(spark):
    rows = [(1, "nifty ", dt.date(2026, 3, 24), 22500.0, "ce", 2, dt.date(2026, 3, 10), 120.5),
            (1, "SENSEX", dt.date(2026, 3, 24), 22500.0, "CE", 0, dt.date(2026, 3, 10), 0.0),
            (1, "NIFTY", dt.date(2026, 3, 24), 0.0, "XY", 1, dt.date(2026, 3, 10), 10.0)]
    df = spark.createDataFrame(rows, "portfolio_id int, symbol string, expiry_date date, strike double, "
                                     "option_type string, quantity int, entry_date date, entry_price double")
    rules = sorted(r.rule for r in validate_positions(df).collect())
    assert rules == ["non_positive_entry_price", "unknown_option_type", "unknown_symbol", "zero_quantity"]


def test_sync_report_statuses(spark):
    lat = spark.createDataFrame([("a", "x", dt.date(2024, 1, 5)), ("a", "y", dt.date(2024, 1, 3)), ("b", "z", None)],
                                "layer string, dataset string, latest_date date")
    st = {r.dataset: r.status for r in sync_report(lat).collect()}
    assert st == {"x": "IN SYNC", "y": "OUT OF SYNC", "z": "NO DATA"}
    st2 = {r.dataset: (r.status, r.expected_date) for r in sync_report(lat, "2024-01-04", "2024-01-04").collect()}
    assert st2["y"][0] == "NO DATA" and st2["x"] == ("IN SYNC", dt.date(2024, 1, 4))


def _schedule(spark, n=300):
    """Periods without overlap for many symbols: gaps, one-day periods, an open end for some, an empty period."""
    import datetime as dt
    import random
    rng, rows = random.Random(5), []
    for k in range(n):
        day = dt.date(2019, 1, 1) + dt.timedelta(rng.randint(0, 300))
        for i in range(rng.randint(1, 6)):
            end = day + dt.timedelta(rng.choice([0, 3, 40, 400]))
            rows.append((f"S{k}", day, end, 10 * i + 5))
            day = end + dt.timedelta(rng.choice([1, 1, 90]))
        if k % 3:
            rows.append((f"S{k}", day, None, 99))
        rows.append((f"S{k}", dt.date(2018, 5, 2), dt.date(2018, 5, 1), 7))
    return spark.createDataFrame(rows, "symbol string, start_date date, end_date date, lot_size int")


def test_interval_join_of_a_large_schedule_equals_the_broadcast_one(spark):
    from riskloom.operators.joins import lot_size_asof, strike_interval_lookup
    lots = _schedule(spark)
    df = spark.range(6000).selectExpr("id", "if(id % 3 = 0, 'S1', concat('S', id % 310)) as symbol",
                                      "if(id % 97 = 0, null, date_add(date'2018-04-01', cast(id * 7 % 2500 as int))) as trade_date")
    a, b = (lot_size_asof(df, lots, configuration=c) for c in (True, False))
    assert b.count() == 6000 and b.select("id").distinct().count() == 6000
    assert a.exceptAll(b.select(*a.columns)).count() == 0
    steps = lots.withColumnRenamed("lot_size", "strike_step")
    c, d = (strike_interval_lookup(df, steps, configuration=x) for x in (True, False))
    assert c.exceptAll(d.select(*c.columns)).count() == 0
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lot_size_asof(df, lots, configuration=False)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Broadcast" not in plan and "NestedLoop" not in plan and "SortMergeJoin" in plan
