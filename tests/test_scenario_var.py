import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators.scenario import scenario_futures, scenario_option, with_shock
from riskloom.operators.var import last_known, numbered_returns, var_cvar

SNAP = "spot double, strike double, dte int, rate double, div_yield double, iv double, option_type string, " \
       "delta double, gamma double, vega double, theta double, rho double, multiplier int"


def _opt(spark, rows, shock):
    df = spark.createDataFrame(rows, SNAP)
    return {r.option_type + str(r.dte): r for r in scenario_option(with_shock(df, *shock)).collect()}


def test_zero_shock_zero_pnl(spark):
    rows = [(22000.0, 22000.0, 30, 0.065, 1.2, 0.18, t, 0.5, 0.002, 8.5, -5.0, 3.2, 75) for t in ("CE", "PE")]
    out = _opt(spark, rows, (0.0, 0.0, 0.0))
    for r in out.values():
        assert r.method == "full_reprice" and abs(r.pnl_total) < 1e-6


def test_method_cascade(spark):
    rows = [
        (22000.0, 22000.0, 0, 0.065, 1.2, 0.18, "CE", 0.5, 0.002, 8.5, -5.0, 3.2, 75),    # expired
        (22000.0, 22000.0, 30, 0.065, 1.2, None, "PE", -0.5, 0.002, 8.5, -5.0, -3.2, 75),  # greeks
        (22000.0, 22000.0, 31, 0.065, 1.2, None, "PE", None, None, None, None, None, 75),  # no data
    ]
    out = _opt(spark, rows, (1.0, 2.0, 25.0))
    assert out["CE0"].method == "expired" and out["CE0"].pnl_total == 0.0
    g = out["PE30"]
    dS = 22000 * 0.01
    assert g.method == "greeks_approx"
    assert g.pnl_per_lot == pytest.approx(-0.5 * dS + 0.5 * 0.002 * dS * dS + 8.5 * 2.0 + -3.2 * 0.25)
    assert out["PE31"].method == "no_data" and out["PE31"].pnl_total == 0.0


def test_call_gains_put_loses_on_up_move(spark):
    rows = [(22000.0, 22000.0, 30, 0.065, 1.2, 0.18, t, None, None, None, None, None, 1) for t in ("CE", "PE")]
    out = _opt(spark, rows, (2.0, 0.0, 0.0))
    assert out["CE30"].pnl_total > 0 > out["PE30"].pnl_total


def test_futures_linear(spark):
    df = spark.createDataFrame([(22000.0, 75)], "spot double, multiplier int")
    r = scenario_futures(with_shock(df, -2.0, 5.0, 100.0)).collect()[0]
    assert r.method == "futures_linear" and r.pnl_total == pytest.approx(-440.0 * 75)


def test_var_cvar_against_numpy(spark):
    rng = np.random.default_rng(42)
    pnl = np.round(rng.normal(0, 10000, 252), 2)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(pnl)], "portfolio_id int, scenario_date int, portfolio_pnl double")
    r = var_cvar(df).collect()[0]
    v95, v99 = -np.percentile(pnl, 5), -np.percentile(pnl, 1)
    assert r.var_95 == pytest.approx(round(v95, 2), abs=0.011)
    assert r.var_99 == pytest.approx(round(v99, 2), abs=0.011)
    assert r.cvar_95 == pytest.approx(round(-pnl[pnl < -v95].mean(), 2), abs=0.011)
    assert r.var_99 >= r.var_95 and r.cvar_95 >= r.var_95 and r.cvar_99 >= r.var_99
    assert r.scenario_count == 252


def test_cvar_falls_back_to_var(spark):
    df = spark.createDataFrame([(1, i, -500.0) for i in range(10)], "portfolio_id int, scenario_date int, portfolio_pnl double")
    r = var_cvar(df).collect()[0]
    assert r.var_95 == r.cvar_95 == 500.0


def test_scenarios_end_at_the_valuation_date(spark):
    import datetime as dt
    day = lambda i: dt.date(2024, 1, i)
    spot = spark.createDataFrame([("NIFTY", day(i), float(100 + i)) for i in (1, 2, 3, 5)], "symbol string, trade_date date, close double")
    r = numbered_returns(spot)
    assert [(x.n, x.scenario_date) for x in r.orderBy("n").collect()] == [(1, day(2)), (2, day(3)), (3, day(5))]
    asked = spark.createDataFrame([("NIFTY", day(i)) for i in (1, 3, 4, 9)], "driver_symbol string, trade_date date")
    assert {x.trade_date: x.last_n for x in last_known(r, asked).collect()} == {day(1): 0, day(3): 2, day(4): 2, day(9): 3}


def test_scenario_rank_query_keeps_every_scenario(spark, sf_small):
    from riskloom import queryset as Q
    ranked = Q.q_scenario_rank(spark, sf_small)
    group = ["portfolio_id", "trade_date"]
    got = {tuple(r[:2]): tuple(r[2:]) for r in ranked.groupBy(*group).agg(F.count("*"), F.max("loss_rank"), F.countDistinct("loss_rank")).collect()}
    want = {tuple(r[:2]): (r[2],) * 3 for r in Q._pnl(spark, sf_small).groupBy(*group).count().collect()}
    assert got == want and max(n for n, _, _ in want.values()) > 5


def _by_rows(c, lookback, driver):
    """Scenario PnL with one row per leg and scenario, through the single-contract operator."""
    from riskloom.operators import var as V
    from riskloom.operators.portfolio import net_positions, resolve_positions
    spark = c.spark
    opt, fut = resolve_positions(net_positions(c.positions), c.chain_keyed, c.futures, c.processed.lot_size)
    r, drv = numbered_returns(c.processed.spot), V.driver_map(spark, driver)

    def expand(d):
        known = last_known(r, d.select("trade_date", "symbol").distinct().join(drv, "symbol"))
        d = d.join(drv, "symbol").join(known, ["driver_symbol", "trade_date"]).join(r.withColumnRenamed("driver_symbol", "drv"), (
            F.col("driver_symbol") == F.col("drv")) & (F.col("n") <= F.col("last_n")) & (F.col("n") > F.col("last_n") - lookback))
        return d.withColumns({"vol_shock_abs": F.lit(0.0), "rate_shock_bps": F.lit(0.0)})
    cols = ["portfolio_id", "trade_date", "scenario_date", "pnl_total"]
    u = scenario_option(expand(opt)).select(*cols).unionByName(scenario_futures(expand(fut)).select(*cols))
    return u.groupBy(*cols[:3]).agg(F.sum("pnl_total").alias("want"))


@pytest.mark.parametrize("driver,lookback", [("NIFTY", 30), (None, 17)])
def test_vectors_equal_row_by_row_pricing(spark, sf_small, driver, lookback):
    from riskloom import catalog
    from riskloom.operators import var as V
    c = catalog.ctx(spark, sf_small)
    v = V.scenario_vectors(c.positions, c.chain_keyed, c.futures, c.processed.lot_size, c.processed.spot, lookback, driver, partitions=5)
    key = ["portfolio_id", "trade_date", "scenario_date"]
    both = V.flat_pnl(v).join(_by_rows(c, lookback, driver), key, "full").select(
        F.count(F.lit(1)).alias("n"), F.max(F.coalesce(F.abs(F.col("portfolio_pnl") - F.col("want")), F.lit(1e9))).alias("d")).first()
    assert both.n > 1000 and both.d < 1e-6
    flat = V.flat_pnl(v)
    for a, b in ((V.var_cvar_vectors(v), V.var_cvar(flat, V.GROUP)), (V.rank_vectors(v), V.scenario_rank(flat, V.GROUP)),
                 (V.worst_best_vectors(v), V.worst_best_days(flat, V.GROUP))):
        a, b = a.select(*b.columns), b
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_a_hot_portfolio_or_date_makes_no_hot_task(spark):
    from riskloom.operators import var as V
    legs = spark.range(60000).selectExpr(
        "if(id % 3 = 0, 1, id % 997) as portfolio_id", "date_add(date'2024-01-01', cast(if(id % 3 = 0, 7, id % 200) as int)) as trade_date",
        "'NIFTY' as symbol", "date'2025-01-01' as expiry_date", "cast(id % 5000 as double) as strike", "'CE' as option_type")
    sizes = legs.groupBy("trade_date").agg(F.count(F.lit(1)).alias("legs"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        d = V.dealt(legs, sizes, 8)
        n = sorted(r["count"] for r in d.groupBy(F.spark_partition_id()).count().collect())
        whole = d.select("trade_date", "strike", F.spark_partition_id().alias("p")).distinct()
        assert whole.groupBy("trade_date", "strike").count().where("count > 1").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(n) == 8 and n[-1] <= 2 * n[4]


def test_exact_ranks_by_counting(spark):
    from riskloom.operators import var as V
    rng = np.random.default_rng(3)
    groups = {1: rng.integers(-10**12, 10**12, 500), 2: np.array([5]), 3: np.repeat([-7, 0, 7], 40), 4: rng.integers(0, 50, 300)}
    df = spark.createDataFrame([(g, int(x)) for g, xs in groups.items() for x in xs] + [(1, None)], "g int, v long")
    ranks = [(g, f"r{k}", k) for g, xs in groups.items() for k in {0, len(xs) // 20, len(xs) - 1}]
    got = V.exact_ranks(df, ["g"], "v", spark.createDataFrame(ranks, "g int, target string, rank long"), bins=16)
    assert {(r.g, r.target): r.value for r in got.collect()} == {(g, t): int(np.sort(groups[g])[k]) for g, t, k in ranks}


def test_pooled_var_against_numpy(spark):
    from riskloom.operators import var as V
    rng = np.random.default_rng(4)
    rows = [(g, float(x)) for g, s in ((1, 1e4), (2, 3.0), (3, 0.0)) for x in np.round(rng.normal(0, 1, 1000) * s, 2)]
    out = V.pooled_var(spark.createDataFrame(rows, "portfolio_id int, portfolio_pnl double")).collect()
    for r in out:
        x = np.array([v for g, v in rows if g == r.portfolio_id])
        assert r.scenario_count == 1000
        assert r.var_95 == pytest.approx(-np.percentile(x, 5), abs=0.0051) and r.var_99 == pytest.approx(-np.percentile(x, 1), abs=0.0051)


def test_pooled_var_has_the_whole_aggregate(spark):
    """Tail means, mean and bounds of each group, as ``var_cvar`` and numpy have them; ties at the quantile and groups of one."""
    from riskloom.operators import var as V
    rng = np.random.default_rng(5)
    groups = {1: np.round(rng.normal(0, 1e4, 1001), 2), 2: np.round(rng.normal(0, 0.05, 900), 2), 3: np.zeros(50), 4: np.array([-3.25]),
              5: np.repeat([-9.0, -1.5, 2.0], [10, 90, 101])}
    df = spark.createDataFrame([(g, float(x)) for g, xs in groups.items() for x in xs], "portfolio_id int, portfolio_pnl double")
    nobody = V.pooled_var(spark.createDataFrame([(None, -2.0), (None, 4.0), (7, 1.0)], df.schema)).collect()
    assert {r.portfolio_id: (r.scenario_count, r.mean_pnl, r.min_pnl) for r in nobody} == {None: (2, 1.0, -2.0), 7: (1, 1.0, 1.0)}
    got = {r.portfolio_id: r for r in V.pooled_var(df).collect()}
    same = {r.portfolio_id: r for r in V.var_cvar(df).collect()}
    assert set(got) == set(groups)
    for g, x in groups.items():
        r = got[g].asDict()
        for name, share in (("95", 5), ("99", 1)):
            q = np.percentile(x, share)
            tail = x[x < q]
            assert r[f"cvar_{name}"] == pytest.approx(-(tail.mean() if len(tail) else q), abs=0.0051)
        assert r["mean_pnl"] == pytest.approx(x.mean(), abs=0.0051) and (r["min_pnl"], r["max_pnl"]) == (x.min(), x.max())
        assert r == pytest.approx(same[g].asDict(), abs=0.0051)
