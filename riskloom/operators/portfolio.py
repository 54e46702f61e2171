"""Portfolio risk: positions ⋈ lots ⋈ market -> MtM, scenario PnL, net Greeks.

Many portfolios (``portfolio_id``), valuation dates (the position's
``trade_date``) and shocks are handled in one plan; there is no loop over
positions or shocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import join_contract, lot_size_asof
from .scenario import (mtm_futures, mtm_option, scenario_futures, scenario_option,
                       with_base_price, with_shock)

OPTION_MARKET = ["spot", "iv", "rate", "div_yield", "dte", "delta", "gamma", "vega", "theta", "rho"]
FUTURES_MARKET = ["spot", "rate", "div_yield", "dte", "settle"]
OPTION_KEY = ["symbol", "trade_date", "expiry_date", "strike", "option_type"]
FUTURES_KEY = ["symbol", "trade_date", "expiry_date"]
GREEKS = ["delta", "gamma", "vega", "theta", "rho"]


def normalise_positions(positions: DataFrame) -> DataFrame:
    return positions.withColumns({
        "symbol": F.upper(F.trim("symbol")), "option_type": F.upper(F.trim("option_type")),
    })


def net_positions(positions: DataFrame) -> DataFrame:
    """One row per (portfolio, contract, valuation date): Σ quantity.

    Scenario PnL is linear in quantity, so scenario work only needs net
    legs.  Netting the narrow position rows first means the market join
    and everything after it see at most one row per held contract.
    """
    p = normalise_positions(positions)
    return p.groupBy("portfolio_id", *OPTION_KEY).agg(F.sum(F.col("quantity").cast("bigint")).alias("quantity"))


def resolve_positions(positions: DataFrame, chain: DataFrame, futures: DataFrame,
                      lots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(option legs, futures legs) with lot size, multiplier and market columns.

    Unmatched legs keep NULL market columns and ``_matched = false``.
    """
    pos = lot_size_asof(normalise_positions(positions), lots, "trade_date")
    pos = pos.withColumn("multiplier", F.col("quantity").cast("bigint") * F.col("lot_size"))
    opt = join_contract(pos.filter(F.col("option_type") != "XX"), chain, OPTION_KEY, OPTION_MARKET)
    fut = join_contract(pos.filter(F.col("option_type") == "XX"), futures, FUTURES_KEY, FUTURES_MARKET)
    return opt, fut


POSITION_RESULT = ["portfolio_id", "symbol", "trade_date", "expiry_date", "strike", "option_type",
                   "quantity", "lot_size", "entry_date", "entry_price", "current_price", "mtm_pnl",
                   "scenario_pnl", "total_pnl", "method", *GREEKS]


def position_results(opt: DataFrame, fut: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Value resolved legs under the shock columns already on them."""
    o = scenario_option(mtm_option(with_base_price(opt), has_base=True), has_base=True)
    f = scenario_futures(mtm_futures(fut))
    f = f.withColumns({
        "delta": F.when(F.col("_matched"), F.lit(1.0)),
        **{g: F.when(F.col("_matched"), F.lit(0.0)) for g in ("gamma", "vega", "theta", "rho")},
    })
    o = o.withColumns({g: F.when(F.col("_matched"), F.col(g)) for g in GREEKS})
    cols = [c for c in POSITION_RESULT if c != "scenario_pnl" and c != "total_pnl"] + list(extra)

    def shape(d):
        return d.withColumn("scenario_pnl", F.col("pnl_total")).withColumn(
            "total_pnl", F.col("mtm_pnl") + F.col("scenario_pnl")).select(
            *cols[:12], "scenario_pnl", "total_pnl", *cols[12:])
    return shape(o).unionByName(shape(f))


def portfolio_risk(positions: DataFrame, chain: DataFrame, futures: DataFrame, lots: DataFrame,
                   spot_shock_pct=0.0, vol_shock_abs=0.0, rate_shock_bps=0.0) -> DataFrame:
    """One result row per position (no_data rows kept with zero PnL)."""
    opt, fut = resolve_positions(positions, chain, futures, lots)
    opt = with_shock(opt, spot_shock_pct, vol_shock_abs, rate_shock_bps)
    fut = with_shock(fut, spot_shock_pct, vol_shock_abs, rate_shock_bps)
    return position_results(opt, fut)


def net_portfolio(results: DataFrame, by: Sequence[str] = ("portfolio_id",)) -> DataFrame:
    """Σ MtM, scenario and total PnL; Σ greek x quantity x lot (NULL greek = 0)."""
    w = F.col("quantity").cast("bigint") * F.col("lot_size")
    return results.groupBy(*by).agg(
        F.sum("mtm_pnl").alias("total_mtm_pnl"),
        F.sum("scenario_pnl").alias("total_scenario_pnl"),
        F.sum("total_pnl").alias("total_pnl"),
        *[F.sum(F.coalesce(F.col(g), F.lit(0.0)) * w).alias(f"net_{g}") for g in GREEKS],
        F.count(F.lit(1)).alias("positions"),
        F.count_if(F.col("method") == "no_data").alias("no_data_count"),
    )


def shock_grid(positions: DataFrame, chain: DataFrame, futures: DataFrame, lots: DataFrame,
               spot: Sequence[float], vol: Sequence[float], rate: Sequence[float]) -> DataFrame:
    """Scenario PnL of every portfolio over a grid of (spot %, vol pts, rate bps).

    The three axes are exploded in turn next to each resolved leg (no join,
    no shuffle; the plan holds the axes, not the points); the base price is
    computed once per leg before the expansion, and positions are first
    netted per (portfolio, contract) since PnL is linear in the quantity.
    """
    opt, fut = resolve_positions(net_positions(positions), chain, futures, lots)

    def expand(df: DataFrame) -> DataFrame:
        for name, axis in (("spot_shock_pct", spot), ("vol_shock_abs", vol), ("rate_shock_bps", rate)):
            df = df.select("*", F.explode(F.array(*[F.lit(float(x)) for x in axis])).alias(name))
        return df

    o = expand(with_base_price(opt))
    f = expand(fut)
    o = scenario_option(o, has_base=True)
    f = scenario_futures(f)
    keys = ["portfolio_id", "spot_shock_pct", "vol_shock_abs", "rate_shock_bps"]
    u = o.select(*keys, "pnl_total").unionByName(f.select(*keys, "pnl_total"))
    return u.groupBy(*keys).agg(F.sum("pnl_total").alias("scenario_pnl"))
