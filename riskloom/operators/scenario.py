"""Scenario shocks, mark-to-market and the per-contract scenario cascade.

All operators add columns to a DataFrame of contracts; shocks are columns
too (``spot_shock_pct``, ``vol_shock_abs`` in vol points, ``rate_shock_bps``),
so one plan prices any number of (contract, shock) rows at once.

Expected contract columns: spot, strike, dte, rate (decimal), div_yield (%),
iv (decimal), option_type, delta/gamma/vega/rho (may be NULL),
multiplier (= quantity x lot size), and for MtM ``entry_price``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.blackscholes import apply_stages, bs_stages, stage_columns

SIGMA_FLOOR_SHOCKED = 1e-4

SHOCKED_SPOT = "spot * (1e0 + spot_shock_pct / 100e0)"
SHOCKED_RATE = "rate + rate_shock_bps / 10000e0"
SHOCKED_VOL = f"greatest(coalesce(iv, 0e0) + vol_shock_abs / 100e0, {SIGMA_FLOOR_SHOCKED!r})"


def with_shock(df: DataFrame, spot_shock_pct: float | Column, vol_shock_abs: float | Column,
               rate_shock_bps: float | Column) -> DataFrame:
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return df.withColumns({"spot_shock_pct": lit(spot_shock_pct), "vol_shock_abs": lit(vol_shock_abs),
                           "rate_shock_bps": lit(rate_shock_bps)})


def apply_shock(df: DataFrame) -> DataFrame:
    """Shocked spot, rate and (floored) vol."""
    return df.withColumns({"spot_shocked": F.expr(SHOCKED_SPOT), "rate_shocked": F.expr(SHOCKED_RATE),
                           "vol_shocked": F.expr(SHOCKED_VOL)})


def with_pricing_inputs(df: DataFrame) -> DataFrame:
    return df.withColumns({"t_years": F.col("dte") / 365.0, "q": F.col("div_yield") / 100.0})


def with_base_price(df: DataFrame, out: str = "base_price") -> DataFrame:
    """BS price at the snapshot IV, NULL unless dte > 0 and iv > 0."""
    st = bs_stages("spot", "strike", "t_years", "rate", "q", "iv", "option_type = 'CE'", "_bp")
    df = apply_stages(with_pricing_inputs(df), st)
    df = df.withColumn(out, F.when((F.col("dte") > 0) & (F.col("iv") > 0), F.col("_bp_price")))
    return df.drop(*stage_columns(st), "t_years", "q")


def base_price_method(df: DataFrame) -> DataFrame:
    """``base_price`` plus ``method`` = expired | base_price_only."""
    df = with_base_price(df)
    return df.withColumn("method", F.when(F.col("dte") <= 0, "expired").otherwise("base_price_only")) \
        .withColumn("base_price", F.when(F.col("dte") > 0, F.col("base_price")))


def option_method(df: DataFrame) -> Column:
    """Scenario method of an option leg; it does not depend on the shock."""
    live_iv = F.col("iv").isNotNull() & (F.col("iv") > 0)
    greeks_ok = (F.col("delta").isNotNull() & F.col("gamma").isNotNull() & F.col("vega").isNotNull()
                 & F.col("rho").isNotNull())
    matched = F.col("_matched") if "_matched" in df.columns else F.lit(True)
    return (F.when(~matched, "no_data").when(F.col("dte") <= 0, "expired")
            .when(live_iv, "full_reprice").when(greeks_ok, "greeks_approx").otherwise("no_data"))


def _shocked_stages() -> list[dict[str, str]]:
    return bs_stages(SHOCKED_SPOT, "strike", "t_years", SHOCKED_RATE, "q", SHOCKED_VOL,
                     "option_type = 'CE'", "_sp")


SPOT_FREE_STAGES = 2  # the first stages of a pricing use T, sigma, r, q only


def prepare_shocked_pricing(df: DataFrame) -> DataFrame:
    """Evaluate the parts of the shocked pricing that do not depend on the
    spot shock (time, vol and rate terms) — e.g. once per leg before a
    leg x scenario expansion whose scenarios only move spot."""
    return apply_stages(with_pricing_inputs(df), _shocked_stages()[:SPOT_FREE_STAGES])


def scenario_option(df: DataFrame, has_base: bool = False, prepared: bool = False) -> DataFrame:
    """Method cascade for options: expired -> full_reprice (iv > 0) ->
    greeks_approx (delta, gamma, vega, rho all present) -> no_data.

    Adds method, base_price, shocked_price, pnl_per_lot, pnl_total.
    ``_matched`` (contract found in the chain) defaults to true.
    """
    if "_matched" not in df.columns:
        df = df.withColumn("_matched", F.lit(True))
    if not has_base:
        df = with_base_price(df)
    st = _shocked_stages()
    if prepared:
        df = apply_stages(df, st[SPOT_FREE_STAGES:])
    else:
        df = apply_stages(with_pricing_inputs(df), st)
    dS = F.expr(SHOCKED_SPOT) - F.col("spot")
    approx = (F.col("delta") * dS + F.lit(0.5) * F.col("gamma") * dS * dS
              + F.col("vega") * F.col("vol_shock_abs") + F.col("rho") * (F.col("rate_shock_bps") / 100.0))
    if "method" not in df.columns:
        df = df.withColumn("method", option_method(df))
    full = F.col("method") == "full_reprice"
    df = df.withColumns({
        "base_price": F.when(full, F.col("base_price")),
        "shocked_price": F.when(full, F.col("_sp_price")),
        "pnl_per_lot": F.when(full, F.col("_sp_price") - F.col("base_price"))
        .when(F.col("method") == "greeks_approx", approx).otherwise(F.lit(0.0)),
    })
    df = df.withColumn("pnl_total", F.col("pnl_per_lot") * F.col("multiplier"))
    return df.drop(*stage_columns(st), "t_years", "q")


def scenario_futures(df: DataFrame) -> DataFrame:
    """Linear futures PnL: dS x multiplier (vol and rate shocks ignored)."""
    if "_matched" not in df.columns:
        df = df.withColumn("_matched", F.lit(True))
    shocked = F.expr(SHOCKED_SPOT)
    m = F.col("_matched")
    return df.withColumns({
        "method": F.when(m, "futures_linear").otherwise("no_data"),
        "base_price": F.when(m, F.col("spot")),
        "shocked_price": F.when(m, shocked),
        "pnl_per_lot": F.when(m, shocked - F.col("spot")).otherwise(F.lit(0.0)),
    }).withColumn("pnl_total", F.col("pnl_per_lot") * F.col("multiplier"))


def mtm_option(df: DataFrame, has_base: bool = False) -> DataFrame:
    """current_price = BS at IV (NULL if dte <= 0 or no IV); mtm = (price - entry) x mult."""
    if not has_base:
        df = with_base_price(df)
    ok = F.col("base_price").isNotNull()
    if "_matched" in df.columns:
        ok = ok & F.col("_matched")
    return df.withColumns({
        "current_price": F.when(ok, F.col("base_price")),
        "mtm_pnl": F.when(ok, (F.col("base_price") - F.col("entry_price")) * F.col("multiplier"))
        .otherwise(F.lit(0.0)),
    })


def mtm_futures(df: DataFrame, mark: str = "spot") -> DataFrame:
    """Futures marked at spot (source-system parity) or at settle."""
    px = F.col(mark)
    ok = F.col("_matched") if "_matched" in df.columns else F.lit(True)
    return df.withColumns({
        "current_price": F.when(ok, px),
        "mtm_pnl": F.when(ok, (px - F.col("entry_price")) * F.col("multiplier")).otherwise(F.lit(0.0)),
    })
