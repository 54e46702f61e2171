"""Batch pricing operators: rates, IV + Greeks, futures fair value, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.blackscholes import with_bs_greeks, with_bs_price
from ..functions.curve import interpolate_rate
from .iv import iv_valid, with_implied_vol

GREEKS = ["delta", "gamma", "vega", "theta", "rho"]


def with_rate(df: DataFrame) -> DataFrame:
    """``rate`` (decimal) from the 3m/6m/1y pillars (percent) and ``dte``."""
    return df.withColumn("rate", interpolate_rate("dte", "rate_3m", "rate_6m", "rate_1y"))


def with_model_inputs(df: DataFrame) -> DataFrame:
    """Engine-internal inputs: years to expiry and the decimal dividend yield.

    ``div_yield`` is stored in percent; it is divided by 100 here, at the
    pricing boundary, and nowhere else.
    """
    return df.withColumns({"t_years": F.col("dte") / 365.0, "q": F.col("div_yield") / 100.0})


def curate_greeks(df: DataFrame) -> DataFrame:
    """Add ``iv`` and the five Greeks (NULL Greeks where IV is NULL).

    Expects spot, strike, settle, dte, option_type, rate, div_yield (%).
    """
    df = with_implied_vol(with_model_inputs(df))
    df = with_bs_greeks(df, "spot", "strike", "t_years", "rate", "q", "iv",
                        "option_type = 'CE'")
    return df.drop("t_years", "q")


def futures_fair_value(df: DataFrame) -> DataFrame:
    """theoretical_price = S e^{(r - q) T}, basis = settle - fair, delta = 1."""
    T = F.col("dte") / 365.0
    fair = F.col("spot") * F.exp((F.col("rate") - F.col("div_yield") / 100.0) * T)
    return df.withColumn("theoretical_price", fair).withColumns(
        {"basis": F.col("settle") - F.col("theoretical_price"), "delta": F.lit(1.0)}
    )


def reprice_residual(df: DataFrame) -> DataFrame:
    """Model price at the solved IV minus settle (rows with an IV only)."""
    d = with_model_inputs(df.filter(F.col("iv").isNotNull()))
    d = with_bs_price(d, "model_price", "spot", "strike", "t_years", "rate", "q", "iv",
                      "option_type = 'CE'")
    return d.withColumn("residual", F.col("model_price") - F.col("settle")).drop("t_years", "q")


def put_call_parity_residual(df: DataFrame) -> DataFrame:
    """C - P - (S e^{-qT} - K e^{-rT}) per (date, symbol, expiry, strike).

    A conditional aggregate pairs the call and the put of a strike without a
    self-join: one shuffle on the contract key minus the option type.
    """
    keys = ["trade_date", "symbol", "expiry_date", "strike"]
    g = df.groupBy(*keys).agg(
        F.max(F.when(F.col("option_type") == "CE", F.col("settle"))).alias("call"),
        F.max(F.when(F.col("option_type") == "PE", F.col("settle"))).alias("put"),
        F.max("spot").alias("spot"), F.max("rate").alias("rate"),
        F.max("div_yield").alias("div_yield"), F.max("dte").alias("dte"),
    ).filter(F.col("call").isNotNull() & F.col("put").isNotNull())
    T = F.col("dte") / 365.0
    fwd = F.col("spot") * F.exp(-(F.col("div_yield") / 100.0) * T) - F.col("strike") * F.exp(-F.col("rate") * T)
    return g.withColumn("parity_residual", F.col("call") - F.col("put") - fwd)


__all__ = ["with_rate", "curate_greeks", "futures_fair_value", "reprice_residual",
           "put_call_parity_residual", "iv_valid", "GREEKS"]
