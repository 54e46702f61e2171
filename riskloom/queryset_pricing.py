"""Registered queries of the pricing operators (inventory 2.J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import oracle as O
from .catalog import ctx, register
from .functions.blackscholes import apply_stages, bs_stages, greek_stages, stage_columns, stages_sql
from .functions.normal import cdf_stages, pdf_sql
from .operators import pricing as PR
from .operators.iv import iv_valid, with_implied_vol
from .oracle import with_ctes

KEY = ["trade_date", "symbol", "expiry_date", "strike", "option_type"]
KEYS = ", ".join(KEY)
FIXED_VOL = "0.2e0"  # the flat volatility used by the closed-form checks


def _base(spark, sf_dir):
    """Chain rows before IV: contracts with spot, div yield and rate."""
    from .plans.curated import curated_rates
    c = ctx(spark, sf_dir)
    return PR.with_model_inputs(curated_rates(c.processed.options, c.processed))


@register("interpolate_rate", with_ctes(f"SELECT {KEYS}, dte, rate FROM c_base"))
def q_interpolate_rate(spark, sf_dir):
    return _base(spark, sf_dir).select(*KEY, "dte", "rate")


@register("iv_valid", with_ctes(
    f"SELECT {KEYS}, coalesce(t_years > 0 AND settle > 0 AND spot > 0 AND strike > 0 AND option_type IN ('CE','PE') "
    "AND settle >= (CASE WHEN option_type = 'CE' "
    "THEN greatest(spot * exp(-q * greatest(t_years, 1e-10)) - strike * exp(-rate * greatest(t_years, 1e-10)), 0e0) "
    "ELSE greatest(strike * exp(-rate * greatest(t_years, 1e-10)) - spot * exp(-q * greatest(t_years, 1e-10)), 0e0) END)"
    " - 1e-06, false) AS iv_valid FROM c_base"))
def q_iv_valid(spark, sf_dir):
    return _base(spark, sf_dir).select(*KEY, iv_valid().alias("iv_valid"))


@register("implied_vol", with_ctes(f"SELECT {KEYS}, iv FROM c_iv"))
def q_implied_vol(spark, sf_dir):
    return with_implied_vol(_base(spark, sf_dir)).select(*KEY, "iv")


_X = "ln(spot / strike) * 10e0"


@register("norm_cdf", with_ctes(
    f"SELECT {KEYS}, x, _n_cdf AS cdf, {pdf_sql('x')} AS pdf FROM "
    + stages_sql(f"(SELECT {KEYS}, {_X} AS x FROM chain)", cdf_stages({"_n_cdf": "x"}, "_n")) + " AS z"))
def q_norm_cdf(spark, sf_dir):
    """N(x) and n(x) for x = 10 ln(S/K) of every chain row."""
    d = ctx(spark, sf_dir).chain_view.select(*KEY, F.expr(_X).alias("x"))
    st = cdf_stages({"_n_cdf": "x"}, "_n")
    d = apply_stages(d, st)
    return d.select(*KEY, "x", F.col("_n_cdf").alias("cdf"), F.expr(pdf_sql("x")).alias("pdf"))


_PRICE_IN = f"(SELECT {KEYS}, spot, dte / 365e0 AS t_years, rate, div_yield / 100e0 AS q FROM chain)"


@register("bs_price", with_ctes(
    f"SELECT {KEYS}, _b_price AS price FROM "
    + stages_sql(_PRICE_IN, bs_stages("spot", "strike", "t_years", "rate", "q", FIXED_VOL, "option_type = 'CE'", "_b"))
    + " AS z"))
def q_bs_price(spark, sf_dir):
    """Closed-form price of every chain contract at a flat 20% vol."""
    d = PR.with_model_inputs(ctx(spark, sf_dir).chain_view).select(*KEY, "spot", "t_years", "rate", "q")
    st = bs_stages("spot", "strike", "t_years", "rate", "q", FIXED_VOL, "option_type = 'CE'", "_b")
    return apply_stages(d, st).select(*KEY, F.col("_b_price").alias("price"))


@register("bs_greeks", with_ctes(
    f"SELECT {KEYS}, _b_delta AS delta, _b_gamma AS gamma, _b_vega AS vega, _b_theta AS theta, _b_rho AS rho FROM "
    + stages_sql(_PRICE_IN, bs_stages("spot", "strike", "t_years", "rate", "q", FIXED_VOL, "option_type = 'CE'", "_b")
                 + greek_stages("spot", "strike", "rate", "q", "_b")) + " AS z"))
def q_bs_greeks(spark, sf_dir):
    d = PR.with_model_inputs(ctx(spark, sf_dir).chain_view).select(*KEY, "spot", "t_years", "rate", "q")
    st = bs_stages("spot", "strike", "t_years", "rate", "q", FIXED_VOL, "option_type = 'CE'", "_b") + \
        greek_stages("spot", "strike", "rate", "q", "_b")
    d = apply_stages(d, st)
    return d.select(*KEY, *[F.col(f"_b_{g}").alias(g) for g in PR.GREEKS])


@register("futures_fair_value", with_ctes(
    "SELECT trade_date, symbol, expiry_date, spot, settle, theoretical_price, basis, delta FROM cfut"))
def q_futures_fair_value(spark, sf_dir):
    return ctx(spark, sf_dir).futures.select("trade_date", "symbol", "expiry_date", "spot", "settle",
                                              "theoretical_price", "basis", "delta")


@register("put_call_parity_residual", with_ctes(
    "SELECT trade_date, symbol, expiry_date, strike, call, put, spot, rate, div_yield, dte, "
    "call - put - (spot * exp(-(div_yield / 100e0) * (dte / 365e0)) - strike * exp(-rate * (dte / 365e0))) AS parity_residual "
    "FROM (SELECT trade_date, symbol, expiry_date, strike, max(CASE WHEN option_type = 'CE' THEN settle END) AS call, "
    "max(CASE WHEN option_type = 'PE' THEN settle END) AS put, max(spot) AS spot, max(rate) AS rate, "
    "max(div_yield) AS div_yield, max(dte) AS dte FROM chain GROUP BY 1, 2, 3, 4) g "
    "WHERE call IS NOT NULL AND put IS NOT NULL"))
def q_put_call_parity_residual(spark, sf_dir):
    return PR.put_call_parity_residual(ctx(spark, sf_dir).chain_view)


@register("reprice_residual", with_ctes(
    f"SELECT {KEYS}, settle, iv, _r_price AS model_price, _r_price - settle AS residual FROM "
    + stages_sql(f"(SELECT {KEYS}, settle, iv, spot, dte / 365e0 AS t_years, rate, div_yield / 100e0 AS q "
                 "FROM chain WHERE iv IS NOT NULL)",
                 bs_stages("spot", "strike", "t_years", "rate", "q", "iv", "option_type = 'CE'", "_r")) + " AS z"))
def q_reprice_residual(spark, sf_dir):
    d = PR.reprice_residual(ctx(spark, sf_dir).chain_view)
    return d.select(*KEY, "settle", "iv", "model_price", "residual")


@register("norm_pdf", with_ctes(f"SELECT {KEYS}, x, {pdf_sql('x')} AS pdf FROM (SELECT {KEYS}, {_X} AS x FROM chain) z"))
def q_norm_pdf(spark, sf_dir):
    d = ctx(spark, sf_dir).chain_view.select(*KEY, F.expr(_X).alias("x"))
    return d.select(*KEY, "x", F.expr(pdf_sql("x")).alias("pdf"))
