"""Implied volatility as Columns: no loop, no Python worker.

:func:`with_implied_vol` runs the stages of ``functions.impliedvol`` (a rational first
guess, two third-order Householder steps; a settled root reprices within 1e-6) and
keeps the root if it lies in [0.001, 5].  Rows whose steps have not settled take one or
two more; rows whose price does not determine the volatility in double precision take the
bisection that defines the answer there.  Both sit in CASE branches, so other rows do not
pay for them.  A row gets an IV only if it passes :func:`iv_valid`; otherwise NULL.

:func:`solve_iv_np` is the same definition by bisection in numpy, for the tests.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.blackscholes import apply_stages
from ..functions.impliedvol import (
    BISECTIONS, IV_LOWER, IV_UPPER, TOLERANCE, bisection_sql, iv_stages, more_steps_sql, well_sql)
from ..functions.normal import norm_cdf_np


def bs_price_np(S, K, T, r, q, sigma, w):
    """numpy twin of ``bs_stages`` (identical operation order)."""
    T_ = np.maximum(T, 1e-10)
    s = np.maximum(sigma, 1e-10)
    sq = np.sqrt(T_)
    eq = np.exp(-q * T_)
    er = np.exp(-r * T_)
    d1 = (np.log(S / K) + (r - q + 0.5 * s * s) * T_) / (s * sq)
    d2 = d1 - s * sq
    n1 = norm_cdf_np(w * d1)
    n2 = norm_cdf_np(w * d2)
    return w * (S * eq * n1 - K * er * n2)


def solve_iv_np(px, S, K, T, r, q, is_call, valid) -> np.ndarray:
    """Vectorised bisection; NaN where no volatility is found.

    ln(S/K), sqrt(T) and the two discount factors do not depend on sigma;
    they are computed once, outside the 60 halvings (same values, same
    operation order as :func:`bs_price_np`, so the result is bit-identical).
    """
    out = np.full(len(px), np.nan)
    idx = np.flatnonzero(valid)
    if idx.size == 0:
        return out
    px, S, K, T, r, q = (a[idx] for a in (px, S, K, T, r, q))
    w = np.where(is_call[idx], 1.0, -1.0)
    T_ = np.maximum(T, 1e-10)
    sq = np.sqrt(T_)
    eq = np.exp(-q * T_)
    er = np.exp(-r * T_)
    ln_sk = np.log(S / K)
    carry = r - q
    s_eq, k_er = S * eq, K * er

    def price(sigma):
        s = np.maximum(sigma, 1e-10)
        d1 = (ln_sk + (carry + 0.5 * s * s) * T_) / (s * sq)
        d2 = d1 - s * sq
        return w * (s_eq * norm_cdf_np(w * d1) - k_er * norm_cdf_np(w * d2))

    lo = np.full(idx.size, IV_LOWER)
    hi = np.full(idx.size, IV_UPPER)
    bracketed = (price(lo) - px <= 0.0) & (price(hi) - px >= 0.0)
    for _ in range(BISECTIONS):
        m = (lo + hi) / 2.0
        up = price(m) > px
        hi = np.where(up, m, hi)
        lo = np.where(up, lo, m)
    sig = (lo + hi) / 2.0
    ok = bracketed & (np.abs(price(sig) - px) < TOLERANCE)
    out[idx] = np.where(ok, sig, np.nan)
    return out


def iv_valid(settle="settle", S="spot", K="strike", T="t_years", r="rate", q="q",
             option_type="option_type") -> Column:
    """Row can carry an IV: live, positive inputs, CE/PE, settle not below
    the discounted intrinsic value (minus 1e-6)."""
    Tf = F.greatest(F.col(T), F.lit(1e-10))
    fwd_s = F.col(S) * F.exp(-F.col(q) * Tf)
    fwd_k = F.col(K) * F.exp(-F.col(r) * Tf)
    intrinsic = F.when(F.col(option_type) == "CE", F.greatest(fwd_s - fwd_k, F.lit(0.0))).otherwise(
        F.greatest(fwd_k - fwd_s, F.lit(0.0))
    )
    return F.coalesce(
        (F.col(T) > 0) & (F.col(settle) > 0) & (F.col(S) > 0) & (F.col(K) > 0)
        & F.col(option_type).isin("CE", "PE") & (F.col(settle) >= intrinsic - TOLERANCE),
        F.lit(False),
    )


def with_implied_vol(df: DataFrame, out: str = "iv", settle="settle", S="spot", K="strike", T="t_years", r="rate", q="q",
                     option_type="option_type") -> DataFrame:
    """Add ``out``: the implied volatility (NULL where not solvable)."""
    ok = "_iv_ok"
    stages = iv_stages(settle, S, K, T, r, q, f"{option_type} = 'CE'", ok)
    # the row itself travels as one struct, so a stage copies it as bytes and not column by column
    need = list(dict.fromkeys((settle, S, K, T, r, q, option_type)))
    kept = [c for c in df.columns if c != out]
    d = df.select(F.struct(*kept).alias("_iv_row"), *need, iv_valid(settle, S, K, T, r, q, option_type).alias(ok))
    d = apply_stages(d, stages)
    # through a generator: a filter on the result must not copy the stages into itself
    inside = lambda v: f"CASE WHEN {v} BETWEEN {IV_LOWER!r}D AND {IV_UPPER!r}D THEN {v} END"
    rest = more_steps_sql(f"CASE WHEN {well_sql(T, 'n.s', 'n.d')} THEN {inside('n.s / _iv_sq')} "
                          f"ELSE {bisection_sql(settle, S, K, r, q)} END")
    iv = F.expr(f"CASE WHEN _iv_well THEN {inside('_iv_sig')} WHEN {ok} THEN {rest} END")
    return d.select("_iv_row", F.explode(F.array(iv)).alias(out)).select("_iv_row.*", out)
