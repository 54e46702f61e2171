"""Property-based checks of the numpy kernels (no Spark needed)."""
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from riskloom.operators.iv import bs_price_np, solve_iv_np


@settings(max_examples=300, deadline=None)
@given(
    S=st.floats(5000, 60000), m=st.floats(0.8, 1.2), dte=st.integers(5, 400),
    r=st.floats(0.0, 0.12), q=st.floats(0.0, 0.03), sigma=st.floats(0.05, 1.5), call=st.booleans(),
)
def test_iv_round_trip_reprices(S, m, dte, r, q, sigma, call):
    K, T, w = S * m, dte / 365.0, 1.0 if call else -1.0
    a = lambda x: np.array([x], dtype=float)
    px = bs_price_np(a(S), a(K), a(T), a(r), a(q), a(sigma), a(w))
    iv = solve_iv_np(px, a(S), a(K), a(T), a(r), a(q), np.array([call]), np.array([True]))
    if np.isnan(iv[0]):
        # only allowed when the price carries no volatility information
        assert px[0] < 1e-6 or abs(bs_price_np(a(S), a(K), a(T), a(r), a(q), a(0.001), a(w))[0] - px[0]) < 1e-6
        return
    back = bs_price_np(a(S), a(K), a(T), a(r), a(q), iv, a(w))
    assert abs(back[0] - px[0]) < 1e-6


@settings(max_examples=200, deadline=None)
@given(S=st.floats(5000, 60000), m=st.floats(0.5, 1.5), dte=st.integers(1, 700),
       r=st.floats(0.0, 0.12), q=st.floats(0.0, 0.03), sigma=st.floats(0.01, 3.0))
def test_put_call_parity_numpy(S, m, dte, r, q, sigma):
    K, T = S * m, dte / 365.0
    a = lambda x: np.array([x], dtype=float)
    c = bs_price_np(a(S), a(K), a(T), a(r), a(q), a(sigma), a(1.0))[0]
    p = bs_price_np(a(S), a(K), a(T), a(r), a(q), a(sigma), a(-1.0))[0]
    assert abs((c - p) - (S * np.exp(-q * T) - K * np.exp(-r * T))) < 1e-6 * max(1.0, S / 1000)


@settings(max_examples=100, deadline=None)
@given(S=st.floats(5000, 60000), m=st.floats(0.7, 1.3), dte=st.integers(1, 400),
       s1=st.floats(0.01, 2.0), s2=st.floats(0.01, 2.0), call=st.booleans())
def test_price_monotone_in_vol(S, m, dte, s1, s2, call):
    a = lambda x: np.array([x], dtype=float)
    lo, hi = sorted((s1, s2))
    w = a(1.0 if call else -1.0)
    p_lo = bs_price_np(a(S), a(S * m), a(dte / 365), a(0.065), a(0.012), a(lo), w)[0]
    p_hi = bs_price_np(a(S), a(S * m), a(dte / 365), a(0.065), a(0.012), a(hi), w)[0]
    assert p_hi >= p_lo - 1e-9
