"""Closed-form pricing, Greeks, cumulative normal and the IV solver."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.functions.blackscholes import apply_stages, bs_stages, greek_stages
from riskloom.functions.normal import cdf_stages, norm_cdf_np
from riskloom.operators.iv import bs_price_np, iv_valid, solve_iv_np, with_implied_vol


def ref_price(S, K, T, r, q, s, call):
    """Independent scalar Black-Scholes-Merton via math.erf."""
    N = lambda x: 0.5 * (1 + math.erf(x / math.sqrt(2)))
    d1 = (math.log(S / K) + (r - q + 0.5 * s * s) * T) / (s * math.sqrt(T))
    d2 = d1 - s * math.sqrt(T)
    if call:
        return S * math.exp(-q * T) * N(d1) - K * math.exp(-r * T) * N(d2)
    return K * math.exp(-r * T) * N(-d2) - S * math.exp(-q * T) * N(-d1)


def test_cdf_matches_erf():
    x = np.linspace(-9, 9, 20001)
    ref = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in x])
    assert np.max(np.abs(norm_cdf_np(x) - ref)) < 1e-14
    assert norm_cdf_np(np.array([0.0]))[0] == 0.5
    assert norm_cdf_np(np.array([50.0]))[0] == 1.0 and norm_cdf_np(np.array([-50.0]))[0] == 0.0


def test_cdf_spark_equals_numpy(spark):
    xs = [float(v) for v in np.linspace(-12, 12, 241)]
    df = spark.createDataFrame([(v,) for v in xs], "x double")
    out = apply_stages(df, cdf_stages({"n": "x"}, "_c")).select("x", "n").collect()
    got = np.array([r.n for r in out])
    exp = norm_cdf_np(np.array([r.x for r in out]))
    assert np.max(np.abs(got - exp)) <= 1e-16


CASES = [  # spot, strike, dte, type, sigma  (spot 22000, r 6.5%, q 1.23%)
    (22000.0, 22000.0, 30, "CE", 0.18), (22000.0, 22000.0, 30, "PE", 0.18),
    (22000.0, 21000.0, 30, "CE", 0.15), (22000.0, 23000.0, 30, "CE", 0.20),
    (22000.0, 23000.0, 30, "PE", 0.20), (22000.0, 21000.0, 180, "PE", 0.25),
]


def _priced(spark, sigma_col="sigma"):
    rows = [(S, K, d / 365.0, 0.065, 0.0123, t, s) for S, K, d, t, s in CASES]
    df = spark.createDataFrame(rows, "spot double, strike double, t_years double, rate double, q double, "
                                     "option_type string, sigma double")
    st = bs_stages("spot", "strike", "t_years", "rate", "q", sigma_col, "option_type = 'CE'", "_b") + \
        greek_stages("spot", "strike", "rate", "q", "_b")
    return apply_stages(df, st).collect()


def test_price_matches_reference(spark):
    for r in _priced(spark):
        ref = ref_price(r.spot, r.strike, r.t_years, r.rate, r.q, r.sigma, r.option_type == "CE")
        assert r._b_price == pytest.approx(ref, abs=1e-8)


def test_put_call_parity_and_greek_identities(spark):
    rows = [(22000.0, K, 30 / 365.0, 0.065, 0.0123, t, 0.2) for K in (21000.0, 22000.0, 23000.0) for t in ("CE", "PE")]
    df = spark.createDataFrame(rows, "spot double, strike double, t_years double, rate double, q double, "
                                     "option_type string, sigma double")
    st = bs_stages("spot", "strike", "t_years", "rate", "q", "sigma", "option_type = 'CE'", "_b") + \
        greek_stages("spot", "strike", "rate", "q", "_b")
    out = {(r.strike, r.option_type): r for r in apply_stages(df, st).collect()}
    for K in (21000.0, 22000.0, 23000.0):
        c, p = out[(K, "CE")], out[(K, "PE")]
        T = 30 / 365.0
        fwd = 22000 * math.exp(-0.0123 * T) - K * math.exp(-0.065 * T)
        assert c._b_price - p._b_price == pytest.approx(fwd, abs=1e-6)
        assert c._b_gamma == pytest.approx(p._b_gamma, abs=1e-8)
        assert c._b_vega == pytest.approx(p._b_vega, abs=1e-8)
        assert c._b_delta - p._b_delta == pytest.approx(math.exp(-0.0123 * T), abs=1e-9)
        assert 0 < c._b_delta < 1 and -1 < p._b_delta < 0
        assert c._b_theta < 0 and c._b_rho > 0 and p._b_rho < 0


def test_iv_round_trip_numpy():
    for S, K, d, t, s in CASES:
        T = d / 365.0
        w = 1.0 if t == "CE" else -1.0
        px = bs_price_np(np.array([S]), np.array([K]), np.array([T]), np.array([0.065]), np.array([0.0123]),
                         np.array([s]), np.array([w]))
        iv = solve_iv_np(px, np.array([S]), np.array([K]), np.array([T]), np.array([0.065]), np.array([0.0123]),
                         np.array([t == "CE"]), np.array([True]))
        assert iv[0] == pytest.approx(s, abs=1e-4)


def _iv_frame(spark, rows):
    df = spark.createDataFrame(rows, "settle double, spot double, strike double, t_years double, rate double, "
                                     "q double, option_type string")
    return with_implied_vol(df).collect()


def test_iv_spark_round_trip_and_invalid_rows(spark):
    T = 30 / 365.0
    good = ref_price(22000.0, 22000.0, T, 0.065, 0.0123, 0.18, True)
    rows = [
        (good, 22000.0, 22000.0, T, 0.065, 0.0123, "CE"),
        (good, 22000.0, 22000.0, 0.0, 0.065, 0.0123, "CE"),      # dte <= 0
        (0.0, 22000.0, 22000.0, T, 0.065, 0.0123, "CE"),         # settle <= 0
        (good, 0.0, 22000.0, T, 0.065, 0.0123, "CE"),            # spot <= 0
        (good, 22000.0, 0.0, T, 0.065, 0.0123, "CE"),            # strike <= 0
        (good, 22000.0, 22000.0, T, 0.065, 0.0123, "XX"),        # not an option
        (10.0, 22000.0, 21000.0, T, 0.065, 0.0123, "CE"),        # below intrinsic
        (30000.0, 22000.0, 22000.0, T, 0.065, 0.0123, "CE"),     # above the 500% price
    ]
    out = _iv_frame(spark, rows)
    assert out[0].iv == pytest.approx(0.18, abs=1e-4)
    assert all(r.iv is None for r in out[1:])


def test_iv_batch_of_identical_rows(spark):
    T = 30 / 365.0
    px = ref_price(22000.0, 22000.0, T, 0.065, 0.0123, 0.2, True)
    out = _iv_frame(spark, [(px, 22000.0, 22000.0, T, 0.065, 0.0123, "CE")] * 1000)
    solved = [r.iv for r in out if r.iv is not None]
    assert len(solved) > 900 and max(abs(v - 0.2) for v in solved) < 1e-6


def test_iv_never_nan(spark):
    out = _iv_frame(spark, [(float("nan"), 22000.0, 22000.0, 0.1, 0.065, 0.0123, "CE")])
    assert out[0].iv is None


def _grid():
    """Prices of a wide grid, out to volatilities and moneyness where they say nothing, and off by a little."""
    rows = []
    for m in (0.5, 0.8, 0.95, 0.999, 1.0, 1.001, 1.05, 1.3, 2.0):
        for T in (1 / 365, 7 / 365, 0.25, 2.0):
            for s in (0.001, 0.0011, 0.01, 0.05, 0.2, 0.6, 1.5, 4.0, 5.0):
                for call in (True, False):
                    px = ref_price(22000.0, 22000.0 * m, T, 0.065, 0.0123, s, call)
                    rows += [(px + e, 22000.0, 22000.0 * m, T, 0.065, 0.0123, "CE" if call else "PE") for e in (0.0, 1e-7, 0.05)]
    rows += [(px, S, S, T, 0.0, 0.0, "CE") for px, S, T in ((400.0, 20000.0, 0.1), (1e-9, 20000.0, 0.1), (0.05, 1.0, 0.1))]  # ln(S/K) = 0
    return rows


def test_iv_equals_bisection_where_the_price_decides_and_reprices_everywhere(spark):
    rows = _grid()
    df = spark.createDataFrame(rows, "settle double, spot double, strike double, t_years double, rate double, q double, option_type string")
    got = with_implied_vol(df.withColumn("ok", iv_valid())).collect()
    a = {k: np.array([getattr(r, k) for r in got], float) for k in ("settle", "spot", "strike", "t_years", "rate", "q")}
    call, ok = np.array([r.option_type == "CE" for r in got]), np.array([r.ok for r in got])
    iv = np.array([np.nan if r.iv is None else r.iv for r in got])
    want = solve_iv_np(a["settle"], a["spot"], a["strike"], a["t_years"], a["rate"], a["q"], call, ok)
    w = np.where(call, 1.0, -1.0)
    price = lambda s: bs_price_np(a["spot"], a["strike"], a["t_years"], a["rate"], a["q"], s, w)
    both = ~np.isnan(iv) & ~np.isnan(want)
    assert both.sum() > 1000
    assert np.max(np.abs(price(iv) - a["settle"])[~np.isnan(iv)]) < 1e-6
    # without an answer only at the ends of the interval, where one rounding decides
    edge = np.minimum(np.abs(price(np.full(len(iv), 0.001)) - a["settle"]), np.abs(price(np.full(len(iv), 5.0)) - a["settle"])) < 1e-9
    assert np.all(edge | (np.isnan(iv) == np.isnan(want)))
    vega = (price(iv + 1e-4) - price(iv - 1e-4)) / 2e-4
    sharp = both & (vega > 1e-3 * a["spot"])
    assert sharp.sum() > 700 and np.max(np.abs(iv - want)[sharp]) < 1e-10


def test_rows_whose_steps_have_not_settled_take_another_and_no_bisection(spark, monkeypatch):
    """The price decides their volatility: the next step finds it, 60 halvings are not needed."""
    from riskloom.operators import iv as IV
    cols = "settle double, spot double, strike double, t_years double, rate double, q double, option_type string"
    rows = [(426.01081119784254, 21418.224, 21900.0, 360 / 365, 0.0572, 0.0168, "CE"),
            (143.01425780743773, 20535.5264, 20500.0, 24 / 365, 0.055855, 0.0084, "CE"),
            (550.968203026858, 23559.2901, 23150.0, 32 / 365, 0.060055, 0.0116, "CE")]
    want = [r.iv for r in with_implied_vol(spark.createDataFrame(rows, cols)).collect()]
    a = np.array([r[:6] for r in rows]).T
    assert np.allclose(want, solve_iv_np(*a, np.full(3, True), np.full(3, True)), rtol=0, atol=1e-10)
    monkeypatch.setattr(IV, "bisection_sql", lambda *a: "CAST(NULL AS DOUBLE)")
    assert [r.iv for r in with_implied_vol(spark.createDataFrame(rows, cols)).collect()] == want


def test_curated_chain_has_no_python_node(spark, sf_small):
    import __spark_entry__ as entry
    plan = entry.queries()["curate_greeks"](spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_filters_on_the_volatility_do_not_copy_the_stages(spark):
    T = 30 / 365.0
    rows = [(ref_price(22000.0, 22000.0, T, 0.065, 0.0123, s, True), 22000.0, 22000.0, T, 0.065, 0.0123, "CE") for s in (0.1, 0.2)]
    df = spark.createDataFrame(rows + [(0.0, 1.0, 1.0, T, 0.0, 0.0, "CE")], "settle double, spot double, strike double, "
                               "t_years double, rate double, q double, option_type string")
    assert with_implied_vol(df).where("iv is not null and iv > 0.15").count() == 1
    assert with_implied_vol(df).where("iv is null").count() == 1


def test_greeks_are_finite_differences_of_the_reference_price(spark):
    """Formulas against other arithmetic: erf prices, central differences."""
    for r in _priced(spark):
        call = r.option_type == "CE"
        f = lambda S=r.spot, T=r.t_years, rate=r.rate, s=r.sigma: ref_price(S, r.strike, T, rate, r.q, s, call)  # noqa: B023, E731
        h, d, v = 0.5, 1e-5, 1e-5
        assert r._b_delta == pytest.approx((f(S=r.spot + h) - f(S=r.spot - h)) / (2 * h), rel=1e-5)
        assert r._b_gamma == pytest.approx((f(S=r.spot + h) - 2 * f() + f(S=r.spot - h)) / h**2, rel=1e-3)
        assert r._b_vega == pytest.approx((f(s=r.sigma + v) - f(s=r.sigma - v)) / (2 * v) / 100, rel=1e-5)
        assert r._b_rho == pytest.approx((f(rate=r.rate + d) - f(rate=r.rate - d)) / (2 * d) / 100, rel=1e-5)
        assert r._b_theta == pytest.approx(-(f(T=r.t_years + d) - f(T=r.t_years - d)) / (2 * d) / 365, rel=1e-3)
