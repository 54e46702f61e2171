"""SQL text of the engine's layers, for the DuckDB oracle.

``with_ctes(select)`` wraps a final SELECT with the fixture views, the
processed and curated layers and the portfolio inputs, all as CTEs.  The
pricing text (cumulative normal, Black-Scholes stages, curve) is the same
text the Spark side uses through ``F.expr``, so the oracle proves the plumbing
and not the formulas (tests/test_pricing.py checks those against other
arithmetic); joins, windows, de-duplication and aggregation are written
independently here in plain SQL.
"""

from __future__ import annotations

from .fixtures import FIXTURE_CTES
from .functions.blackscholes import bs_stages, greek_stages, stages_sql
from .functions.curve import interpolate_rate_sql
from .functions.rounding import round_dec_sql
from .operators.iv import BISECTIONS, IV_LOWER, IV_UPPER, TOLERANCE

KEY5 = "trade_date, symbol, expiry_date, strike, option_type"
ORDER = "l_orderkey, l_linenumber, l_extendedprice"
IV_IN_COLS = f"{KEY5}, settle, spot, t_years, rate, q"


def _price_sql(src: str, sigma: str, p: str) -> str:
    return stages_sql(src, bs_stages("spot", "strike", "t_years", "rate", "q", sigma,
                                     "option_type = 'CE'", p))


def iv_ctes(base: str = "c_base", p: str = "iv") -> list[tuple[str, str]]:
    """Bisection over the valid rows of ``base``, as CTEs named with ``p``; ``{p}_out`` has the key and the volatility."""
    valid = (
        "(t_years > 0 AND settle > 0 AND spot > 0 AND strike > 0 AND option_type IN ('CE','PE') "
        "AND settle >= (CASE WHEN option_type = 'CE' "
        "THEN greatest(spot * exp(-q * greatest(t_years, 1e-10)) - strike * exp(-rate * greatest(t_years, 1e-10)), 0e0) "
        "ELSE greatest(strike * exp(-rate * greatest(t_years, 1e-10)) - spot * exp(-q * greatest(t_years, 1e-10)), 0e0) END)"
        f" - {TOLERANCE!r})"
    )
    lo_src = f"(SELECT {IV_IN_COLS} FROM {base} WHERE {valid})"
    lo = _price_sql(lo_src, f"{IV_LOWER!r}e0", "_lo")
    both = _price_sql(f"(SELECT {IV_IN_COLS}, _lo_price FROM {lo} AS l)", f"{IV_UPPER!r}e0", "_hi")
    step_src = f"(SELECT {IV_IN_COLS}, k, lo, hi, (lo + hi) / 2e0 AS m FROM {p}_bis WHERE k < {BISECTIONS})"
    step = _price_sql(step_src, "m", "_m")
    final_src = f"(SELECT {IV_IN_COLS}, (lo + hi) / 2e0 AS sig FROM {p}_bis WHERE k = {BISECTIONS})"
    final = _price_sql(final_src, "sig", "_f")
    return [
        (f"{p}_start", f"SELECT {IV_IN_COLS} FROM {both} AS b "
                     "WHERE _lo_price - settle <= 0e0 AND _hi_price - settle >= 0e0"),
        (f"{p}_bis", f"SELECT {IV_IN_COLS}, 0 AS k, {IV_LOWER!r}e0 AS lo, {IV_UPPER!r}e0 AS hi FROM {p}_start "
                   f"UNION ALL SELECT {IV_IN_COLS}, k + 1 AS k, "
                   "CASE WHEN _m_price > settle THEN lo ELSE m END AS lo, "
                   f"CASE WHEN _m_price > settle THEN m ELSE hi END AS hi FROM {step} AS s"),
        (f"{p}_out", f"SELECT {KEY5}, sig AS iv FROM {final} AS f WHERE abs(_f_price - settle) < {TOLERANCE!r}"),
    ]


def _greeks_select(src: str, sigma: str = "iv") -> str:
    st = bs_stages("spot", "strike", "t_years", "rate", "q", sigma, "option_type = 'CE'", "_g") + \
        greek_stages("spot", "strike", "rate", "q", "_g")
    return stages_sql(src, st)


CHAIN_COLS = ("trade_date, symbol, expiry_date, strike, option_type, open, high, low, close, settle, "
              "contracts, open_interest, chg_in_oi, dte, spot, div_yield, rate")

PROCESSED_CTES: list[tuple[str, str]] = [
    ("p_options", f"""SELECT trade_date, symbol, expiry_date, strike, option_type, settle AS open, settle AS high,
  settle AS low, settle AS close, settle, contracts, open_interest, CAST(0 AS BIGINT) AS chg_in_oi, dte
FROM (SELECT *, row_number() OVER (PARTITION BY {KEY5} ORDER BY {ORDER}) AS rn FROM options) x WHERE rn = 1"""),
    ("p_futures", f"""SELECT trade_date, symbol, expiry_date, settle AS open, settle AS high,
  settle AS low, settle AS close, settle, contracts, open_interest, CAST(0 AS BIGINT) AS chg_in_oi, dte
FROM (SELECT *, row_number() OVER (PARTITION BY trade_date, symbol, expiry_date ORDER BY {ORDER}) AS rn
      FROM futures) x WHERE rn = 1"""),
    ("p_spot", "SELECT trade_date, symbol, open, high, low, close FROM spot"),
    ("p_yield", "SELECT trade_date, symbol, coalesce(div_yield, 0e0) AS div_yield, "
                "div_yield IS NULL AS div_yield_filled FROM div_yield_raw"),
    ("p_gbond_c", """SELECT trade_date, lower(trim(tenor)) AS tenor, price > 15e0 AS was_par_price,
  CASE WHEN price > 15e0 THEN ((100e0 - price) / 100e0) * (365e0 / d) * 100e0 ELSE price END AS yield_pct
FROM (SELECT *, CASE lower(trim(tenor)) WHEN '3m' THEN 91e0 WHEN '6m' THEN 182e0 WHEN '1y' THEN 365e0 END AS d
      FROM gbond_raw) g"""),
    ("p_gbond", """SELECT trade_date, tenor, yield_pct, yield_pct AS open, yield_pct AS high, yield_pct AS low,
  was_par_price,
  (yield_pct / lag(yield_pct) OVER (PARTITION BY tenor ORDER BY trade_date) - 1e0) * 100e0 AS change_pct
FROM p_gbond_c"""),
    ("p_vix", "SELECT trade_date, close FROM vix"),
    ("p_rates", """SELECT trade_date, max(CASE WHEN tenor = '3m' THEN yield_pct END) AS rate_3m,
  max(CASE WHEN tenor = '6m' THEN yield_pct END) AS rate_6m, max(CASE WHEN tenor = '1y' THEN yield_pct END) AS rate_1y
FROM p_gbond GROUP BY trade_date"""),
    ("p_mkt", """SELECT s.trade_date, s.symbol, s.close AS spot, y.div_yield, r.rate_3m, r.rate_6m, r.rate_1y
FROM p_spot s JOIN p_yield y ON s.trade_date = y.trade_date AND s.symbol = y.symbol
JOIN p_rates r ON r.trade_date = s.trade_date
WHERE r.rate_3m IS NOT NULL AND r.rate_6m IS NOT NULL AND r.rate_1y IS NOT NULL"""),
    ("c_base", f"""SELECT o.*, m.spot, m.div_yield, {interpolate_rate_sql('o.dte', 'm.rate_3m', 'm.rate_6m', 'm.rate_1y')} AS rate,
  o.dte / 365e0 AS t_years, m.div_yield / 100e0 AS q
FROM p_options o JOIN p_mkt m ON o.trade_date = m.trade_date AND o.symbol = m.symbol"""),
    *iv_ctes(),
    ("c_iv", f"""SELECT b.*, i.iv FROM c_base b LEFT JOIN iv_out i ON b.trade_date = i.trade_date
  AND b.symbol = i.symbol AND b.expiry_date = i.expiry_date AND b.strike = i.strike AND b.option_type = i.option_type"""),
    ("chain", f"""SELECT {CHAIN_COLS}, iv, _g_delta AS delta, _g_gamma AS gamma, _g_vega AS vega,
  _g_theta AS theta, _g_rho AS rho FROM {_greeks_select('c_iv')} AS g"""),
    ("c_fut", f"""SELECT o.*, m.spot, m.div_yield, {interpolate_rate_sql('o.dte', 'm.rate_3m', 'm.rate_6m', 'm.rate_1y')} AS rate
FROM p_futures o JOIN p_mkt m ON o.trade_date = m.trade_date AND o.symbol = m.symbol"""),
    ("cfut", """SELECT trade_date, symbol, expiry_date, open, high, low, close, settle, contracts, open_interest,
  chg_in_oi, dte, spot, div_yield, rate, spot * exp((rate - div_yield / 100e0) * (dte / 365e0)) AS theoretical_price,
  settle - spot * exp((rate - div_yield / 100e0) * (dte / 365e0)) AS basis, 1e0 AS delta FROM c_fut"""),
]

EXTRA_CTES: list[tuple[str, str]] = [
    ("bhav_typed", "SELECT * FROM options UNION ALL BY NAME SELECT * FROM futures"),
]


def all_ctes() -> list[tuple[str, str]]:
    return FIXTURE_CTES + PROCESSED_CTES + EXTRA_CTES


def with_ctes(select_sql: str, extra: list[tuple[str, str]] | None = None) -> str:
    body = ",\n".join(f"{n} AS (\n{s}\n)" for n, s in all_ctes() + list(extra or []))
    return f"WITH RECURSIVE {body}\n{select_sql}"


# ---------------------------------------------------------------------------
# Portfolio / scenario / VaR text
# ---------------------------------------------------------------------------

from .operators.scenario import SHOCKED_RATE, SHOCKED_SPOT, SHOCKED_VOL  # noqa: E402

GREEK_NAMES = ["delta", "gamma", "vega", "theta", "rho"]
OPT_MKT = "spot, iv, rate, div_yield, dte, delta, gamma, vega, theta, rho"

EXTRA_CTES += [
    ("pos_lot", """SELECT p.portfolio_id, upper(trim(p.symbol)) AS symbol, p.trade_date, p.expiry_date, p.strike,
  upper(trim(p.option_type)) AS option_type, p.quantity, p.entry_date, p.entry_price,
  CAST(coalesce(l.lot_size, 1) AS INT) AS lot_size, l.lot_size IS NULL AS lot_size_missing,
  p.quantity * CAST(coalesce(l.lot_size, 1) AS INT) AS multiplier
FROM positions p LEFT JOIN lot_size l ON upper(trim(p.symbol)) = l.symbol AND l.start_date <= p.trade_date
  AND (l.end_date IS NULL OR l.end_date >= p.trade_date)"""),
    ("pos_opt", f"""SELECT p.*, c.spot, c.iv, c.rate, c.div_yield, c.dte, c.delta, c.gamma, c.vega, c.theta, c.rho,
  c.trade_date IS NOT NULL AS _matched
FROM (SELECT * FROM pos_lot WHERE option_type <> 'XX') p LEFT JOIN chain c ON p.symbol = c.symbol
  AND p.trade_date = c.trade_date AND p.expiry_date = c.expiry_date AND p.strike = c.strike AND p.option_type = c.option_type"""),
    ("pos_fut", """SELECT p.*, f.spot, f.rate, f.div_yield, f.dte, f.settle, f.trade_date IS NOT NULL AS _matched
FROM (SELECT * FROM pos_lot WHERE option_type = 'XX') p LEFT JOIN cfut f ON p.symbol = f.symbol
  AND p.trade_date = f.trade_date AND p.expiry_date = f.expiry_date"""),
]


def base_price_sql(src: str) -> str:
    """``src`` + base_price (BS at iv when dte > 0 and iv > 0)."""
    inner = stages_sql(f"(SELECT *, dte / 365e0 AS t_years, div_yield / 100e0 AS q FROM {src} AS z)",
                       bs_stages("spot", "strike", "t_years", "rate", "q", "iv", "option_type = 'CE'", "_bp"))
    return f"(SELECT *, CASE WHEN dte > 0 AND iv > 0 THEN _bp_price END AS base_price FROM {inner} AS bp)"


def scenario_option_sql(src: str) -> str:
    """``src`` (with base_price and shock columns) + method, base_price,
    shocked_price, pnl_per_lot, pnl_total (original base_price replaced)."""
    inner = stages_sql(f"(SELECT *, dte / 365e0 AS t_years, div_yield / 100e0 AS q FROM {src} AS z)",
                       bs_stages(SHOCKED_SPOT, "strike", "t_years", SHOCKED_RATE, "q", SHOCKED_VOL,
                                 "option_type = 'CE'", "_sp"))
    ds = f"(({SHOCKED_SPOT}) - spot)"
    method = ("CASE WHEN NOT _matched THEN 'no_data' WHEN dte <= 0 THEN 'expired' "
              "WHEN iv IS NOT NULL AND iv > 0 THEN 'full_reprice' "
              "WHEN delta IS NOT NULL AND gamma IS NOT NULL AND vega IS NOT NULL AND rho IS NOT NULL "
              "THEN 'greeks_approx' ELSE 'no_data' END")
    approx = (f"delta * {ds} + 0.5e0 * gamma * {ds} * {ds} + vega * vol_shock_abs"
              " + rho * (rate_shock_bps / 100e0)")
    m = f"(SELECT *, {method} AS method FROM {inner} AS mm)"
    p = (f"(SELECT * REPLACE (CASE WHEN method = 'full_reprice' THEN base_price END AS base_price), "
         f"CASE WHEN method = 'full_reprice' THEN _sp_price END AS shocked_price, "
         f"CASE WHEN method = 'full_reprice' THEN _sp_price - base_price "
         f"WHEN method = 'greeks_approx' THEN {approx} ELSE 0e0 END AS pnl_per_lot FROM {m} AS pp)")
    return f"(SELECT *, pnl_per_lot * multiplier AS pnl_total FROM {p} AS pt)"


def scenario_futures_sql(src: str) -> str:
    s = f"({SHOCKED_SPOT})"
    return (f"(SELECT *, CASE WHEN _matched THEN 'futures_linear' ELSE 'no_data' END AS method, "
            f"CASE WHEN _matched THEN spot END AS base_price, CASE WHEN _matched THEN {s} END AS shocked_price, "
            f"CASE WHEN _matched THEN {s} - spot ELSE 0e0 END AS pnl_per_lot, "
            f"(CASE WHEN _matched THEN {s} - spot ELSE 0e0 END) * multiplier AS pnl_total FROM {src} AS sf)")


def shock_cols(spot: float, vol: float, rate: float) -> str:
    return f"{float(spot)!r}e0 AS spot_shock_pct, {float(vol)!r}e0 AS vol_shock_abs, {float(rate)!r}e0 AS rate_shock_bps"


POSITION_RESULT_SQL = ("portfolio_id, symbol, trade_date, expiry_date, strike, option_type, quantity, lot_size, "
                       "entry_date, entry_price, current_price, mtm_pnl, scenario_pnl, total_pnl, method, "
                       "delta, gamma, vega, theta, rho")


def position_results_sql(spot: float, vol: float, rate: float) -> str:
    """One row per position under a fixed shock (portfolio_risk)."""
    o_src = f"(SELECT *, {shock_cols(spot, vol, rate)} FROM pos_opt)"
    o = base_price_sql(o_src)
    o = (f"(SELECT *, CASE WHEN base_price IS NOT NULL AND _matched THEN base_price END AS current_price, "
         f"CASE WHEN base_price IS NOT NULL AND _matched THEN (base_price - entry_price) * multiplier ELSE 0e0 END AS mtm_pnl "
         f"FROM {o} AS mo)")
    o = scenario_option_sql(o)
    o = (f"SELECT portfolio_id, symbol, trade_date, expiry_date, strike, option_type, quantity, lot_size, entry_date, "
         f"entry_price, current_price, mtm_pnl, pnl_total AS scenario_pnl, mtm_pnl + pnl_total AS total_pnl, method, "
         f"CASE WHEN _matched THEN delta END AS delta, CASE WHEN _matched THEN gamma END AS gamma, "
         f"CASE WHEN _matched THEN vega END AS vega, CASE WHEN _matched THEN theta END AS theta, "
         f"CASE WHEN _matched THEN rho END AS rho FROM {o} AS ro")
    f_src = f"(SELECT *, {shock_cols(spot, vol, rate)} FROM pos_fut)"
    f = (f"(SELECT *, CASE WHEN _matched THEN spot END AS current_price, "
         f"CASE WHEN _matched THEN (spot - entry_price) * multiplier ELSE 0e0 END AS mtm_pnl FROM {f_src} AS mf)")
    f = scenario_futures_sql(f)
    f = (f"SELECT portfolio_id, symbol, trade_date, expiry_date, strike, option_type, quantity, lot_size, entry_date, "
         f"entry_price, current_price, mtm_pnl, pnl_total AS scenario_pnl, mtm_pnl + pnl_total AS total_pnl, method, "
         f"CASE WHEN _matched THEN 1e0 END AS delta, CASE WHEN _matched THEN 0e0 END AS gamma, "
         f"CASE WHEN _matched THEN 0e0 END AS vega, CASE WHEN _matched THEN 0e0 END AS theta, "
         f"CASE WHEN _matched THEN 0e0 END AS rho FROM {f} AS rf")
    return f"({o} UNION ALL {f})"


def net_portfolio_sql(results: str, by: str = "portfolio_id") -> str:
    greeks = ", ".join(f"sum(coalesce({g}, 0e0) * (quantity * lot_size)) AS net_{g}" for g in GREEK_NAMES)
    return (f"SELECT {by}, sum(mtm_pnl) AS total_mtm_pnl, sum(scenario_pnl) AS total_scenario_pnl, "
            f"sum(total_pnl) AS total_pnl, {greeks}, count(*) AS positions, "
            f"count(*) FILTER (WHERE method = 'no_data') AS no_data_count FROM {results} AS r GROUP BY {by}")


def returns_sql(lookback: int = 252) -> str:
    return f"""(SELECT symbol, trade_date, spot, prev_spot, (spot - prev_spot) / prev_spot AS daily_return FROM (
  SELECT symbol, trade_date, spot, lag(spot) OVER (PARTITION BY symbol ORDER BY trade_date) AS prev_spot FROM (
    SELECT symbol, trade_date, close AS spot,
      row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS rn FROM p_spot) a
  WHERE rn <= {lookback + 1}) b WHERE prev_spot IS NOT NULL)"""


def scenarios_sql(lookback: int = 252) -> str:
    return (f"(SELECT symbol AS driver_symbol, trade_date AS scenario_date, daily_return * 100e0 AS spot_shock_pct, "
            f"{round_dec_sql('daily_return * 100e0', 4)} AS spot_return_pct, "
            f"0e0 AS vol_shock_abs, 0e0 AS rate_shock_bps FROM {returns_sql(lookback)} AS rr)")


#: Every daily return of every index, numbered by date.
RETURNS_ALL = ("ret", """SELECT symbol, trade_date, (spot - prev_spot) / prev_spot AS daily_return,
  row_number() OVER (PARTITION BY symbol ORDER BY trade_date) AS n
FROM (SELECT symbol, trade_date, close AS spot, lag(close) OVER (PARTITION BY symbol ORDER BY trade_date) AS prev_spot
      FROM p_spot) x WHERE prev_spot IS NOT NULL""")


def scenario_pnl_sql(lookback: int = 252, driver: str | None = "NIFTY") -> str:
    """(portfolio_id, trade_date, scenario_date, portfolio_pnl): positions x the
    last ``lookback`` returns up to each valuation date (needs RETURNS_ALL).

    ``driver`` = one index shocks every leg; ``None`` = each leg's own index.
    """
    sc = (f"(SELECT v.trade_date, v.symbol AS driver_symbol, r.trade_date AS scenario_date, r.daily_return * 100e0 AS spot_shock_pct, "
          f"0e0 AS vol_shock_abs, 0e0 AS rate_shock_bps FROM (SELECT d.trade_date, r.symbol, max(r.n) AS last_n "
          f"FROM (SELECT DISTINCT trade_date FROM positions) d JOIN ret r ON r.trade_date <= d.trade_date GROUP BY 1, 2) v "
          f"JOIN ret r ON r.symbol = v.symbol AND r.n BETWEEN v.last_n - {lookback - 1} AND v.last_n)")
    on = "s.trade_date = p.trade_date AND " + (f"s.driver_symbol = '{driver}'" if driver else "s.driver_symbol = p.symbol")
    cols = "p.*, s.scenario_date, s.spot_shock_pct, s.vol_shock_abs, s.rate_shock_bps"
    o = scenario_option_sql(base_price_sql(f"(SELECT {cols} FROM pos_opt p JOIN {sc} s ON {on})"))
    f = scenario_futures_sql(f"(SELECT {cols} FROM pos_fut p JOIN {sc} s ON {on})")
    k = "portfolio_id, trade_date, scenario_date"
    return (f"(SELECT {k}, sum(pnl_total) AS portfolio_pnl FROM (SELECT {k}, pnl_total FROM {o} AS so UNION ALL "
            f"SELECT {k}, pnl_total FROM {f} AS sf2) u GROUP BY {k})")


def var_cvar_sql(pnl: str) -> str:
    R = round_dec_sql
    k = "portfolio_id, trade_date"
    return f"""SELECT g.portfolio_id, g.trade_date, g.scenario_count, {R('-g.q95', 2)} AS var_95, {R('-g.q99', 2)} AS var_99,
  {R('coalesce(-t.t95, -g.q95)', 2)} AS cvar_95, {R('coalesce(-t.t99, -g.q99)', 2)} AS cvar_99,
  {R('g.m', 2)} AS mean_pnl, {R('g.lo', 2)} AS min_pnl, {R('g.hi', 2)} AS max_pnl
FROM (SELECT {k}, count(*) AS scenario_count, quantile_cont(_p, 0.05) AS q95, quantile_cont(_p, 0.01) AS q99,
        avg(_p) AS m, min(_p) AS lo, max(_p) AS hi FROM {pnl} GROUP BY {k}) g
JOIN (SELECT x.portfolio_id, x.trade_date, avg(x._p) FILTER (WHERE x._p < q.q95) AS t95, avg(x._p) FILTER (WHERE x._p < q.q99) AS t99
      FROM {pnl} x JOIN (SELECT {k}, quantile_cont(_p, 0.05) AS q95, quantile_cont(_p, 0.01) AS q99 FROM {pnl} GROUP BY {k}) q
        ON x.portfolio_id = q.portfolio_id AND x.trade_date = q.trade_date GROUP BY 1, 2) t
  ON t.portfolio_id = g.portfolio_id AND t.trade_date = g.trade_date"""


def pooled_var_sql(pnl: str) -> str:
    """``var_cvar_sql`` over all valuation dates of a portfolio."""
    R = round_dec_sql
    q = "quantile_cont(_p, 0.05) AS q95, quantile_cont(_p, 0.01) AS q99"
    return f"""SELECT g.portfolio_id, g.scenario_count, {R('-g.q95', 2)} AS var_95, {R('-g.q99', 2)} AS var_99,
  {R('coalesce(-t.t95, -g.q95)', 2)} AS cvar_95, {R('coalesce(-t.t99, -g.q99)', 2)} AS cvar_99,
  {R('g.m', 2)} AS mean_pnl, {R('g.lo', 2)} AS min_pnl, {R('g.hi', 2)} AS max_pnl
FROM (SELECT portfolio_id, count(*) AS scenario_count, {q}, avg(_p) AS m, min(_p) AS lo, max(_p) AS hi FROM {pnl} GROUP BY 1) g
JOIN (SELECT x.portfolio_id, avg(x._p) FILTER (WHERE x._p < q.q95) AS t95, avg(x._p) FILTER (WHERE x._p < q.q99) AS t99
      FROM {pnl} x JOIN (SELECT portfolio_id, {q} FROM {pnl} GROUP BY 1) q ON x.portfolio_id IS NOT DISTINCT FROM q.portfolio_id GROUP BY 1) t
  ON t.portfolio_id IS NOT DISTINCT FROM g.portfolio_id"""
