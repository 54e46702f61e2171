"""Black-Scholes-Merton price and Greeks as staged Spark SQL expressions.

A pricing is a short list of *stages*; each stage is a dict
``{column_name: sql_text}`` whose expressions only reference input columns
or columns made by earlier stages.  Spark applies a stage with
``withColumns`` (so d1/d2 are computed once and the cumulative normal is
never inlined into a giant expression), the DuckDB oracle nests one
``SELECT *, ...`` per stage.  Same text, same operation order, same numbers.

Conventions (fixed): day count 365; ``T`` and ``sigma`` floored at 1e-10;
vega per 1 vol point (/100); theta per calendar day (/365); rho per 1%
(/100).  ``q`` is a decimal dividend yield (the stored percent value must be
divided by 100 before it gets here).

For a call ``w = +1``, for a put ``w = -1``; with ``n1 = N(w d1)`` and
``n2 = N(w d2)``::

    price = w (S e^{-qT} n1 - K e^{-rT} n2)
    delta = w e^{-qT} n1
    theta = (-S e^{-qT} pdf(d1) sigma / (2 sqrt T) - w (r K e^{-rT} n2 - q S e^{-qT} n1)) / 365
    rho   = w K T e^{-rT} n2 / 100
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .normal import cdf_stages, pdf_sql

T_FLOOR = "1e-10"
SIGMA_FLOOR = "1e-10"
DAYS_PER_YEAR = 365


def bs_stages(
    S: str, K: str, T: str, r: str, q: str, sigma: str, is_call: str, p: str = "_bs"
) -> list[dict[str, str]]:
    """Stages that leave ``{p}_price`` plus the pieces the Greeks need."""
    return [
        {
            f"{p}_T": f"greatest({T}, {T_FLOOR})",
            f"{p}_s": f"greatest({sigma}, {SIGMA_FLOOR})",
            f"{p}_w": f"CASE WHEN {is_call} THEN 1e0 ELSE -1e0 END",
        },
        {
            f"{p}_sq": f"sqrt({p}_T)",
            f"{p}_eq": f"exp(-({q}) * {p}_T)",
            f"{p}_er": f"exp(-({r}) * {p}_T)",
        },
        {
            f"{p}_d1": f"(ln(({S}) / ({K})) + (({r}) - ({q}) + 0.5e0 * {p}_s * {p}_s) * {p}_T)"
            f" / ({p}_s * {p}_sq)"
        },
        {f"{p}_d2": f"{p}_d1 - {p}_s * {p}_sq"},
        {f"{p}_x1": f"{p}_w * {p}_d1", f"{p}_x2": f"{p}_w * {p}_d2"},
        *cdf_stages({f"{p}_n1": f"{p}_x1", f"{p}_n2": f"{p}_x2"}, f"{p}_c"),
        {
            f"{p}_price": f"{p}_w * (({S}) * {p}_eq * {p}_n1 - ({K}) * {p}_er * {p}_n2)"
        },
    ]


def greek_stages(S: str, K: str, r: str, q: str, p: str = "_bs") -> list[dict[str, str]]:
    """Greeks on top of :func:`bs_stages` (same prefix)."""
    return [
        {f"{p}_pdf": pdf_sql(f"{p}_d1")},
        {
            f"{p}_delta": f"{p}_w * {p}_eq * {p}_n1",
            f"{p}_gamma": f"{p}_eq * {p}_pdf / (({S}) * {p}_s * {p}_sq)",
            f"{p}_vega": f"({S}) * {p}_eq * {p}_pdf * {p}_sq / 100e0",
            f"{p}_theta": f"(-(({S}) * {p}_eq * {p}_pdf * {p}_s) / (2e0 * {p}_sq)"
            f" - {p}_w * (({r}) * ({K}) * {p}_er * {p}_n2 - ({q}) * ({S}) * {p}_eq * {p}_n1))"
            f" / {DAYS_PER_YEAR}e0",
            f"{p}_rho": f"{p}_w * ({K}) * {p}_T * {p}_er * {p}_n2 / 100e0",
        },
    ]


def stage_columns(stages: list[dict[str, str]]) -> list[str]:
    return [c for st in stages for c in st]


def apply_stages(df: DataFrame, stages: list[dict[str, str]]) -> DataFrame:
    for st in stages:
        df = df.withColumns({k: F.expr(v) for k, v in st.items()})
    return df


def stages_sql(from_sql: str, stages: list[dict[str, str]], alias: str = "t") -> str:
    """Nest the stages as SQL subqueries over ``from_sql`` (oracle side)."""
    sql = from_sql
    for i, st in enumerate(stages):
        cols = ", ".join(f"{v} AS {k}" for k, v in st.items())
        sql = f"(SELECT *, {cols} FROM {sql} AS {alias}{i})"
    return sql


def with_bs_price(
    df: DataFrame, out: str, S: str, K: str, T: str, r: str, q: str, sigma: str,
    is_call: str, p: str = "_bs", keep: bool = False,
) -> DataFrame:
    """Add column ``out`` = BS price; temporaries dropped unless ``keep``."""
    st = bs_stages(S, K, T, r, q, sigma, is_call, p)
    df = apply_stages(df, st).withColumnRenamed(f"{p}_price", out)
    if keep:
        return df
    return df.drop(*[c for c in stage_columns(st) if c != f"{p}_price"])


def with_bs_greeks(
    df: DataFrame, S: str, K: str, T: str, r: str, q: str, sigma: str, is_call: str,
    p: str = "_g", names: dict[str, str] | None = None, price: str | None = None,
) -> DataFrame:
    """Add delta, gamma, vega, theta, rho (and optionally the price)."""
    names = names or {g: g for g in ("delta", "gamma", "vega", "theta", "rho")}
    st = bs_stages(S, K, T, r, q, sigma, is_call, p) + greek_stages(S, K, r, q, p)
    df = apply_stages(df, st)
    ren = {f"{p}_{g}": n for g, n in names.items()}
    if price:
        ren[f"{p}_price"] = price
    df = df.withColumnsRenamed(ren)
    return df.drop(*[c for c in stage_columns(st) if c not in ren])
