"""Standard normal pdf / cdf as Spark SQL text, Column builders and numpy.

Neither Spark SQL nor DuckDB has ``erf``, so the cumulative normal is the
double-precision rational approximation of Hart (1968), as popularised by
West, "Better approximations to cumulative normal functions" (2005).  The
same text is used by Spark (``F.expr``), by the DuckDB oracle, and — with
identical operation order — by the numpy kernel of the IV solver, so the
three agree to the last few ulps.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed coefficients of the Hart double-precision approximation.
HART_P = [
    0.0352624965998911,
    0.700383064443688,
    6.37396220353165,
    33.912866078383,
    112.079291497871,
    221.213596169931,
    220.206867912376,
]
HART_Q = [
    0.0883883476483184,
    1.75566716318264,
    16.064177579207,
    86.7807322029461,
    296.564248779674,
    637.333633378831,
    793.826512519948,
    440.413735824752,
]
HART_SPLIT = 7.07106781186547
HART_CUTOFF = 37.0
SQRT_2PI = 2.506628274631


def _lit(x: float) -> str:
    # exponent form so both engines read DOUBLE, never DECIMAL
    return f"{x!r}e0" if "e" not in repr(x) else repr(x)


def _horner_sql(coefs: list[float], a: str) -> str:
    expr = _lit(coefs[0])
    for c in coefs[1:]:
        expr = f"(({expr}) * {a} + {_lit(c)})"
    return expr


def cdf_sql(x: str) -> str:
    """SQL text of N(x) for a column/identifier ``x`` (referenced ~20 times,
    so pass a column name, not a large expression)."""
    a = f"abs({x})"
    tail = (
        f"exp(-({a}) * ({a}) / 2e0) * {_horner_sql(HART_P, a)} / {_horner_sql(HART_Q, a)}"
    )
    far = (
        f"exp(-({a}) * ({a}) / 2e0) / ({a} + 1e0 / ({a} + 2e0 / ({a} + 3e0 / "
        f"({a} + 4e0 / ({a} + 0.65e0))))) / {_lit(SQRT_2PI)}"
    )
    lower = (
        f"(CASE WHEN {a} > {_lit(HART_CUTOFF)} THEN 0e0 "
        f"WHEN {a} < {_lit(HART_SPLIT)} THEN {tail} ELSE {far} END)"
    )
    return f"(CASE WHEN {x} > 0e0 THEN 1e0 - {lower} ELSE {lower} END)"


def cdf_stages(xs: dict[str, str], p: str) -> list[dict[str, str]]:
    """N(x) for several inputs as small stages (``{out: x}``).

    Same arithmetic as :func:`cdf_sql`, but |x|, the Gaussian factor and the
    lower tail are separate columns, so no stage holds more than one
    polynomial and the generated code stays small enough to be JIT-compiled.
    """
    a = {f"{p}{i}_a": f"abs({x})" for i, x in enumerate(xs.values())}
    e = {f"{p}{i}_e": f"exp(-{p}{i}_a * {p}{i}_a / 2e0)" for i in range(len(xs))}
    lo = {}
    for i in range(len(xs)):
        ai, ei = f"{p}{i}_a", f"{p}{i}_e"
        lo[f"{p}{i}_lo"] = (
            f"CASE WHEN {ai} > {_lit(HART_CUTOFF)} THEN 0e0 "
            f"WHEN {ai} < {_lit(HART_SPLIT)} THEN {ei} * {_horner_sql(HART_P, ai)} / {_horner_sql(HART_Q, ai)} "
            f"ELSE {ei} / ({ai} + 1e0 / ({ai} + 2e0 / ({ai} + 3e0 / ({ai} + 4e0 / ({ai} + 0.65e0))))) "
            f"/ {_lit(SQRT_2PI)} END"
        )
    out = {o: f"CASE WHEN {x} > 0e0 THEN 1e0 - {p}{i}_lo ELSE {p}{i}_lo END"
           for i, (o, x) in enumerate(xs.items())}
    return [a, e, lo, out]


def pdf_sql(x: str) -> str:
    return f"(exp(-0.5e0 * {x} * {x}) / sqrt(2e0 * pi()))"


def norm_cdf(col_name: str) -> Column:
    """N(x) as a Spark Column over the named column."""
    return F.expr(cdf_sql(f"`{col_name}`"))


def norm_pdf(col_name: str) -> Column:
    return F.expr(pdf_sql(f"`{col_name}`"))


def norm_cdf_np(x: np.ndarray) -> np.ndarray:
    """numpy twin of :func:`cdf_sql` (same operation order, same values).

    The far-tail continued fraction is evaluated only where |x| >= 7.07
    (rare), and the polynomials are built in place.
    """
    x = np.asarray(x, dtype=np.float64)
    a = np.abs(x)
    e = np.exp(-a * a / 2.0)
    p = np.full_like(a, HART_P[0])
    for c in HART_P[1:]:
        p *= a
        p += c
    q = np.full_like(a, HART_Q[0])
    for c in HART_Q[1:]:
        q *= a
        q += c
    lower = e * p
    lower /= q
    far = a >= HART_SPLIT
    if far.any():
        af, ef = a[far], e[far]
        lower[far] = np.where(
            af > HART_CUTOFF, 0.0,
            ef / (af + 1.0 / (af + 2.0 / (af + 3.0 / (af + 4.0 / (af + 0.65))))) / SQRT_2PI)
    return np.where(x > 0.0, 1.0 - lower, lower)


def norm_pdf_np(x: np.ndarray) -> np.ndarray:
    return np.exp(-0.5 * x * x) / np.sqrt(2.0 * np.pi)
