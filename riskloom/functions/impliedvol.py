"""Implied volatility as staged SQL expressions: a rational first guess and two
third-order Householder steps, without a loop and without Python.

With ``a = S e^{-qT}`` and ``b = K e^{-rT}``, the out-of-the-money time value over
``sqrt(a b)`` depends on the total volatility ``s = sigma sqrt(T)`` and on
``x = -|ln(a / b)|`` alone::

    beta(s) = e^{x/2} N(x/s + s/2) - e^{-x/2} N(x/s - s/2)
    beta'   = exp(-(x/s)^2 / 2 - s^2 / 8) / sqrt(2 pi)
    beta'' / beta' = x^2 / s^3 - s / 4

``beta`` bends at ``s_c = sqrt(2 |x|)``.  Below ``beta(s_c)`` the logarithm is solved,
starting where ``1 / s^2`` is linear in it (its behaviour as s goes to 0); above, beta
itself, starting from the tangent at ``s_c``.  Each step is Newton's corrected by the
second and third derivatives, so errors go with their fourth power: where the last
step moved by less than ``SETTLED``, the price is met far within ``TOLERANCE``.

Rows whose steps have not settled (``{p}_well`` false) take up to ``MORE_STEPS`` further
ones (:func:`more_steps_sql`), evaluated for those rows only, at less than half the cost
of the halvings.  Rows whose price hardly moves with the volatility (a vega below
``MIN_VEGA`` of the discounted spot, or steps that do not settle) have no root that
doubles can tell; there the answer is, by definition, what bisection gives
(:func:`bisection_sql`), evaluated for those rows only.
"""

from __future__ import annotations

from .normal import cdf_sql

IV_LOWER = 0.001
IV_UPPER = 5.0
BISECTIONS = 60
TOLERANCE = 1e-6
MIN_VEGA = 1e-4  # of the discounted spot, for one unit of volatility
STEPS = 2
MORE_STEPS = 2  # for the rows that need them
SETTLED = 3e-4  # relative size of the last step; its error goes with the fourth power
_ROOT_2PI = "sqrt(2e0 * pi())"


def _step(p: str, i: int, s: str) -> list[dict[str, str]]:
    """Stages that improve the total volatility ``s``; leaves ``{p}{i}_s`` and ``{p}{i}_d`` (the relative move).

    ``k2`` and ``k3`` are the second and third derivative of the function solved over its first.
    """
    c, low = f"{p}{i}", f"{p}_low"
    h2, g = f"{c}_h2", f"({c}_v / nullif({c}_b, 0e0))"
    h3 = f"({h2} * {h2} - 3e0 * {p}_x * {p}_x / ({s} * {s} * {s} * {s}) - 0.25e0)"
    move = (f"({c}_nu * (1e0 + 0.5e0 * {c}_k2 * {c}_nu) / nullif(1e0 + {c}_nu * ({c}_k2 + {c}_k3 * {c}_nu / 6e0), 0e0))")
    return [
        {f"{c}_z1": f"{p}_x / {s} + 0.5e0 * {s}", f"{c}_z2": f"{p}_x / {s} - 0.5e0 * {s}"},
        {f"{c}_n1": cdf_sql(f"{c}_z1"), f"{c}_n2": cdf_sql(f"{c}_z2")},
        {f"{c}_b": f"{p}_eh * {c}_n1 - {c}_n2 / {p}_eh",
         f"{c}_v": f"{p}_eh * exp(-0.5e0 * {c}_z1 * {c}_z1) / {_ROOT_2PI}",
         f"{h2}": f"{p}_x * {p}_x / ({s} * {s} * {s}) - 0.25e0 * {s}"},
        {f"{c}_nu": f"CASE WHEN {low} THEN (ln({p}_beta) - ln({c}_b)) / {g} ELSE ({p}_beta - {c}_b) / nullif({c}_v, 0e0) END",
         f"{c}_k2": f"CASE WHEN {low} THEN {h2} - {g} ELSE {h2} END",
         f"{c}_k3": f"CASE WHEN {low} THEN {h3} - 3e0 * {h2} * {g} + 2e0 * {g} * {g} ELSE {h3} END"},
        {f"{c}_s": f"least(greatest({s} + {move}, 0.2e0 * {s}), 5e0 * {s})", f"{c}_d": f"abs({move}) / {s}"},
    ]


def iv_stages(px: str, S: str, K: str, T: str, r: str, q: str, is_call: str, valid: str, p: str = "_iv") -> list[dict[str, str]]:
    """Stages that leave ``{p}_sig`` (NULL where ``valid`` is false) and ``{p}_well``.

    Few and large: a stage that is not inlined into the next costs a copy of the row.
    """
    c = f"{p}c"
    newton = lambda y: f"({y} - ({c}_ka * (exp({y}) - 1e0) + {c}_kb * {y} - {c}_kl) / ({c}_ka * exp({y}) + {c}_kb))"
    stages = [
        {f"{p}_T": f"greatest({T}, 1e-10)", f"{p}_w": f"CASE WHEN {is_call} THEN 1e0 ELSE -1e0 END"},
        {f"{p}_sq": f"sqrt({p}_T)", f"{p}_a": f"CASE WHEN {valid} THEN ({S}) * exp(-({q}) * {p}_T) END",
         f"{p}_b": f"CASE WHEN {valid} THEN ({K}) * exp(-({r}) * {p}_T) END"},
        {f"{p}_y": f"ln({p}_a / {p}_b)",
         f"{p}_beta": f"(({px}) - greatest({p}_w * ({p}_a - {p}_b), 0e0)) / sqrt({p}_a * {p}_b)"},
        # at s_c: z1 = 0, z2 = -s_c
        {f"{p}_x": f"-abs({p}_y)", f"{p}_eh": f"exp(-0.5e0 * abs({p}_y))", f"{p}_sc": f"sqrt(2e0 * abs({p}_y))",
         f"{c}_z2": f"-sqrt(2e0 * abs({p}_y))"},
        {f"{c}_n2": cdf_sql(f"{c}_z2")},
        {f"{c}_b": f"0.5e0 * {p}_eh - {c}_n2 / {p}_eh", f"{c}_v": f"{p}_eh / {_ROOT_2PI}"},
        {f"{p}_low": f"{p}_beta < {c}_b", f"{c}_ka": f"-0.25e0 * {p}_x", f"{c}_kl": f"ln({c}_b) - ln({p}_beta)",
         f"{c}_kb": f"CASE WHEN {p}_beta < {c}_b THEN 0.5e0 * {c}_v * {p}_sc / {c}_b + 0.25e0 * {p}_x END"},
        # both terms are positive, so either one alone bounds the root from above
        {f"{c}_y0": f"CASE WHEN {p}_low THEN least({c}_kl / {c}_kb, ln(1e0 + {c}_kl / {c}_ka)) END"},
        {f"{c}_y1": newton(f"{c}_y0")},
        {f"{p}_s0": f"CASE WHEN NOT {p}_beta > 0e0 THEN NULL WHEN {p}_low THEN {p}_sc * exp(-0.5e0 * {newton(f'{c}_y1')}) "
                    f"ELSE {p}_sc + ({p}_beta - {c}_b) / {c}_v END"},
    ]
    s = f"{p}_s0"
    for i in range(STEPS):
        stages += _step(p, i, s)
        s = f"{p}{i}_s"
    return [*stages, {f"{p}_sig": f"{s} / {p}_sq", f"{p}_well": well_sql(T, s, f"{p}{STEPS - 1}_d", p)}]


def well_sql(T: str, s: str, d: str, p: str = "_iv") -> str:
    """The total volatility ``s`` is the root: its last move ``d`` was small and the price decides it."""
    d1 = f"({p}_y / {s} + 0.5e0 * {s})"
    return (f"coalesce({d} < {SETTLED!r} AND ({T}) > 1e-10 AND "
            f"exp(-0.5e0 * {d1} * {d1}) / {_ROOT_2PI} * {p}_sq > {MIN_VEGA!r}, false)")


def _let(value: str, name: str, body: str) -> str:
    """SQL text of ``body`` with ``name`` bound to ``value``, evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def more_steps_sql(body: str, name: str = "n", p: str = "_iv") -> str:
    """``body`` with ``name`` bound to (s, d) after the steps that a row still needs."""
    c = f"{p}{STEPS}"
    step = f"named_struct('s', {c}_s, 'd', {c}_d)"
    for stage in reversed(_step(p, STEPS, "z.s")):
        for column, value in stage.items():
            step = _let(value, column, step)
    last = f"{p}{STEPS - 1}"
    steps = (f"aggregate(sequence(1, {MORE_STEPS}), named_struct('s', {last}_s, 'd', {last}_d), "
             f"(z, i) -> if(z.d < {SETTLED!r}, z, {step}))")
    return _let(steps, name, body)


def bisection_sql(px: str, S: str, K: str, r: str, q: str, p: str = "_iv") -> str:
    """60 halvings of [0.001, 5] on the stages' discounted legs; NULL if they do not bracket the price or do not reach it."""
    def price(m: str) -> str:
        cdf = lambda x: _let(x, "cx", cdf_sql("cx"))
        d1 = f"(ln(({S}) / ({K})) + (({r}) - ({q}) + 0.5e0 * {m} * {m}) * {p}_T) / ({m} * {p}_sq)"
        return _let(d1, "d1", f"{p}_w * ({p}_a * {cdf(f'{p}_w * d1')} - {p}_b * {cdf(f'{p}_w * (d1 - {m} * {p}_sq)')})")
    lo, hi = f"{IV_LOWER!r}D", f"{IV_UPPER!r}D"
    halve = _let("(z.lo + z.hi) / 2e0", "m", f"if({price('m')} > ({px}), named_struct('lo', z.lo, 'hi', m), named_struct('lo', m, 'hi', z.hi))")
    root = f"aggregate(sequence(1, {BISECTIONS}), named_struct('lo', {lo}, 'hi', {hi}), (z, i) -> {halve}, z -> (z.lo + z.hi) / 2e0)"
    return (f"CASE WHEN {price(lo)} <= ({px}) AND {price(hi)} >= ({px}) THEN "
            + _let(root, "sig", f"if(abs({price('sig')} - ({px})) < {TOLERANCE!r}, sig, CAST(NULL AS DOUBLE))") + " END")
