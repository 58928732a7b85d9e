"""Fisher's exact test and the pooled t-test as Spark SQL expressions.

Spark has neither log-gamma nor a distribution function, so both tails are composed from
built-in functions. Nothing is broadcast or tabulated: the cost of one evaluation does not depend
on a table that grows with the cohort. The formulas are written as SQL text, whose arguments are
column names or other SQL expressions of number type.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients in odd powers of 1/z of the asymptotic series of log-gamma, and of
# log(gamma(z + 1/2) / gamma(z)).
_LOG_GAMMA_SERIES = [1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360]
_HALF_STEP_SERIES = [-1 / 8, 1 / 192, -1 / 640, 17 / 14336, -31 / 18432, 691 / 180224]

_SHIFT = 10  # arguments are moved up this far, where the series is exact in double precision
_TAIL_EXPONENT = 42  # terms below exp(-42) of the first cannot change a double


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` standing for a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _odd_powers(z: str, coefficients: list[float]) -> str:
    inner = f"({coefficients[-1]!r}D)"
    for c in reversed(coefficients[:-1]):
        inner = f"({c!r}D + {inner} / ({z} * {z}))"
    return f"{inner} / {z}"


def log_gamma(z: str) -> str:
    """Natural logarithm of the gamma function for z > 0."""
    shifted = f"(z + {_SHIFT}D)"
    product = " * ".join(f"(z + {i}D)" for i in range(_SHIFT))
    return _let(
        "z",
        f"cast({z} as double)",
        f"(({shifted} - 0.5D) * ln{shifted} - {shifted} + {0.5 * math.log(2 * math.pi)!r}D"
        f" + {_odd_powers(shifted, _LOG_GAMMA_SERIES)} - ln({product}))",
    )


def log_factorial(n: str) -> str:
    """Natural logarithm of n!."""
    return log_gamma(f"{n} + 1D")


def _log_half_step(a: str) -> str:
    """log(gamma(a + 1/2) / gamma(a)), without the cancellation of two log-gammas."""
    shifted = f"({a} + {_SHIFT}D)"
    ratio = " * ".join(f"(({a} + {i}D) / ({a} + {i}.5D))" for i in range(_SHIFT))
    return f"(0.5D * ln{shifted} + {_odd_powers(shifted, _HALF_STEP_SERIES)} + ln({ratio}))"


def _hypergeometric_upper(v: str) -> str:
    """P(X >= a) for the 2x2 table v = (a, b / c, d) whose terms fall from a on.

    The first term comes from log-factorials, the others from the ratio of neighbours. The sum
    stops where the rest is below double precision. With L the log of the first ratio
    (terms shrink at least by exp(-(L + h*s)) from term h on, s = 1/b + 1/c), twice the
    solution h of h * (L + h*s) = 42 terms are enough.
    """
    a, b, c, d = f"{v}.a", f"{v}.b", f"{v}.c", f"{v}.d"

    def log_product(*numbers: str) -> str:
        return f"aggregate(array({', '.join(numbers)}), 0D, (s, n) -> s + {log_factorial('n')})"

    margins = log_product(f"{a} + {b}", f"{c} + {d}", f"{a} + {c}", f"{b} + {d}")
    cells = log_product(a, b, c, d, f"{a} + {b} + {c} + {d}")
    fall = f"greatest(ln(({a} + 1D) * ({d} + 1D)) - ln(greatest({b} * {c}, 1D)), 0D)"
    steep = f"(1D / greatest({b}, 1D) + 1D / greatest({c}, 1D))"
    k = f"{4 * _TAIL_EXPONENT}D"
    enough = _let("f", fall, f"({k} / (f + sqrt(f * f + {k} * {steep})) + 1D)")
    steps = f"cast(ceil(least({b}, {c}, {enough})) as int)"
    term = f"state.term * (({b} - j) * ({c} - j)) / (({a} + j + 1D) * ({d} + j + 1D))"
    add_next = _let("t", term, "named_struct('term', t, 'total', state.total + t)")
    # one step past the last possible table adds an exact zero, so the sequence is never empty
    tail = (
        f"aggregate(sequence(0, {steps}), named_struct('term', 1D, 'total', 1D),"
        f" (state, j) -> {add_next}, state -> state.total)"
    )
    return f"exp({margins} - {cells}) * {tail}"


def fisher_greater(
    sum_case: str = "sum_case",
    n_case: str = "n_case",
    sum_control: str = "sum_control",
    n_control: str = "n_control",
    table: str = "standard",
) -> Column:
    """One-sided (greater) Fisher exact p-value of carriers among cases against controls.

    ``table='standard'`` is (sum_case, n_case - sum_case / sum_control, n_control - sum_control).
    ``table='compat'`` puts all n_control in the last cell, as earlier stored rankings did.
    NULL when a group is empty.
    """
    if table not in ("standard", "compat"):
        raise ValueError("table must be 'standard' or 'compat'")
    last = f"{n_control} - {sum_control}" if table == "standard" else n_control

    def cells(a: str, b: str, c: str, d: str) -> str:
        parts = zip("abcd", (a, b, c, d))
        fields = ", ".join(f"'{name}', cast({value} as double)" for name, value in parts)
        return f"named_struct({fields})"

    # Below the mode the terms still rise, so the other tail, (X <= a - 1), is summed and taken
    # from one. It is the upper tail of the table with its rows swapped, from c + 1 on.
    rising = "(x.b * x.c > (x.a + 1D) * (x.d + 1D))"
    swapped = cells("x.c + 1D", "x.d - 1D", "x.a - 1D", "x.b + 1D")
    tail = _let("v", f"if({rising}, {swapped}, x)", _hypergeometric_upper("v"))
    p = _let("p", tail, f"least(if({rising}, 1D - p, p), 1D)")
    given = cells(sum_case, f"{n_case} - {sum_case}", sum_control, last)
    whole = _let("x", given, f"if(x.a = 0, 1D, {p})")
    return F.expr(f"CASE WHEN {n_case} > 0 AND {n_control} > 0 THEN {whole} END")


def pooled_t(
    n1: str = "n_case",
    sum1: str = "sum_case",
    sumsq1: str = "sumsq_case",
    n2: str = "n_control",
    sum2: str = "sum_control",
    sumsq2: str = "sumsq_control",
) -> Column:
    """Two-sample t statistic with pooled variance from counts, sums and sums of squares.

    Members without a value count as zeros through n. NULL without variance or degrees of freedom.
    """

    def number(x: str) -> str:
        return f"cast({x} as double)"

    def spread(n: str, total: str, squares: str) -> str:
        n, total, squares = number(n), number(total), number(squares)
        return f"({n} * {squares} - {total} * {total}) / {n}"

    df = f"({number(n1)} + {number(n2)} - 2D)"
    error = (
        f"({spread(n1, sum1, sumsq1)} + {spread(n2, sum2, sumsq2)}) / {df}"
        f" * (1D / {number(n1)} + 1D / {number(n2)})"
    )
    difference = f"({number(sum1)} / {n1} - {number(sum2)} / {n2})"
    t = _let("e", error, f"if(e > 0, {difference} / sqrt(e), cast(null as double))")
    return F.expr(f"CASE WHEN {n1} > 0 AND {n2} > 0 AND {n1} + {n2} > 2 THEN {t} END")


def _fraction_terms(root: str, large: str | None = None) -> str:
    """Double steps after which the continued fraction at x is exact, given sqrt(1 - x).

    Every double step shrinks the error at least by ((1 - r) / (1 + r))^2, the rate of a fraction whose
    coefficients are all -x / 4, except for the first ones where b is the large parameter; those are
    exact within seven. Where a is large, the fraction nears that of the normal tail first, whose error
    after n steps is exp(-4 t sqrt(n / 2)), so ``large``, 162 / t^2 steps, are enough as well.
    """
    fall = f"greatest(ln((1D + {root}) / greatest(1D - {root}, 1e-16D)), 1e-9D)"
    if large is None:
        return f"cast(ceil(18D / {fall}) as int) + 7"
    return f"cast(ceil(least(18D / {fall}, {large})) as int) + 2"


def _beta_fraction(a: str, b: str, x: str, terms: str) -> str:
    """Continued fraction of the incomplete beta function, evaluated by the modified Lentz rule."""
    first = f"1D / (1D - ({a} + {b}) * {x} / ({a} + 1D))"
    start = _let("w", first, "named_struct('c', 1D, 'd', w, 'h', w)")

    def advance(state: str, coefficient: str) -> str:
        c = f"(1D + k / {state}.c)"
        d = f"(1D / (1D + k * {state}.d))"
        update = f"named_struct('c', {c}, 'd', {d}, 'h', {state}.h * {c} * {d})"
        return _let("k", coefficient, update)

    end = f"({a} + 2D * m)"
    even = f"m * ({b} - m) * {x} / (({end} - 1D) * {end})"
    odd = f"-({a} + m) * ({a} + {b} + m) * {x} / ({end} * ({end} + 1D))"
    step = _let("half", advance("state", even), advance("half", odd))
    return f"aggregate(sequence(1, {terms}), {start}, (state, m) -> {step}, state -> state.h)"


def _t_two_sided(t: str, df: str) -> str:
    """P(|T| >= |t|), the regularised incomplete beta function at df / (df + t^2)."""
    front = (
        f"exp({_log_half_step('v.a')} - {0.5 * math.log(math.pi)!r}D"
        " + v.a * ln(v.x) + 0.5D * ln(v.y))"
    )
    # each side of this point one of the two symmetric fractions converges fast
    direct = "(v.x < (v.a + 1D) / (v.a + 2.5D))"
    near = _fraction_terms("sqrt(v.y)", "81D * v.x / (v.a * v.y)")
    arguments = (
        f"if({direct}, named_struct('a', v.a, 'b', 0.5D, 'x', v.x, 'n', {near}),"
        f" named_struct('a', 0.5D, 'b', v.a, 'x', v.y, 'n', {_fraction_terms('sqrt(v.x)')}))"
    )
    part = _let("q", arguments, f"{front} * {_beta_fraction('q.a', 'q.b', 'q.x', 'q.n')} / q.a")
    p = _let("p", part, f"greatest(least(if({direct}, p, 1D - p), 1D), 0D)")
    known = (
        f"named_struct('a', cast({df} as double) / 2D, 'x', {df} / ({df} + {t} * {t}),"
        f" 'y', {t} * {t} / ({df} + {t} * {t}))"
    )
    whole = _let("v", known, p)
    return f"CASE WHEN {t} IS NOT NULL AND {df} > 0 THEN if({t} = 0, 1D, {whole}) END"


def t_two_sided(t: str, df: str) -> Column:
    """Two-sided p-value of Student's t with df degrees of freedom. NULL for NULL."""
    return F.expr(_t_two_sided(t, f"({df})"))


def t_halved(t: str, df: str) -> Column:
    """The two-sided p-value halved, whatever the sign of t."""
    return t_two_sided(t, df) / 2


def t_greater(t: str, df: str) -> Column:
    """P(T >= t): small only when the first group is larger."""
    half = f"({_t_two_sided(t, f'({df})')})"
    return F.expr(_let("p", f"{half} / 2D", f"if({t} >= 0, p, 1D - p)"))
