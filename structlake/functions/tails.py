"""Tail probabilities as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

#: Coefficients of 1/x, 1/x**3, … in the asymptotic series of ln Γ.
_SERIES = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)
_SHIFT = 10
_TINY = 1e-300


def _series(x: Column) -> Column:
    return sum((F.lit(c) / F.pow(x, F.lit(2.0 * k + 1)) for k, c in enumerate(_SERIES)), F.lit(0.0))


def log_gamma(x: Column) -> Column:
    """ln Γ for positive x: the asymptotic series ten places up, stepped back down by products."""
    far = x + F.lit(float(_SHIFT))
    steps = sum((F.log(x + F.lit(float(k))) for k in range(_SHIFT)), F.lit(0.0))
    return (far - 0.5) * F.log(far) - far + 0.5 * math.log(2 * math.pi) + _series(far) - steps


def log_gamma_rise(x: Column, by: Column) -> Column:
    """ln Γ(x + by) - ln Γ(x), without the cancellation that large x would bring."""
    far = x + F.lit(float(_SHIFT))
    steps = sum((F.log1p(by / (x + F.lit(float(k)))) for k in range(_SHIFT)), F.lit(0.0))
    return (far - 0.5) * F.log1p(by / far) + by * F.log(far + by) - by + _series(far + by) - _series(far) - steps


def _away(value: Column) -> Column:
    return F.when(F.abs(value) < _TINY, F.lit(_TINY)).otherwise(value)


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, by Lentz's forward recurrence.

    It settles after some square root of the larger parameter steps where x is below the mean.
    """
    steps = F.sequence(F.lit(1), (F.lit(80) + 8 * F.sqrt(F.greatest(a, b))).cast("int"))

    def turn(state: Column, factor: Column) -> Column:
        d = 1.0 / _away(1.0 + factor * state["d"])
        c = _away(1.0 + factor / state["c"])
        return F.struct(c.alias("c"), d.alias("d"), (state["h"] * c * d).alias("h"))

    def step(state: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a - 1.0 + 2 * m) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 1.0 + 2 * m))
        # Each turn is bound to a name, so that the next one does not unfold it again.
        half = F.transform(F.array(turn(state, even)), lambda s: turn(s, odd))
        return half[0]

    first = 1.0 / _away(1.0 - (a + b) * x / (a + 1.0))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))
    return F.aggregate(steps, start, step, lambda s: s["h"])


def incomplete_beta(a: Column, b: Column, x: Column, rest: Column) -> Column:
    """Regularised incomplete beta function for x from 0 to 1; ``rest`` is 1 - x, given so that neither end loses digits."""
    def log_of(value: Column, other: Column) -> Column:
        return F.when(value < 0.5, F.log(value)).otherwise(F.log1p(-other))

    small = F.least(a, b)
    front = F.exp(log_gamma_rise(F.greatest(a, b), small) - log_gamma(small) + a * log_of(x, rest) + b * log_of(rest, x))
    lower = front * _fraction(a, b, x) / a
    upper = 1.0 - front * _fraction(b, a, rest) / b
    return (F.when(x <= 0, F.lit(0.0)).when(rest <= 0, F.lit(1.0))
            .when(x < (a + 1.0) / (a + b + 2.0), lower).otherwise(upper))


def student_two_sided(t: Column, degrees: Column) -> Column:
    """Probability that a Student t variable lies further from zero than t, on either side.

    Good to nine digits for some million degrees of freedom, to seven for 10 ** 9.
    """
    n = degrees.cast("double")
    return F.when(n > 0, incomplete_beta(n / 2, F.lit(0.5), n / (n + t * t), t * t / (n + t * t)))
