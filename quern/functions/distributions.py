"""Log-probabilities of distributions, as columns that generate code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of the series of erf; enough for double precision up to the size where it is 1.
TERMS = 110
MOST = 6.0


def erf(x: Column) -> Column:
    """The error function by its series with positive terms, as nested products."""
    size = F.least(F.abs(x), F.lit(MOST))
    # Doubles throughout: a cast at every level would take the analyzer a pass each.
    twice = F.lit(2.0) * size * size
    total = F.lit(1.0)
    for n in range(TERMS, 0, -1):
        total = F.lit(1.0) + twice * F.lit(1.0 / (2 * n + 1)) * total
    return F.signum(x) * F.least(F.lit(2 / math.sqrt(math.pi)) * size * F.exp(-size * size) * total, F.lit(1.0))


def positive(value: Column, transform: str = "softplus") -> Column:
    """A raw parameter made positive."""
    kinds = {
        "softplus": lambda: F.log1p(F.exp(-F.abs(value))) + F.greatest(value, F.lit(0.0)),
        "abs": lambda: F.abs(value),
        "exp": lambda: F.exp(F.greatest(F.least(value, F.lit(50.0)), F.lit(-50.0))),
        "identity": lambda: F.greatest(value, F.lit(0.0)),
        "none": lambda: F.greatest(value, F.lit(0.0)),
    }
    if transform not in kinds:
        raise ValueError(f"unsupported positive transform: {transform}")
    return kinds[transform]()


def _at_least(value: Column, least: float = 1e-8) -> Column:
    return F.greatest(value, F.lit(least))


def log_gamma(x: Column) -> Column:
    """Stirling's formula with its first correction."""
    x = _at_least(x)
    return (x - 0.5) * F.ln(x) - x + F.lit(0.5 * math.log(2 * math.pi)) + 1 / (12 * x)


def normal(y: Column, mean: Column, std: Column) -> Column:
    """``std`` as it is in the logarithm, and at least 1e-8 below the deviation."""
    z = (y - mean) / _at_least(std)
    return F.lit(-0.5 * math.log(2 * math.pi)) - F.ln(std) - 0.5 * z * z


def poisson(y: Column, rate: Column) -> Column:
    """With Stirling's formula for the factorial of counts above 0."""
    rate = _at_least(rate)
    factorial = F.when(y <= 0, F.lit(0.0)).otherwise(y * F.ln(y) - y + 0.5 * F.ln(2 * math.pi * y + 1 / 3))
    return y * F.ln(rate) - rate - factorial


def negative_binomial(y: Column, mean: Column, alpha: Column) -> Column:
    mean, alpha = _at_least(mean), _at_least(alpha)
    size, hit = 1 / alpha, 1 / (1 + alpha * mean)
    return log_gamma(y + size) - log_gamma(y + 1) - log_gamma(size) + y * F.ln(1 - hit) + size * F.ln(hit)
