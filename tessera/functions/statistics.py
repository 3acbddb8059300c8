"""Tests and densities as Column expressions, from the logarithm of the gamma function."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x > 0: Stirling's series at x + 8, less the factors stepped over; about 12 digits."""
    z = x + 8
    #: Stirling's coefficients.
    series = sum((F.lit(c) / F.pow(z, F.lit(2 * i + 1)) for i, c in enumerate((1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188))), F.lit(0.0))
    steps = x
    for k in range(1, 8):
        steps = steps * (x + k)
    return (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + series - F.ln(steps)


def log_choose(n: Column, k: Column) -> Column:
    return F.when((k == 0) | (k == n), 0.0).otherwise(log_gamma(n + 1.0) - log_gamma(k + 1.0) - log_gamma(n - k + 1.0))


def fisher_exact(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Two-sided p of the table (a, b; c, d): all tables with its margins that are no likelier. A fold in logarithms, each table's from the one before."""
    row, column, n = a + b, a + c, a + b + c + d
    low, high = F.greatest(F.lit(0), row + column - n), F.least(row, column)
    table = lambda k: log_choose(row, k) + log_choose(n - row, column - k) - log_choose(n, column)
    start = F.struct(table(low).alias("now"), table(a).alias("own"), F.lit(0.0).alias("p"))

    def step(s: Column, k: Column) -> Column:
        term = F.when(s["now"] <= s["own"] + 1e-8, F.exp(s["now"])).otherwise(0.0)
        after = s["now"] + F.ln((row - k) * (column - k) / ((k + 1) * (n - row - column + k + 1)))
        return F.struct(F.coalesce(after, F.lit(float("-inf"))).alias("now"), s["own"].alias("own"), (s["p"] + term).alias("p"))

    return F.when(low == high, 1.0).otherwise(F.aggregate(F.sequence(low, high), start, step, lambda s: F.least(s["p"], F.lit(1.0))))


def beta_binomial(n: Column, k: Column, a: float, b: float) -> Column:
    """Density of k of n under a Beta(a, b) mixed binomial."""
    whole = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    return F.exp(log_gamma(n + 1.0) - log_gamma(k + 1.0) - log_gamma(n - k + 1.0) + log_gamma(k + F.lit(a)) + log_gamma(n - k + F.lit(b)) - log_gamma(n + F.lit(a + b)) + whole)


def consensus_quality(n: Column, k: Column, error: tuple[float, float], alpha: tuple[float, float], prior: float, most: int) -> Column:
    """Phred quality of a consensus of n bases with k differences: a sequencing error (first rates, with ``prior``) against a true difference, halved and capped."""
    density = [beta_binomial(n, k, a, a * (1 - e) / e) for e, a in zip(error, alpha, strict=True)]
    wrong = density[0] * prior / (density[0] * prior + density[1] * (1 - prior))
    return F.floor(F.least(F.floor(-4.343 * F.ln(1 - wrong) + 0.499), F.lit(most)) / 2)
