"""Numeric column expressions that several operators share."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LN10 = math.log(10.0)


def ratio(a, b) -> Column:
    """a / b, and 0 where b is 0 or either is null."""
    a, b = (x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x)) for x in (a, b))
    return F.coalesce(a / F.when(b != 0, b), F.lit(0.0))


def rounded(x, digits: int = 6) -> Column:
    """``x`` rounded for comparison between engines; never a negative zero."""
    return F.round(F.col(x) if isinstance(x, str) else x, digits) + F.lit(0.0)


def chernoff(obs, exp, nu, a, natural: bool = False) -> Column:
    """The Chernoff bound of an observed sum: L^2 / (2 (nu + a L / 3)) with L = obs - exp, as -log10 of
    a probability (or natural); 0 where L is negative or the bound is undefined."""
    obs, exp, nu, a = (F.col(x) if isinstance(x, str) else x for x in (obs, exp, nu, a))
    gap = obs - exp
    bound = ratio(gap * gap, 2.0 * (nu + a * gap / 3.0))
    return F.when(gap > 0, bound if natural else bound / LN10).otherwise(0.0)


def xlogx_ratio(p: Column, q: Column) -> Column:
    """p ln(p / q), 0 for p = 0."""
    return F.when(p > 0, p * F.ln(F.when(p > 0, p) / F.when(q > 0, q))).otherwise(0.0)


def hypergeometric_tail(population, success, sample, observed) -> Column:
    """Upper bound, in nats, of a hypergeometric tail: n KL(k/n, K/N), 0 if under-represented."""
    population, success, sample, observed = ((F.col(x) if isinstance(x, str) else x).cast("double") for x in (population, success, sample, observed))
    p, q = ratio(observed, sample), ratio(success, population)
    kl = xlogx_ratio(p, q) + xlogx_ratio(1 - p, 1 - q)
    return F.when(p > q, F.coalesce(sample * kl, F.lit(0.0))).otherwise(0.0)


def log10_normal_tail(z: Column) -> Column:
    """log10 of the standard normal's upper tail: Mills' ratio as a continued fraction from 1.5 on, the
    series z^(2k+1) / (2k+1)!! below."""
    far = F.greatest(F.abs(z), F.lit(1.5))
    inverse = F.aggregate(F.sequence(F.lit(60), F.lit(1)), far, lambda x, k: far + k / x)
    log_tail = -far * far / (2 * LN10) - F.log10(inverse * math.sqrt(2 * math.pi))
    low = F.least(F.greatest(z, F.lit(-1.5)), F.lit(1.5))
    factors = [1.0 / math.prod(range(1, 2 * k + 2, 2)) for k in range(20, -1, -1)]
    series = low * F.aggregate(F.array(*map(F.lit, factors)), F.lit(0.0), lambda s, c: s * low * low + c)
    near = 0.5 - series * F.exp(-low * low / 2) / math.sqrt(2 * math.pi)
    return F.when(z > 1.5, log_tail).when(z < -1.5, F.log10(1 - F.pow(F.lit(10.0), log_tail))).otherwise(F.log10(near))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def opacity(z: Column, threshold: float = -0.5, power: float = 2.0) -> Column:
    """1 above a threshold of the standardized value, else a sigmoid, to a power."""
    base = F.when(z > threshold, 1.0).otherwise(sigmoid(power * (z - threshold)))
    return F.pow(base, F.lit(power))
