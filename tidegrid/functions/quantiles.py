"""Cornish-Fisher quantiles, prediction intervals and their losses, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ppf(p: float) -> float:
    """Quantile of the standard normal distribution."""
    return NormalDist().inv_cdf(p)


def cornish_fisher(q: Column | float, n: Column | float, mean: Column, stdev: Column, k3: Column | None = None, k4: Column | None = None) -> Column:
    """The quantile at the normal quantile q of the mean of n samples; without k4, or k3, the shorter expansions."""
    q = F.lit(q) if isinstance(q, float) else q
    n = F.lit(float(n)) if isinstance(n, (int, float)) else n
    z = q
    if k3 is not None:
        z = z + (q * q - 1) * k3 / 6 / F.sqrt(n)
        if k4 is not None:
            z = z + ((q * q * q - 3 * q) * k4 / 24 - (2 * q * q * q - 5 * q) * k3 * k3 / 36) / n
    return mean + stdev * z


def pinball(p: Column | float, x: Column, q: Column) -> Column:
    p = F.lit(p) if isinstance(p, float) else p
    return F.when(x < q, (1 - p) * (q - x)).otherwise(p * (x - q))


def winkler(p: Column | float, x: Column, lower: Column, upper: Column) -> Column:
    p = F.lit(p) if isinstance(p, float) else p
    a = 1 - p
    return (upper - lower) + F.when(x < lower, 2 * (lower - x) / a).otherwise(0) + F.when(x > upper, 2 * (x - upper) / a).otherwise(0)


def bounds(p: float) -> tuple[float, float]:
    """Lower and upper probability of the central interval p."""
    return round((1 - p) / 2, 12), round(1 - (1 - p) / 2, 12)


def intervals(cumulants: DataFrame, p: Sequence[float], n: str = "n_members", monotone: bool = False) -> DataFrame:
    """Rows of cumulants (mean, stdev, skewness, kurtosis, n) once for each p, with p, lower and upper.

    The probabilities are literals, so this is a narrow projection. monotone swaps bounds that cross.
    """
    mean, stdev, k3, k4 = map(F.col, ("mean", "stdev", "skewness", "kurtosis"))
    each = []
    for x in p:
        lo, hi = (cornish_fisher(ppf(b), F.col(n).cast("double"), mean, stdev, k3, k4) for b in bounds(x))
        if monotone:
            lo, hi = F.least(lo, hi), F.greatest(lo, hi)
        each.append(F.struct(F.lit(float(x)).alias("p"), lo.alias("lower"), hi.alias("upper")))
    rest = [c for c in cumulants.columns if c not in ("mean", "stdev", "skewness", "kurtosis")]
    return cumulants.select(*rest, F.explode(F.array(*each)).alias("i")).select(*rest, "i.*")


def to_frame(rows: DataFrame, keys: Sequence[str], p: Sequence[float]) -> DataFrame:
    """Long intervals as a wide table: 'Lower 95.0% PI', 'Upper 95.0% PI', ... for the given p."""
    wide = rows.groupBy(*keys).pivot("p", list(map(float, p))).agg(F.first("lower").alias("lower"), F.first("upper").alias("upper"))
    names = [F.col(f"`{float(x)}_{b.lower()}`").alias(f"{b} {100 * x:g}% PI") for x in p for b in ("Lower", "Upper")]
    return wide.select(*keys, *names)
