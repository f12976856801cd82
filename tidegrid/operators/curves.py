"""Column expressions over arrays that are curves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, where use names it often within lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def knee_place(curve: Column) -> Column:
    """The place of the knee of a convex falling curve by Kneedle, as kernels.knee(); the last place without one."""

    def of(c: Column) -> Column:
        n, low, high = c["n"], c["low"], c["high"]
        d = F.transform(c["y"], lambda y, i: 1 - (y - low) / (high - low) - i / (n - 1))
        return F.when((n > 2) & (high > low), F.coalesce(bound(d, first_knee), n - 1)).otherwise(n - 1)

    def first_knee(d: Column) -> Column:
        at = lambda i: F.get(d, i)
        inner = F.sequence(F.lit(1), F.size(d) - 2)
        peaks = F.filter(inner, lambda i: (at(i) > at(i - 1)) & (at(i) >= at(i + 1)))
        dips = F.filter(inner, lambda i: (at(i) < at(i - 1)) & (at(i) <= at(i + 1)))
        return bound(F.struct(d.alias("d"), peaks.alias("peaks"), F.concat(peaks, dips).alias("turns")), falls)

    def falls(s: Column) -> Column:
        """The first peak after which the curve falls far enough before it turns again."""
        d, n = s["d"], F.size(s["d"])

        def is_knee(i: Column) -> Column:
            until = F.coalesce(F.array_min(F.filter(s["turns"], lambda j: j > i)), n)
            return F.array_min(F.slice(d, i + 2, until - i - 1)) < F.get(d, i) - F.lit(1.0) / (n - 1)

        return F.get(F.filter(s["peaks"], is_knee), F.lit(0))

    parts = F.struct(curve.alias("y"), F.size(curve).alias("n"), F.array_min(curve).alias("low"), F.array_max(curve).alias("high"))
    return bound(parts, of)
