"""Partial autocorrelations of long series as column expressions: lag products by stretches of a series, then one row a series.

No series is ever held by one task: rows are numbered and cut into stretches that get the last rows before them, so that
sums of lag products add up by partial aggregation. What is left of a series, an array of autocovariances, is folded
by Durbin and Levinson's recursion.
"""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .curves import bound, knee_place
from .samples import STRETCH, stretches


def autocovariances(df: DataFrame, keys: Sequence[str], column: str, lags: int, width: int | None = None, stretch: int = STRETCH) -> DataFrame:
    """(keys, n, c): rows and autocovariances about the mean at lags 0..lags (below n), each over the n - lag pairs there are. Nulls have no part."""
    own = df.where(F.col(column).isNotNull()).select(*keys, "ts", F.col(column).cast("double").alias("_x"))
    key = F.struct(*keys)
    means = own.groupBy(key.alias("_key")).agg(F.avg("_x").alias("_mean"))
    centred = own.withColumn("_key", key).join(means, "_key").select(*keys, "ts", (F.col("_x") - F.col("_mean")).alias("_d"))
    dealt = stretches(centred, keys, lags, 0, width, stretch)
    w = Window.partitionBy(*keys, "_stretch").orderBy("_at").rowsBetween(-lags, 0)
    near = dealt.withColumn("_near", F.reverse(F.collect_list("_d").over(w))).where("_mine = _stretch")
    products = near.select(*keys, F.transform("_near", lambda x: x * F.col("_d")).alias("_p"))
    sums = products.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(F.get("_p", F.lit(k))).alias(f"_p{k}") for k in range(lags + 1)])
    each = F.array(*[F.when(F.col("n") > k, F.col(f"_p{k}") / (F.col("n") - k)) for k in range(lags + 1)])
    return sums.select(*keys, "n", F.array_compact(each).alias("c"))


def durbin_levinson(c: Column, lags: int) -> Column:
    """Partial autocorrelations at lags 0..lags of an array of autocovariances; 0 where outside [-1, 1], past the array's end or once all is explained."""
    if not lags:
        return F.array(F.lit(1.0))

    def step(acc: Column, k: Column, c: Column) -> Column:
        def after(r: Column) -> Column:
            phi = F.concat(F.zip_with(acc["phi"], F.reverse(acc["phi"]), lambda x, y: x - r * y), F.array(r))
            stop = F.struct(acc["phi"].alias("phi"), F.lit(0.0).alias("error"), F.concat(acc["out"], F.array(F.lit(0.0))).alias("out"))
            return F.when(r.isNull(), stop).otherwise(F.struct(phi.alias("phi"), (acc["error"] * (1 - r * r)).alias("error"), F.concat(acc["out"], F.array(r)).alias("out")))

        explained = F.aggregate(F.zip_with(acc["phi"], F.reverse(F.slice(c, F.lit(2), k - 1)), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
        return bound(F.when((acc["error"] > 0) & (k < F.size(c)), (F.get(c, k) - explained) / acc["error"]), after)

    def fold(c: Column) -> Column:
        start = F.struct(F.array().cast("array<double>").alias("phi"), F.get(c, F.lit(0)).alias("error"), F.array(F.lit(1.0)).alias("out"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(lags)), start, lambda acc, k: step(acc, k, c), lambda acc: acc["out"])

    return F.transform(bound(c, fold), lambda x: F.when(F.abs(x) <= 1, x).otherwise(0.0))


def partial_autocorrelations(df: DataFrame, keys: Sequence[str], column: str, lags: int, p: float = 0.99, width: int | None = None, stretch: int = STRETCH) -> DataFrame:
    """(keys, lag, score, selected, ci) for each series and lag 0..lags.

    selected: up to the knee of the share of what later lags explain beyond chance, whose radius is ci.
    """
    z = NormalDist().inv_cdf(0.5 + p / 2)
    rows = autocovariances(df, keys, column, lags, width, stretch)
    rows = rows.select(*keys, durbin_levinson(F.col("c"), lags).alias("s"), (F.lit(z) / F.sqrt("n")).alias("ci"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)

    def rest(over: Column) -> Column:
        return F.transform(over, lambda x, i: total(F.slice(over, i + 1, F.size(over))))

    def place(later: Column) -> Column:
        return bound(total(later), lambda every: knee_place(F.transform(later, lambda x, i: 1 - total(F.slice(later, F.lit(1), i + 1)) / F.when(every > 0, every).otherwise(1.0))))

    def selected(r: Column) -> Column:
        over = F.transform(r["s"], lambda s: F.when(F.abs(s) < r["ci"], 0.0).otherwise((s - r["ci"]) * (s - r["ci"])))
        return F.struct(r["s"].alias("s"), bound(bound(over, rest), place).alias("place"))

    rows = rows.select(*keys, "ci", bound(F.struct("s", "ci"), selected).alias("_found")).select(*keys, "ci", F.col("_found.s").alias("s"), F.col("_found.place").alias("place"))
    return rows.select(*keys, F.posexplode("s").alias("lag", "score"), "place", "ci").select(*keys, "lag", "score", (F.col("lag") <= F.col("place")).alias("selected"), "ci")
