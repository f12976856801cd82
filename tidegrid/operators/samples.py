"""Sliding samples for sequence models, scalers, and selection by scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ranges
from .curves import knee_place
from .order_statistics import quantiles


#: Rows of a stretch of a series whose samples are made together, at least.
STRETCH = 4_096


def stretches(df: DataFrame, keys: Sequence[str], before: int, after: int, width: int | None = None, stretch: int = STRETCH) -> DataFrame:
    """df with _at, each row's number in its key's time order from 0 on, and _stretch, the run of equal length that it is dealt to.

    A row is its own stretch's (_mine) and also goes to the next one if that begins within before rows, and to the one
    before if that ended within after rows, so that windows of such frames by (keys, _stretch) over _at are whole for
    the rows with _mine = _stretch. width: of the ranges of time in which rows are numbered, in microseconds; measured
    by default.
    """
    rows = ranges.numbered(df, keys, width or ranges.width(df, keys)).withColumn("_at", F.col("_n") - 1).drop("_n")
    size = max(stretch, before, after, 1)
    mine, place = F.floor(F.col("_at") / size), F.pmod("_at", F.lit(size))
    parts = F.array_compact(F.array(mine, F.when(place >= size - before, mine + 1), F.when((place < after) & (mine > 0), mine - 1)))
    return rows.withColumn("_mine", mine).withColumn("_stretch", F.explode(parts))


def sliding_samples(df: DataFrame, keys: Sequence[str], columns: Sequence[str], lookback: int, horizon: int, width: int | None = None, stretch: int = STRETCH) -> DataFrame:
    """(keys, ts, <c>_past, <c>_future): at each time the lookback values before it and the horizon values from it on, in order.

    Only samples with all of both are given, so a key with n rows has n - lookback - horizon + 1. Samples are made by
    stretches of a series.
    """
    dealt = stretches(df.select(*keys, "ts", *columns), keys, lookback, horizon - 1, width, stretch)
    w = Window.partitionBy(*keys, "_stretch").orderBy("_at")
    past, future = w.rowsBetween(-lookback, -1), w.rowsBetween(0, horizon - 1)
    out = dealt.withColumns({"_n_past": F.count(F.lit(1)).over(past), "_n_future": F.count(F.lit(1)).over(future)})
    out = out.withColumns({f"{c}_{s}": F.collect_list(F.coalesce(c, F.lit(float("nan")))).over(o) for c in columns for s, o in (("past", past), ("future", future))})
    whole = (F.col("_mine") == F.col("_stretch")) & (F.col("_n_past") == lookback) & (F.col("_n_future") == horizon)
    return out.where(whole).select(*keys, "ts", *[f"{c}_{s}" for c in columns for s in ("past", "future")])


def sample_rows(samples: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """A sample array as rows (keys, ts, step, value)."""
    return samples.select(*keys, "ts", F.posexplode(column).alias("step", "value"))


def scaler(df: DataFrame, keys: Sequence[str], column: str, method: str | None) -> DataFrame:
    """(keys, center, scale) such that (x - center) / scale is scaled; a constant column has scale 1.

    minmax: to [0, 1]; absmax: to [-1, 1]; mean: mean 0 and population deviation 1; median: over the quartiles' distance.
    """
    x = F.col(column)
    if method == "median":
        q = quantiles(df, keys, column, (0.25, 0.5, 0.75))
        out = q.select(*keys, F.col("q1").alias("center"), (F.col("q2") - F.col("q0")).alias("scale"))
    else:
        center, scale = {
            "minmax": (F.min(x), F.max(x) - F.min(x)),
            "absmax": (F.lit(0.0), F.max(F.abs(x))),
            "mean": (F.avg(x), F.stddev_pop(x)),
            None: (F.lit(0.0), F.lit(1.0)),
        }[method]
        out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), center.alias("center"), scale.alias("scale"))
    return out.select(*keys, "center", F.when(F.col("scale") > 0, F.col("scale")).otherwise(1.0).alias("scale"))


def scale(df: DataFrame, fitted: DataFrame, keys: Sequence[str], column: str, inverse: bool = False) -> DataFrame:
    x = F.col(column) * F.col("scale") + F.col("center") if inverse else (F.col(column) - F.col("center")) / F.col("scale")
    return df.join(fitted, list(keys)).withColumn(column, x).drop("center", "scale")


def first_rows(df: DataFrame, keys: Sequence[str], n: int, last: bool = False) -> DataFrame:
    """The first (or last) n rows of each key by time."""
    w = Window.partitionBy(*keys).orderBy(F.desc("ts") if last else F.asc("ts"))
    return df.withColumn("_row", F.row_number().over(w)).where(F.col("_row") <= n).drop("_row")


def top_by_share(scores: DataFrame, keys: Sequence[str], ratio: float) -> DataFrame:
    """scores with selected: the highest ones whose cumulative share is within the ratio and one more, at least 3."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "feature")
    everything = Window.partitionBy(*keys)
    cumulative = F.sum("score").over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("score").over(everything)
    ranked = scores.withColumns({"_rank": F.row_number().over(order), "_cum": cumulative})
    within = F.sum((F.col("_cum") <= ratio).cast("int")).over(everything)
    return ranked.withColumn("selected", F.col("_rank") <= F.greatest(within + 1, F.lit(3))).drop("_rank", "_cum")


def top_by_knee(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """scores with selected: the highest ones before the knee of the falling curve of a key's scores, at least 3. A key has one row a feature."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "feature")
    curves = scores.groupBy(*keys).agg(F.reverse(F.array_sort(F.collect_list("score"))).alias("_curve"))
    places = curves.select(F.struct(*keys).alias("_key"), knee_place(F.col("_curve")).alias("_place"))
    ranked = scores.withColumns({"_rank": F.row_number().over(order), "_key": F.struct(*keys)}).join(places, "_key")
    return ranked.withColumn("selected", F.col("_rank") <= F.greatest("_place", F.lit(3))).drop("_rank", "_key", "_place")
