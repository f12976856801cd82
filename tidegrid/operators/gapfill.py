"""Regular grids and what fills their gaps."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timegrid import after, bucket, micros, steps
from . import ranges

#: Buckets that one row of a grid is made into at a time.
STRETCH = 10_000


def grid(spans: DataFrame, resolution_s: int) -> DataFrame:
    """One row for each bucket of (keys, start, end), both ends included, as ts. A long span is cut into stretches first, which tasks share."""
    last = F.timestamp_add("MICROSECOND", F.lit(1), F.col("end"))
    keys = [c for c in spans.columns if c not in ("start", "end")]
    long_s = resolution_s * STRETCH
    cut = spans.select(*keys, "start", last.alias("_end"), F.explode(steps(F.col("start"), last, long_s)).alias("_from"))
    dealt = cut.repartition(*keys, "_from") if keys else cut.repartition("_from")
    return dealt.select(*keys, F.explode(steps(F.greatest("start", "_from"), F.least("_end", after("_from", long_s)), resolution_s)).alias("ts"))


def regular(df: DataFrame, keys: Sequence[str], resolution_s: int) -> DataFrame:
    """df (at most one row a bucket, at its start) with a row for every bucket from each key's first to last; new ones are null."""
    spans = df.groupBy(*keys).agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    return grid(spans, resolution_s).join(df, [*keys, "ts"], "left")


def linear_fill(df: DataFrame, keys: Sequence[str], columns: Sequence[str], width: int | None = None) -> DataFrame:
    """Nulls between two values lie on the line between them; after the last value they repeat it; before the first they stay.

    Each range of time (width in microseconds, measured by default) is filled by itself, with the last value before it and the first one after it.
    """
    rows = ranges.parted(df, keys, width or ranges.width(df, keys))
    t = micros("ts")
    here = {c: F.when(F.col(c).isNotNull(), F.struct(t.alias("t"), F.col(c).alias("v"))) for c in columns}
    ends = rows.groupBy(ranges.PART).agg(*[f(here[c]).alias(f"{side}{k}") for k, c in enumerate(columns) for f, side in ((F.min, "_first"), (F.max, "_last"))])
    handed = [F.last(f"{side}{k}", ignorenulls=True).over(ranges.along(keys, side == "_last")).alias(f"_from{side}{k}") for k in range(len(columns)) for side in ("_first", "_last")]
    # Both frames grow row by row; one that shrinks to the end would be computed anew for each row.
    w = Window.partitionBy(ranges.PART)
    back, ahead = (w.orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.asc("ts"), F.desc("ts")))
    near = {f"_{side}{k}": F.last(here[c], ignorenulls=True).over(o) for k, c in enumerate(columns) for side, o in (("p", back), ("n", ahead))}
    both = ranges.handed_on(rows.withColumns(near), ends.select(ranges.PART, *handed))
    out = {}
    for k, c in enumerate(columns):
        p, n = F.coalesce(f"_p{k}", f"_from_last{k}"), F.coalesce(f"_n{k}", f"_from_first{k}")
        between = p["v"] + (n["v"] - p["v"]) * (t - p["t"]) / (n["t"] - p["t"])
        out[c] = F.when(F.col(c).isNotNull(), F.col(c)).when(n.isNull(), p["v"]).otherwise(between)
    shown = dict(zip(keys, ranges.keys_of(keys), strict=True))
    return both.withColumns(out).select(*[shown.get(c, F.col(c)) for c in df.columns])


def resampled(df: DataFrame, columns: Sequence[str], resolution_s: int) -> DataFrame:
    """A wide table (ts, columns) at a resolution: off-grid rows go, gaps are filled along lines, equal times are averaged."""
    on_grid = df.where(bucket("ts", resolution_s) == F.col("ts")).groupBy("ts").agg(*[F.avg(c).alias(c) for c in columns])
    one = on_grid.withColumn("_all", F.lit(1))
    return linear_fill(regular(one, ["_all"], resolution_s), ["_all"], columns).drop("_all")


def dedupe_mean(df: DataFrame, keys: Sequence[str], columns: Sequence[str], fill: float | None = None) -> DataFrame:
    """One row a key with the means of its rows; missing values filled if asked for."""
    out = df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in columns])
    return out.na.fill(fill, list(columns)) if fill is not None else out


def quadratic_spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The interpolating spline of order 2 through (x, y), knots midway between the points; short inputs use lines."""
    if len(x) < 3:
        return np.interp(at, x, y) if len(x) else np.zeros(len(at))
    knots = np.concatenate(([x[0]] * 3, (x[1:-2] + x[2:-1]) / 2, [x[-1]] * 3))

    def basis(at: np.ndarray) -> np.ndarray:
        at = np.clip(at, x[0], x[-1])
        b = ((knots[:-1] <= at[:, None]) & (at[:, None] < knots[1:])).astype(float)
        b[at == x[-1], len(x) - 1] = 1
        for k in (1, 2):
            wide = np.where((d := knots[k:-1] - knots[: -k - 1]) > 0, d, np.inf)
            next_ = np.where((e := knots[k + 1 :] - knots[1:-k]) > 0, e, np.inf)
            b = (at[:, None] - knots[: -k - 1]) / wide * b[:, :-1] + (knots[k + 1 :] - at[:, None]) / next_ * b[:, 1:]
        return b

    return basis(at) @ np.linalg.solve(basis(x), y)


def spline_fill(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Nulls inside each key's range from a spline of order 2; what is left is 0. A key's rows are one cluster's time steps."""

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", ignore_index=True)
        t = pdf.ts.to_numpy("datetime64[us]").astype(np.int64) / 1e6
        for c in columns:
            known = pdf[c].notna().to_numpy()
            if known.any() and not known.all():
                inside = ~known & (t > t[known][0]) & (t < t[known][-1])
                pdf.loc[inside, c] = quadratic_spline(t[known], pdf[c].to_numpy(float)[known], t[inside])
        return pdf.fillna(dict.fromkeys(columns, 0.0))

    return df.groupBy(*keys).applyInPandas(fill, df.schema)
