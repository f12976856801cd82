"""Multi-resolution segments of irregular series: moments of the curve through the samples, without any UDF.

Consecutive samples are joined by a line (or a step). Each pair is cut at the buckets of the finest resolution; the
moments of a piece have closed forms. Pieces of a bucket are merged in time order, and coarser resolutions are merged
from the finished segments of the finer one they are derived from, never from the samples again.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import lcm

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timegrid import ResolutionTree, after, bucket, seconds, steps
from ..schema import ID, MOMENTS
from . import ranges
from .moments import folded, folded_sums, per_length


def linear_integral(ta: Column, va: Column, tb: Column, vb: Column, i0: Column, i1: Column) -> Column:
    """Integral over [i0, i1] of the line through both samples, beyond them too; of a constant if their times are equal."""
    x0, x1, length = seconds(ta, i0), seconds(ta, i1), seconds(ta, tb)
    slope = F.when(length != 0, (vb - va) / length).otherwise(0.0)
    return slope * (x1 * x1 - x0 * x0) / 2 + va * (x1 - x0)


def step_integral(ta: Column, va: Column, tb: Column, vb: Column, i0: Column, i1: Column) -> Column:
    """Integral over [i0, i1] of va from a until b and vb from b on; 0 before a."""
    first = F.greatest(seconds(F.greatest(ta, i0), F.least(tb, i1)), F.lit(0.0))
    return va * first + vb * F.greatest(seconds(F.greatest(tb, i0), i1), F.lit(0.0))


INTEGRALS = {"linear": linear_integral, "step": step_integral}


def pairs(series: DataFrame, keys: Sequence[str] = ID, arrival: str | None = None, width: int | None = None) -> DataFrame:
    """(keys, ta, va, tb, vb): consecutive samples of each series.

    Samples that don't come later than all before them are dropped: in order of the arrival column, or else of time,
    where of equal times the first value in order stays. A series is split by ranges of time (width in microseconds,
    measured by default), each of which gets the last sample before it.
    """
    rows = series.where("ts is not null and value is not null and not isnan(value)")
    if arrival:
        came = ranges.parted(rows.select(*keys, "ts", "value", arrival), keys, ranges.width(rows, keys, arrival), arrival)
        latest = came.groupBy(ranges.PART).agg(F.max("ts").alias("_latest"))
        carried = latest.select(ranges.PART, F.max("_latest").over(ranges.along(keys)).alias("_earlier"))
        inside = F.max("ts").over(Window.partitionBy(ranges.PART).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1))
        seen = ranges.handed_on(came.withColumn("_seen", inside), carried).withColumn("_seen", F.greatest("_seen", "_earlier"))
        rows = seen.where("_seen is null or ts > _seen").select(*ranges.keys_of(keys), "ts", "value")
    own = rows.select(*keys, "ts", "value")
    dealt = ranges.parted(own, keys, width or ranges.width(own, keys)).groupBy(ranges.PART, "ts").agg(F.min("value").alias("value"))
    both = ranges.with_previous(dealt, keys, ["ts", "value"]).where("before is not null")
    return both.select(*ranges.keys_of(keys), F.col("before.ts").alias("ta"), F.col("before.value").alias("va"), F.col("ts").alias("tb"), F.col("value").alias("vb"))


def pieces(series: DataFrame, resolution_s: int, function: str = "linear", arrival: str | None = None, width: int | None = None) -> DataFrame:
    """(id, step, i0, i1, length, count, mean, m2, m3, m4): a row for each of pairs() and bucket it overlaps."""
    cut = pairs(series, ID, arrival, width).withColumn("step", F.explode(steps("ta", "tb", resolution_s)))
    cut = cut.withColumns({"i0": F.greatest("step", "ta"), "i1": F.least(after("step", resolution_s), F.col("tb"))}).withColumn("length", seconds("i0", "i1"))
    c = {x: F.col(x) for x in ("ta", "va", "tb", "vb", "i0", "i1")}
    integral = INTEGRALS[function]
    cut = cut.withColumn("mean", integral(c["ta"], c["va"], c["tb"], c["vb"], c["i0"], c["i1"]) / F.col("length"))

    def moment(d: int) -> Column:
        a, b = (F.pow(c[v] - F.col("mean"), F.lit(float(d))) for v in ("va", "vb"))
        return integral(c["ta"], a, c["tb"], b, c["i0"], c["i1"]) / F.col("length")

    cut = cut.withColumns({f"m{d}": moment(d) for d in (2, 3, 4)})
    return cut.select(*ID, "step", "i0", "i1", "length", (F.col("i0") == F.col("ta")).cast("long").alias("count"), *MOMENTS)


def _merged(parts: DataFrame, keys: Sequence[str], start: str, end: str, width: int | None = None) -> DataFrame:
    """Parts that count (all columns null where they don't) merged in time order, by keys; with a width a key's parts are split by ranges of their start."""
    agg = folded(parts, keys, start, width).groupBy(*keys).agg(*folded_sums(start, end)).where("seg_start is not null")
    return agg.select(*keys, "seg_start", "seg_end", "length", "count", "mean", *[per_length(m) for m in MOMENTS[1:]])


def segments(series: DataFrame, tree: ResolutionTree, function: str = "linear", arrival: str | None = None, open_too: bool = True, width: int | None = None) -> DataFrame:
    """Segments of all resolutions of the tree: finished ones (complete), and the one still open at each series' end.

    A bucket's segment is complete once a sample at or after its end has come. A level that others are derived from
    goes through one exchange that all of them read, so the samples are cut and merged once. It is dealt by series and
    stretches of time that every resolution divides. width: of the ranges that series are split by, in microseconds,
    measured by default; buckets that are longer than a range are split by ranges too.
    """
    width = width or ranges.width(series.where("ts is not null"), ID)
    whole = lcm(*(r.seconds for r in tree))
    stretch = whole * max(1, width // (whole * 1_000_000))
    out, levels = None, {}
    for r in tree:
        parent = tree.parents[r]
        if parent is None:
            own = _merged(pieces(series, r.seconds, function, arrival, width), [*ID, "step"], "i0", "i1", width if width < r.seconds * 1_000_000 else None)
            own = own.withColumn("_stretch", bucket("step", stretch))
        else:
            # Open segments drop out inside the aggregation: as a filter they would move below the shared exchange and split it.
            done = F.col("seg_end") == after("step", parent.seconds)
            finer = levels[parent].select(*ID, "_stretch", bucket("step", r.seconds).alias("up"), *[F.when(done, F.col(c)).alias(c) for c in ("seg_start", "seg_end", "length", "count", *MOMENTS)])
            own = _merged(finer, [*ID, "_stretch", "up"], "seg_start", "seg_end").withColumnRenamed("up", "step")
        levels[r] = own = own.repartition(*ID, "_stretch") if tree.children(r) else own
        complete = F.col("seg_end") == after("step", r.seconds)
        rows = own.select(*ID, F.lit(r.seconds).cast("long").alias("resolution_s"), "seg_start", "seg_end", "length", "count", *MOMENTS, complete.alias("complete"))
        rows = rows if open_too else rows.where("complete")
        out = rows if out is None else out.unionByName(rows)
    return out


def covered_moments(segments: DataFrame, resolution_s: int, skip_empty: bool = False) -> DataFrame:
    """Segments of one resolution as moments: keyed by the bucket's start, weight the share of it that is covered."""
    rows = segments.where(F.col("resolution_s") == resolution_s)
    rows = rows.where("count > 0") if skip_empty else rows
    return rows.select(*ID, bucket("seg_start", resolution_s).alias("ts"), (F.col("length") / resolution_s).alias("weight"), *MOMENTS)
