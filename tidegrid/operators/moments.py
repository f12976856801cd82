"""Central moments: of buckets, scaled, combined over members, and standardized.

A row's moments are weight, mean and the raw 2nd to 4th central moments m2, m3, m4.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timegrid import TimeInterval, bucket
from ..schema import ID, MOMENTS
from . import ranges


def observed(series: DataFrame, interval: TimeInterval | None = None, skip_zeros: bool = False) -> DataFrame:
    """The rows that count: with a time and a value (NaN is none), in the interval, and not zero if asked for."""
    rows = series.where("ts is not null and value is not null and not isnan(value)")
    if interval is not None:
        rows = rows.where(interval.where())
    return rows.where("value <> 0") if skip_zeros else rows


def bucket_moments(series: DataFrame, resolution_s: int, interval: TimeInterval | None = None, skip_zeros: bool = False) -> DataFrame:
    """(id, ts, weight, mean, m2, m3, m4): one row for each bucket that has values: their mean, weight 1, no spread."""
    rows = observed(series, interval, skip_zeros)
    means = rows.groupBy(*ID, bucket("ts", resolution_s).alias("ts")).agg(F.avg("value").alias("mean"))
    return means.select(*ID, "ts", F.lit(1.0).alias("weight"), "mean", *[F.lit(0.0).alias(m) for m in MOMENTS[1:]])


def factors(moments: DataFrame) -> DataFrame:
    """(id, factor): the mean of a series' bucket means, by which it is divided. Null where that is 0."""
    return moments.groupBy(*ID).agg(F.avg("mean").alias("factor")).withColumn("factor", F.nullif("factor", F.lit(0.0)))


def scaled(moments: DataFrame, factors: DataFrame) -> DataFrame:
    """Moments divided by the factor's powers; series without a factor are left out."""
    joined = moments.join(factors.where("factor is not null"), ID)
    return joined.withColumns({m: F.col(m) / F.pow("factor", F.lit(float(d))) for d, m in enumerate(MOMENTS, 1)}).drop("factor")


def combined(moments: DataFrame, keys: Sequence[str], near: float | Column = 1.0, filled: int | None = None) -> DataFrame:
    """(keys, n_members, weight, mean, m2, m3, m4) of all parts of a key together, exactly and in one partial aggregation.

    Sums of powers are taken about a value near the means (1 for scaled series), so that little cancels, and moved to
    the mean afterwards. Nulls have no weight. Parts may come in any order and any grouping.
    """
    c = F.lit(near) if isinstance(near, (int, float)) else near
    w, d, m2, m3, m4 = F.col("weight"), F.col("mean") - c, F.col("m2"), F.col("m3"), F.col("m4")
    s = moments.where("weight > 0 and mean is not null").groupBy(*keys).agg(
        F.count("*").alias("n_members"),
        F.sum(w).alias("weight"),
        F.sum(w * d).alias("s1"),
        F.sum(w * (m2 + d * d)).alias("s2"),
        F.sum(w * (m3 + 3 * d * m2 + d * d * d)).alias("s3"),
        F.sum(w * (m4 + 4 * d * m3 + 6 * d * d * m2 + d * d * d * d)).alias("s4"),
    )
    e, r2, r3, r4 = (F.col(f"s{k}") / F.col("weight") for k in (1, 2, 3, 4))
    return s.select(
        *keys,
        "n_members",
        "weight",
        (c + e).alias("mean"),
        F.greatest(r2 - e * e, F.lit(0.0)).alias("m2"),
        (r3 - 3 * e * r2 + 2 * e * e * e).alias("m3"),
        (r4 - 4 * e * r3 + 6 * e * e * r2 - 3 * e * e * e * e).alias("m4"),
    )


def folded(parts: DataFrame, keys: Sequence[str], start: str, width: int | None = None) -> DataFrame:
    """parts (length, count, mean, m2, m3, m4) with the terms of their order-dependent merge, for folded_sums() to add up by key.

    Parts of a key are merged one by one in order of start; the 3rd and 4th moment leave out the cross terms with the
    lower ones, so another order or grouping gives another result. Merging part k into the parts before it, of length W
    and mean M, moves the mean to N and adds W (M - N)^d and length (m_d + (mean - N)^d) to the d-th moment's sum: W
    and M are running sums, so no key's parts are collected. With a width (in microseconds) the sums run within ranges
    of start, each with those of the key's ranges before it. Parts of length 0 change nothing, null parts are left out.
    """
    w, mean = F.coalesce("length", F.lit(0.0)), F.coalesce("mean", F.lit(0.0))
    rows, inner = parts.withColumns({"_w": w, "_s": w * mean}), list(keys)
    if width:
        at = ranges.position(parts, start)
        rows, inner = rows.withColumn("_from", at - F.pmod(at, F.lit(width))), [*keys, "_from"]
    order = Window.partitionBy(*inner).orderBy(start).rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(order), F.lit(0.0))
    rows = rows.withColumns({"_w0": total("_w"), "_s0": total("_s")})
    if width:
        sums = rows.groupBy(F.struct(*inner).alias(ranges.PART)).agg(F.sum("_w").alias("_w"), F.sum("_s").alias("_s"))
        earlier = sums.select(ranges.PART, *[F.coalesce(F.sum(c).over(ranges.along(keys)), F.lit(0.0)).alias(f"{c}1") for c in ("_w", "_s")])
        joined = ranges.handed_on(rows.withColumn(ranges.PART, F.struct(*inner)), earlier).drop(ranges.PART)
        rows = joined.withColumns({f"{c}0": F.col(f"{c}0") + F.col(f"{c}1") for c in ("_w", "_s")})
    ratio = lambda s, w: F.when(w > 0, s / w).otherwise(0.0)
    w0, s0 = F.col("_w0"), F.col("_s0")
    rows = rows.withColumns({"_m0": ratio(s0, w0), "_m1": ratio(s0 + F.col("_s"), w0 + F.col("_w"))})
    to = F.col("_m1")
    terms = {f"_t{d}": w0 * F.pow(F.col("_m0") - to, F.lit(float(d))) + F.col("_w") * (F.col(f"m{d}") + F.pow(F.col("mean") - to, F.lit(float(d)))) for d in (2, 3, 4)}
    return rows.withColumns(terms)


def folded_sums(start: str, end: str) -> list[Column]:
    """What folded() gives, added up by key, with the first start and the last end; moments still times the length."""
    length = F.sum("_w")
    return [
        F.min(start).alias("seg_start"),
        F.max(end).alias("seg_end"),
        length.alias("length"),
        F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("count"),
        F.when(length > 0, F.sum("_s") / length).otherwise(0.0).alias("mean"),
        *[F.coalesce(F.sum(f"_t{d}"), F.lit(0.0)).alias(f"m{d}") for d in (2, 3, 4)],
    ]


def per_length(moment: str) -> Column:
    return F.when(F.col("length") > 0, F.col(moment) / F.col("length")).otherwise(0.0).alias(moment)


def standardized(moments: DataFrame) -> DataFrame:
    """Cumulants: mean, stdev, skewness, kurtosis (excess) instead of the moments; without spread the last two are 0."""
    m2 = F.nullif("m2", F.lit(0.0))
    rest = [c for c in moments.columns if c not in (*MOMENTS, "weight")]
    return moments.select(*rest, "mean", F.sqrt("m2").alias("stdev"), F.coalesce(F.col("m3") / F.pow(m2, F.lit(1.5)), F.lit(0.0)).alias("skewness"), F.coalesce(F.col("m4") / (m2 * m2) - 3, F.lit(0.0)).alias("kurtosis"))


def cumulants(moments: DataFrame, factors: DataFrame, membership: DataFrame) -> DataFrame:
    """(category, cluster, value_type, ts, n_members, mean, stdev, skewness, kurtosis) of scaled members.

    One aggregation by cluster and time takes the place of joining the members one after the other. Factors and
    membership have a row a series: Spark broadcasts them where they are small and shuffles by series otherwise.
    """
    members = scaled(moments, factors).join(membership, ["category", "source"])
    return standardized(combined(members, ["category", "cluster", "value_type", "ts"]))
