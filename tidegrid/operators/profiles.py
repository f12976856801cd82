"""Calendar profiles of series, and profiles as feature rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import Encoder
from ..functions.timegrid import TimeInterval, steps
from ..schema import ID


def classes(spark, resolution_s: int, interval: TimeInterval, encoders: Sequence[Encoder], calendar: DataFrame | None = None) -> DataFrame:
    """(ts, one integer class a calendar feature) for each step of the interval."""
    from ..functions.calendar import with_calendar

    span = spark.createDataFrame([(interval.start, interval.end)], "start timestamp_ntz, end timestamp_ntz")
    ts = span.select(F.explode(steps("start", "end", resolution_s)).alias("ts"))
    ts = with_calendar(ts, calendar) if calendar is not None else ts
    return ts.select("ts", *[e.index().alias(f"class_{e.name}") for e in encoders])


def profiles(moments: DataFrame, factors: DataFrame, encoders: Sequence[Encoder], grouped: DataFrame | None = None) -> DataFrame:
    """(id, class_..., level): mean bucket value of each calendar class over the series' factor.

    Classes are integers, so no group depends on how a sine rounds. grouped: the moments with their classes (with
    features that need a calendar); otherwise they come from the timestamps.
    """
    names = [f"class_{e.name}" for e in encoders]
    rows = grouped if grouped is not None else moments.withColumns({n: e.index() for n, e in zip(names, encoders, strict=True)})
    means = rows.groupBy(*ID, *names).agg(F.avg("mean").alias("level"))
    return means.join(factors.where("factor is not null"), ID).withColumn("level", F.col("level") / F.col("factor")).drop("factor")


def feature_rows(profiles: DataFrame) -> DataFrame:
    """(category, source, feature, level): the features of a source are its classes of all its value types."""
    names = [c for c in profiles.columns if c.startswith("class_")]
    return profiles.select("category", "source", F.concat_ws("/", "value_type", *[F.col(n).cast("string") for n in names]).alias("feature"), "level")


def wide(features: DataFrame, known: Sequence[str]) -> DataFrame:
    """One row a source, one column for each of the known features."""
    return features.groupBy("category", "source").pivot("feature", list(known)).agg(F.first("level"))
