"""Column names and types of the canonical tables. All timestamps are without time zone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ID = ["source", "value_type", "category"]
NA = "NA"
MOMENTS = ["mean", "m2", "m3", "m4"]

SERIES = T.StructType([*[T.StructField(c, T.StringType()) for c in ID], T.StructField("ts", T.TimestampNTZType()), T.StructField("value", T.DoubleType())])
SEGMENTS = T.StructType(
    [
        *[T.StructField(c, T.StringType()) for c in ID],
        T.StructField("resolution_s", T.LongType()),
        T.StructField("seg_start", T.TimestampNTZType()),
        T.StructField("seg_end", T.TimestampNTZType()),
        T.StructField("length", T.DoubleType()),
        T.StructField("count", T.LongType()),
        *[T.StructField(c, T.DoubleType()) for c in MOMENTS],
        T.StructField("complete", T.BooleanType()),
    ]
)


def series(df: DataFrame, ts: str = "ts", value: str = "value", source="NA", value_type="NA", category="NA") -> DataFrame:
    """df as a series table. The id parts are columns or constants; missing ones are 'NA'. Raises if a column is absent or ts is no timestamp."""
    kind = dict(df.dtypes).get(ts)
    if kind not in ("timestamp", "timestamp_ntz", "date"):
        raise ValueError(f"{ts} is {kind or 'absent'}; a timestamp column is needed")
    as_column = lambda x: (F.lit(x) if isinstance(x, str) else x).cast("string")
    return df.select(as_column(source).alias("source"), as_column(value_type).alias("value_type"), as_column(category).alias("category"), F.col(ts).cast("timestamp_ntz").alias("ts"), F.col(value).cast("double").alias("value"))
