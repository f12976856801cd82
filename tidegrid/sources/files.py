"""Series from CSV and Parquet files, datasets as plug-ins, and sinks."""

from __future__ import annotations

import math
from abc import ABC, abstractmethod
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import number, uniform
from ..schema import ID, NA
from ..schema import series as as_series


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_csv(spark: SparkSession, *paths: str, columns: Sequence[str], header: bool = True, sep: str = ",", recursive: bool = False) -> DataFrame:
    """All columns as strings, named in file order. Missing paths give no rows; so there is no schema inference pass."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    there = [p for p in paths if _exists(spark, p)]
    if not there:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", header).option("sep", sep).option("enforceSchema", True).option("recursiveFileLookup", recursive).csv(there)


def csv_series(spark: SparkSession, *paths: str, columns: Sequence[str], ts: str | int, value: str | int, source: Column | str | int = NA, value_type: Column | str = NA, category: Column | str = NA, **options) -> DataFrame:
    """A series table from CSV files. ts, value (and source as an int) are names or places of columns; bad numbers are null."""
    at = lambda c: columns[c] if isinstance(c, int) else c
    rows = read_csv(spark, *paths, columns=columns, **options)
    own = F.col(at(source)) if isinstance(source, int) else source
    return as_series(rows.withColumns({"_ts": F.col(at(ts)).try_cast("timestamp_ntz"), "_value": number(at(value))}), "_ts", "_value", own, value_type, category)


def averaged(series: DataFrame) -> DataFrame:
    """Interleaved series with one row for each series and time: the mean of duplicates; rows without a value go."""
    return series.where("value is not null").groupBy(*ID, "ts").agg(F.avg("value").alias("value"))


def split_series(series: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    """One folder for each category and source, so that a reader of few series lists and reads only theirs."""
    series.write.mode(mode).partitionBy("category", "source").parquet(folder)


def stream_csv(spark: SparkSession, folder: str, ts: str = "ts", value: str = "value", columns: str = "ts TIMESTAMP_NTZ, value DOUBLE", source: Column | str = NA) -> DataFrame:
    """A streaming series table of the files that appear in a folder. A malformed row fails the query."""
    rows = spark.readStream.schema(columns).option("header", True).option("mode", "FAILFAST").csv(folder)
    return as_series(rows, ts, value, source)


def write_csv(df: DataFrame, folder: str, overwrite: bool = False, header: bool = True, sep: str = ",") -> None:
    """Appends to a folder of CSV files, or replaces it."""
    df.write.mode("overwrite" if overwrite else "append").option("header", header).option("sep", sep).csv(folder)


def in_memory(spark: SparkSession, rows, ts: str = "ts", value: str = "value", **ids) -> DataFrame:
    """A series table from a pandas frame whose ts column is of datetimes."""
    if not str(rows[ts].dtype).startswith("datetime64"):
        raise ValueError(f"{ts} is no datetime column")
    return as_series(spark.createDataFrame(rows), ts, value, **ids)


def generated(spark: SparkSession, series: int | DataFrame, start: str, n_steps: int, resolution_s: int, degree: int = 3, seed: int = 0, value_type: Column | None = None, category: Column | None = None) -> DataFrame:
    """Series y_t = (sum of sin(t)^k for k < degree) times standard normal noise, by id and step without any driver loop.

    series: how many, numbered from 0 on, or a frame with a column id of numbers. The noise is made from a hash of
    seed, id and step (Box and Muller), so it is the same for any number of tasks.
    """
    ids = spark.range(series) if isinstance(series, int) else series.select("id")
    i, t = F.col("id"), F.col("step")
    wave = sum((F.pow(F.sin(t.cast("double") * n_steps / max(1, n_steps - 1)), F.lit(float(k))) for k in range(1, degree)), F.lit(1.0))
    radius, angle = uniform(seed, "id", "step", F.lit("r")), uniform(seed, "id", "step", F.lit("a"))
    noise = F.sqrt(-2 * F.log(1 - radius)) * F.cos(2 * math.pi * angle)
    rows = ids.select("id", F.explode(F.sequence(F.lit(0), F.lit(n_steps - 1))).alias("step"))
    ts = F.timestamp_add("SECOND", t * resolution_s, F.lit(start).cast("timestamp_ntz"))
    return as_series(rows.select("id", ts.alias("ts"), (wave * noise).alias("value")), "ts", "value", i.cast("string"), value_type if value_type is not None else (i % 2).cast("string"), category if category is not None else F.floor(i % 4 / 2).cast("string"))


class DataSource(ABC):
    """A dataset: an exogenous table (ts, columns...) and a series table."""

    @abstractmethod
    def dataset(self) -> tuple[DataFrame | None, DataFrame]: ...


class SmartMeters(DataSource):
    """Meter readings in CSV files of one layout. Presets below name the layouts of public datasets, for local copies."""

    def __init__(self, spark: SparkSession, *paths: str, columns: Sequence[str], ts: int, value: int, source: int | None = None, weather: DataFrame | None = None, header: bool = True, sep: str = ",", unix: bool = False, calendar: str = "GB", resolution_s: int = 1800):
        self.spark, self.paths, self.columns, self.at = spark, paths, columns, (ts, value, source)
        self.weather, self.header, self.sep, self.unix, self.calendar, self.resolution_s = weather, header, sep, unix, calendar, resolution_s

    def series(self) -> DataFrame:
        ts, value, source = self.at
        rows = read_csv(self.spark, *self.paths, columns=self.columns, header=self.header, sep=self.sep)
        name = F.col(self.columns[source]) if source is not None else F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1)
        raw = F.col(self.columns[ts])
        when = F.timestamp_seconds(raw.try_cast("double")).cast("timestamp_ntz") if self.unix else raw.try_cast("timestamp_ntz")
        return as_series(rows.withColumns({"_ts": when, "_value": number(self.columns[value])}), "_ts", "_value", name).where("ts is not null and value is not null")

    def dataset(self) -> tuple[DataFrame | None, DataFrame]:
        if self.weather is None:
            return None, self.series()
        columns = [c for c in self.weather.columns if c != "ts"]
        return self.weather.groupBy("ts").agg(*[F.avg(c).alias(c) for c in columns]).na.fill(0.0, columns), self.series()


# The column orders of the public files, where the time, value and id are, and the region's calendar.
LCL = {"columns": ["id", "tariff", "time", "kwh"], "ts": 2, "value": 3, "source": 0, "calendar": "GB", "resolution_s": 1800}
REFIT = {"columns": ["time", "unix", "aggregate"], "ts": 0, "value": 2, "calendar": "GB", "resolution_s": 8}
SGSC = {"columns": ["id", "time", "event", "controlled", "general"], "ts": 1, "value": 4, "source": 0, "calendar": "AU-NSW", "resolution_s": 1800}
UMASS = {"columns": ["time", "kw"], "ts": 0, "value": 1, "header": False, "calendar": "US-NH", "resolution_s": 900}
