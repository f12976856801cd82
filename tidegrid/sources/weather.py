"""Weather as an exogenous table (ts, columns...), from local files. There is no network client here."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import celsius, kilometres, millimetres, number, percent
from ..functions.timegrid import TimeInterval

CONVERSIONS = {"fahrenheit": celsius, "inches": millimetres, "miles": kilometres, "ratio": percent}


class Weather(ABC):
    @abstractmethod
    def read(self) -> DataFrame: ...


class WeatherFiles(Weather):
    """CSV files with a header, unioned: renames and converts columns, takes Unix seconds or timestamps, clips to an interval.

    columns: name in the file -> (name, unit as in CONVERSIONS or None).
    """

    def __init__(self, spark: SparkSession, *paths: str, time: str, columns: dict[str, tuple[str, str | None]], unix: bool = False, interval: TimeInterval | None = None):
        self.spark, self.paths, self.time, self.columns, self.unix, self.interval = spark, paths, time, columns, unix, interval

    def read(self) -> DataFrame:
        rows = self.spark.read.option("header", True).csv(list(self.paths))
        raw = F.col(self.time)
        ts = F.timestamp_seconds(raw.try_cast("double")).cast("timestamp_ntz") if self.unix else raw.try_cast("timestamp_ntz")
        out = rows.select(ts.alias("ts"), *[(CONVERSIONS[unit](number(c)) if unit else number(c)).alias(name) for c, (name, unit) in self.columns.items()]).where("ts is not null")
        return out.where(self.interval.where()) if self.interval else out


class WeatherXML(Weather):
    """An hourly XML extract, one row element a time."""

    def __init__(self, spark: SparkSession, path: str, row: str, schema: str, time: str = "ts"):
        self.spark, self.path, self.row, self.schema, self.time = spark, path, row, schema, time

    def read(self) -> DataFrame:
        rows = self.spark.read.format("xml").option("rowTag", self.row).schema(self.schema).load(self.path)
        return rows.withColumnRenamed(self.time, "ts")
