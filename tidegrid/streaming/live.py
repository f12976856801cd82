"""Segments of a stream whose state is a table: timers for idle series, open segments beside the written ones.

A series' state is its last sample and a map from resolution to the segment under way, in a RocksDB state store. Only
what a batch changes is read and written. A series' samples of a batch meet in one task, which holds their times and
values, sorts them and cuts them by columns, a block of pieces at a time. Series that fall silent can be closed by a timer on the watermark. The state
of the last finished batch can be read as a table, so that finished and open segments together are what the batch
operator gives for all samples so far.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.timegrid import ResolutionTree, after, bucket, from_micros, micros
from ..schema import ID, MOMENTS
from .segments import Open, SegmentState, frame

PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LAST = "t long, value double"
OPEN = "start_us long, end_us long, length double, count long, " + ", ".join(f"{m} double" for m in MOMENTS)
OUT = ", ".join(f"{c} string" for c in ID) + ", resolution_s long, " + OPEN


class SegmentProcessor(StatefulProcessor):
    """One pass over each series; see SegmentState. idle_s: seconds of event time without a sample after which its open segments are given out as they are."""

    def __init__(self, tree: ResolutionTree, step: bool, idle_s: int | None, arrival: bool = False):
        self.tree, self.step, self.idle_s, self.arrival = tree, step, idle_s, arrival

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", LAST)
        self.open = handle.getMapState("open", "resolution_s long", OPEN)

    def _rows(self, key: tuple, found: list[tuple[int, Open]]) -> Iterator[pd.DataFrame]:
        if found:
            yield pd.DataFrame([(*key, r, *astuple(s)) for r, s in found], columns=[c.split()[0] for c in OUT.split(", ")])

    def _in_order(self, rows: Iterator[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray]:
        """Times and values; of a batch's rows no more is held than what orders them."""
        columns = ["us", "value", "place"] if self.arrival else ["us", "value"]
        pdf = pd.concat([r[columns] for r in rows], ignore_index=True)
        t, v = pdf.us.to_numpy(), pdf.value.to_numpy()
        order = pdf.sort_values(["place", "value"], kind="stable").index.to_numpy() if self.arrival else np.lexsort((v, t))
        return t[order], v[order]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        s = SegmentState(self.tree, self.step)
        if self.last.exists():
            t, value = self.last.get()
            s.last = (t, value)
            s.open = {k[0]: Open(*v) for k, v in self.open.iterator()}
        before = dict(s.open)
        for r, found in s.extend(*self._in_order(rows)):
            yield frame(key, r, found)
        for r in before.keys() - s.open.keys():
            self.open.removeKey((r,))
        for r, own in s.open.items():
            if before.get(r) != own:
                self.open.updateValue((r,), astuple(own))
        self.last.update(s.last)
        if self.idle_s is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(s.last[0] // 1000 + self.idle_s * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Gives the open segments out and forgets the series: its next sample starts anew."""
        found = [(k[0], Open(*v)) for k, v in self.open.iterator()]
        self.open.clear()
        self.last.clear()
        yield from self._rows(key, sorted(found))

    def close(self) -> None:
        pass


def live_segments(series: DataFrame, tree: ResolutionTree, step: bool = False, arrival: str | None = None, skip_zeros: bool = False, idle_s: int | None = None, late_s: int = 0) -> DataFrame:
    """Segments (id, resolution_s, seg_start, seg_end, length, count, moments, complete) of a streaming series table, in append mode.

    Within a micro-batch a series' samples are taken in order of the arrival column if there is one, else of time and
    value; across batches a sample that isn't later than the last one is dropped. With idle_s a series without a sample
    for so many seconds, by a watermark late_s behind the latest sample of all series, is closed: its open segments come
    out with complete false where their bucket isn't full, and nothing joins them to a later sample. Samples behind the
    watermark are dropped then.
    """
    series.sparkSession.conf.set(PROVIDER, ROCKS)
    rows = series.where("ts is not null and value is not null and not isnan(value)")
    rows = rows.where("value <> 0") if skip_zeros else rows
    us = micros("ts")
    rows = rows.select(*ID, us.alias("us"), "value", *([F.col(arrival).alias("place")] if arrival else []), F.timestamp_micros(us).alias("at"))
    timed = idle_s is not None
    rows = rows.withWatermark("at", f"{late_s} seconds") if timed else rows.drop("at")
    out = rows.groupBy(*ID).transformWithStateInPandas(SegmentProcessor(tree, step, idle_s, arrival is not None), OUT, "Append", "EventTime" if timed else "None")
    return _shown(out)


def _shown(rows: DataFrame) -> DataFrame:
    start, end = from_micros(F.col("start_us")), from_micros(F.col("end_us"))
    size = F.col("resolution_s") * 1_000_000
    complete = F.pmod("end_us", size) == 0
    return rows.select(*ID, "resolution_s", start.alias("seg_start"), end.alias("seg_end"), "length", "count", *MOMENTS, complete.alias("complete"))


def written_live(segments: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream of segments to Parquet, partitioned by resolution: a query over all input there is now."""
    return segments.writeStream.partitionBy("resolution_s").format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def open_segments(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The segments under way after the last finished batch, one row a series and resolution, from the query's checkpoint."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "open").load()
    rows = state.select(*[F.col(f"key.{c}").alias(c) for c in ID], F.col("user_map_key.resolution_s").alias("resolution_s"), "user_map_value.*")
    return _shown(rows).withColumn("complete", F.lit(False))


def written_segments(spark: SparkSession, folder: str, resolution_s: int | None = None) -> DataFrame:
    """What written_live() has appended, of one resolution (only its folder is read) or all."""
    rows = spark.read.parquet(folder).withColumn("resolution_s", F.col("resolution_s").cast("long"))
    return rows if resolution_s is None else rows.where(F.col("resolution_s") == resolution_s)


def segment_table(spark: SparkSession, folder: str, checkpoint: str, resolution_s: int | None = None) -> DataFrame:
    """Finished segments and open ones together, as segments.segments() gives them for all samples so far."""
    open_ = open_segments(spark, checkpoint)
    open_ = open_ if resolution_s is None else open_.where(F.col("resolution_s") == resolution_s)
    done = written_segments(spark, folder, resolution_s)
    return done.select(open_.columns).unionByName(open_)


def series_of(rows: DataFrame, resolution_s: int) -> DataFrame:
    """One resolution's segments as a series table (their means by the start of their bucket), for a further transform."""
    return rows.where(F.col("resolution_s") == resolution_s).select(*ID, bucket("seg_start", resolution_s).alias("ts"), F.col("mean").alias("value"), after(bucket("seg_start", resolution_s), resolution_s).alias("until"))
