"""Cumulants that are kept up to date by batches: power sums by series and bucket, appended once for each batch and merged on read.

Each batch of a stream writes the sums of its samples into a folder of its own number, overwriting what an attempt before
it left there, so a batch counts once however often it runs. Sums add up in any order: a bucket may get samples from
many batches, late ones included. Compaction puts the sums of old batches into one folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.timegrid import TimeInterval, bucket
from ..operators.moments import observed
from ..schema import ID

SUMS = ["n", "s1", "s2", "s3", "s4"]


class PowerSums:
    """Sums of powers of the values of each series and bucket, in a folder with a subfolder a batch."""

    def __init__(self, spark: SparkSession, folder: str, resolution_s: int, skip_zeros: bool = False):
        self.spark, self.folder, self.resolution_s, self.skip_zeros = spark, folder.rstrip("/"), resolution_s, skip_zeros

    def sums(self, series: DataFrame, interval: TimeInterval | None = None) -> DataFrame:
        rows = observed(series, interval, self.skip_zeros)
        powers = [F.sum(F.pow("value", F.lit(float(k)))).alias(f"s{k}") for k in (2, 3, 4)]
        return rows.groupBy(*ID, bucket("ts", self.resolution_s).alias("ts")).agg(F.count("*").alias("n"), F.sum("value").alias("s1"), *powers)

    def append(self, series: DataFrame, batch: int) -> None:
        """Adds a batch of samples; the same number again replaces it. A number below a compaction's is already in it and changes nothing."""
        if batch > self._compacted():
            self.sums(series).write.mode("overwrite").parquet(f"{self.folder}/batch={batch}")

    def follow(self, series: DataFrame, checkpoint: str) -> StreamingQuery:
        """A query that appends all that a streaming series table has now."""
        write = series.writeStream.foreachBatch(lambda rows, batch: self.append(rows, batch))
        return write.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self) -> list[str]:
        fs, path = self._fs()
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _compacted(self) -> int:
        """The number of the last batch that is in a finished compaction, -1 without one."""
        fs, path = self._fs()
        done = [int(n.split("=")[1]) for n in self._names() if n.startswith("upto=") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(path, f"{n}/_SUCCESS"))]
        return max(done, default=-1)

    def _parts(self) -> list[str]:
        upto = self._compacted()
        own = [n for n in self._names() if n.startswith("batch=") and int(n.split("=")[1]) > upto]
        return [f"{self.folder}/{n}" for n in ([f"upto={upto}"] if upto >= 0 else []) + own]

    def compact(self) -> None:
        """Puts all batches so far into one folder, then deletes what that replaces. A reader of the old folders has to read anew."""
        parts = self._parts()
        last = max((int(p.rsplit("=", 1)[1]) for p in parts), default=-1)
        if last < 0 or parts == [f"{self.folder}/upto={last}"]:
            return
        self._merged().write.mode("overwrite").parquet(f"{self.folder}/upto={last}")
        fs, path = self._fs()
        for n in self._names():
            if n != f"upto={last}" and int(n.split("=")[1]) <= last:
                fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path, n), True)

    def _merged(self) -> DataFrame:
        parts = self._parts()
        schema = ", ".join(f"{c} string" for c in ID) + ", ts timestamp_ntz, n long, s1 double, s2 double, s3 double, s4 double"
        rows = self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)
        return rows.groupBy(*ID, "ts").agg(*[F.sum(c).alias(c) for c in SUMS])

    def moments(self, spread: bool = False) -> DataFrame:
        """(id, ts, weight, mean, m2, m3, m4): as bucket_moments() of all samples so far; with spread also the moments within each bucket."""
        s = self._merged()
        mean = F.col("s1") / F.col("n")
        r2, r3, r4 = (F.col(f"s{k}") / F.col("n") for k in (2, 3, 4))
        own = [F.greatest(r2 - mean * mean, F.lit(0.0)), r3 - 3 * mean * r2 + 2 * F.pow(mean, F.lit(3.0)), r4 - 4 * mean * r3 + 6 * mean * mean * r2 - 3 * F.pow(mean, F.lit(4.0))]
        m = own if spread else [F.lit(0.0)] * 3
        return s.select(*ID, "ts", F.lit(1.0).alias("weight"), mean.alias("mean"), *[x.alias(f"m{k}") for k, x in enumerate(m, 2)])
