"""From series to cluster-level cumulants and back to intervals."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import DayOfWeek, Encoder, with_calendar
from ..functions.quantiles import bounds, intervals, pinball, winkler
from ..functions.timegrid import TimeInterval
from ..operators.clustering import Clustering
from ..operators.gapfill import regular, spline_fill
from ..operators.kernels import impute_nearest
from ..operators.moments import bucket_moments, cumulants, factors
from ..operators.profiles import feature_rows, profiles


@dataclass
class CumulantTransform:
    """Finds clusters of series by their calendar profiles, and turns member series into cumulants of clusters.

    factors and membership are small tables (a row a series) and can be written and reused. Only the profile matrix of
    a category, sources x classes, comes to the driver; most_cells bounds it, beyond which fit() raises.
    """

    resolution_s: int
    encoders: Sequence[Encoder] = (DayOfWeek,)
    calendar: DataFrame | None = None
    clustering: Callable[[], Clustering] = Clustering
    imputer: Callable[[np.ndarray], np.ndarray] = impute_nearest
    skip_zeros: bool = False
    approximation: Callable[[DataFrame, TimeInterval | None], DataFrame] | None = None
    most_cells: int = 50_000_000
    factors: DataFrame | None = None
    membership: DataFrame | None = None
    clusterings: dict[str, Clustering] = field(default_factory=dict)
    features: dict[str, list[str]] = field(default_factory=dict)

    def moments(self, series: DataFrame, interval: TimeInterval | None = None) -> DataFrame:
        if self.approximation:
            return self.approximation(series, interval)
        return bucket_moments(series, self.resolution_s, interval, self.skip_zeros)

    def fit(self, series: DataFrame, interval: TimeInterval | None = None) -> CumulantTransform:
        """Categories are clustered apart; all value types of a source go to the same cluster."""
        spark = series.sparkSession
        moments = self.moments(series, interval)
        self.factors = factors(moments)
        grouped = None
        if self.calendar is not None:
            grouped = with_calendar(moments, self.calendar)
            grouped = grouped.withColumns({f"class_{e.name}": e.index() for e in self.encoders})
        rows = feature_rows(profiles(moments, self.factors, self.encoders, grouped))
        n = rows.count()
        if n > self.most_cells:
            raise ValueError(f"{n} profile cells; raise most_cells or use spark_kmeans on the profiles")
        labels: list[tuple[str, str, int]] = []
        for category, pdf in rows.toPandas().groupby("category"):
            matrix = pdf.pivot(index="source", columns="feature", values="level").sort_index()
            model = self.clusterings[category] = self.clustering()
            self.features[category] = list(matrix.columns)
            found = model.fit_predict(self.imputer(matrix.to_numpy(float)))
            labels += [(category, s, int(c)) for s, c in zip(matrix.index, found, strict=True)]
        self.membership = spark.createDataFrame(labels, "category string, source string, cluster int")
        return self

    def transform(self, series: DataFrame, interval: TimeInterval | None = None, fill_gaps: bool = False) -> DataFrame:
        """(category, cluster, value_type, ts, n_members, mean, stdev, skewness, kurtosis)."""
        if self.factors is None or self.membership is None:
            raise ValueError("fit comes before transform")
        out = cumulants(self.moments(series, interval), self.factors, self.membership)
        if not fill_gaps:
            return out
        keys = ["category", "cluster", "value_type"]
        return spline_fill(regular(out, keys, self.resolution_s).na.fill(0, ["n_members"]), keys, ["mean", "stdev", "skewness", "kurtosis"])

    def fit_transform(self, series: DataFrame, interval: TimeInterval | None = None) -> DataFrame:
        return self.fit(series, interval).transform(series, interval)

    def members(self) -> DataFrame:
        """(category, cluster, value_type, source, factor)."""
        return self.membership.join(self.factors.where("factor is not null"), ["category", "source"])

    def inverse_transform(self, cumulants: DataFrame, p: Sequence[float], clusters: bool = True, members: bool = True) -> DataFrame:
        """Intervals (level, category, cluster, value_type, id, ts, p, lower, upper) of clusters and, times their factor, members."""
        keys = ["category", "cluster", "value_type"]
        size = self.members().groupBy(*keys).agg(F.count("*").alias("n_members"))
        own = intervals(cumulants.drop("n_members").join(size, keys), p)
        out = []
        if clusters:
            out.append(own.select(F.lit("cluster").alias("level"), *keys, F.col("cluster").cast("string").alias("id"), "ts", "p", "lower", "upper"))
        if members:
            each = own.join(self.members(), keys)
            out.append(each.select(F.lit("member").alias("level"), *keys, F.col("source").alias("id"), "ts", "p", (F.col("lower") * F.col("factor")).alias("lower"), (F.col("upper") * F.col("factor")).alias("upper")))
        return out[0] if len(out) == 1 else out[0].unionByName(out[1])

    def evaluate(self, series: DataFrame, cumulants: DataFrame, p: Sequence[float], interval: TimeInterval | None = None) -> tuple[DataFrame, DataFrame]:
        """(pinball, winkler) scores of members: mean losses by source, value type, category and probability."""
        predicted = self.inverse_transform(cumulants, p, clusters=False)
        actual = self.moments(series, interval).select("source", "value_type", "category", "ts", F.col("mean").alias("x"))
        both = predicted.withColumnRenamed("id", "source").join(actual, ["source", "value_type", "category", "ts"])
        return scores(both, p)

    def clustering_score(self, spark) -> DataFrame:
        rows = [(c, *r) for c, m in sorted(self.clusterings.items()) for r in m.summary()]
        return spark.createDataFrame([(c, k, float(s), bool(b), n) for c, k, s, b, n in rows], "category string, k int, score double, selected boolean, cardinality array<int>")

    def extractor_score(self, spark) -> DataFrame:
        rows = [(c, i, float(s), i in m.kept) for c, m in sorted(self.clusterings.items()) for i, s in enumerate(m.shares)]
        return spark.createDataFrame(rows, "category string, feature int, score double, selected boolean")

    def plot_frame(self, cumulants: DataFrame, p: Sequence[float], members: bool = False) -> DataFrame:
        """Tidy traces for any plotting tool: (category, cluster, value_type, trace, p, bound, ts, y), wide intervals first."""
        rows = self.inverse_transform(cumulants, p, members=members)
        long = rows.unpivot(["level", "category", "cluster", "value_type", "id", "ts", "p"], ["lower", "upper"], "bound", "y")
        return long.withColumn("trace", F.concat_ws("/", "level", "id")).orderBy("category", "cluster", F.desc("p"), "bound", "ts")


def scores(rows: DataFrame, p: Sequence[float]) -> tuple[DataFrame, DataFrame]:
    """Mean losses of rows (source, value_type, category, p, lower, upper, x)."""
    keys = ["source", "value_type", "category"]
    sides = {x: bounds(x) for x in p}
    low, high = (F.coalesce(*[F.when(F.col("p") == float(x), F.lit(b[k])) for x, b in sides.items()]) for k in (0, 1))
    quantiles = rows.select(*keys, "x", F.explode(F.array(F.struct(low.alias("q"), F.col("lower").alias("v")), F.struct(high.alias("q"), F.col("upper").alias("v")))).alias("s"))
    pin = quantiles.groupBy(*keys, F.round("s.q", 6).alias("p")).agg(F.avg(pinball(F.col("s.q"), F.col("x"), F.col("s.v"))).alias("score"))
    win = rows.groupBy(*keys, "p").agg(F.avg(winkler(F.col("p"), F.col("x"), F.col("lower"), F.col("upper"))).alias("score"))
    return pin, win
