"""Linear quantile regression over the rows of a table, by reweighted least squares whose normal equations Spark adds up.

A pass gives, for each probability, the sums of weighted products of the columns: one row a task and probability, added
up by place in Spark, so that what reaches the driver has the size of the columns squared. The weights of a row are
the share of its side over its distance from the present fit.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distances below this weigh as if they were this large.
LEAST = 1e-6


def _design(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return np.column_stack((np.ones(len(b)), np.stack(b.x.to_numpy()).astype(float))), b.y.to_numpy(float)


def fit(rows: DataFrame, probabilities: Sequence[float], steps: int = 200, tolerance: float = 1e-8) -> np.ndarray:
    """Weights (constant first), a row a probability, of rows (x array<double>, y double) without nulls; rows should be cheap to read many times."""
    first = rows.select(F.size("x").alias("n")).first()
    if first is None:
        raise ValueError("no rows")
    width = first.n + 1
    w = np.zeros((len(probabilities), width))
    for step in range(steps + 1):

        def run(batches: Iterable[pd.DataFrame], w: np.ndarray = w, plain: bool = step == 0) -> Iterator[pd.DataFrame]:
            sums = np.zeros((len(probabilities), width, width + 1))
            for b in batches:
                if len(b):
                    a, y = _design(b)
                    for k, p in enumerate(probabilities):
                        r = y - a @ w[k]
                        v = np.ones(len(y)) if plain else np.where(r >= 0, p, 1 - p) / np.maximum(np.abs(r), LEAST)
                        sums[k] += (a * v[:, None]).T @ np.column_stack((a, y))
            yield pd.DataFrame({"sums": [sums.ravel()]})

        parts = rows.mapInPandas(run, "sums array<double>").select(F.posexplode("sums").alias("at", "v"))
        found = {r.at: r.v for r in parts.groupBy("at").agg(F.sum("v").alias("v")).collect()}
        s = np.array([found[i] for i in range(len(found))]).reshape(len(probabilities), width, width + 1)
        new = np.stack([np.linalg.lstsq(m[:, :-1], m[:, -1], rcond=None)[0] for m in s])
        done = np.abs(new - w).max() < tolerance
        w = new
        if done:
            break
    return w


def predicted(rows: DataFrame, weights: np.ndarray, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """rows' kept columns and a column for each row of weights, as column expressions."""

    def value(w: np.ndarray):
        return F.aggregate(F.zip_with("x", F.array(*map(F.lit, map(float, w[1:]))), lambda a, b: a * b), F.lit(float(w[0])), lambda a, b: a + b)

    return rows.select(*keep, *[value(w).alias(n) for w, n in zip(weights, names, strict=True)])
