"""What Python workers need: this package where the driver was started from elsewhere, and batches of bounded size."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
from pathlib import Path

from pyspark.sql import SparkSession

BATCH, DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", ("67108864b", "64m")
#: Sizes of batches that this package sets: of a query, and of the pipeline's stages, which share executors that have run long.
QUERY, STAGE = "16m", "4m"
#: Freed memory of a worker goes back to the machine: large blocks are mapped, and Arrow has no pool of its own.
MEMORY = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_MMAP_THRESHOLD_": "1048576", "MALLOC_TRIM_THRESHOLD_": "1048576", "MALLOC_ARENA_MAX": "2"}
ROOT = str(Path(__file__).resolve().parent.parent)


def importable(spark: SparkSession, batch: str = QUERY) -> SparkSession:
    """Adds this repository's folder to the workers' PYTHONPATH (where it isn't there, nothing changes).

    Batches hold 16 MB at most (or batch) instead of Spark's 64, unless the session has a size of its own: a batch of texts is held
    several times over, in the executor and in its Python worker. Settings of memory that are in the environment stay.
    """
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    for name, value in MEMORY.items():
        if name not in os.environ:
            environment.setdefault(name, value)
    if spark.conf.get(BATCH, None) in (None, *DEFAULT, QUERY, STAGE):
        spark.conf.set(BATCH, batch)
    return spark


def let_go() -> None:
    """At the end of a task: what Python no longer holds goes back to the machine, where the system's library can do that."""
    gc.collect()
    with contextlib.suppress(AttributeError, OSError, TypeError):
        ctypes.CDLL(None).malloc_trim(0)
