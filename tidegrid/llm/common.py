"""What the operators share: the folder that all machines see, written tables, text rules, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of all contracts: space and the controls from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder (not created yet) below spark.checkpoint.dir, which the driver and all executors can read and write.

    Where the setting is absent a temporary folder serves, but only in local mode: on a cluster it would be a
    different folder on each machine, so there it is an error.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        top = "file://" + tempfile.mkdtemp(prefix="tidegrid-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet into the shared folder and read again: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that no later read needs."""
    for df in tables:
        spark = df.sparkSession
        hadoop = spark._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(hadoop).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Ids of 8 bytes that are broadcast at most; longer lists are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of df has (in any case), made from the given ones."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
        taken.add(name.lower())
    return out


def with_ids(docs: DataFrame, ids: DataFrame, how: str, column: str = "own_id", id_column: str = "doc_id") -> DataFrame:
    """docs semi- or anti-joined with written ids (one column, of a name that docs lacks; null is equal to null): broadcast if it is a short list."""
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, docs[id_column].eqNullSafe(F.col(column)), how)


def text_of(column: str = "text") -> Column:
    """Null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def star_step(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star pass over edges (u > v): neighbours are linked to the smallest one in reach."""
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


#: Links that one task joins up by itself: 16 MB of ids. Longer lists go by star passes.
ONE_TASK = 1_000_000


def _joined_up(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over all links of the partition."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        root = x
        while (p := parent.setdefault(root, root)) != root:
            root = p
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for b in batches:
        for u, v in zip(b.u.tolist(), b.v.tolist(), strict=True):
            x, y = top(u), top(v)
            if x != y:
                parent[max(x, y)] = min(x, y)
    yield pd.DataFrame({"id": list(parent), "component": [top(x) for x in parent]}, dtype="int64")


def connected_components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(id, component) of every id in edges (a, b), component being the smallest id that can be reached.

    Few links are joined up by one task. More of them by alternating large-star and small-star passes until they stay
    the same, each written to the shared folder: joins and aggregates by node, so no task and no driver ever holds a
    component. The result has the smallest ids of components too.
    """
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "cc")
    n = now.count()
    if n <= one_task:
        return written(now.coalesce(1).mapInPandas(_joined_up, "id long, component long"), "components")
    before = None
    while True:
        n, mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == (n, mark):
            ends = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(ends)
        before = (n, mark)
        after = written(star_step(star_step(now, True), False), "cc")
        discard(now)
        now = after
