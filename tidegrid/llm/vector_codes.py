"""Product codes of vectors: integer codebooks, nearest entries by a float32 screen and an exact second look.

Each component x becomes the integer floor(4096 * x) and each vector is cut into equal consecutive parts. A part's
codebook starts with that part of the vectors of the smallest ids; each round assigns every part to its nearest entry
and replaces an entry by the floored mean of its parts. Nearest is exact: one float32 matrix product gives all
distances of a block with an interval that no rounding can leave; only entries whose interval overlaps the best one
are computed anew in 64-bit integers, and of equal distances the lower index wins.

Rounds are jobs over the written integer vectors: tasks add up their rows by part and entry, Spark adds up the tasks,
and only the codebooks (parts x entries, whatever the number of rows) go through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, fresh, written

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6


def integers(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, q array<long>) of the vectors that are neither null nor hold null or non-finite components.

    Squared distances of whole vectors must fit 64 bits: a component too large for that is an error.
    """
    own = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(column).cast("array<double>").alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    most = F.sqrt(F.lit(2.0**60) / F.greatest(F.size("v"), F.lit(1)))
    large = F.exists("v", lambda x: F.abs(x * SCALE) > most)
    kept = own.where(F.col("v").isNotNull() & ~odd)
    q = F.when(large, F.raise_error(F.lit("a component is too large for 64-bit distances"))).otherwise(F.transform("v", lambda x: F.floor(x * SCALE)))
    return kept.select("vec_id", "label", q.cast("array<bigint>").alias("q"))


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(index of the nearest row of entries, squared distance) for each row of x, all int64, and how many entries were looked at twice.

    In single precision a product of d terms, inputs rounded too, is off by at most (d + 2) u |x| |c| in any order of
    summation, u = 2**-24, to first order; the factor 1.01 covers the rest, and the last term the double arithmetic.
    """
    d = x.shape[1]
    product = (x.astype(np.float32) @ entries.astype(np.float32).T).astype(np.float64)
    squares = (entries * entries).sum(1).astype(np.float64)
    norms = np.sqrt((x.astype(np.float64) ** 2).sum(1))[:, None] * np.sqrt(squares)
    radius = 2 * 1.01 * (d + 2) * 2.0**-24 * norms + 2.0**-50 * (squares + 2 * np.abs(product) + norms)
    score = squares - 2 * product
    open_ = score - radius <= (score + radius).min(1)[:, None]
    best = open_.argmax(1)
    several = np.flatnonzero(open_.sum(1) > 1)
    again = 0
    if len(several):
        rows, columns = np.nonzero(open_[several])
        exact = np.full((len(several), len(entries)), np.iinfo(np.int64).max)
        exact[rows, columns] = ((x[several[rows]] - entries[columns]) ** 2).sum(1)
        best[several] = exact.argmin(1)  # the first of equal ones
        again = len(rows)
    return best, ((x - entries[best]) ** 2).sum(1), again


def _blocks(pdf: pd.DataFrame, dim: int, size: int = 8_192) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for k in range(0, len(pdf), size):
        part = pdf.iloc[k : k + size]
        if any(len(q) != dim for q in part.q):
            raise ValueError(f"a vector has not the length {dim} of that with the smallest id")
        yield part, np.stack(part.q.to_numpy()).astype(np.int64)


def _sums(books: np.ndarray):
    """Tasks' sums: a row for each part and entry that has rows."""
    parts, entries, width = books.shape

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, counts = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for b in batches:
            for _, x in _blocks(b, parts * width):
                for p in range(parts):
                    own = x[:, p * width : (p + 1) * width]
                    best, _, _ = nearest(own, books[p])
                    np.add.at(sums[p], best, own)
                    counts[p] += np.bincount(best, minlength=entries)
        used = np.argwhere(counts)
        if len(used):
            i = [(p, e, j) for p, e in used for j in range(width)]
            yield pd.DataFrame({"part": [p for p, _, _ in i], "entry": [e for _, e, _ in i], "place": [j for _, _, j in i], "total": [sums[k] for k in i], "n": [counts[p, e] for p, e, _ in i]})

    return run


def start(rows: DataFrame, parts: int, entries: int) -> np.ndarray:
    """The codebooks of the rows with the smallest ids (null last, then by components): fewer entries where there are fewer rows."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(entries).select("q").collect()
    if not first:
        return np.zeros((parts, 0, 0), np.int64)
    if len({len(r.q) for r in first}) > 1 or not first[0].q or len(first[0].q) % parts:
        raise ValueError(f"vectors must all have one length, a multiple of {parts}")
    return np.array([r.q for r in first], np.int64).reshape(len(first), parts, -1).swapaxes(0, 1).copy()


def improved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: floored means, unused entries as they were."""
    sums = rows.select("q").mapInPandas(_sums(books), "part int, entry int, place int, total long, n long")
    out = books.copy()
    for r in sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        out[r.part, r.entry, r.place] = r.total // r.n
    return out


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def assigned(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error): two hex digits a part, and the squared distances of all parts together."""
    parts, _, width = books.shape
    names = [f"{i:02x}" for i in range(256)]
    kind = dict(rows.dtypes)["label"]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part, x in _blocks(b, parts * width):
                found = [nearest(x[:, p * width : (p + 1) * width], books[p]) for p in range(parts)]
                codes = np.stack([f[0] for f in found], 1).tolist()
                yield part[["vec_id", "label"]].assign(code=["".join(map(names.__getitem__, c)) for c in codes], error=sum(f[1] for f in found))

    return rows.mapInPandas(run, f"vec_id long, label {kind}, code string, error long")


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, label: str = "label") -> DataFrame:
    """Per vector: vec_id, code, error, label_error (error over all rows of its label, nulls together), codebooks_sha256.

    Vectors that are null or hold null or non-finite components have no row. Equal distances go to the lower index,
    repeated rows give repeated rows, a null vec_id comes after all others in the choice of first entries; of one
    vec_id the smaller components come first. With fewer rows than entries a codebook has as many entries as there
    are rows. Empty vectors give no rows. Lengths that differ or cannot be cut are an error. Further columns are
    ignored. At most 256 entries.
    """
    if not 0 < entries <= 256:
        raise ValueError("1 to 256 entries have two hex digits")
    rows = written(integers(vectors, label=label), "integers")
    books = start(rows, parts, entries)
    if not books.size:
        return rows.limit(0).select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    for _ in range(rounds):
        books = improved(rows, books)
    out = written(assigned(rows, books), "codes")
    own, total = fresh(out, "own_label", "label_error")
    sums = out.groupBy(F.col("label").alias(own)).agg(F.sum("error").alias(total))
    few = sums.count() <= BROADCAST_IDS
    joined = out.join(F.broadcast(sums) if few else sums, out["label"].eqNullSafe(F.col(own)))
    return joined.select("vec_id", "code", "error", F.col(total).alias("label_error"), F.lit(digest(books)).alias("codebooks_sha256"))


def sql(parts: int = PARTS, width: int = 8, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same in SQL for vectors of parts x width components."""
    steps = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"parts AS MATERIALIZED (SELECT rid, p, q[{width} * p + 1 : {width} * p + {width}] AS v FROM kept, range({parts}) t(p))",
        f"first AS (SELECT rid, row_number() OVER (ORDER BY vec_id NULLS LAST, q) - 1 AS k FROM kept QUALIFY k < {entries})",
        "c0 AS MATERIALIZED (SELECT p, k, v FROM first JOIN parts USING (rid))",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} AS MATERIALIZED (SELECT rid, p, any_value(v) AS v, arg_min(k, d * {entries} + k) AS k, min(d) AS d FROM (SELECT rid, parts.p, parts.v, k,
    list_sum(list_transform(list_zip(parts.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT AS d FROM parts JOIN c{r} c ON c.p = parts.p) GROUP BY rid, p)"""
        )
        if r < rounds:
            steps.append(
                f"""u{r} AS (SELECT p, k, list(((s - ((s % n) + n) % n) / n)::BIGINT ORDER BY i) AS v FROM (SELECT p, k, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{r}, range(1, {width + 1}) t(i) GROUP BY p, k, i) GROUP BY p, k)"""
            )
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.p, c.k, coalesce(u.v, c.v) AS v FROM c{r} c LEFT JOIN u{r} u ON u.p = c.p AND u.k = c.k)")
    steps.append(f"books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM c{rounds})")
    steps.append(f"e AS (SELECT rid, string_agg(printf('%02x', k), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY rid)")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM e JOIN kept USING (rid), books"
