"""Exact deduplication with a minimal perfect hash over historical distinct digests.

The history is a table of distinct digests, each with the locator of the row that won and how many rows it stands for.
It is split into shards by digest; each shard becomes one record: a minimal perfect hash, as it is, and its slots, which
hold the whole digest and the locator. A row probes its shard's record; the slot's 32 bytes are compared, so a row is a
member only if its digest is exactly there. Members take the winner from the slot. The rest group by digest among
themselves.

A corpus without a history is taken in two lots. The distinct digests of the first are the history; the rows of the
second probe it before anything of theirs is grouped. A member that beats its slot's winner takes the slot over, then
all members look their winners up. Only nonmembers are grouped by themselves. A group of many copies is in the history
but for a chance of 2 to the power of minus its size, so the rows that are grouped and joined by digest come from
small groups.

Digest rows are all that is shuffled; texts are read once. The shard of a digest that very many rows carry is dealt
out over several tasks, each with its own copy of that shard's record.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, discard, fresh, text_of, with_ids, written

#: Digests in a shard, and rows that one task probes, on average.
SHARD, PROBES = 50_000, 100_000
LEVELS, ROOM = 32, 2


def _mixed(h: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = h + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Maps n distinct 64-bit keys to 0..n-1, each slot used once.

    Each level is a bit array; a key that is alone at its place there settles, the others go on to the next level.
    A settled key's slot is the number of set bits before its own. What is left after all levels (practically
    nothing) is kept in a sorted list. A key outside the set may get any slot or none (-1).
    """

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.bits, self.before, self.start, self.rest = levels, [], 0, rest
        for alone in levels:
            self.before.append(self.start + np.cumsum(alone) - 1)
            self.start += int(alone.sum())

    @classmethod
    def build(cls, keys: np.ndarray) -> "PerfectHash":
        levels, rest = [], keys
        for level in range(LEVELS):
            if not len(rest):
                break
            size = np.uint64(ROOM * len(rest) + 1)
            at = (_mixed(rest, level) % size).astype(np.int64)
            levels.append(np.bincount(at, minlength=int(size)) == 1)
            rest = rest[~levels[-1][at]]
        return cls(levels, np.sort(rest))

    def dump(self) -> bytes:
        """Number of levels and of keys in the list, the levels' sizes, their bits, the list."""
        head = np.array([len(self.bits), len(self.rest), *map(len, self.bits)], "<u8")
        return b"".join([head.tobytes(), *(np.packbits(x).tobytes() for x in self.bits), self.rest.astype("<u8").tobytes()])

    @classmethod
    def load(cls, data: bytes) -> "PerfectHash":
        n, n_rest = np.frombuffer(data, "<u8", 2).tolist()
        at, levels = 16 + 8 * n, []
        for size in np.frombuffer(data, "<u8", n, 16).tolist():
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, -(-size // 8), at), count=size).astype(bool))
            at += -(-size // 8)
        return cls(levels, np.frombuffer(data, "<u8", n_rest, at))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (bits, before) in enumerate(zip(self.bits, self.before, strict=True)):
            at = (_mixed(keys[open_], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[open_[hit]] = before[at[hit]]
            open_ = open_[~hit]
        if len(self.rest) and len(open_):
            i = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            out[open_] = np.where(self.rest[i] == keys[open_], self.start + i, -1)
        return out


def _digests(values) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.uint8).reshape(-1, 32)


def _keys(digests: np.ndarray, at: int) -> np.ndarray:
    return np.ascontiguousarray(digests[:, at : at + 8]).view(np.uint64).ravel()


def _record(pdf: pd.DataFrame) -> pd.DataFrame:
    """One shard's history as a record: its hash, and slots in the hash's order. Repeated digests are an error.

    Keys are 8 bytes of the digests; should two digests agree there, others are taken.
    """
    digests = _digests(pdf.digest)
    if len(set(pdf.digest)) < len(pdf):
        raise ValueError("the history repeats a digest")
    at = next(k for k in (8, 16, 24) if len(np.unique(_keys(digests, k))) == len(digests))
    perfect = PerfectHash.build(_keys(digests, at))
    order = np.argsort(perfect.slots(_keys(digests, at)))
    no_id = pdf.keep_id.isna().to_numpy()
    columns = (digests[order].tobytes(), pdf.keep_id.fillna(0).to_numpy(np.int64)[order].tobytes(), no_id[order].tobytes(), pdf.keep_uid.to_numpy(np.int64)[order].tobytes(), pdf.group_size.to_numpy(np.int64)[order].tobytes())
    return pd.DataFrame({"shard": [pdf.shard.iloc[0]], "n": [len(pdf)], "at": [at], "hash": [perfect.dump()], "slots": [b"".join(columns)]})


def _lookup(probes: pd.DataFrame, records: pd.DataFrame) -> pd.DataFrame:
    """Probes of one shard against its record."""
    out = probes[["doc_id", "uid", "n_cp", "digest"]].copy()
    if not len(out) or not len(records):
        none = pd.array([None] * len(out), "Int64")
        return out.assign(keep_id=none, keep_uid=none, group_size=none)
    n, blob = int(records.n.iloc[0]), records.slots.iloc[0]
    held = np.frombuffer(blob, np.uint8, 32 * n).reshape(-1, 32)
    ids, nulls = np.frombuffer(blob, np.int64, n, 32 * n), np.frombuffer(blob, np.bool_, n, 40 * n)
    uids, sizes = np.frombuffer(blob, np.int64, n, 41 * n), np.frombuffer(blob, np.int64, n, 49 * n)
    own = _digests(out.digest)
    slot = PerfectHash.load(records["hash"].iloc[0]).slots(_keys(own, int(records["at"].iloc[0])))
    place = np.maximum(slot, 0)
    member = (slot >= 0) & (held[place] == own).all(axis=1)
    out["keep_id"] = pd.arrays.IntegerArray(ids[place].copy(), ~member | nulls[place])
    out["keep_uid"] = pd.arrays.IntegerArray(uids[place].copy(), ~member)
    out["group_size"] = pd.arrays.IntegerArray(sizes[place].copy(), ~member)
    return out


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_cp, digest, uid) of every row; written, so that uid stays what it is."""
    text = text_of()
    own = docs.select("doc_id", F.length(text).cast("long").alias("n_cp"), F.unhex(F.sha2(F.translate(text, SPACE_CHARS, ""), 256)).alias("digest"))
    return written(own.withColumn("uid", F.monotonically_increasing_id()), "digests")


def _best(n_cp, doc_id, uid) -> Column:
    """Sorts the winner first: most code points, then the smallest doc_id (null last), then the first row."""
    return F.struct((-n_cp).alias("n"), doc_id.isNull().alias("none"), doc_id.alias("doc_id"), uid.alias("uid"))


def _ranked(rows: DataFrame) -> DataFrame:
    """(digest, best, group_size): the winner's place in _best() and how many rows there are."""
    best = F.min(_best(F.col("n_cp"), F.col("doc_id"), F.col("uid")))
    return rows.groupBy("digest").agg(best.alias("best"), F.count("*").alias("group_size"))


def _winners(ranked: DataFrame) -> DataFrame:
    return ranked.select("digest", F.col("best.doc_id").alias("keep_id"), F.col("best.uid").alias("keep_uid"), "group_size")


def summary(rows: DataFrame) -> DataFrame:
    """(digest, keep_id, keep_uid, group_size) of rows of digests(): a history."""
    return _winners(_ranked(rows))


def _shard(n_shards: int):
    return F.pmod(F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long"), F.lit(n_shards))


def against_history(rows: DataFrame, history: DataFrame) -> DataFrame:
    """rows of digests() with keep_id, keep_uid and group_size from the history; null where it lacks the digest."""
    rows_n = rows.count()
    n_shards = max(1, -(-history.count() // SHARD), -(-rows_n // PROBES))
    records = written(history.withColumn("shard", _shard(n_shards)).groupBy("shard").applyInPandas(_record, "shard long, n long, at int, hash binary, slots binary"), "perfect_hash")
    probes = rows.withColumn("shard", _shard(n_shards))
    copies = probes.groupBy("shard").agg(F.ceil(F.count("*") / F.lit(2 * PROBES)).cast("int").alias("copies"))
    dealt = probes.join(copies, "shard").withColumn("part", F.pmod(F.xxhash64("uid"), F.col("copies")))
    spread = copies.join(records, "shard").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies").cast("long") - 1))).drop("copies")
    schema = "doc_id long, uid long, n_cp long, digest binary, keep_id long, keep_uid long, group_size long"
    return dealt.drop("copies").groupBy("shard", "part").cogroup(spread.toDF("shard", "n", "at", "hash", "slots", "part").groupBy("shard", "part")).applyInPandas(_lookup, schema)


def exact_dedup(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, uid.

    Texts are equal when the same after white space is deleted; null counts as empty. Of equal texts the row with the
    most code points stays, then the smallest doc_id (null last), then the first of repeated rows: exactly one is kept.
    history: (digest, keep_id, keep_uid, group_size), such as summary() of an earlier corpus, each digest once; its
    members are all repeats of rows that went before: none of them is kept, and group_size is the history's. Without
    it the history is that of docs' first lot. Empty docs give no rows; further columns of docs are ignored.
    """
    rows = digests(docs)
    if history is not None:
        probed = written(against_history(rows, history), "probed")
        members = probed.where("keep_uid is not null").withColumn("kept", F.lit(False))
        others = probed.where("keep_uid is null")
    else:
        first = F.pmod(F.xxhash64("doc_id", "n_cp", "uid"), F.lit(2)) == 0
        old = written(_ranked(rows.where(first)), "history")
        probed = written(against_history(rows.where(~first), _winners(old)), "probed")
        # A member may beat the winner of its slot: bests and sizes of both lots are put together, which sums up in the tasks first.
        new = _ranked(probed.where("keep_uid is not null"))
        taken_over = old.unionByName(new).groupBy("digest").agg(F.min("best").alias("best"), F.sum("group_size").alias("group_size"))
        history = written(_winners(taken_over), "history")
        sure = rows.where(first).unionByName(probed.where("keep_uid is not null").select(*rows.columns))
        members = written(against_history(sure, history), "members").withColumn("kept", F.col("keep_uid") == F.col("uid"))
        others = probed.where("keep_uid is null")
    others = others.drop("keep_id", "keep_uid", "group_size")
    grouped = others.join(summary(others), "digest").withColumn("kept", F.col("keep_uid") == F.col("uid"))
    out = members.unionByName(grouped).select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256"), "uid")
    discard(rows)
    return out


def named(column: str) -> Column:
    """A column of any name, with dots or backticks too."""
    return F.col("`" + column.replace("`", "``") + "`")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without repeats, all columns as they are: of equal texts (null counts as empty) the row that exact_dedup() keeps.

    Rows that share a doc_id, null included, are told apart by their texts; of those with equal texts one row stays.
    Empty docs stay empty. Further columns may have any names.
    """
    found = written(exact_dedup(docs), "kept")
    by_id = found.groupBy("doc_id").agg(F.max("kept").alias("has_kept"), F.count("*").alias("n"))
    gone, sha, size, row = fresh(docs, "gone", "sha", "size", "row")
    drop = written(by_id.where("not has_kept or n > 1").select(F.col("doc_id").alias(gone), F.col("has_kept").alias(sha)), "gone")
    single = with_ids(docs, drop.select(gone), "left_anti", gone)
    same = drop.where(F.col(sha)).select(gone)
    if same.isEmpty():
        return single
    own = F.sha2(F.translate(text_of(), SPACE_CHARS, ""), 256)
    many = with_ids(docs, same, "left_semi", gone).select(F.struct(*[named(c) for c in docs.columns]).alias(row), "doc_id", own.alias(sha), F.length(text_of()).alias(size))
    wanted = found.where("kept").select(F.col("doc_id").alias(gone), F.col("text_sha256").alias("w_sha"))
    one = many.join(wanted, F.col("doc_id").eqNullSafe(F.col(gone)) & (F.col(sha) == F.col("w_sha")), "left_semi")
    best = one.groupBy("doc_id", sha).agg(F.max_by(row, size).alias(row))
    return single.unionByName(best.select(*[F.col(row).getField(c).alias(c) for c in docs.columns]))
