"""N-gram Jaccard self-join by universe partition and pigeonhole, and the groups its links form.

Two sets with Jaccard similarity of 0.75 or more differ in at most H = (|a| + |b|) / 7 elements. Sizes are cut into
bands; each band has a join group that holds its own documents and the larger ones that may still be similar to them.
In a group all shingles are dealt by hash into m segments, alike for all documents. A differing element spoils one
segment, so of a document's q non-empty segments at least q - H are the same in both. For each document and group the
cheapest allocation that is still certain is used:

* q > H: the segments themselves. The document can spare its q - H - 1 most frequent segments (such as those inside a
  passage that many documents share), by one order of frequency for all; the least frequent common one stays in both.
* otherwise, if segments of two or more elements count double, more than H: also every segment without one of its
  elements, which finds segments that differ in one element.
* otherwise also a finer partition (four times the segments), and so on; with each shingle alone, q is over H.

Signatures are packed into binary bins by hash, so a bin's size follows from the number of bins. In a bin, documents
with the same signature make up a run; the members of runs, not their pairs, go on. Each document then leaves out what
it can spare, the most frequent first, which is most of what a common passage brings about. In what is left, one
document of each run is compared with the others and similar documents join up. Runs that still hold several
components are gone through once more: short ones pair by pair across components, long ones (of large groups) block by
block, so nothing is lost and no group is expanded into all its pairs. Every link is verified on the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, discard, fresh, text_of, with_ids, written
from .shingles import WORDS, forget, mixed, shingle_sets

PERCENT = 75
SHORT_RUN = 32  # members of a run whose pairs are written out
KEPT_SHINGLES = 50_000  # of the sets that a task has at hand
BIN = 400_000  # signatures in a bin, on average
BAND = 1.5
AT_ONCE = 200  # documents whose signatures are packed together
BLOCK_DOCS, BLOCK_SHINGLES = 512, 100_000  # at most in a block of a family, about


@lru_cache(maxsize=1)
def tops() -> np.ndarray:
    """The largest size of each band."""
    out = [1]
    while out[-1] < 2**40:
        out.append(max(out[-1] + 1, int(out[-1] * BAND)))
    return np.array(out)


def differing(a: int, b: int) -> int:
    """The most elements in which similar sets of these sizes differ: 100 * common >= PERCENT * union."""
    return (a + b) * (100 - PERCENT) // (100 + PERCENT)


def largest_partner(size: int) -> int:
    return size * 100 // PERCENT


def groups(size: int) -> list[int]:
    """The join groups a document takes part in: its own band's, and those of smaller bands with possible partners."""
    own = int(np.searchsorted(tops(), size))
    out = [own]
    while out[-1] > 0 and largest_partner(int(tops()[out[-1] - 1])) >= size:
        out.append(out[-1] - 1)
    return out


def most_differing(size: int, group: int) -> int:
    """The most elements in which a set of this size differs from a similar one that the group holds with it: from no larger one than the group's own, if it is a larger band's."""
    top = int(tops()[group])
    return differing(size, largest_partner(size) if size <= top else top)


def segments(group: int, level: int) -> int:
    """Enough that the smallest sets of the group usually have more non-empty segments than H."""
    return max(2, int(tops()[group] * 8 // 15) + 1) << (2 * level)


def allocation(own: np.ndarray, group: int, places: np.ndarray | None = None) -> tuple[int, list[tuple[np.ndarray, np.ndarray, bool, int]]]:
    """(q, [(segment of each element, sizes, with deletions, level)]): what a sorted set gives to a group."""
    most, parts, first = most_differing(len(own), group), [], 0
    for level in range(40):
        hashed = places if places is not None and level == 0 else mixed(own, 7 + level)
        seg = (hashed % np.uint64(segments(group, level))).astype(np.int64)
        sizes = np.bincount(seg)
        q = int((sizes > 0).sum())
        first = first or q
        parts.append((seg, sizes, q <= most, level))
        if q > most or int(np.minimum(sizes, 2).sum()) > most:
            break
    return first, parts


def signatures(own: np.ndarray, group: int, value: np.ndarray | None = None, places: np.ndarray | None = None) -> tuple[int, list[tuple[np.ndarray, int]]]:
    """(q, [(64-bit signatures, 1 for those with an element left out else 0)]). value and places: hashes of own, if known already."""
    out: list[tuple[np.ndarray, int]] = []
    value = mixed(own, 3) if value is None else value
    q, parts = allocation(own, group, places)
    for seg, sizes, deletions, level in parts:
        with np.errstate(over="ignore"):
            total = np.zeros(len(sizes), np.uint64)
            np.add.at(total, seg, value)
            place = np.arange(len(sizes), dtype=np.uint64) + np.uint64(group << 48 | level << 40)
            full = np.flatnonzero(sizes)
            out.append((mixed(total[full] ^ mixed(place[full], 5)), 0))
            if deletions:
                some = np.flatnonzero(sizes[seg] > 1)
                out.append((mixed((total[seg[some]] - value[some]) ^ mixed(place[seg[some]], 5)), 1))
    return q, out


def describe(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, key (128 bits of the set; null if empty)."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), AT_ONCE):
                part = b[k : k + AT_ONCE]
                flat, at = shingle_sets(part.text)
                with np.errstate(over="ignore"):
                    sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(flat, s)))) for s in (1, 2)]
                    keys = np.stack([s[at[1:]] - s[at[:-1]] for s in sums], 1)
                n = np.diff(at)
                yield pd.DataFrame({"doc_id": part.doc_id.array, "n_shingles": n, "key": [x.tobytes() if m else None for x, m in zip(keys, n, strict=True)]})
        forget()

    return docs.select("doc_id", text_of().alias("text")).mapInPandas(run, "doc_id long, n_shingles long, key binary")


def packed(docs: DataFrame, n_bins: int) -> DataFrame:
    """(bin, sig, doc, info, size): arrays as bytes; sig is what the bin leaves of the signature, doc is in steps, info group * 2 + left out.

    Rows of negative bins carry, for each document and group (as info), how many segments it can spare (as sig) and its size.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), AT_ONCE):
                part = b[k : k + AT_ONCE]
                flat, at = shingle_sets(part.text)
                sigs, ids, info, held = [], [], [], []
                values, places = mixed(flat, 3), mixed(flat, 7)
                for doc, a, z in zip(part.doc_id.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    for g in groups(z - a) if z > a else ():
                        q, found = signatures(flat[a:z], g, values[a:z], places[a:z])
                        held.append((doc, max(0, q - most_differing(z - a, g) - 1), g, z - a))
                        for s, left_out in found:
                            sigs.append(s)
                            ids.append((doc, len(s)))
                            info.append(g * 2 + left_out)
                if not sigs:
                    continue
                times = [n for _, n in ids]
                sig = np.concatenate(sigs)
                doc = np.repeat(np.array([d for d, _ in ids], np.int64), times)
                kind = np.repeat(np.array(info, np.uint8), times)
                home = ((sig >> np.uint64(32)) % np.uint64(n_bins)).astype(np.int64)
                order = np.lexsort((doc, kind, home))
                sig, doc, kind, home = sig[order].astype(np.uint32), doc[order], kind[order], home[order]
                starts = np.flatnonzero(np.concatenate(([True], home[1:] != home[:-1])))
                rows = [(int(home[i]), sig[i:j].tobytes(), np.diff(doc[i:j], prepend=0).tobytes(), kind[i:j].tobytes(), None) for i, j in zip(starts, np.append(starts[1:], len(home)), strict=True)]
                h_doc, spare, h_group, size = (np.array(x, np.int64) for x in zip(*held, strict=True))
                rows.append((-1 - int(h_doc[0] % n_bins), spare.astype(np.uint32).tobytes(), np.diff(h_doc, prepend=0).tobytes(), h_group.astype(np.uint8).tobytes(), size.tobytes()))
                yield pd.DataFrame(rows, columns=["bin", "sig", "doc", "info", "size"])
        forget()

    return docs.select("doc_id", text_of().alias("text")).mapInPandas(run, "bin long, sig binary, doc binary, info binary, size binary")


def runs(pdf: pd.DataFrame) -> pd.DataFrame:
    """One bin: the members of runs of two or more (doc, grp, whole, sig, run: its length).

    Of a negative bin what it carries: (doc, grp, null, what the document can spare, its size).
    """
    sig = np.concatenate([np.frombuffer(x, np.uint32) for x in pdf.sig])
    doc = np.concatenate([np.cumsum(np.frombuffer(x, np.int64)) for x in pdf.doc])
    info = np.concatenate([np.frombuffer(x, np.uint8) for x in pdf["info"]])
    if pdf.bin.iloc[0] < 0:
        size = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["size"]])
        return pd.DataFrame({"doc": doc, "grp": info.astype(np.int32), "whole": pd.array([None] * len(doc), "boolean"), "sig": sig.astype(np.int64), "run": size})
    order = np.argsort(sig, kind="stable")
    sig, doc, info = sig[order], doc[order], info[order]
    starts = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
    length = np.diff(np.append(starts, len(sig)))
    member = np.repeat(length > 1, length)
    return pd.DataFrame({"doc": doc[member], "grp": (info[member] >> 1).astype(np.int32), "whole": pd.array(info[member] % 2 == 0, "boolean"), "sig": (np.int64(pdf.bin.iloc[0]) << 32) | sig[member].astype(np.int64), "run": np.repeat(length, length)[member]})


def sets_of(docs: DataFrame) -> DataFrame:
    """(doc_id, set array<long>) of each row, sorted."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), AT_ONCE):
                part = b[k : k + AT_ONCE]
                flat, at = shingle_sets(part.text)
                yield pd.DataFrame({"doc_id": part.doc_id.array, "set": [flat[a:z].view(np.int64) for a, z in zip(at[:-1], at[1:], strict=True)]})
        forget()

    return docs.select("doc_id", text_of().alias("text")).mapInPandas(run, "doc_id long, set array<long>")


def words_of(text: str) -> list[bytes]:
    """Lower-cased for A-Z and cut at [ \\t-\\r] only, which is what bytes.lower() and bytes.split() do."""
    return text.encode().lower().split()


def exact_set(text: str) -> frozenset[tuple[bytes, ...]]:
    """The shingles themselves; with fewer words than a shingle the whole sequence is one."""
    w = words_of(text)
    return frozenset(zip(*(w[k:] for k in range(WORDS)), strict=False)) if len(w) >= WORDS else frozenset([tuple(w)] if w else [])


def similar(x: frozenset, y: frozenset) -> bool:
    common = len(x & y)
    return common > 0 and 100 * common >= PERCENT * (len(x) + len(y) - common)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of pairs (a, b) whose sets of shingles, word by word, are similar. texts: (doc_id, text), one row a document."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, kept, room = (None, frozenset()), {}, 0  # sets of b come one after the other, those of a from time to time
        for batch in batches:
            good = []
            for a, b, x, y in zip(batch.a, batch.b, batch.text_a, batch.text_b, strict=True):
                if last[0] != b:
                    last = (b, exact_set(y))
                if (own := kept.get(a)) is None:
                    if room > KEPT_SHINGLES:
                        kept.clear()
                        room = 0
                    own = kept[a] = exact_set(x)
                    room += len(own)
                good.append(similar(own, last[1]))
            yield batch.loc[good, ["a", "b"]]

    a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInPandas(run, "a long, b long")


def kept_members(docs: DataFrame, n_bins: int) -> DataFrame:
    """(sig, doc, n, pos): the signatures by which a document looks for partners, where any other document has them too.

    Of each document and group the most frequent segments that it can spare are left out, by one order for all. The
    frequency of a segment is the length of its run, so a document most of whose segments are its own alone has none
    left, and one that shares only a common passage neither. pos: how many of the document's segments are as rare or
    rarer, itself included; 0 where nothing could be spared.
    """
    found = packed(docs, n_bins).groupBy("bin").applyInPandas(runs, "doc long, grp int, whole boolean, sig long, run long")
    held = F.col("whole").isNull()
    own = Window.partitionBy("doc", "grp")
    place = F.row_number().over(own.orderBy(F.desc("whole"), F.desc("run"), "sig"))
    found = found.withColumns({"place": place, "spare": F.max(F.when(held, F.col("sig"))).over(own), "n": F.max(F.when(held, F.col("run"))).over(own)})
    tops_of = docs.sparkSession.createDataFrame([(g, int(t)) for g, t in enumerate(tops())], "grp int, top long")  # a row a band
    found = found.where("whole is not null and (not whole or place > spare)").join(F.broadcast(tops_of), "grp")
    most = F.floor((F.col("n") + F.when(F.col("n") <= F.col("top"), F.floor(F.col("n") * 100 / PERCENT)).otherwise(F.col("top"))) * (100 - PERCENT) / (100 + PERCENT))
    pos = F.when(F.col("whole") & (F.col("spare") > 0), most + 2 + F.col("spare") - F.col("place")).otherwise(F.lit(0))
    return found.select("sig", "doc", "n", pos.cast("int").alias("pos"))


def may_be_similar(a: str, b: str) -> Column:
    """Whether a run may show a similar pair: by their sizes, and as the rarest segments that both have stand early in both."""
    n_a, n_b = F.col(f"{a}.n"), F.col(f"{b}.n")
    differ = F.floor((n_a + n_b) * (100 - PERCENT) / (100 + PERCENT))
    return (F.greatest(n_a, n_b) * PERCENT <= F.least(n_a, n_b) * 100) & (F.greatest(f"{a}.pos", f"{b}.pos") <= differ + 1)


def similar_links(docs: DataFrame, described: DataFrame) -> DataFrame:
    """Links (a, b) between documents of different sets whose components are those of all similar pairs.

    described: of describe(), written. Of equal sets only the smallest doc_id takes part.
    """
    classes = described.where("key is not null and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("rep"))
    others = written(described.where("key is not null").join(classes, "key").where("doc_id <> rep").select(F.col("doc_id").alias("own_id")).distinct(), "copies")
    n_bins = max(1, (described.agg(F.sum("n_shingles")).first()[0] or 0) // BIN)
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    chosen = with_ids(docs, others, "left_anti")
    members = written(kept_members(chosen, n_bins), "members")
    star = written(_representatives(members), "pairs")
    ids = written(star.select(F.col("a").alias("own_id")).union(star.select(F.col("b").alias("own_id"))).distinct(), "candidates")
    texts = written(with_ids(chosen.select("doc_id", text_of().alias("text")), ids, "left_semi").dropDuplicates(["doc_id"]), "texts")
    links = written(verified(star, texts), "links")
    discard(others, star, ids)
    for short in (True, False):
        apart = _apart(members, links, short)
        if apart.isEmpty():
            continue
        new = verified(_all_pairs(apart) if short else written(_across(apart, texts), "across"), texts)
        links = written(links.union(new), "links")
        discard(apart)
    discard(members, texts)
    return links


def _apart(members: DataFrame, links: DataFrame, short: bool) -> DataFrame:
    """(sig, doc, n, pos, part): the short or the long runs that hold documents of several components (part)."""
    parts = connected_components(links).withColumnRenamed("id", "doc")
    placed = members.join(parts, "doc", "left").withColumn("part", F.coalesce("component", "doc")).drop("component")
    run = F.count("*") <= SHORT_RUN
    several = placed.groupBy("sig").agg(F.min("part").alias("least"), F.max("part").alias("most"), run.alias("short")).where((F.col("least") != F.col("most")) & (F.col("short") == F.lit(short)))
    return written(placed.join(several.select("sig"), "sig"), "apart")


def _representatives(members: DataFrame) -> DataFrame:
    """(a, b): of each run one document, by an order that is the same for all runs, with each other one."""
    order = F.struct(F.xxhash64("doc").alias("h"), "doc", "n", "pos")
    first = members.groupBy("sig").agg(F.min(order).alias("rep"), F.count("*").alias("run")).where("run > 1")
    both = members.select("sig", F.struct("doc", "n", "pos").alias("own")).join(first, "sig").where((F.col("own.doc") != F.col("rep.doc")) & may_be_similar("own", "rep"))
    return both.select(F.least("own.doc", "rep.doc").alias("a"), F.greatest("own.doc", "rep.doc").alias("b")).distinct()


def _all_pairs(apart: DataFrame) -> DataFrame:
    """(a, b): of short runs all pairs across components."""
    x, y = (apart.select("sig", F.struct("doc", "n", "pos", "part").alias(c)) for c in ("x", "y"))
    both = x.join(y, "sig").where((F.col("x.doc") < F.col("y.doc")) & (F.col("x.part") != F.col("y.part")) & may_be_similar("x", "y"))
    return both.select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b")).distinct()


def _across(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between components (part) that meet in long runs (sig, doc, n, part).

    Documents that runs hold together are a family, dealt over blocks of bounded size; blocks that share a run are
    compared. Of two components one isn't the family's largest, so only members of the others look for partners.
    """
    first = members.groupBy("sig").agg(F.min("doc").alias("b"))
    families = connected_components(members.join(first, "sig").select(F.col("doc").alias("a"), "b")).select(F.col("id").alias("doc"), F.col("component").alias("family"))
    docs = members.select("doc", "n", "part").distinct().join(families, "doc")
    size = docs.groupBy("family", "part").agg(F.count("*").alias("c"), F.sum("n").alias("n")).groupBy("family").agg(
        F.max(F.struct("c", "part"))["part"].alias("largest"), F.ceil(F.greatest(F.sum("c") / BLOCK_DOCS, F.sum("n") / BLOCK_SHINGLES)).cast("long").alias("blocks")
    )
    docs = written(docs.join(size, "family").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks"))).drop("blocks"), "blocks")
    packed_blocks = written(docs.join(sets_of(texts).withColumnRenamed("doc_id", "doc"), "doc").groupBy("family", "block").applyInPandas(_pack, "family long, block long, doc binary, part binary, n binary, small binary, sets binary"), "packed_blocks")
    where = written(members.select("sig", "doc").join(docs.select("doc", "family", "block"), "doc").select("sig", "family", "block").distinct(), "runs_of_blocks")
    pairs = where.join(where.select("sig", F.col("block").alias("other")), "sig").where("block <= other").select("family", "block", "other").distinct()
    other = packed_blocks.select("family", F.col("block").alias("other"), *[F.col(c).alias(f"{c}_b") for c in ("doc", "part", "n", "small", "sets")])
    return pairs.join(packed_blocks, ["family", "block"]).join(other, ["family", "other"]).mapInPandas(_compare, "a long, b long")


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("doc")
    small = (pdf.part != pdf.largest).to_numpy()
    columns = [pdf[c].to_numpy(np.int64).tobytes() for c in ("doc", "part", "n")]
    sets = b"".join(np.asarray(x, np.int64).tobytes() for x in pdf["set"])
    return pd.DataFrame([(pdf.family.iloc[0], pdf.block.iloc[0], *columns, small.tobytes(), sets)], columns=["family", "block", "doc", "part", "n", "small", "sets"])


def common_counts(x: np.ndarray, x_rows: np.ndarray, y: np.ndarray, y_rows: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Sizes of the intersections of all rows of x with all rows of y, given as shingles and the rows they are in.

    Shingles that many rows hold go through a matrix product, a few thousand at a time; the others pair by pair.
    """
    both = np.intersect1d(x, y)
    keep = [np.isin(v, both) for v in (x, y)]
    x, x_rows, y, y_rows = x[keep[0]], x_rows[keep[0]], y[keep[1]], y_rows[keep[1]]
    x_at, y_at = np.searchsorted(both, x), np.searchsorted(both, y)
    p, q = np.bincount(x_at, minlength=len(both)), np.bincount(y_at, minlength=len(both))
    out = np.zeros(shape, np.float32)
    dense = np.flatnonzero(p * q > 64)
    for k in range(0, len(dense), 4_096):
        place = np.full(len(both), -1)
        place[dense[k : k + 4_096]] = np.arange(len(dense[k : k + 4_096]))
        sides = []
        for at, rows, n in ((x_at, x_rows, shape[0]), (y_at, y_rows, shape[1])):
            m = np.zeros((n, len(dense[k : k + 4_096])), np.float32)
            ok = place[at] >= 0
            m[rows[ok], place[at[ok]]] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    sparse = p * q <= 64
    xs, ys = sparse[x_at], sparse[y_at]
    order = np.argsort(y_at[ys], kind="stable")
    ys_at, ys_rows = y_at[ys][order], y_rows[ys][order]
    begin, times = np.searchsorted(ys_at, x_at[xs]), q[x_at[xs]]
    if len(times):
        partner = ys_rows[np.repeat(begin - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(times.sum())]
        np.add.at(out, (np.repeat(x_rows[xs], times), partner), 1)
    return out


def _compare(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of blocks: as many links across components as it takes to join those that are similar anywhere."""
    for b in batches:
        for row in b.itertuples(index=False):
            sides = []
            for end in ("", "_b"):
                doc, part, n, flat = (np.frombuffer(getattr(row, c + end), np.int64) for c in ("doc", "part", "n", "sets"))
                sides.append((doc, part, n, flat, np.repeat(np.arange(len(doc)), n), np.frombuffer(getattr(row, "small" + end), np.bool_)))
            (doc, part, n, flat, rows, small), (doc_b, part_b, n_b, flat_b, rows_b, small_b) = sides
            if not small.any() and not small_b.any():
                continue
            common = common_counts(flat, rows, flat_b, rows_b, (len(doc), len(doc_b)))
            similar = common * (100 + PERCENT) >= (n[:, None] + n_b[None]) * PERCENT
            similar &= (part[:, None] != part_b[None]) & (small[:, None] | small_b[None])
            parent: dict[int, int] = {}

            def top(x: int, parent: dict[int, int] = parent) -> int:
                while (p := parent.setdefault(x, x)) != x:
                    parent[x] = parent[p]
                    x = parent[x]
                return x

            links = []
            for i, j in zip(*np.nonzero(similar), strict=True):
                x, y = top(int(part[i])), top(int(part_b[j]))
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    links.append((int(doc[i]), int(doc_b[j])))
            yield pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def ngram_jaccard_join(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included).

    Equal sets are linked; a set without shingles (null, empty or blank text) with nothing. Rows that share a doc_id
    are one document. A row without doc_id takes no part in links and has no component_id. Empty docs give no rows;
    further columns of docs are ignored. Sets count as equal, and shingles as the same in n_shingles, by hashes of 128
    and 64 bits; links between different sets are verified word by word.
    """
    described = written(describe(docs), "described")
    classes = described.where("key is not null and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("rep"))
    links = similar_links(docs, described)
    equal = described.where("doc_id is not null").join(classes, "key").where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    parts = connected_components(links.union(equal))
    out = described.select("doc_id", "n_shingles").join(parts, F.col("doc_id") == F.col("id"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one document of each component, the one with the smallest doc_id, all columns as they are.

    Documents without words (null, empty or blank texts) all stay, as do rows without doc_id. Rows that share a doc_id
    are one document: they stay or go together, repeated rows included. Empty docs stay empty. Further columns may have
    any names.
    """
    (own_id,) = fresh(docs, "own_id")
    found = written(ngram_jaccard_join(docs.select("doc_id", "text")), "components")
    gone = written(found.where("component_id <> doc_id").select(F.col("doc_id").alias(own_id)).distinct(), "near_copies")
    return with_ids(docs, gone, "left_anti", own_id)
