"""Alignment of two tokenizers' tokens of the same texts, by a sweep over the ends of tokens.

Both tokenizers encode " " + text (the second one adds the space itself), so the bytes of their tokens are the same
and every token is known by its id and the byte offset of its end. These end events of both sides form one table, in
runs: the events of up to RUN consecutive tokens of one side are a row with the offset at which the run starts and the
ids (ends follow from the tokens' lengths), so that a row costs about a byte a token. Rows are dealt by document,
sorted by document and offset within the partition, and streamed through a machine that closes a group wherever
both sides end. It works on a window of events at a time; what it carries on is the open group, the events of the side
that is ahead, and the sums of the document it is in. A place where any token ends closes exactly one link: the pair
of tokens, one of each side, that both cover the byte before it.

Pairs of ids are then counted over documents, and each document's links are joined with these counts.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workers import let_go
from .bpe import LONGEST, UNEVEN, TextEncoder
from .common import text_of, written
from .records import LETTERS, library_encoder
from .token_counts import PieceTokens

#: Tokens of a row of events, and tokens of both sides that the sweep takes at a time.
RUN, WINDOW = 8_192, 100_000
#: Words whose ids a worker keeps during a task: beyond that it starts anew. A word takes about 300 bytes.
KEPT = 500_000
#: Pairs of ids that are broadcast at most with their counts (32 bytes each, 64 MB); more are joined by a shuffle.
BROADCAST_PAIRS = 2_000_000
SPACE_PLACE = regex.compile(r"\s|$")


class ByteLevel:
    """A byte-level tokenizers file; special tokens inside texts are plain text."""

    def __init__(self, path: str, pattern: str):
        import json

        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        if j["pre_tokenizer"]["type"] != "ByteLevel" or j["pre_tokenizer"]["add_prefix_space"] or j["normalizer"]:
            raise ValueError(f"{path} is no plain byte-level tokenizer")
        whole, size = library_encoder(path, pattern)
        self.size = size
        self.encoder = TextEncoder(pattern, whole.piece_ids, KEPT)
        self.lead = len(self.encoder.encode("x"))
        byte = {chr(letter): b for b, letter in LETTERS.items()}
        self.tokens = [b""] * size
        for token, i in j["model"]["vocab"].items():
            self.tokens[i] = bytes(map(byte.__getitem__, token))
        if len({t for t in self.tokens if len(t) == 1}) < 256:
            raise ValueError(f"{path} lacks some bytes")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of a space and each text."""
        out, e = [], self.encoder
        for t in texts:
            if not t or t[0].isspace():
                ids = e.encode(" " + t)
            else:  # the pattern cuts before the first white space after a word, so the first word can go by itself
                end = SPACE_PLACE.search(t).start()
                ids = e.split(" " + t[:end]) + e.encode("x" + t[end:])[self.lead :]
            out.append(np.frombuffer(ids, "<u4"))
        return out


class Pieces:
    """A sentencepiece file that adds a space before each text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = m.get_piece_size()
        pieces = list(map(m.id_to_piece, range(self.size)))
        self.tokens = [bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        # No merge crosses a turn to a space, nor a line end, which is a byte of its own after the added space.
        self.by_words = PieceTokens(path).proven and [self.tokens[i] for i in m.encode("\na")] == [b" ", b"\n", b"a"] and not any("\n" in p for p in pieces)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Words:
    """Ids of both sides of whole texts, each word's once during a task where its ids don't depend on what stands around it.

    That is so where single spaces and line ends stand between words: both tokenizers cut before a space that follows
    another character, and at line ends. Other texts are encoded whole. A text's ids are None where B's tokens are not
    its bytes after a space; A has every byte as a token, so its tokens always are.
    """

    def __init__(self, a: ByteLevel, b: Pieces):
        self.a, self.b = a, b
        #: Words and line ends with the word after them -> packed ids; b has None where the bytes differ.
        self.ids_a: dict[str, bytes] = {}
        self.ids_b: dict[str, bytes | None] = {}

    def _learn(self, words: set[str]) -> tuple[dict, dict]:
        """Both tables with the words in them; they start anew when full. Long words are in the returned ones only."""
        new = list(words.difference(self.ids_a))
        if len(self.ids_a) + len(new) > KEPT:
            self.ids_a.clear()
            self.ids_b.clear()
            new = list(words)
        get, split, long_a, long_b = self.b.tokens.__getitem__, self.a.encoder.split, {}, {}
        for w, ids in zip(new, self.b.encode(new), strict=True):
            if w[:1] == "\n":
                text, ids = w, ids[1:]  # without the space that the library adds
            else:
                text = " " + w
            kept = len(w) <= LONGEST
            (self.ids_a if kept else long_a)[w] = split(text)
            (self.ids_b if kept else long_b)[w] = array("I", ids).tobytes() if b"".join(map(get, ids)) == text.encode() else None
        return (self.ids_a | long_a, self.ids_b | long_b) if long_a else (self.ids_a, self.ids_b)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        cut, words = [], set()
        for t in texts:
            if not self.b.by_words or not t or t[0].isspace() or t[-1].isspace() or any(map(t.__contains__, UNEVEN)):
                cut.append(None)
            else:
                cut.append(t.replace("\n", " \n").split(" "))
                words.update(cut[-1])
        ids_a, ids_b = self._learn(words)
        whole = iter(self._whole([t for t, c in zip(texts, cut, strict=True) if c is None]))
        out = []
        for own in cut:
            if own is None:
                out.append(next(whole))
            else:
                b = list(map(ids_b.__getitem__, own))
                out.append(None if None in b else (np.frombuffer(b"".join(map(ids_a.__getitem__, own)), "<u4"), np.frombuffer(b"".join(b), "<u4")))
        return out

    def _whole(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        tokens = self.b.tokens
        same = lambda ids, t: bool(t) and b"".join([tokens[i] for i in ids]) == (" " + t).encode()
        return [(a, np.array(b, "<u4")) if same(b, t) else None for t, a, b in zip(texts, self.a.encode(texts), self.b.encode(texts), strict=True)]

    def forget(self) -> None:
        self.ids_a.clear()
        self.ids_b.clear()
        self.a.encoder.forget()


class Sides:
    """Both tokenizers and the tables that the sweep looks into."""

    def __init__(self, path_a: str, path_b: str, pattern: str):
        self.both = ByteLevel(path_a, pattern), Pieces(path_b)
        self.lengths = [np.array(list(map(len, s.tokens)), np.int64) for s in self.both]
        self.kinds = ["<u2" if s.size <= 1 << 16 else "<u4" for s in self.both]
        # The decimal ids with what can follow them: "," within a side, "|" after the last of A, ";" after the last of B.
        names = [f"{i}{end}".encode() for s, last in zip(self.both, "|;", strict=True) for end in ("," + last) for i in range(s.size)]
        self.name_lengths = np.array(list(map(len, names)))
        self.names = np.zeros((len(names), int(self.name_lengths.max())), np.uint8)
        for k, n in enumerate(names):
            self.names[k, : len(n)] = np.frombuffer(n, np.uint8)


@lru_cache(maxsize=1)
def sides_of(path_a: str, path_b: str, pattern: str) -> Sides:
    return Sides(path_a, path_b, pattern)


def forget() -> None:
    """At the end of a task."""
    sides_of.cache_clear()
    library_encoder.cache_clear()
    let_go()


EVENTS = "uid long, doc_id long, start long, side int, ok boolean, ids binary"


def end_events(docs: DataFrame, path_a: str, path_b: str, pattern: str) -> DataFrame:
    """The events of both sides in runs: EVENTS, at least a row a side and document; ok is whether its tokens' bytes are those of the text after a space.

    Ids are compressed little-endian integers of the vocabulary's width. Both sides come from one pass over docs, so
    that they agree on uid, which tells rows apart that share a doc_id.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sides = sides_of(path_a, path_b, pattern)
        words = Words(*sides.both)
        pack, none = zstandard.ZstdCompressor(level=1).compress, (np.zeros(0, "<u4"),) * 2
        for b in batches:
            for k in range(0, len(b), 200):
                part, rows = b.iloc[k : k + 200], []
                for uid, doc_id, both in zip(part.uid, part.doc_id.astype(object).where(part.doc_id.notna(), None), words.encode(part.text.tolist()), strict=True):
                    for number, (ids, lengths, kind) in enumerate(zip(both or none, sides.lengths, sides.kinds, strict=True)):
                        starts = np.concatenate(([0], np.cumsum(lengths[ids[: len(ids) - 1]]))) if len(ids) > RUN else [0]
                        rows += [(uid, doc_id, int(starts[i]), number, both is not None, pack(ids[i : i + RUN].astype(kind).tobytes())) for i in range(0, max(len(ids), 1), RUN)]
                out = pd.DataFrame(rows, columns=["uid", "doc_id", "start", "side", "ok", "ids"])
                yield out.assign(doc_id=pd.array(out.doc_id, "Int64"))
        words.forget()
        del sides, words
        forget()

    own = docs.select("doc_id", text_of().alias("text")).withColumn("uid", F.monotonically_increasing_id())
    return own.mapInPandas(run, EVENTS)


class Open:
    """What the sweep knows of a document until it is done: tokens that wait for a common end, and sums."""

    def __init__(self, uid: int, doc_id: int | None):
        self.uid, self.doc_id, self.ok = uid, doc_id, True
        self.ids: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
        self.counts, self.sha, self.owed = np.zeros(4, np.int64), hashlib.sha256(), b""
        self.pairs, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)


class Closed:
    """The groups that a window closes: ids of both sides, and of each token its document (a place in docs) and group, of each link too."""

    def __init__(self, sides: Sides, docs: list[Open], last_open: bool):
        self.docs, self.ids, self.doc, ends = docs, [], [], []
        for k in (0, 1):
            ids = [np.concatenate(d.ids[k]) if d.ids[k] else np.zeros(0, np.uint32) for d in docs]
            n = np.array(list(map(len, ids)))
            doc = np.repeat(np.arange(len(docs)), n)
            ids = np.concatenate(ids).astype(np.int64)
            total = np.concatenate(([0], np.cumsum(sides.lengths[k][ids])))
            first = total[np.concatenate(([0], np.cumsum(n)))[:-1]]
            ends.append((doc << 42) + total[1:] - first[doc])
            self.ids.append(ids)
            self.doc.append(doc)
        common = np.intersect1d(*ends, assume_unique=True)
        if last_open:  # its tokens after the last common end wait
            last = len(docs) - 1
            stop = common[-1] if len(common) and common[-1] >> 42 == last else last << 42
            for k in (0, 1):
                cut = np.searchsorted(ends[k], stop, "right")
                docs[last].ids[k][:] = [self.ids[k][cut:]]
                self.ids[k], self.doc[k], ends[k] = self.ids[k][:cut], self.doc[k][:cut], ends[k][:cut]
        self.ends = ends
        self.group = [np.searchsorted(common, e) for e in ends]
        self.group_doc = common >> 42
        self.at_end = [common[g] == e for g, e in zip(self.group, ends, strict=True)]

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, token of A, token of B) of each link, in order: one closes at every place where a token ends."""
        a, b = self.ends
        places = np.sort(np.concatenate((a, b[~self.at_end[1]])), kind="stable")
        return places >> 42, np.searchsorted(a, places), np.searchsorted(b, places)

    def written(self, sides: Sides) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, where each document's begin, and the end): the groups as `a1,a2|b1;a3|b2,b3;`, documents after one another."""
        (a, b), (ga, gb), (ea, eb) = self.ids, self.group, self.at_end
        na, nb = (s.size for s in sides.both)
        codes, doc = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.int64)
        at_a = np.arange(len(a)) + np.searchsorted(gb, ga)
        at_b = np.arange(len(b)) + np.searchsorted(ga, gb, "right")
        last_a = np.append(ga[1:] != ga[:-1], True)[: len(a)]
        codes[at_a], codes[at_b] = a + na * last_a, 2 * na + b + nb * eb
        doc[at_a], doc[at_b] = self.doc[0], self.doc[1]
        n = sides.name_lengths[codes]
        shown = sides.names[codes][np.arange(sides.names.shape[1]) < n[:, None]]
        return shown, np.concatenate(([0], np.cumsum(np.bincount(doc, n, len(self.docs)).astype(np.int64))))


def add_sums(c: Closed, sides: Sides) -> None:
    """Adds a window's groups to the sums of its documents."""
    docs, n = c.docs, len(c.docs)
    link_doc, i, j = c.links()
    pair = c.ids[0][i] * sides.both[1].size + c.ids[1][j]
    keys, times = np.unique((link_doc << 42) + pair, return_counts=True)
    at = np.searchsorted(keys, np.arange(n + 1) << 42)
    counts = np.stack([np.bincount(d, minlength=n) for d in (*c.doc, c.group_doc, link_doc)], 1)
    shown, begin = c.written(sides)
    shown = memoryview(shown)
    for k, d in enumerate(docs):
        d.counts += counts[k]
        if begin[k] < begin[k + 1]:
            d.sha.update(d.owed)
            d.sha.update(shown[begin[k] : begin[k + 1] - 1])
            d.owed = b";"
            own, t = keys[at[k] : at[k + 1]] & ((1 << 42) - 1), times[at[k] : at[k + 1]]
            if len(d.pairs):  # a document of several windows
                own, inverse = np.unique(np.concatenate((d.pairs, own)), return_inverse=True)
                t = np.bincount(inverse, np.concatenate((d.times, t))).astype(np.int64)
            d.pairs, d.times = own, t


def closings(batches: Iterable[pa.RecordBatch], sides: Sides, window: int = WINDOW) -> Iterator[tuple[Closed, list[Open]]]:
    """Runs the machine over sorted events: the groups closed by each window, and the documents that are done with it."""
    docs: list[Open] = []
    held, unpack = 0, zstandard.ZstdDecompressor().decompress
    for b in batches:
        for uid, doc_id, side, ok, ids in zip(*(b.column(c).to_pylist() for c in ("uid", "doc_id", "side", "ok", "ids")), strict=True):
            if not docs or docs[-1].uid != uid:
                if held >= window:
                    yield Closed(sides, docs, False), docs
                    docs, held = [], 0
                docs.append(Open(uid, doc_id))
            d = docs[-1]
            if not ok:
                d.ok = False
                for own in d.ids:
                    own.clear()
            if d.ok:
                own = np.frombuffer(unpack(ids), sides.kinds[side])
                d.ids[side].append(own)
                held += len(own)
                if held >= 2 * window:  # within a document
                    yield Closed(sides, docs, True), docs[:-1]
                    docs = docs[-1:]
                    held = sum(map(len, (*d.ids[0], *d.ids[1])))
                    window = max(window, held)
    if docs:
        yield Closed(sides, docs, False), docs


DIGESTS = "uid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a array<int>, b array<int>, n array<int>"
GROUPS = "doc_id long, part long, a_ids array<int>, b_ids array<int>"


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(list(map(len, values))))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values).astype(np.int32)))


def sorted_events(docs: DataFrame, path_a: str, path_b: str, pattern: str) -> DataFrame:
    """Events dealt by document, in order of their place within it."""
    return end_events(docs, path_a, path_b, pattern).repartition("uid").sortWithinPartitions("uid", "start", "side")


def swept(docs: DataFrame, path_a: str, path_b: str, pattern: str, window: int = WINDOW) -> DataFrame:
    """DIGESTS: a row a document with its counts, the digest of its groups, and its different links (ids a and b, n times)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = sides_of(path_a, path_b, pattern)
        size = sides.both[1].size
        for closed, done in closings(batches, sides, window):
            add_sums(closed, sides)
            for k in range(0, len(done), 1_000):
                part = done[k : k + 1_000]
                counts = np.stack([d.counts for d in part], 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([d.uid for d in part], pa.int64()),
                        pa.array([d.doc_id for d in part], pa.int64()),
                        *map(pa.array, counts),
                        pa.array([d.sha.hexdigest() if d.counts[0] else "" for d in part]),
                        _lists([d.pairs // size for d in part]),
                        _lists([d.pairs % size for d in part]),
                        _lists([d.times for d in part]),
                    ],
                    names=["uid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a", "b", "n"],
                )
        del sides
        forget()

    return sorted_events(docs, path_a, path_b, pattern).mapInArrow(run, DIGESTS)


def groups(docs: DataFrame, path_a: str, path_b: str, pattern: str, window: int = WINDOW) -> DataFrame:
    """GROUPS: the groups themselves, part counting those of a document in order from 0. Documents without tokens have none."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = sides_of(path_a, path_b, pattern)
        before: dict[int, int] = {}
        for c, _ in closings(batches, sides, window):
            n = len(c.group_doc)
            first = np.searchsorted(c.group_doc, c.group_doc)
            base = np.array([before.get(d.uid, 0) for d in c.docs])
            before = {c.docs[-1].uid: int(base[-1] + (c.group_doc == len(c.docs) - 1).sum())}
            for k in range(0, n, 50_000):
                stop = min(k + 50_000, n)
                bounds = [np.searchsorted(g, np.arange(k, stop + 1)) for g in c.group]
                lists = [pa.ListArray.from_arrays(pa.array((x - x[0]).astype(np.int32)), pa.array(ids[x[0] : x[-1]].astype(np.int32))) for x, ids in zip(bounds, c.ids, strict=True)]
                own = c.group_doc[k:stop]
                yield pa.RecordBatch.from_arrays([pa.array([c.docs[i].doc_id for i in own.tolist()], pa.int64()), pa.array(np.arange(k, stop) - first[k:stop] + base[own]), *lists], names=["doc_id", "part", "a_ids", "b_ids"])
        del sides
        forget()

    return sorted_events(docs, path_a, path_b, pattern).mapInArrow(run, GROUPS)


def _pair(a: Column, b: Column) -> Column:
    return F.shiftleft(a.cast("long"), 32) + b


def pair_counts(documents: DataFrame) -> DataFrame:
    """(pair, docs, best) of swept documents: how many hold the pair of ids linked, and whether no pair of the same A id is held by more.

    An A id has as many pairs at most as there are B ids.
    """
    pairs = documents.select(F.explode(F.arrays_zip("a", "b")).alias("p")).groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("*").alias("docs"))
    best = F.col("docs") == F.max("docs").over(Window.partitionBy("a"))
    return pairs.select(_pair(F.col("a"), F.col("b")).alias("pair"), "docs", best.alias("best"))


def aligned(docs: DataFrame, path_a: str, path_b: str, pattern: str, window: int = WINDOW) -> DataFrame:
    """Per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A document is a row: rows that repeat a doc_id, or have none, count each for itself. Texts that are null or empty,
    or whose tokens' bytes aren't a space and the text on either side, have no tokens: zeros and an empty digest.
    Ties: all of an A id's pairs with its highest count are best. Further columns are ignored; empty docs give no rows.
    """
    documents = written(swept(docs, path_a, path_b, pattern, window), "swept")
    counts = written(pair_counts(documents), "pairs")
    few = counts.count() <= BROADCAST_PAIRS
    own = ["uid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    links = documents.select(*own, F.explode_outer(F.arrays_zip("a", "b", "n")).alias("l")).select(*own, _pair(F.col("l.a"), F.col("l.b")).alias("pair"), F.col("l.n").cast("long").alias("n"))
    joined = links.join(F.broadcast(counts) if few else counts, "pair", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = joined.groupBy(*own).agg(total(F.when(F.col("best"), F.col("n"))).alias("n_best"), total(F.col("n") * F.col("docs")).alias("count_sum"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
