"""Token ids as length-delimited binary records, with an index of offsets for shuffled reads.

A shard file is a run of records in ascending doc_id order:

    length        unsigned 64 bits, little endian: bytes of the payload
    masked crc    unsigned 32 bits: of the length's 8 bytes
    payload       doc_id (signed 64 bits), flags (unsigned 8 bits: 1 if doc_id is null), then the ids, 2 or 4 bytes each
    masked crc    unsigned 32 bits: of the payload

The checksum is CRC-32, rotated right by 15 bits with 0xA282EAD8 added, so that a checksum of data that holds
checksums stays sound. Beside each shard lies its index: the offset of every record as unsigned 64 bits, after the
number of ids in the shard and the width of an id. A reader can take records in any order from it.

Files are written by the tasks that encode, through the file system that the folder's scheme names, under a name of
the attempt's own, so nothing is renamed or written over. The manifest has the names of the attempts that Spark took;
what other attempts (lost executors, speculation) left is deleted once it is written.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import TextEncoder
from .common import shared_dir, text_of, written

#: Words whose ids a worker keeps during a task: the library takes longer for a new one than a table of 120 MB is worth.
KEPT = 600_000
MASK, ROTATE = 0xA282EAD8, 15
HEAD, LENGTH, CRC = struct.Struct("<qB"), struct.Struct("<Q"), struct.Struct("<I")


def masked(crc: int) -> int:
    return ((crc >> ROTATE | crc << (32 - ROTATE)) + MASK) & 0xFFFFFFFF


def record(payload: bytes) -> bytes:
    length = LENGTH.pack(len(payload))
    return b"".join((length, CRC.pack(masked(zlib.crc32(length))), payload, CRC.pack(masked(zlib.crc32(payload)))))


def records(data: bytes, offsets: np.ndarray) -> Iterator[bytes]:
    """The payloads at these offsets, each checked."""
    for at in offsets.tolist():
        (n,) = LENGTH.unpack_from(data, at)
        if masked(zlib.crc32(data[at : at + 8])) != CRC.unpack_from(data, at + 8)[0]:
            raise ValueError(f"damaged length at {at}")
        payload = data[at + 12 : at + 12 + n]
        if len(payload) != n or masked(zlib.crc32(payload)) != CRC.unpack_from(data, at + 12 + n)[0]:
            raise ValueError(f"damaged record at {at}")
        yield payload


def file_system(folder: str):
    """(file system, path) for a folder given by a URI or a path."""
    from pyarrow import fs

    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), os.path.abspath(folder))


class Shard:
    """Writes one shard and its index."""

    def __init__(self, folder: str, name: str, width: int):
        self.fs, top = file_system(folder)
        self.fs.create_dir(top, recursive=True)
        self.path, self.width = f"{top}/{name}", width
        self.out = self.fs.open_output_stream(f"{self.path}.records")
        self.offsets, self.at, self.ids = [], 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        whole = record(HEAD.pack(doc_id or 0, doc_id is None) + ids.astype(f"<u{self.width}").tobytes())
        self.offsets.append(self.at)
        self.out.write(whole)
        self.at += len(whole)
        self.ids += len(ids)

    def close(self) -> None:
        self.out.close()
        with self.fs.open_output_stream(f"{self.path}.index") as f:
            f.write(struct.pack("<QQ", self.ids, self.width) + np.array(self.offsets, "<u8").tobytes())


def read_shard(folder: str, name: str, order: np.ndarray | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of each record, in file order or in the given order of record numbers."""
    fs, top = file_system(folder)
    with fs.open_input_file(f"{top}/{name}.index") as f:
        index = f.read()
    _, width = struct.unpack_from("<QQ", index)
    offsets = np.frombuffer(index, "<u8", offset=16)
    with fs.open_input_file(f"{top}/{name}.records") as f:
        size, step = f.size(), 1 if order is not None else 2_000
        picks = offsets if order is None else offsets[order]
        ends = dict(zip(offsets.tolist(), [*offsets[1:].tolist(), size], strict=True))
        for k in range(0, len(picks), step):
            part = picks[k : k + step]
            base = int(part[0])
            f.seek(base)
            data = f.read(ends[int(part[-1])] - base)
            for payload in records(data, part - np.uint64(base)):
                doc_id, flags = HEAD.unpack_from(payload)
                yield None if flags & 1 else doc_id, np.frombuffer(payload, f"<u{width}", offset=HEAD.size).astype(np.uint32)


#: The bytes that stand for themselves in a byte-level vocabulary; the others follow from U+0100 on.
PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
LETTERS = {b: b for b in PLAIN} | {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(PLAIN)))}
SPACE_LETTER = chr(LETTERS[32])


class LibraryEncoder(TextEncoder):
    """A TextEncoder but for texts that hold any of the added tokens: those go to whole()."""

    def __init__(self, pattern: str, piece_ids, added: list[str], whole):
        super().__init__(pattern, piece_ids, KEPT)
        self.added, self.whole = added, whole

    def encode(self, text: str) -> bytes:
        for token in self.added:
            if token in text:
                return np.array(self.whole(text), "<u4").tobytes()
        return super().encode(text)


@lru_cache(maxsize=2)
def library_encoder(path: str, pattern: str) -> tuple[LibraryEncoder, int]:
    """Encodes by the tokenizers library's model, each word of the text once: the library too cuts at the pattern and maps bytes to letters, so a text's ids are those of its pieces in turn.

    Texts that hold an added token (as <|endoftext|>) go through the library whole, which gives it its own id.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    tokens = t.model.tokenize
    packed = [struct.Struct(f"<{n}I").pack for n in range(32)]

    def ids(piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():  # of these only the space has another letter
            found = tokens(piece.replace(" ", SPACE_LETTER))
        else:
            found = tokens(piece.encode().decode("latin-1").translate(LETTERS))
        return packed[len(found)](*[x.id for x in found]) if len(found) < len(packed) else np.array([x.id for x in found], "<u4").tobytes()

    added = [a.content for a in t.get_added_tokens_decoder().values()]
    return LibraryEncoder(pattern, ids, added, lambda text: t.encode(text, add_special_tokens=False).ids), t.get_vocab_size()


def write_records(docs: DataFrame, folder: str, path: str, pattern: str, end_id: int, n_shards: int) -> DataFrame:
    """Writes docs' ids, end_id after each, into shards of ascending doc_id; returns (shard, name, n_docs, n_ids), written."""
    own = docs.select("doc_id", text_of().alias("text"))
    ranged = own.repartitionByRange(n_shards, F.col("doc_id").asc_nulls_last(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encoder, size = library_encoder(path, pattern)
        number = TaskContext.get().partitionId()
        name, shard, n = f"{number:06d}-{uuid.uuid4().hex[:12]}", None, 0
        for b in batches:
            for doc_id, text in zip(b.doc_id.astype(object).where(b.doc_id.notna(), None), b.text, strict=True):
                shard = shard or Shard(folder, name, 2 if max(size, end_id + 1) <= 1 << 16 else 4)
                ids = np.append(np.frombuffer(encoder.encode(text), "<u4"), np.uint32(end_id))
                shard.add(None if doc_id is None else int(doc_id), ids)
                n += 1
        encoder.forget()
        if shard:
            shard.close()
            yield pd.DataFrame({"shard": [number], "name": [name], "n_docs": [n], "n_ids": [shard.ids]})

    manifest = written(ranged.mapInPandas(run, "shard long, name string, n_docs long, n_ids long"), "manifest")
    without_strays(manifest, folder)
    return manifest


def without_strays(manifest: DataFrame, folder: str) -> None:
    """Deletes files of the folder that no row of the manifest (one a shard) names."""
    spark = manifest.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path):
        names = {r.name for r in manifest.select("name").collect()}
        for f in fs.listStatus(path):
            if f.getPath().getName().split(".")[0] not in names:
                fs.delete(f.getPath(), False)


def read_records(manifest: DataFrame, folder: str) -> DataFrame:
    """Per record: doc_id, start (ids of all records before it), n_tokens, ids_crc32; one task a shard or less.

    The shards' first positions are sums over the manifest, which has one row a shard.
    """
    from pyspark.sql import Window

    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    tasks = manifest.withColumn("base", F.coalesce(before, F.lit(0))).repartition(max(1, manifest.count()), "shard")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, base in zip(b.name, b.base, strict=True):
                rows, at = [], int(base)
                for doc_id, ids in read_shard(folder, name):
                    rows.append((doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at += len(ids)
                    if len(rows) >= 10_000:
                        yield _frame(rows)
                        rows = []
                if rows:
                    yield _frame(rows)

    return tasks.mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
    return out.assign(doc_id=pd.array([r[0] for r in rows], "Int64"))


#: Bytes of Parquet that make up a shard, about: each task meets its words anew, so small shards cost more.
SHARD_BYTES = 16 << 20


def shards_for(docs: DataFrame) -> int:
    """By the size that Spark knows of the input; at least one."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(1, min(size // SHARD_BYTES, 100_000))


def token_records(docs: DataFrame, path: str, pattern: str, end_id: int = 0, folder: str | None = None) -> DataFrame:
    """Writes docs as records to folder (new, in the shared folder by default) and reads the rows of read_records() back.

    Null texts count as empty: their record has the end id only. Documents are in ascending doc_id order, null last;
    rows that repeat a doc_id follow each other by the hash of their text. Empty docs give no files and no rows;
    further columns are ignored.
    """
    folder = folder or shared_dir(docs.sparkSession, "records")
    return read_records(write_records(docs, folder, path, pattern, end_id, shards_for(docs)), folder)
