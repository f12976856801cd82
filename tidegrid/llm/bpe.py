"""Byte-level BPE: exact encoding by backtracking over longest matches, and decoding.

The bytes of a piece are read as Latin-1 characters, so that one Aho-Corasick automaton over the vocabulary finds all
tokens in it in one pass; that gives the longest token at each place. The encoder takes the longest token, accepts it
if it can follow the token before it, else tries its next shorter prefix token, and steps back where none is left; a
place that has failed once is never tried again, so the work is linear in the piece. Two tokens can be neighbours
exactly if merging the bytes of both by rank gives the two tokens back; that answer is memoised for each pair. A
sequence in which all neighbours agree is what the merges produce, so the ids are those of the rank merges.

Pieces repeat, so their ids are kept in bounded tables of the worker process. Texts are cut at single spaces and line
ends first, where the split pattern always cuts too, and only new words are matched against the pattern.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workers import let_go
from .common import text_of

#: Words of at most LONGEST characters whose ids a task keeps after a space (of line starts and pieces a third), and pairs of neighbours; beyond
#: that it starts anew. A word takes about 200 bytes, a pair 150.
KEPT, LONGEST, PAIRS = 400_000, 64, 200_000

#: What a text must not hold to be cut so: white space other than the space and the line end, and any two of these in a row.
UNEVEN = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"] + ["  ", " \n", "\n ", "\n\n"]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


class BytePairEncoder:
    """Encodes the bytes of one piece. ranks: bytes of a token -> id, lower ids merge first, all 256 bytes present."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for t, i in ranks.items():
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        #: The next shorter token that begins this one.
        self.shorter: dict[int, int | None] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.rights: dict[int, list | None] = {}
        self.lefts: dict[int, list | None] = {}
        self.lengths = [len(self.tokens.get(i, b"")) for i in range(max(self.tokens) + 1)]

    def merges(self, data: bytes, until: int = 1) -> list[bytes]:
        """Merges the lowest rank again and again, at its first place, until so many parts are left or none can merge."""
        parts = [data[i : i + 1] for i in range(len(data))]
        get = self.ranks.get
        while len(parts) > until:
            found = [(r, i) for i in range(len(parts) - 1) if (r := get(parts[i] + parts[i + 1])) is not None]
            if not found:
                break
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def edge(self, token: int, right: bool) -> list[tuple[bytes, float]] | None:
        """The parts that lie at the token's right (or left) edge while it is merged, each with the rank that takes it up.

        None if merging the token's own bytes doesn't give it: such a token never stands in a result.
        """
        data, up, out = self.tokens[token], float("inf"), []
        if self.merges(data) != [data]:
            return None
        while True:
            out.append((data, up))
            if len(data) == 1:
                return out
            up = self.ranks[data]
            data = self.merges(data, 2)[right]

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of both leaves a and b: no part at a's right edge merges with one at b's left edge while both are there.

        Of equal ranks the first place merges first, so inside a before across, and across before inside b.
        """
        if a not in self.rights:
            self.rights[a] = self.edge(a, True)
        if b not in self.lefts:
            self.lefts[b] = self.edge(b, False)
        x, y, get = self.rights[a], self.lefts[b], self.ranks.get
        fits = x is not None and y is not None and not any((r := get(p + q)) is not None and r < up and r <= vp for p, up in x for q, vp in y)
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        self.pairs[a, b] = fits
        return fits

    def prefix(self, token: int) -> int | None:
        data, get = self.tokens[token], self.ranks.get
        self.shorter[token] = found = next((i for n in range(len(data) - 1, 0, -1) if (i := get(data[:n])) is not None), None)
        return found

    def encode(self, piece: bytes) -> list[int]:
        if (i := self.ranks.get(piece)) is not None:
            return [i]
        n = len(piece)
        longest: list = [None] * n
        # Matches come by their end; of those that start at one place the later one is the longer one.
        lengths = self.lengths
        for end, i in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - lengths[i]] = i
        tokens: list[int] = []
        starts: list[int] = []
        dead, at, last, token = set(), 0, -1, longest[0]
        pairs, shorter = self.pairs, self.shorter
        while True:
            end = at + lengths[token]
            if end not in dead:
                if last < 0:
                    fits = True
                elif (fits := pairs.get((last, token))) is None:
                    fits = self.compatible(last, token)
                if fits:
                    tokens.append(token)
                    if end == n:
                        return tokens
                    starts.append(at)
                    at, last, token = end, token, longest[end]
                    continue
            token = shorter[token] if token in shorter else self.prefix(token)
            while token is None:
                dead.add(at)
                at, token = starts.pop(), tokens.pop()
                last = tokens[-1] if tokens else -1
                token = shorter[token] if token in shorter else self.prefix(token)


class _Words(dict):
    """A word -> its ids as little-endian unsigned 32-bit integers; new ones are made on demand, all with the same lead before them."""

    def __init__(self, make, lead: str, most: int):
        self.make, self.lead, self.most = make, lead, most

    def __missing__(self, word: str) -> bytes:
        ids = self.make(self.lead + word)
        if len(word) <= LONGEST:
            if len(self) >= self.most:
                self.clear()
            self[word] = ids
        return ids


class TextEncoder:
    """Encodes whole texts: each match of the pattern separately. piece_ids: a piece -> its ids as packed bytes."""

    def __init__(self, pattern: str, piece_ids, kept: int = KEPT):
        self.find = regex.compile(pattern).findall
        self.pieces: dict[str, bytes] = {}
        self.piece_ids, self.kept = piece_ids, kept
        self.first, self.spaced = _Words(self.split, "", kept // 3), _Words(self.split, " ", kept)
        self.line = piece_ids("\n")

    def forget(self) -> None:
        """Empties the tables: a worker that waits for its next task, beside others, is to hold little."""
        for kept in (self.first, self.spaced, self.pieces):
            kept.clear()

    def split(self, text: str) -> bytes:
        word = text.lstrip(" ") if text[:1] == " " and text[1:2] != " " else text
        if word.isalpha() and len(text) <= LONGEST and (word.isascii() or max(word) < "\u0250"):  # letters after at most one space are one piece
            return self.piece_ids(text)
        found = self.find(text)
        if len(found) == 1 and len(text) <= LONGEST:  # a word, which the caller keeps
            return self.piece_ids(text)
        get, out = self.pieces.get, []
        for p in found:
            ids = get(p)
            if ids is None:
                ids = self.piece_ids(p)
                if len(p) <= LONGEST:
                    if len(self.pieces) >= self.kept // 3:
                        self.pieces.clear()
                    self.pieces[p] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        # Where each white space character stands alone between words and is a space or a line end, the pattern cuts before each one.
        if not text or text[0].isspace() or text[-1].isspace() or any(map(text.__contains__, UNEVEN)):
            return self.split(text) if len(text) < 10_000 else self.by_lines(text)
        out, spaced = [], self.spaced.__getitem__
        for line in text.split("\n"):
            head, *rest = line.split(" ")
            out.append(self.first[head])
            out.extend(map(spaced, rest))
            out.append(self.line)
        return b"".join(out[:-1])

    def by_lines(self, text: str) -> bytes:
        """Long texts with runs of white space: cut at line ends that have none beside them, where the pattern cuts as well."""
        parts = regex.split(r"(?<=\S)\n(?=\S)", text)
        return self.line.join(map(self.encode if len(parts) > 1 else self.split, parts))


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> tuple[TextEncoder, list[bytes]]:
    """One for each task and vocabulary: forget() drops them."""
    bpe = BytePairEncoder(read_ranks(path))
    tokens = [bpe.tokens.get(i, b"") for i in range(max(bpe.tokens) + 1)]
    return TextEncoder(pattern, lambda p: np.array(bpe.encode(p.encode()), "<u4").tobytes()), tokens


def forget() -> None:
    """At the end of a task: the encoders go with all their tables, as the worker process waits beside others. They are made anew in 0.2 s."""
    encoder.cache_clear()
    let_go()


def decoded(ids: bytes, tokens: list[bytes]) -> bytes:
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs' (doc_id, ids array<int>) for the whole text (null: empty, no ids). Repeated rows give repeated rows."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        text_encoder = encoder(path, pattern)[0]
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "ids": [np.frombuffer(text_encoder.encode(t), "<i4") for t in b.text]})
        del text_encoder
        forget()

    return docs.select("doc_id", text_of().alias("text")).mapInPandas(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, data binary) of (doc_id, ids array<int>); null ids give empty data."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = encoder(path, pattern)[1]
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "data": [b"" if i is None else decoded(np.asarray(i, "<u4").tobytes(), tokens) for i in b.ids]})
        del tokens
        forget()

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, data binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256. Encodes the whole text and decodes the ids.

    Null or empty texts have no tokens and the digests of nothing; repeated rows give repeated rows; empty docs give
    none; further columns of docs are ignored.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        text_encoder, tokens = encoder(path, pattern)
        sha = hashlib.sha256
        for b in batches:
            rows = []
            for t in b.text:
                ids = text_encoder.encode(t)
                rows.append((len(ids) // 4, sha(ids).hexdigest(), sha(decoded(ids, tokens)).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", b.doc_id.array)
            yield out
        del text_encoder, tokens
        forget()

    return docs.select("doc_id", text_of().alias("text")).mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
