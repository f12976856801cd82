"""Token counts by a library's tokenizer; huge texts are encoded in overlapping chunks and spliced.

A text longer than a chunk is cut into chunks that overlap, each a row of its own, so that tasks share it. Every chunk
is encoded by the library with offsets. Two neighbours are spliced at a place inside their overlap where both have a
token end and the text turns from a character that is no white space to a space: for the tokenizers that proven()
knows no token, special token or piece of the split pattern ever crosses such a place, whatever stands around it, and
merges stay within pieces, so the tokens on both sides of it are those of the whole text. The count of a text is the
last chunk's tokens, plus, over all splices, the left chunk's tokens before the place minus the right chunk's.
Where an overlap has no such place the text is cut anew with larger chunks and overlaps, in the end into one.

The same places part a text's words, so that most words need not go through the library: their counts are kept during
a task. Of byte-level BPE files, as byte_bpe_50k.json, the pieces of a word that is new are counted by the library's
model, each once (PieceCounts); chunks are counted so too. Other known tokenizers take new words whole (WordCounts).
"""

from __future__ import annotations

import json
import os
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workers import let_go
from .bpe import UNEVEN
from .common import text_of, written
from .records import LETTERS, SPACE_LETTER

#: Code points of a chunk and of what it shares with the next one, at first.
CHUNK, OVERLAP = 16_384, 256
#: Words whose counts a worker keeps during a task (of pieces that no space leads a third), and their length. A word takes about 150 bytes.
KEPT, LONGEST = 600_000, 64
TURN = regex.compile(r"(?<=[^\s\x1c-\x1f]) ")
#: White space before a space, which may be one piece of the split.
RUNS = [c + " " for c in map(chr, range(0x3001)) if c.isspace()]

#: The split patterns of the known tokenizers; none matches across a turn from a character that is no white space to a space.
SPLITS = (r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",)
#: How the library's byte-level split cuts. Only asked about characters below U+0250, whose classes no version of Unicode changes.
LEVEL = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def _normalizer_stays(n: dict | None) -> bool:
    """Whether normalizing leaves a turn to a space where it is: characters are not composed with a space."""
    if n is None or n["type"] in ("NFC", "Lowercase"):
        return True
    if n["type"] == "Sequence":
        return all(map(_normalizer_stays, n["normalizers"]))
    return n["type"] == "Replace" and n["pattern"] == {"Regex": "\\s+"} and n["content"] == " "


def _splitter_cuts(p: dict | None) -> bool:
    if p is None:
        return False
    if p["type"] == "Sequence":
        return any(map(_splitter_cuts, p["pretokenizers"]))
    return p["type"] in ("Whitespace", "WhitespaceSplit") or p["type"] == "ByteLevel" and p["use_regex"] or p["type"] == "Split" and p["pattern"].get("Regex") in SPLITS


class JsonTokens:
    """A tokenizers file: counts of texts, ends of tokens in code points, and whether turns to a space are proven places."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        whole = all(not (a["lstrip"] or a["rstrip"] or regex.search(r"\s", a["content"])) for a in j["added_tokens"])
        self.proven = j["model"]["type"] in ("BPE", "WordPiece", "WordLevel") and whole and _normalizer_stays(j["normalizer"]) and _splitter_cuts(j["pre_tokenizer"])
        p, self.added = j["pre_tokenizer"], [a["content"] for a in j["added_tokens"]]
        #: Whether a text's tokens are those of its pieces by LEVEL, each by the model alone.
        self.level = self.proven and j["model"]["type"] == "BPE" and j["normalizer"] is None and p["type"] == "ByteLevel" and p["use_regex"] and not p["add_prefix_space"] and not j["model"].get("dropout")
        self.tokenize, self.split = self.tokenizer.model.tokenize, self.tokenizer.pre_tokenizer and self.tokenizer.pre_tokenizer.pre_tokenize_str

    def counts(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def ends(self, text: str) -> np.ndarray:
        return np.array([end for _, end in self.tokenizer.encode(text, add_special_tokens=False).offsets], np.int64)


class PieceTokens:
    """A sentencepiece file. Merges of a BPE model never cross a turn to a space if no piece holds one, and if texts are not normalized."""

    level = False

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = map(self.model.id_to_piece, range(self.model.get_piece_size()))
        # The turn has to survive normalizing, and of a BPE model the scores are falling ranks.
        same = self.model.normalize("a  b ﬁ́ \n") == "▁a▁▁b▁ﬁ́▁\n"
        ranks = [self.model.get_score(i) for i in range(self.model.get_piece_size()) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i))]
        self.proven = same and all(float(s).is_integer() for s in ranks) and not any("▁" in p.lstrip("▁") for p in pieces)

    def counts(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.model.encode(texts, num_threads=1)]

    def ends(self, text: str) -> np.ndarray:
        data = np.frombuffer(text.encode(), np.uint8)
        letters = np.flatnonzero((data & 0xC0) != 0x80)  # the library counts bytes
        return np.searchsorted(letters, [p.end for p in self.model.encode(text, return_type="proto").pieces])


class WordCounts:
    """Counts of whole texts, each word's once during a task: the turns from a word to a single space are proven places, so a text's count is the sum of those of its words.

    Each word but the first is counted with the space before it, which the sentencepiece library adds to a text by
    itself. Texts with white space before a space, or a space at an end, are counted whole.
    """

    def __init__(self, tokens: JsonTokens | PieceTokens):
        self.tokens, self.lead = tokens, " " if isinstance(tokens, JsonTokens) else ""
        self.kept: dict[str, int] = {}

    def counts(self, texts: list[str]) -> list[int]:
        cut = [None if t[:1] == " " or t[-1:] == " " or not t or any(map(t.__contains__, RUNS)) else t.split(" ") for t in texts]
        words = set()
        for own in cut:
            if own:
                words.update(own[1:])
        new = list(words.difference(self.kept))
        if len(self.kept) + len(new) > KEPT:
            self.kept.clear()
            new = list(words)
        found = dict(zip(new, self.tokens.counts([self.lead + w for w in new]), strict=True))
        table = self.kept
        if any(len(w) > LONGEST for w in new):
            table = self.kept | found
            found = {w: n for w, n in found.items() if len(w) <= LONGEST}
        self.kept.update(found)
        rest = iter(self.tokens.counts([t if own is None else own[0] for t, own in zip(texts, cut, strict=True)]))
        return [next(rest) + (sum(map(table.__getitem__, own[1:])) if own else 0) for own in cut]


class _Kept(dict):
    """A word -> its tokens; new ones are counted on demand, all with the same lead before them."""

    def __init__(self, count: Callable[[str], int], lead: str, most: int):
        self.count, self.lead, self.most = count, lead, most

    def __missing__(self, word: str) -> int:
        n = self.count(self.lead + word)
        if len(word) <= LONGEST:
            if len(self) >= self.most:
                self.clear()
            self[word] = n
        return n


class PieceCounts:
    """Counts of whole texts by a byte-level BPE file: the sum over their words, of which new ones are the sum over their pieces.

    Words are what lies between turns to a space. Where single spaces and line ends stand between words, the split cuts
    before and after each line end too. A piece, counted by the library's model, is kept beside the words.
    """

    def __init__(self, tokens: JsonTokens):
        self.tokens = tokens
        self.spaced, self.first = _Kept(self.word, " ", KEPT), _Kept(self.word, "", KEPT // 3)

    def word(self, text: str) -> int:
        """text's tokens: by the model if it is one piece, else by its pieces, or by the library whole where it holds an added token."""
        for token in self.tokens.added:
            if token in text:
                return self.tokens.counts([text])[0]
        bare = text[1:] if text[:1] == " " else text
        low = bare.isascii() or max(bare) < "\u0250"
        if low and bare.isalpha():
            return self.piece(text)
        found = LEVEL.findall(text) if low else [text[i:j] for _, (i, j) in self.tokens.split(text)]
        if len(found) == 1:
            return self.piece(text)
        return sum([self.spaced[p[1:]] if p[0] == " " else self.first[p] for p in found])

    def piece(self, text: str) -> int:
        if text.isascii() and text.isprintable():  # of these only the space has another letter
            return len(self.tokens.tokenize(text.replace(" ", SPACE_LETTER)))
        return len(self.tokens.tokenize(text.encode().decode("latin-1").translate(LETTERS)))

    def count(self, text: str, spaced: bool = False) -> int:
        """Tokens of text, or if spaced of a space and text."""
        first = self.spaced if spaced else self.first
        if not text or text[0].isspace() or text[-1].isspace() or any(map(text.__contains__, UNEVEN)):
            head, *rest = TURN.split(text)
            return first[head] + sum(map(self.spaced.__getitem__, rest)) if text or spaced else 0
        lines, n = text.split("\n"), 0
        for line in lines:
            head, *rest = line.split(" ")
            n += first[head] + sum(map(self.spaced.__getitem__, rest))
            first = self.first
        return n + (len(lines) - 1) * self.first["\n"]

    def counts(self, texts: list[str]) -> list[int]:
        return list(map(self.count, texts))

    def before(self, text: str, spans: list[tuple[int, int]]) -> tuple[list[tuple[list[int], list[int]]], int]:
        """For each of the spans [first, until): (turns to a space in it counted from first, tokens before each); and the tokens of text."""
        turns = sorted({m.start() for span in spans for m in TURN.finditer(text, *span)})
        sums, at, n = [], 0, 0
        for turn in turns:
            n += self.count(text[at + (at > 0) : turn], at > 0)
            sums.append(n)
            at = turn
        inside = [range(bisect_left(turns, first), bisect_left(turns, until)) for first, until in spans]
        return [([turns[i] - first for i in own], [sums[i] for i in own]) for own, (first, _) in zip(inside, spans, strict=True)], n + self.count(text[at + (at > 0) :], at > 0)


class Ends:
    """What PieceCounts.before gives, by the ends of all tokens of the text."""

    def __init__(self, tokens: JsonTokens | PieceTokens):
        self.tokens = tokens

    def before(self, text: str, spans: list[tuple[int, int]]) -> tuple[list[tuple[list[int], list[int]]], int]:
        ends = self.tokens.ends(text)
        return [_places(ends, text, *span) for span in spans], len(ends)


def counter_of(tokens: JsonTokens | PieceTokens) -> JsonTokens | PieceTokens | PieceCounts | WordCounts:
    if not tokens.proven:
        return tokens
    return PieceCounts(tokens) if tokens.level else WordCounts(tokens)


@lru_cache(maxsize=2)
def tokens_of(path: str) -> JsonTokens | PieceTokens:
    return JsonTokens(path) if path.endswith(".json") else PieceTokens(path)


def forget() -> None:
    """At the end of a task: the library's table of words goes with the tokenizer."""
    tokens_of.cache_clear()
    let_go()


def _places(ends: np.ndarray, text: str, first: int, until: int) -> tuple[list[int], list[int]]:
    """(places in [first, until) counted from first, tokens before each) of the turns to a space at which a token ends."""
    turns = np.array([m.start() for m in TURN.finditer(text, first, until)], np.int64)
    before = np.searchsorted(ends, turns, "right")
    good = (before > 0) & (ends[np.maximum(before, 1) - 1] == turns) if len(ends) else np.zeros(len(turns), bool)
    return (turns[good] - first).tolist(), before[good].tolist()


CHUNKS = "digest string, k long, last boolean, text string"
JOINTS = "digest string, joint long, side int, places array<int>, before array<long>, n long"


def chunked(texts: DataFrame, size: int, overlap: int) -> DataFrame:
    """Chunks of (digest, text): chunk k is [k size, (k + 1) size + overlap); the last one reaches the end."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for digest, text in zip(b.digest, b.text, strict=True):
                n = max(1, -(-(len(text) - overlap) // size))
                for k in range(0, n, 64):
                    ks = range(k, min(k + 64, n))
                    yield pd.DataFrame({"digest": digest, "k": ks, "last": [i == n - 1 for i in ks], "text": [text[i * size : (i + 1) * size + overlap] if i < n - 1 else text[i * size :] for i in ks]})

    return texts.mapInPandas(run, CHUNKS)


def joints(chunks: DataFrame, path: str, size: int, overlap: int) -> DataFrame:
    """What each chunk knows of the joints at both its ends: the places there and its tokens before them; the last one its tokens."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = tokens_of(path)
        counter = PieceCounts(tokens) if tokens.level else Ends(tokens)
        for b in batches:
            rows = []
            for digest, k, last, text in zip(b.digest, b.k, b["last"], b.text, strict=True):
                spans = ([(0, overlap)] if k > 0 else []) + ([] if last else [(size, size + overlap)])
                found, n = counter.before(text, spans)
                if k > 0:
                    rows.append((digest, k - 1, 1, *found[0], 0))
                rows.append((digest, -1, 2, [], [], n) if last else (digest, k, 0, *found[-1], 0))
            yield pd.DataFrame(rows, columns=["digest", "joint", "side", "places", "before", "n"])
        del tokens, counter
        forget()

    return chunks.mapInPandas(run, JOINTS)


def spliced(joints: DataFrame) -> DataFrame:
    """(digest, n_tokens, failed): sums over the joints; failed where one has no common place. Texts that come several times count once."""
    side = lambda k: F.max(F.when(F.col("side") == k, F.struct("places", "before")))
    by_joint = joints.groupBy("digest", "joint").agg(side(0).alias("l"), side(1).alias("r"), F.max("n").alias("n"))
    place = F.get(F.array_intersect("l.places", "r.places"), F.lit(0))
    at = lambda c: F.element_at(F.col(f"{c}.before"), F.array_position(F.col(f"{c}.places"), F.col("place")).cast("int"))
    inner = F.col("joint") >= 0
    parts = by_joint.withColumn("place", place).withColumn("part", F.when(~inner, F.col("n")).when(F.col("place").isNotNull(), at("l") - at("r")))
    return parts.groupBy("digest").agg(F.sum("part").alias("n_tokens"), F.max(inner & F.col("place").isNull()).alias("failed"))


def huge_counts(texts: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(digest, n_tokens) of (digest, text), in rounds: texts with a joint that failed come again with chunks four times and overlaps eight times as long."""
    if not tokens_of(path).proven:
        raise ValueError(f"{path}: no place where chunks could be spliced is proven for this tokenizer")
    done, todo = [], texts
    while True:
        pieces = chunked(todo, chunk, overlap).repartition("digest", "k")
        result = written(spliced(joints(pieces, path, chunk, overlap)), "counts")
        done.append(result.where("not failed").select("digest", "n_tokens"))
        failed = result.where("failed").select(F.col("digest").alias("failed_digest"))
        if failed.isEmpty():
            return reduce(DataFrame.unionByName, done)
        todo = texts.join(failed, texts["digest"] == F.col("failed_digest"), "left_semi")
        chunk, overlap = chunk * 4, min(overlap * 8, chunk * 2)


def token_counts(docs: DataFrame, path: str, limit: int = 1024, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Per row of docs: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than limit), as the library for path gives them.

    No begin, end or other added tokens; special strings inside texts as the library takes them by default (the
    tokenizers library gives <|endoftext|> its own id). Null or empty texts have 0 of both. Repeated rows give
    repeated rows, also with a null doc_id; further columns are ignored; empty docs give no rows. Texts of up to chunk
    code points are counted by their words (see PieceCounts and WordCounts); where no splice is proven for a tokenizer (see proven),
    every text is encoded whole.
    """
    rows = docs.select("doc_id", text_of().alias("text"))
    proven = tokens_of(path).proven
    small = rows.where(F.length("text") <= chunk) if proven else rows

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = tokens_of(path)
        counter = counter_of(tokens)
        for b in batches:
            texts = b.text.tolist()
            n = [c for k in range(0, len(texts), 256) for c in counter.counts(texts[k : k + 256])]
            yield pd.DataFrame({"doc_id": b.doc_id, "n_bytes": b.n_bytes, "n_tokens": n})
        del tokens, counter
        forget()

    out = small.withColumn("n_bytes", F.octet_length("text").cast("long")).mapInPandas(run, "doc_id long, n_bytes long, n_tokens long")
    if proven:
        long_ = rows.where(F.length("text") > chunk).withColumn("digest", F.sha2("text", 256))
        counts = huge_counts(long_.select("digest", "text"), path, chunk, overlap)
        sizes = long_.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest")
        out = out.unionByName(sizes.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
