"""Sets of word shingles as sorted arrays of 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import xxhash

from ..workers import let_go

WORDS = 5
#: Words of at most LONGEST bytes whose hashes a worker keeps: 20 MB, about.
KEPT, LONGEST = 100_000, 64
_P = np.uint64(0x9E3779B97F4A7C15 | 1)


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((salt * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= LONGEST:
            if len(self) >= KEPT:
                self.clear()
            self[word] = h
        return h


_hashes = _Hashes()


def forget() -> None:
    """At the end of a task: its worker process stays, and the next task may be one of another operator."""
    _hashes.clear()
    let_go()


def shingle_sets(texts: Iterable[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(all sets one after the other, each sorted and distinct; where each begins, with the end of the last).

    A-Z are lower-cased and words are cut at [ \\t-\\r] only, which is what bytes.lower() and bytes.split() do. A text
    with fewer words than a shingle has its whole sequence as one; without words its set is empty.
    """
    parts = [t.encode().lower().split() for t in texts]
    counts = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(counts)
    get = _hashes.__getitem__
    h = np.fromiter((x for p in parts for x in map(get, p)), np.uint64, int(ends[-1]) if len(ends) else 0)
    with np.errstate(over="ignore"):
        rolled = h.copy()
        for k in range(1, words):
            rolled = rolled[:-1] * _P + h[k:] if len(rolled) > 1 else rolled[:0]
    rolled = mixed(rolled)
    sets = []
    for n, end in zip(counts.tolist(), ends.tolist(), strict=True):
        if n >= words:
            own = np.sort(rolled[end - n : end - words + 1])
            sets.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        elif n:
            with np.errstate(over="ignore"):
                x = np.uint64(n)
                for y in h[end - n : end]:
                    x = x * _P + y
            sets.append(mixed(np.array([x], np.uint64), 1))
        else:
            sets.append(np.empty(0, np.uint64))
    return np.concatenate(sets) if sets else np.empty(0, np.uint64), np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64)
