"""Toxicity by a classifier chain: categories in order, each a linear model that also sees the earlier ones' probabilities.

Features of a text are its distinct words and their prefixes (those that go with a category beyond chance, by the
likelihood ratio), and five figures of its make-up. The chain learns a later category from out-of-fold predictions of
the earlier ones, so that in training they are as good as on new texts; in use the models of all folds' rows predict.

It is fitted on a sample of at most max_labelled labelled rows (and max_bytes of their features), taken by a hash of the
id, with at most MOST_FEATURES word features a model, each of them beyond chance by RATIO; every document is scored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..workers import let_go
from .common import text_of

PREFIXES = (3, 4, 5)
MAX_LABELLED, MAX_BYTES = 5_000, 64 << 20
#: Twice the log likelihood ratio that a feature needs: chance exceeds it about once in 300,000.
RATIO = 22.0
MOST_FEATURES = 256
FOLDS = 5
#: Words of at most LONGEST characters whose features a worker keeps: 20 MB, about.
KEPT, LONGEST = 150_000, 64
_words = re.compile(r"\w+").findall


def keys(word: str) -> list[int]:
    """The word and its prefixes as 32-bit hashes."""
    return [xxhash.xxh32_intdigest("=" + word), *(xxhash.xxh32_intdigest(word[:n]) for n in PREFIXES if len(word) >= n)]


def make_up(text: str, words: list[str], distinct: set[str]) -> tuple[float, ...]:
    n, length = max(1, len(words)), max(1, len(text))
    letters = sum(map(len, words))
    lines = text.split("\n")
    return (np.log1p(len(words)), letters / n, letters / length, len(distinct) / n, len(set(lines)) / len(lines))


@dataclass
class Linear:
    """A logistic model over chosen word features, figures and earlier probabilities, in this order."""

    words: np.ndarray
    weights: np.ndarray
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))

    def predict(self, present: np.ndarray, dense: np.ndarray) -> np.ndarray:
        z = self.weights[0] + present @ self.weights[1 : 1 + present.shape[1]] + ((dense - self.mean) / self.scale) @ self.weights[1 + present.shape[1] :]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def associated(docs: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Features that go with y beyond chance, the strongest first."""
    flat, owner = np.concatenate(docs), np.repeat(y, [len(d) for d in docs])
    features, inverse = np.unique(flat, return_inverse=True)
    df = np.bincount(inverse, minlength=len(features)).astype(float)
    pos = np.bincount(inverse, weights=owner, minlength=len(features))
    n, n1 = len(y), y.sum()

    def part(observed, expected):
        return np.where(observed > 0, observed * np.log(np.maximum(observed, 1e-12) / np.maximum(expected, 1e-12)), 0)

    ratio = 2 * (part(pos, df * n1 / n) + part(df - pos, df * (n - n1) / n) + part(n1 - pos, (n - df) * n1 / n) + part(n - n1 - df + pos, (n - df) * (n - n1) / n))
    order = np.argsort(-ratio, kind="stable")
    return features[order[ratio[order] >= RATIO][:MOST_FEATURES]]


def incidence(docs: list[np.ndarray], features: np.ndarray) -> np.ndarray:
    order = np.argsort(features)
    out = np.zeros((len(docs), len(features)))
    for i, d in enumerate(docs):
        if len(features):
            at = np.searchsorted(features, d, sorter=order)
            hit = order[np.minimum(at, len(features) - 1)]
            out[i, hit[features[hit] == d]] = 1
    return out


def fit_linear(docs: list[np.ndarray], dense: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> Linear:
    """Logistic regression by Newton steps with a ridge; with one class only, its smoothed share."""
    if y.min() == y.max():
        share = (y.sum() + 0.1) / (len(y) + 0.2)
        return Linear(np.empty(0, np.uint32), np.concatenate(([np.log(share / (1 - share))], np.zeros(dense.shape[1]))), dense.mean(0), np.ones(dense.shape[1]))
    words = associated(docs, y)
    mean, scale = dense.mean(0), dense.std(0) + 1e-9
    x = np.hstack([np.ones((len(y), 1)), incidence(docs, words), (dense - mean) / scale])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return Linear(words, w, mean, scale)


def fit_chain(docs: list[np.ndarray], dense: np.ndarray, labels: np.ndarray, fold: np.ndarray) -> list[Linear]:
    """One model a column of labels; a later one sees the out-of-fold probabilities of the ones before."""
    chain: list[Linear] = []
    for k in range(labels.shape[1]):
        y = labels[:, k].astype(float)
        if k + 1 < labels.shape[1]:
            out = np.zeros(len(y))
            for f in range(FOLDS):
                test = fold == f
                if test.any() and not test.all():
                    m = fit_linear([d for d, t in zip(docs, test, strict=True) if not t], dense[~test], y[~test])
                    rows = [d for d, t in zip(docs, test, strict=True) if t]
                    out[test] = m.predict(incidence(rows, m.words), dense[test])
        chain.append(fit_linear(docs, dense, y))
        if k + 1 < labels.shape[1]:
            dense = np.hstack([dense, out[:, None]])
    return chain


def features_of(docs: DataFrame) -> DataFrame:
    """(doc_id, keys binary (unsigned 32-bit integers), dense array<double>) of each row."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t in b.text:
                words = _words(t.lower())
                distinct = set(words)
                rows.append((np.array(sorted({k for w in distinct for k in keys(w)}), np.uint32).tobytes(), np.array(make_up(t, words, distinct))))
            out = pd.DataFrame({"keys": [r[0] for r in rows], "dense": [r[1] for r in rows]})
            out.insert(0, "doc_id", b.doc_id.array)
            yield out

    return docs.select("doc_id", text_of().alias("text")).mapInPandas(run, "doc_id long, keys binary, dense array<double>")


def fit(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...], max_labelled: int = MAX_LABELLED, max_bytes: int = MAX_BYTES) -> list[Linear] | None:
    """The chain for 0/1 columns of labels (doc_id, *categories). None without usable labels.

    Rows with a null are left out; of several rows for a document the largest value of each category counts. The
    sample is at most max_labelled documents, and of those in the order of their hash as many as have word features
    of max_bytes together, which bounds what reaches the driver.
    """
    usable = labels.dropna(subset=["doc_id", *categories]).groupBy("doc_id").agg(*[F.max(c).alias(c) for c in categories])
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample.select(F.col("doc_id").alias("own_id"))), F.col("doc_id") == F.col("own_id"), "left_semi")
    found = features_of(texts).dropDuplicates(["doc_id"]).join(F.broadcast(sample), "doc_id")
    upto = F.sum(F.length("keys")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # over max_labelled rows at most
    rows = found.withColumn("upto", upto).where(F.col("upto") <= max_bytes).drop("upto").toPandas()
    if not len(rows):
        return None
    rows = rows.sort_values("doc_id", ignore_index=True)
    fold = np.array([xxhash.xxh32_intdigest(str(i)) % FOLDS for i in rows.doc_id])
    return fit_chain([np.frombuffer(k, np.uint32) for k in rows["keys"]], np.stack(rows.dense.to_numpy()), rows[list(categories)].to_numpy(), fold)


class _Hits(dict):
    """A word -> the places of its chosen features; most have none."""

    def __init__(self, places: dict[int, list[int]]):
        self.places = places

    def __missing__(self, word: str) -> tuple[int, ...]:
        hit = tuple(p for k in keys(word) for p in self.places.get(k, ()))
        if len(word) <= LONGEST:
            if len(self) >= KEPT:
                self.clear()
            self[word] = hit
        return hit


class Scorer:
    """Probabilities of whole texts, one column a category of the chain."""

    def __init__(self, chain: list[Linear]):
        self.chain, self.spans, self.n = chain, [], 0
        places: dict[int, list[int]] = {}
        for m in chain:
            for i, k in enumerate(m.words.tolist()):
                places.setdefault(k, []).append(self.n + i)
            self.spans.append(slice(self.n, self.n + len(m.words)))
            self.n += len(m.words)
        self.hits = _Hits(places)

    def __call__(self, texts: pd.Series) -> np.ndarray:
        present, dense = np.zeros((len(texts), self.n)), np.zeros((len(texts), 5))
        for i, t in enumerate(texts):
            words = _words(t.lower())
            distinct = set(words)
            for at in filter(None, map(self.hits.__getitem__, distinct)):
                present[i, at] = 1
            dense[i] = make_up(t, words, distinct)
        out = np.zeros((len(texts), len(self.chain)))
        for k, (m, span) in enumerate(zip(self.chain, self.spans, strict=True)):
            out[:, k] = m.predict(present[:, span], dense)
            dense = np.hstack([dense, out[:, k : k + 1]])
        return out


def score(docs: DataFrame, chain: list[Linear] | None, categories: tuple[str, ...]) -> DataFrame:
    """docs with p_<category> for each, from the whole text (a column of that name is replaced); 0 without a chain."""
    if chain is None:
        return docs.withColumns({f"p_{c}": F.lit(0.0) for c in categories})

    @F.pandas_udf("array<double>")
    def probabilities(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(chain)
        for texts in parts:
            yield pd.Series(list(scorer(texts)))
        scorer.hits.clear()
        let_go()

    scored = docs.withColumn("_p", probabilities(text_of()))
    return scored.withColumns({f"p_{c}": F.col("_p")[k] for k, c in enumerate(categories)}).drop("_p")


CATEGORIES = ("low_quality", "toxic")


def labelled(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per row of docs: doc_id, p_low_quality, p_toxic, toxic (p_toxic >= threshold).

    labels: doc_id, quality, toxic. Null texts count as empty. Without usable labels nothing is toxic. Repeated rows
    give repeated rows; empty docs give none; further columns of either table are ignored. The chain is fitted on a
    bounded sample of the labels, as fit() says; a row without doc_id is scored like others.
    """
    chain = fit(docs, labelled(labels), CATEGORIES)
    return score(docs.select("doc_id", "text"), chain, CATEGORIES).drop("text").withColumn("toxic", F.col("p_toxic") >= threshold)


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs without the toxic ones (p_toxic >= threshold), all columns as they are.

    Null or empty texts are scored as texts without words; repeated rows stay or go together; rows without doc_id are
    scored like others. Without usable labels all rows stay; empty docs stay empty. Further columns may have any names.
    """
    chain = fit(docs, labelled(labels), CATEGORIES)
    scored = score(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text"), chain, CATEGORIES)
    return scored.where(F.col("p_toxic") < threshold).select(*[F.col("row")[c].alias(c) for c in docs.columns])
