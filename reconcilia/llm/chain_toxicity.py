"""Toxicity by a classifier chain.

Categories are predicted one after the other with linear (logistic) models; the model of a category
also gets the probabilities of the categories before it. Those are out-of-fold when later models are
trained: each labelled row's probability comes from a model that has not seen the row. In use, the
chain feeds the probabilities of the final models.

Features of a text are counts over its distinct words (letters and digits, lower-cased; runs of marks count too) of hashed
words and word beginnings; a beginning stands for all words that are made from it. So a text's score
is a sum over its distinct words, whatever its length.

The chain is fitted on at most ``label_rows`` labelled documents, the first by a hash of the id, in one
task; what reaches it is the distinct features of that many texts, as arrays of four bytes each, and the driver gets ``features`` for each category.
A fold's model has seen none of its fold's rows, neither in choosing features nor in fitting weights. Every text of the table is scored whole.

Nulls and empty texts score by the intercepts alone and are never flagged. With fewer than two labels
of a category its probability is the labels' share (0 without labels). Features of equal strength go by their
hash, and of rows with one id in ``labels`` one counts. Repeated rows get equal results; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reconcilia.llm.common import saved

LABEL_ROWS = 6000
FEATURES = 1500
FOLDS = 4
BITS = 22
BEGINNINGS = (4, 5, 6, 7)
TOKEN = re.compile(r"[^\W_]+|[^\w\s]{2,}|\|")
#: Words that a task remembers, and letters of the longest among them.
REMEMBERED, LONGEST = 150_000, 64


def word_features(word: str) -> list[int]:
    """Hashed features of a word: itself and its beginnings."""
    parts = [f"{n}^{word[:n]}" for n in BEGINNINGS if len(word) >= n]
    return [xxhash.xxh3_64_intdigest(p) & (1 << BITS) - 1 for p in [word, *parts]]


def distinct_words(text: str | None) -> set[str]:
    return set(TOKEN.findall((text or "").lower()))


def logistic(x: np.ndarray, y: np.ndarray, decay: float = 1.0, rounds: int = 300) -> np.ndarray:
    """Weights (intercept last) of a ridge-penalised logistic regression, by accelerated gradient steps."""
    x = np.column_stack([x, np.ones(len(x), x.dtype)])
    penalty = np.append(np.full(x.shape[1] - 1, decay), 0)
    top = np.ones(x.shape[1])
    for _ in range(15):  # largest curvature, by powers
        top = x.T @ (x @ (top / np.linalg.norm(top)))
    rate = 1 / (np.linalg.norm(top) / 4 + decay)
    w = ahead = np.zeros(x.shape[1])
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30)))
        new = ahead - rate * (x.T @ (p - y) + penalty * ahead)
        ahead, w = new + k / (k + 3) * (new - w), new
    return w


def chances(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


class Sample:
    """Labelled texts as arrays: the distinct features of each, and how often they occur there."""

    def __init__(self, ids: list[np.ndarray]) -> None:
        owner = np.repeat(np.arange(len(ids)), [len(i) for i in ids])
        cells = np.concatenate([np.zeros(0, np.int64), *ids]).astype(np.int64) | owner << BITS + 1
        cells, self.times = np.unique(cells, return_counts=True)
        self.size, self.owner = len(ids), cells >> BITS + 1
        self.seen, self.at = np.unique(cells & (1 << BITS + 1) - 1, return_inverse=True)

    def chosen(self, y: np.ndarray, known: np.ndarray, features: int) -> np.ndarray:
        """Places of the features that tell most about the labels of the ``known`` rows; the others' labels play no part."""
        mine = known[self.owner]
        at, own, y = self.at[mine], y[self.owner[mine]], y[known]
        yes, no = np.bincount(at, own, len(self.seen)) + 0.5, np.bincount(at, 1 - own, len(self.seen)) + 0.5
        odds = np.log(yes / (y.sum() + 1 - yes)) - np.log(no / ((1 - y).sum() + 1 - no))
        strength = np.where(yes + no >= 5, np.abs(odds) / np.sqrt(1 / yes + 1 / no), 0)
        return np.sort(np.argsort(-strength, kind="stable")[:features])

    def matrix(self, chosen: np.ndarray) -> np.ndarray:
        """Counts of the chosen features, a row for each text."""
        place = np.full(len(self.seen), -1)
        place[chosen] = np.arange(len(chosen))
        hit = place[self.at] >= 0
        out = np.zeros((self.size, len(chosen)))
        out[self.owner[hit], place[self.at[hit]]] = self.times[hit]
        return out


def fitted(sample: Sample, y: np.ndarray, earlier: np.ndarray, known: np.ndarray, features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, weights, chances of all rows) of a category's model that has seen the ``known`` rows only, in choosing features as in fitting them."""
    if len(set(y[known])) < 2:
        share = float(np.clip(y[known].mean() if known.any() else 0, 1e-6, 1 - 1e-6))
        return np.zeros(0, int), np.append(np.zeros(earlier.shape[1]), np.log(share / (1 - share))), np.full(sample.size, share)
    chosen = sample.chosen(y, known, features)
    x = np.column_stack([sample.matrix(chosen), earlier])
    w = logistic(x[known], y[known])
    return chosen, w, chances(x, w)


def fit_chain(fold: np.ndarray, ids: list[np.ndarray], labels: np.ndarray, features: int) -> tuple[list[tuple[int, int, float]], np.ndarray]:
    """(category, feature, weight) rows (feature -1: intercept, -2 - c: probability of category c), and the out-of-fold probabilities of every row and category.

    ``ids``: each row's feature ids with repeats; ``labels``: a column for each category.
    """
    sample, out = Sample(ids), []
    earlier = np.zeros((len(fold), 0))
    for c in range(labels.shape[1]):
        y = labels[:, c].astype(float)
        chosen, w, _ = fitted(sample, y, earlier, np.ones(len(fold), bool), features)
        held_out = np.empty(len(fold))
        for k in set(fold):
            held_out[fold == k] = fitted(sample, y, earlier, fold != k, features)[2][fold == k]
        out += [(c, int(sample.seen[f]), float(v)) for f, v in zip(chosen, w, strict=False)]
        out += [(c, -2 - i, float(v)) for i, v in enumerate(w[len(chosen) : -1])]
        out.append((c, -1, float(w[-1])))
        earlier = np.column_stack([earlier, held_out])
    return out, earlier


def learn(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], label_rows: int = LABEL_ROWS, features: int = FEATURES):
    """The chain as (category, feature, weight) rows. ``categories``: 0/1 expressions over ``labels``, in order."""
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = labels.where("doc_id IS NOT NULL").select("doc_id", F.array(*(c.cast("int") for c in categories.values())).alias("y")).where(~F.exists("y", F.isnull))
    chosen = saved(some.dropDuplicates(["doc_id"]).orderBy(*order).limit(label_rows))
    marked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    number = len(categories)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [[f for w in sorted(distinct_words(t.as_py())) for f in word_features(w)] for t in batch.column(1)]
            folds = [xxhash.xxh3_64_intdigest(str(i)) % FOLDS for i in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(folds, pa.int32()), pa.array(ids, pa.list_(pa.int32())), batch.column(2)], names=["doc_id", "fold", "ids", "y"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if parts:
            rows = pa.Table.from_batches(parts).sort_by("doc_id")
            y = np.array(rows["y"].to_pylist(), int).reshape(len(rows), number)
            found, _ = fit_chain(rows["fold"].to_numpy(), [i.values.to_numpy() for i in rows["ids"]], y, features)
        else:
            found, _ = fit_chain(np.zeros(0, int), [], np.zeros((0, number), int), features)
        yield pa.RecordBatch.from_pydict({"category": [f[0] for f in found], "feature": [f[1] for f in found], "weight": [f[2] for f in found]}, pa.schema([("category", pa.int32()), ("feature", pa.int32()), ("weight", pa.float64())]))

    sample = marked.mapInArrow(featured, "doc_id long, fold int, ids array<int>, y array<int>")
    return sample.repartition(1).mapInArrow(train, "category int, feature int, weight double").toPandas()


class WordScores(dict):
    """Weights of a word for every category, None if it has none; short words are remembered, up to a bound."""

    def __init__(self, weights: dict[int, np.ndarray]) -> None:
        self.weights = weights

    def __missing__(self, word: str):
        own = [self.weights[f] for f in word_features(word) if f in self.weights]
        value = sum(own) if own else None
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = value
        return value


def scored(docs: DataFrame, model, names: list[str]) -> DataFrame:
    """doc_id and the probability of every category."""
    chain = np.zeros((len(names), len(names)))
    intercepts = np.zeros(len(names))
    weights: dict[int, np.ndarray] = {}
    for c, f, w in model.itertuples(index=False):
        if f == -1:
            intercepts[c] = w
        elif f < -1:
            chain[c, -2 - f] = w
        else:
            weights.setdefault(int(f), np.zeros(len(names)))[c] += w
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.float64()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = WordScores(weights)
        for batch in batches:
            sums = np.tile(intercepts, (len(batch), 1))
            for row, text in zip(sums, batch.column(1), strict=True):
                for word in sorted(w for w in distinct_words(text.as_py()) if find[w] is not None):
                    row += find[word]
            for c in range(len(names)):
                sums[:, c] += sums[:, :c] @ chain[c, :c]
                sums[:, c] = 1 / (1 + np.exp(-np.clip(sums[:, c], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(sums[:, c]) for c in range(len(names)))], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, " + ", ".join(f"{n} double" for n in names))
