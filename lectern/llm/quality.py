"""Quality of documents: random-indexing word vectors, pooled, and a small neural network.

* Random indexing: every word has a sparse random index vector; its context vector is the sum of the
  index vectors of the words next to it, over the whole corpus. Words share ``WORDS`` slots by a
  hash, so the vectors have a fixed size however many words there are. A second set of vectors stands for
  the shapes of words (case, digits, punctuation).
* A document is pooled into mean and spread of its word vectors, the mean of its shape vectors, the
  agreement of neighbouring words, and its length and variety.
* A network with one hidden layer, in numpy, is fitted on at most ``fit_rows`` labelled documents (in
  hash order); a part of them that the fit does not see sets the temperature of its probabilities.

All counts are whole numbers, so the context vectors do not depend on how the rows are dealt out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import encoded, fold, keep_rows, query, short_batches, table, tidy
from lectern.llm.toxicity import sample_labels
from lectern.plans.scratch import settle

WORDS, SHAPES, SIZE, NONZERO, WINDOW = 2048, 512, 64, 8, 2
_REMEMBERED, _HELD_TOKENS = 200_000, 200_000
_RUNS = [(re.compile(p), r) for p, r in ((rb"[A-Z]+", b"A"), (rb"[a-z\x80-\xff]+", b"a"), (rb"[0-9]+", b"0"), (rb"(.)\1+", rb"\1"))]


def shape(word: bytes) -> bytes:
    for pattern, by in _RUNS:
        word = pattern.sub(by, word)
    return word[:8]


class Slots(dict):
    """Slot of a word and of its shape, remembered as one number; starts anew when it is full."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= _REMEMBERED:
            self.clear()
        slot = xxhash.xxh3_64_intdigest(word) % WORDS * SHAPES + xxhash.xxh3_64_intdigest(shape(word)) % SHAPES
        self[word] = slot
        return slot

    def of(self, text: str | None) -> np.ndarray:
        found = encoded(text).split()
        return np.fromiter(map(self.__getitem__, found), np.int64, len(found))


def index_vectors(rows: int, seed: int) -> np.ndarray:
    """Sparse vectors of +1 and -1 in equal numbers."""
    rng = np.random.default_rng(seed)
    out = np.zeros((rows, SIZE), np.float64)
    for row in out:
        row[rng.permutation(SIZE)[:NONZERO]] = np.resize([1.0, -1.0], NONZERO)
    return out


def context_vectors(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """Sum of the index vectors of neighbouring words for every slot, over all rows.

    Each task adds up its own counts and hands over one row per slot.
    """
    short_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, index = Slots(), index_vectors(WORDS, 1)
        near = np.zeros(WORDS * WORDS, np.int64)
        held: list[np.ndarray] = []
        gap = np.full(WINDOW, -1)

        def add() -> None:
            ids = np.concatenate(held) if held else gap
            for step in range(1, WINDOW + 1):
                a, b = ids[:-step], ids[step:]
                inside = (a >= 0) & (b >= 0)
                # a neighbour beyond a gap belongs to another text
                if step > 1:
                    for k in range(1, step):
                        inside &= ids[k:len(ids) - step + k] >= 0
                np.add.at(near, a[inside] * WORDS + b[inside], 1)
            held.clear()

        n = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                ids = slots.of(text) // SHAPES
                held.extend((ids, gap))
                n += len(ids)
                if n >= _HELD_TOKENS:
                    add()
                    n = 0
        add()
        vectors = np.zeros((WORDS, SIZE))
        for at in range(0, WORDS, 256):  # whole numbers, so the sums do not depend on their order
            rows = slice(at, at + 256)
            some = near.reshape(WORDS, WORDS)[rows].astype(np.float64)
            vectors[rows] += some @ index
            vectors += some.T @ index[rows]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(WORDS, dtype=np.int32)), pa.array(list(vectors), pa.list_(pa.float64()))], ["slot", "v"]
        )

    parts = df.select(text_col).mapInArrow(tidy(run), "slot int, v array<double>")
    sums = parts.groupBy("slot").agg(F.array(*[F.sum(F.col("v")[i]) for i in range(SIZE)]).alias("v"))
    out = np.zeros((WORDS, SIZE))
    for r in sums.collect():
        out[r.slot] = r.v
    return out


@dataclass
class Quality:
    """Word vectors and the fitted network."""

    words: np.ndarray
    shapes: np.ndarray = field(default_factory=lambda: index_vectors(SHAPES, 2))
    middle: np.ndarray | None = None
    scale: np.ndarray | None = None
    layers: list[np.ndarray] = field(default_factory=list)
    temperature: float = 1.0
    prior: float = 0.5

    def agreement(self, ids: np.ndarray, together: int = 10_000) -> np.ndarray:
        """Of each word with the next one; the vectors of a long text are not held at once."""
        ends = range(0, max(len(ids) - 1, 1), together)
        parts = ((self.words[ids[at:at + together + 1][:-1]], self.words[ids[at + 1:at + together + 1]]) for at in ends)
        return np.concatenate([np.einsum("ij,ij->i", a, b) for a, b in parts])

    def pooled(self, texts: list[str | None], slots: Slots) -> np.ndarray:
        counts, kinds = np.zeros((len(texts), WORDS)), np.zeros((len(texts), SHAPES))
        rest = np.zeros((len(texts), 5))
        for i, text in enumerate(texts):
            found = slots.of(text)
            if not len(found):
                continue
            ids, n = found // SHAPES, len(found)
            counts[i], kinds[i] = np.bincount(ids, minlength=WORDS) / n, np.bincount(found % SHAPES, minlength=SHAPES) / n
            same = found[1:] == found[:-1]
            agree = self.agreement(ids)
            rest[i] = (
                np.log1p(n), np.log1p((counts[i] > 0).sum()), same.mean() if n > 1 else 0.0,
                agree.mean() if n > 1 else 0.0, counts[i].max(),
            )
        mean = counts @ self.words
        spread = np.sqrt(np.maximum(counts @ self.words**2 - mean**2, 0.0))
        return np.hstack([mean, spread, kinds @ self.shapes, rest])

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.maximum((x - self.middle) / self.scale @ w1 + b1, 0.0) @ w2 + b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not self.layers:
            return np.full(len(x), self.prior)
        return _sigmoid(self.logits(x) / self.temperature)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train_network(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 40, seed: int = 3) -> list[np.ndarray]:
    """Adam on the cross entropy, with weight decay; rows in a seeded order."""
    rng = np.random.default_rng(seed)
    layers = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), hidden), np.zeros(1)]
    m, v, t = [np.zeros_like(a) for a in layers], [np.zeros_like(a) for a in layers], 0
    size = max(16, min(256, len(x) // 20))
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), size):
            rows = order[at:at + size]
            a, b = x[rows], y[rows]
            z = a @ layers[0] + layers[1]
            h = np.maximum(z, 0)
            out = (_sigmoid(h @ layers[2] + layers[3]) - b) / len(rows)
            back = np.outer(out, layers[2]) * (z > 0)
            slopes = [a.T @ back + 1e-3 * layers[0], back.sum(axis=0), h.T @ out + 1e-3 * layers[2], np.array([out.sum()])]
            t += 1
            for k, g in enumerate(slopes):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                layers[k] = layers[k] - 0.003 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return layers


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least cross entropy on rows that the network has not seen."""
    grid = np.exp(np.linspace(np.log(0.25), np.log(8.0), 61))
    loss = [np.mean(np.logaddexp(0, logits / t) - y * logits / t) for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    folds: int = 5, held: int = 0, fit_rows: int = 20_000,
) -> Quality:
    """Word vectors of all documents, a network of at most ``fit_rows`` labelled ones outside the held-out fold.

    Without labels of both classes every document gets the share of label 1 (0.5 without labels).
    """
    vectors = context_vectors(docs, text_col)
    vectors = vectors - vectors.mean(axis=0)
    model = Quality(vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9))
    sample = settle(sample_labels(labels, id_col, label_col, fit_rows, folds, held), "sample")
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Slots()
        for batch in batches:
            x = model.pooled(batch.column(1).to_pylist(), slots)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(x), pa.list_(pa.float64()))], ["id", "label", "x"])

    # at most fit_rows slim rows
    rows = texts.join(F.broadcast(sample), "id").select("id", "text", "label").mapInArrow(tidy(run), "id bigint, label int, x array<double>")
    rows = rows.toArrow()
    ids, y = rows.column("id").to_numpy(), rows.column("label").to_numpy().astype(float)
    x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(len(y), -1) if len(y) else np.empty((0, 0))
    del rows
    order = np.lexsort((*x.T[::-1], y, ids))
    ids, x, y = ids[order], x[order], y[order]
    if len(y):
        model.prior = float(y.mean())
    if len(y) < 10 or y.min() == y.max():
        return model
    # a fifth sets the temperature
    apart = np.array([i * 2654435761 % 4294967296 % 5 == 0 for i in ids.tolist()])
    if len(set(y[apart])) < 2 or len(set(y[~apart])) < 2:
        apart[:] = False
    fit = ~apart
    model.middle, model.scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-6
    model.layers = train_network((x[fit] - model.middle) / model.scale, y[fit])
    if apart.any():
        model.temperature = fit_temperature(model.logits(x[apart]), y[apart])
    return model


def score_quality(df: DataFrame, model: Quality, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score`` of every row.

    Null and empty texts are scored as a text without words. Repeated rows and null ids stay; further
    columns are not read.
    """
    short_batches(df.sparkSession)
    slim = df.select(F.col(id_col), F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Slots()
        for batch in batches:
            x = model.pooled(batch.column(1).to_pylist(), slots)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.probability(x))], [id_col, "score"])

    return slim.mapInArrow(tidy(run), f"`{id_col}` {slim.schema[id_col].dataType.simpleString()}, score double")


def keep_good(df: DataFrame, model: Quality, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows, with all columns, whose text scores at the threshold or above."""

    def scorer():
        slots = Slots()
        return lambda texts: model.probability(model.pooled(texts, slots))

    return keep_rows(df, text_col, scorer, lambda score: score >= threshold)


@query()
def op8_quality(spark, sf):
    """A quality score of every document, learned outside the held-out fifth."""
    docs = table(spark, sf, "documents")
    scored = score_quality(docs, fit_quality(docs, table(spark, sf, "labels")))
    return scored.select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )
