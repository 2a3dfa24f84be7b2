"""Toxic passages as maximal scoring segments of token log-odds.

* Tokens get the log-odds ratio of occurring in toxic and in other documents, with a Dirichlet prior
  proportional to their overall frequency, and its z-score. Rare words fall back on their beginning.
* A document is a sequence of scores: the log-odds of telling tokens, a small loss for all others. A
  linear scan finds all maximal scoring segments, each a candidate passage.
* The best score of documents that are not toxic follows an extreme-value distribution, in which
  the place grows with the logarithm of the length. It gives the significance of each passage.
* The significances of a document's passages go into a logistic calibration, fitted on documents
  that the log-odds in use have not seen (the labelled sample in two halves, each scored by the other).

Labels are read for at most ``fit_rows`` rows, taken in hash order, so what is joined by broadcast and
what comes to the driver is bounded; all texts are scored in one scan without a shuffle.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import fold, keep_rows, query, short_batches, table, tidy, words
from lectern.plans.scratch import settle

_EDGE = b".,;:!?\"'()[]{}|*#$%&-_/\\<>"
#: Lengths of the beginnings that stand in for words that are not telling, in characters.
_PREFIXES = (8, 7, 6, 5, 4)
#: Weight of the prior: the share of all documents that it adds to either class.
PRIOR = 0.05
#: Loss of a token that tells nothing, greatest gain of one token, least z-score of a telling one.
DRIFT, GAIN, TELLING = 0.2, 6.0, 3.0
#: Passages are significant below this probability.
SIGNIFICANT = 0.01
#: Tokens whose gain is remembered, and counts that a task holds before it hands them over.
_REMEMBERED, _HELD_COUNTS = 200_000, 100_000


def _forms(token: bytes) -> list[bytes]:
    """A word without punctuation at its ends, then its marked beginnings, the longest first."""
    bare = token.strip(_EDGE)
    text = bare.decode("utf-8", "replace")
    return [bare, *(b"\0" + text[:n].encode() for n in _PREFIXES if len(text) > n)] if bare else []


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds ratio and z-score of each token by its document counts.

    The prior adds to both classes the same documents: the share ``PRIOR`` of all, in which tokens
    are as frequent as overall.
    """
    prior = PRIOR * (toxic + clean) + 0.01
    a, b, more = toxic + prior, clean + prior, PRIOR * (n_toxic + n_clean)
    value = np.log(a / np.maximum(n_toxic + more - a, 0.5)) - np.log(b / np.maximum(n_clean + more - b, 0.5))
    return value, value / np.sqrt(1 / a + 1 / b)


def segments(scores: list[tuple[int, float]], drift: float) -> list[tuple[float, int, int]]:
    """All maximal scoring segments ``(score, first, last)`` of a sequence of tokens.

    ``scores`` holds position and gain of the telling tokens, in order; every token costs ``drift``.
    Linear: a segment is merged at most once.
    """
    found: list[list[float]] = []  # [sum before, sum after, first, last]
    total, last = 0.0, -1
    for at, gain in scores:
        total -= drift * (at - last - 1)
        before, total, last = total, total + gain - drift, at
        if total <= before:
            continue
        one = [before, total, at, at]
        while True:
            k = len(found) - 1
            while k >= 0 and found[k][0] >= one[0]:
                k -= int(found[k][4]) if len(found[k]) > 4 else 1
            if k < 0 or found[k][1] >= one[1]:
                break
            one = [found[k][0], one[1], found[k][2], one[3]]
            del found[k:]
        # how far to jump to the nearest earlier segment with a smaller sum before it
        found.append([*one, len(found) - k])
    return [(s[1] - s[0], int(s[2]), int(s[3])) for s in found]


@dataclass
class Toxicity:
    """The fitted scorer."""

    gains: dict[bytes, float]
    rate: float = 1.0
    log_k: float = 0.0
    weights: np.ndarray = field(default_factory=lambda: np.array([-2.0, 0.5, 0.5, 0.5, 0.5]))
    _seen: dict[bytes, float] = field(default_factory=dict, repr=False)

    def _gain(self, token: bytes) -> float:
        gain = next((self.gains[f] for f in _forms(token) if f in self.gains), 0.0)
        if len(self._seen) >= _REMEMBERED:
            self._seen.clear()
        self._seen[token] = gain
        return gain

    def hits(self, tokens: list[bytes]) -> list[tuple[int, float]]:
        """Place and gain of the telling tokens."""
        seen, gain = self._seen.get, self._gain
        hits = []
        for i, w in enumerate(tokens):
            g = seen(w)
            if g is None:
                g = gain(w)
            if g > 0:
                hits.append((i, g))
        return hits

    def passages(self, tokens: list[bytes]) -> list[tuple[float, int, int]]:
        return segments(self.hits(tokens), DRIFT)

    def tail(self, score: float, n: int) -> float:
        """Minus the logarithm of the probability of a best passage of that score by chance."""
        mean = self.log_k + math.log(max(n, 1)) - self.rate * score
        if mean < -30:
            return -mean
        return -math.log(max(-math.expm1(-math.exp(min(mean, 30.0))), 1e-300))

    def features(self, tokens: list[bytes]) -> tuple[list[float], list[tuple[float, int, int]]]:
        """Significance of the best passage, of all significant ones, their share, the telling tokens in
        them; and the passages."""
        hits, n = self.hits(tokens), len(tokens)
        found = segments(hits, DRIFT)
        tails = [(self.tail(s, n), s, a, b) for s, a, b in found]
        good = [t for t in tails if t[0] >= -math.log(SIGNIFICANT)]
        best = max((t[0] for t in tails), default=0.0)
        length = sum(b - a + 1 for _, _, a, b in good)
        places = [at for at, _ in hits]  # both are in order, and passages do not overlap
        inside = sum(bisect_right(places, b) - bisect_left(places, a) for _, _, a, b in good)
        row = [math.log1p(best), math.log1p(sum(t[0] for t in good)), length / max(n, 1), math.log1p(inside)]
        return row, [(s, a, b) for _, s, a, b in good]

    def probability(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(rows @ self.weights[1:] + self.weights[0], -30, 30)))


def sample_labels(labels: DataFrame, id_col: str, label_col: str, rows: int, folds: int, held: int) -> DataFrame:
    """``id, label`` of at most ``rows`` labelled rows outside the held-out fold, in hash order, one per id."""
    used = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold(id_col, folds) != held))
    used = used.select(F.col(id_col).cast("bigint").alias("id"), (F.col(label_col) >= 1).cast("int").alias("label"))
    used = used.groupBy("id").agg(F.max("label").alias("label"))
    return used.orderBy(F.xxhash64("id"), "id").limit(rows)


def _counts(df: DataFrame) -> DataFrame:
    """``token, t0, c0, t1, c1``: toxic and other documents of both halves that hold the token.

    The empty token counts the documents themselves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush():
            keys = list(counts)
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.binary()), pa.array(list(counts.values()), pa.int64())],
                ["cell", "token", "n"],
            )

        for batch in batches:
            for text, label, half in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                cell = 2 * half + label
                held = {f for w in set(words(text)) for f in _forms(w)}
                counts.update((cell, w) for w in held)
                counts[cell, b""] += 1
                if len(counts) > _HELD_COUNTS:
                    yield flush()
                    counts.clear()
        yield flush()

    rows = df.select("text", "label", "half").mapInArrow(tidy(run), "cell int, token binary, n bigint")
    cells = {"c0": 0, "t0": 1, "c1": 2, "t1": 3}
    return rows.groupBy("token").agg(*[F.sum(F.when(F.col("cell") == k, F.col("n")).otherwise(0)).alias(c) for c, k in cells.items()])


def _telling(counts: DataFrame, terms: int) -> list:
    """The counts of the tokens that may tell, by their z-score over both halves, and of all documents."""
    totals = counts.where(F.col("token") == F.lit(b"")).first()
    if totals is None:
        return []
    n_toxic, n_clean = float(totals.t0 + totals.t1), float(totals.c0 + totals.c1)
    toxic, clean = F.col("t0") + F.col("t1"), F.col("c0") + F.col("c1")
    prior, more = PRIOR * (toxic + clean) + 0.01, PRIOR * (n_toxic + n_clean)
    a, b = toxic + prior, clean + prior
    value = F.log(a / F.greatest(n_toxic + more - a, F.lit(0.5))) - F.log(b / F.greatest(n_clean + more - b, F.lit(0.5)))
    z = value / F.sqrt(1 / a + 1 / b)
    some = counts.where((F.col("token") != F.lit(b"")) & (toxic >= 1)).withColumn("z", z).where(F.col("z") >= TELLING / 2)
    return [totals, *some.orderBy(F.desc("z"), "token").limit(2 * terms).drop("z").collect()]


def _lexicon(rows: list, halves: tuple[int, ...], terms: int) -> dict[bytes, float]:
    """Gains of the telling tokens by the counts of some halves."""
    if len(rows) < 2:
        return {}
    both = np.array([[sum(r[f"t{h}"] for h in halves), sum(r[f"c{h}"] for h in halves)] for r in rows], dtype=float)
    keys = [bytes(r.token) for r in rows[1:]]
    value, z = log_odds(both[1:, 0], both[1:, 1], *both[0])
    order = np.argsort(-z, kind="stable")[:terms]
    return {keys[i]: float(min(GAIN, value[i])) for i in order.tolist() if z[i] >= TELLING and value[i] > 2 * DRIFT}


def _fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1.0) -> np.ndarray:
    """Intercept and weights by Newton steps with a ridge."""
    data = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(data.shape[1])
    w[0] = math.log((y.sum() + 1) / (len(y) - y.sum() + 1)) if len(y) else -2.0
    penalty = np.diag([1e-6] + [ridge] * x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(data @ w, -30, 30)))
        slope = data.T @ (p - y) + penalty @ w
        curve = (data * (p * (1 - p))[:, None]).T @ data + penalty + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    folds: int = 5, held: int = 0, fit_rows: int = 40_000, terms: int = 50_000,
) -> Toxicity:
    """Learn from at most ``fit_rows`` labelled documents outside the held-out fold.

    ``terms`` bounds the tokens in use (largest z-scores). Without labels of both classes every
    document gets the prior.
    """
    short_batches(docs.sparkSession)
    sample = settle(sample_labels(labels, id_col, label_col, fit_rows, folds, held), "sample")
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    # at most fit_rows slim rows
    train = settle(texts.join(F.broadcast(sample), "id").withColumn("half", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(2)).cast("int")), "train")
    wanted = _telling(settle(_counts(train), "counts"), terms)
    halves = {0: Toxicity(_lexicon(wanted, (1,), terms)), 1: Toxicity(_lexicon(wanted, (0,), terms))}
    whole = Toxicity(_lexicon(wanted, (0, 1), terms))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, label, half in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                tokens = words(text)
                found = halves[half].passages(tokens)
                out.append((label, half, len(tokens), max((s for s, _, _ in found), default=0.0)))
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["label", "half", "n", "best"])

    slim = train.select("text", "label", "half")
    chance = slim.mapInArrow(tidy(first), "label int, half int, n bigint, best double").where("label = 0 AND n > 0").collect()
    if not chance:
        return whole
    best, n = np.array([r.best for r in chance]), np.array([r.n for r in chance], dtype=float)
    # moments of an extreme-value distribution; a few very long or mislabelled documents do not count
    rate = math.pi / (max(float(np.std(np.minimum(best, np.quantile(best, 0.99)))), 0.5) * math.sqrt(6))
    middle = float(np.mean(np.minimum(best, np.quantile(best, 0.99)) * rate - np.log(n)))
    for model in (whole, *halves.values()):
        model.rate, model.log_k = rate, middle - 0.5772156649

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                (label, *halves[half].features(words(text))[0])
                for text, label, half in zip(*[c.to_pylist() for c in batch.columns], strict=True)
            ]
            columns = list(zip(*out, strict=True)) or [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in columns], ["y", "a", "b", "c", "d"])

    data = np.array(slim.mapInArrow(tidy(second), "y double, a double, b double, c double, d double").orderBy("y", "a", "b", "c", "d").collect())
    whole.weights = _fit_logistic(data[:, 1:], data[:, 0])
    return whole


def score_toxicity(df: DataFrame, model: Toxicity, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score, passages`` (score, first and last token of every significant passage) of every row.

    Null and empty texts have no passage and get the score of that. Repeated rows, null ids stay;
    further columns are not read.
    """
    short_batches(df.sparkSession)
    slim = df.select(F.col(id_col), F.col(text_col).alias("__text"))
    passage = pa.list_(pa.struct([("score", pa.float64()), ("first", pa.int32()), ("last", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.features(words(t)) for t in batch.column(1).to_pylist()]
            rows = np.array([f[0] for f in found]).reshape(-1, 4)
            spans = [[{"score": s, "first": a, "last": b} for s, a, b in f[1]] for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(model.probability(rows)), pa.array(spans, passage)], [id_col, "score", "passages"]
            )

    kind = slim.schema[id_col].dataType.simpleString()
    return slim.mapInArrow(tidy(run), f"`{id_col}` {kind}, score double, passages array<struct<score: double, first: int, last: int>>")


def drop_toxic(df: DataFrame, model: Toxicity, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows, with all columns, whose text scores below the threshold."""

    def scorer():
        return lambda texts: model.probability(np.array([model.features(words(t))[0] for t in texts]).reshape(-1, 4))

    return keep_rows(df, text_col, scorer, lambda score: score < threshold)


@query()
def op7_toxicity(spark, sf):
    """A toxicity score of every document, learned outside the held-out fifth."""
    docs = table(spark, sf, "documents")
    model = fit_toxicity(docs, table(spark, sf, "labels"))
    scored = score_toxicity(docs, model)
    return scored.select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
