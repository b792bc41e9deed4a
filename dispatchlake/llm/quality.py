"""Quality by random-indexing word vectors and a small calibrated network.

Each token has a sparse random index vector. Its context vector is the sum of the index vectors
of the tokens near it, counted over the whole corpus. A document is the mean and the spread of
its tokens' vectors, context and index together; a two-layer network scores it, and one
temperature, fitted on training rows kept apart, makes its scores probabilities.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispatchlake.llm.common import held_out
from dispatchlake.llm.labels import SAMPLE, in_order, training_texts

#: hash buckets that stand for tokens: each has one vector, whatever the number of tokens
BUCKETS = 8192
WIDTH = 64
NONZERO = 4
REACH = 2
HIDDEN = 32
EPOCHS = 40
DECAY = 1e-4
_TOKEN = re.compile(r"\w+|[^\w\s]+")


def _index_vectors(buckets: int = BUCKETS, seed: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """(places, signs) of the nonzero entries of each bucket's index vector."""
    rng = np.random.default_rng(seed)
    places = np.argsort(rng.random((buckets, WIDTH)), axis=1)[:, :NONZERO]
    return places, rng.choice(np.array([-1, 1]), (buckets, NONZERO))


class Buckets:
    """Numbers the tokens of texts; remembers the latest."""

    def __init__(self, buckets: int = BUCKETS, bound: int = 100_000) -> None:
        self.buckets, self.bound, self.known = buckets, bound, {}

    def __call__(self, text: str | None) -> np.ndarray:
        tokens = _TOKEN.findall((text or "").lower())
        known = self.known
        if len(known) > self.bound:
            known.clear()
        try:
            return np.array([known[t] for t in tokens], dtype=np.int64)
        except KeyError:
            for t in tokens:
                if t not in known:
                    known[t] = xxhash.xxh3_64_intdigest(t) % self.buckets
            return np.array([known[t] for t in tokens], dtype=np.int64)


def context_vectors(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The context vectors of all buckets, summed over all texts; their size is fixed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = _index_vectors(buckets)
        number, total = Buckets(buckets), np.zeros(buckets * WIDTH, dtype=np.int64)

        def count(texts: list[np.ndarray]) -> None:
            gap = np.full(REACH, -1)
            line = np.concatenate([x for t in texts for x in (t, gap)])
            for reach in range(1, REACH + 1):
                a, b = line[:-reach], line[reach:]
                both = (a >= 0) & (b >= 0)
                a, b = a[both], b[both]
                for word, other in ((a, b), (b, a)):
                    for k in range(NONZERO):
                        flat, sign = word * WIDTH + places[other, k], signs[other, k]
                        total[:] += np.bincount(flat[sign > 0], minlength=len(total)) - np.bincount(flat[sign < 0], minlength=len(total))

        held, size = [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append(number(text))
                size += len(held[-1])
                if size > 1_000_000:
                    count(held)
                    held, size = [], 0
        if held:
            count(held)
        rows = total.reshape(buckets, WIDTH)
        used = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(list(rows[used]), pa.list_(pa.int64()))], ["bucket", "sums"])

    sums = docs.select("text").mapInArrow(run, "bucket long, sums array<long>")
    summed = sums.groupBy("bucket").agg(*[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(WIDTH)]).toArrow()
    out = np.zeros((buckets, WIDTH))
    if summed.num_rows:
        out[summed.column("bucket").to_numpy()] = np.stack([summed.column(f"s{k}").to_numpy() for k in range(WIDTH)], axis=1)
    return out


def token_vectors(context: np.ndarray) -> np.ndarray:
    """Context vectors of length 1 with the buckets' own index vectors."""
    places, signs = _index_vectors(len(context))
    out = context / np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)
    for k in range(NONZERO):
        out[np.arange(len(context)), places[:, k]] += signs[:, k] / np.sqrt(NONZERO)
    return out.astype(np.float32)


def pooled(tokens: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of a document's token vectors; zeros for one without tokens."""
    if not len(tokens):
        return np.zeros(2 * WIDTH, dtype=np.float32)
    counts = np.bincount(tokens, minlength=len(vectors))
    used = np.flatnonzero(counts)
    share, own = counts[used].astype(np.float32) / len(tokens), vectors[used]
    mean = share @ own
    return np.concatenate((mean, np.sqrt(np.maximum(share @ (own * own) - mean * mean, 0))))


@dataclass
class Network:
    """Two layers over standardised features, with a temperature."""

    centre: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w, b, v, c = self.layers
        return np.tanh((x - self.centre) / self.scale @ w + b) @ v + c[0]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def gradients(layers: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """The slopes of the mean logistic loss, with a slight pull of both layers' weights to zero."""
    w, b, v, c = layers
    h = np.tanh(x @ w + b)
    error = (1 / (1 + np.exp(-np.clip(h @ v + c[0], -30, 30))) - y) / len(y)
    back = error[:, None] * v * (1 - h * h)
    return [x.T @ back + DECAY * w, back.sum(axis=0), h.T @ error + DECAY * v, np.array([error.sum()])]


def best_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of logits, of a grid from 1/4 to 8, with the least mean logistic loss."""
    loss = lambda t: np.logaddexp(0, np.where(y > 0, -logits, logits) / t).mean()
    return float(min(np.geomspace(0.25, 8, 61), key=loss))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = 10) -> Network:
    """Fit by Adam on the logistic loss; every fifth row is kept apart for the temperature.

    With one label only, or no rows, the network gives the share of label 1 for any text.
    """
    rng = np.random.default_rng(seed)
    share = (y.sum() + 0.5) / (len(y) + 1)
    prior = float(np.log(share / (1 - share)))
    width = 2 * WIDTH
    layers = [rng.normal(0, width**-0.5, (width, hidden)), np.zeros(hidden), np.zeros(hidden), np.array([prior])]
    if not len(y) or y.min() == y.max():
        return Network(np.zeros(width), np.ones(width), layers)
    apart = np.arange(len(y)) % 5 == 4
    layers[2] = rng.normal(0, hidden**-0.5, hidden)
    net = Network(x[~apart].mean(axis=0), x[~apart].std(axis=0) + 1e-3, layers)
    own, label = (x[~apart] - net.centre) / net.scale, y[~apart]
    moments, squares, step = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers], 0
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(len(label)), max(1, len(label) // 64)):
            step += 1
            for p, g, m, s in zip(layers, gradients(layers, own[batch], label[batch]), moments, squares, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p -= 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    if apart.any():
        net.temperature = best_temperature(net.logits(x[apart]), y[apart])
    return net


def features(rows: DataFrame, vectors: np.ndarray) -> DataFrame:
    """(doc_id, label, x) of (doc_id, text, label) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = Buckets(len(vectors))
        for batch in batches:
            x = [pooled(number(t), vectors) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x, pa.list_(pa.float32()))], ["doc_id", "label", "x"])

    return rows.mapInArrow(run, "doc_id long, label int, x array<float>")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, buckets: int = BUCKETS) -> tuple[np.ndarray, Network]:
    """Token vectors from all texts and a network from at most `sample` labelled rows."""
    vectors = token_vectors(context_vectors(docs, buckets))
    table = in_order(features(training_texts(docs, labels, label, sample), vectors))
    x = table.column("x").combine_chunks().flatten().to_numpy().reshape(-1, 2 * WIDTH).astype(np.float64)
    return vectors, fit(x, table.column("label").to_numpy().astype(np.float64))


def scorer(vectors: np.ndarray, net: Network):
    """A column function: the probability that a text has label 1."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        number = Buckets(len(vectors))
        for batch in batches:
            x = np.array([pooled(number(t), vectors) for t in batch]).reshape(-1, 2 * WIDTH)
            yield pd.Series(net.probability(x.astype(np.float64)))

    return F.pandas_udf(run, "double")


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3, sample: int = SAMPLE, buckets: int = BUCKETS) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted.

    The word vectors count all texts; the network learns from at most `sample` labelled rows that
    are not held out. A null or empty text has the features of none; without labels all rows get
    one score. Repeated rows get equal scores; columns other than doc_id and text are not read.
    A very long text is tokenised in one task, at about 60 bytes a token. An empty table gives an
    empty result.
    """
    rows = docs.select("doc_id", "text").withColumn("score", scorer(*train(docs, labels, label, sample, buckets))(F.col("text")))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
