"""Toxicity by a factorization machine over hashed terms.

A text's terms are its lower-case words and their beginnings, hashed. Each term of the training
sample has a weight and a short vector; a score adds the weights of a text's terms and the
products of the vectors of all pairs of them, so that an insult and the mention of a group can
mean more together than each alone.

No term is left out beforehand, be it by what it says alone or for being rare. The machine is fitted twice: first with penalties
that draw weights, and vectors as a whole, to zero, unless the term earns its place by itself or
in pairs; then what is left goes on with slight penalties. A penalty pulls whenever a row has its term, so
that of a rare term is made stronger: over the sample it comes to that of `RARE` rows more than have the term.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dispatchlake.llm.common import held_out
from dispatchlake.llm.labels import SAMPLE, in_order, training_texts

HASHES = 1 << 20
FACTORS = 8
EPOCHS = 10
#: texts that a task scores at once, so that the vectors of their terms stay within memory
AT_ONCE = 256
#: over the sample a term's penalties come to those of this many rows more than have it, so that one of a row or two has to say much
RARE = 10
#: penalties of weights and of vectors, first and then
SPARSE, SLIGHT = (0.012, 0.03), (0.001, 0.001)
_WORD = re.compile(r"\w+")


def terms_of(word: str) -> list[int]:
    """Hashes of a word and of its first 4 to 7 letters."""
    digest = lambda t: xxhash.xxh3_64_intdigest(t) % HASHES
    return [digest(word), *(digest(f"{word[:k]}*") for k in range(4, 8) if len(word) > k)]


def _hashed(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = {}
        for batch in batches:
            lists = []
            for text in batch.column(1).to_pylist():
                if len(known) > 200_000:
                    known.clear()
                words = set(_WORD.findall(text.lower()))
                for w in words:
                    if w not in known:
                        known[w] = terms_of(w)
                lists.append(np.unique(np.array([t for w in words for t in known[w]], dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(lists, pa.list_(pa.int32()))], ["doc_id", "label", "terms"])

    return rows.mapInArrow(run, "doc_id long, label int, terms array<int>")


@dataclass
class FactorizationMachine:
    """Scores texts by their known terms; terms holds their hashes."""

    terms: np.ndarray
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def logits(self, at: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Of rows of places in `terms`, each row beginning at a start; the last start is the end."""
        sums = lambda x: np.diff(np.concatenate((np.zeros_like(x[:1]), np.cumsum(x, axis=0)))[starts], axis=0) if len(x) else np.zeros((len(starts) - 1, *x.shape[1:]))
        v = self.vectors[at]
        return self.bias + sums(self.weights[at]) + 0.5 * (sums(v) ** 2 - sums(v * v)).sum(axis=1)


def slopes(ids: np.ndarray, starts: np.ndarray, vectors: np.ndarray, error: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the loss's slope by the weight and by the vector of each entry is: of rows of entries, none empty, with their errors."""
    row = np.repeat(np.arange(len(error)), np.diff(starts))
    own = vectors[ids]
    return error[row], error[row, None] * (np.add.reduceat(own, starts[:-1], axis=0)[row] - own)


def _fitted(model: FactorizationMachine, at: np.ndarray, starts: np.ndarray, y: np.ndarray, penalties: tuple[float, float], epochs: int, rng: np.random.Generator, rare: float = RARE) -> FactorizationMachine:
    """Fit a model by AdaGrad on the logistic loss, each step followed by the penalties' pull to zero."""
    pull = 1 + rare / np.bincount(at, minlength=len(model.weights)).clip(1)
    squares = [1e-2, np.full(model.weights.shape, 1e-4), np.full(len(model.vectors), 1e-4)]
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
            sizes = starts[batch + 1] - starts[batch]
            full, sizes = batch[sizes > 0], sizes[sizes > 0]
            own = np.concatenate(([0], np.cumsum(sizes)))
            ids = at[np.repeat(starts[full] - own[:-1], sizes) + np.arange(own[-1])]
            error = 1 / (1 + np.exp(-np.clip(model.logits(ids, own), -30, 30))) - y[full]
            slope = (error.sum() + (len(batch) - len(full)) / (1 + np.exp(-model.bias)) - y[batch].sum() + y[full].sum()) / len(batch)
            squares[0] += slope**2
            if len(full):
                by_weight, by_vector = slopes(ids, own, model.vectors, error / len(batch))
                used, place = np.unique(ids, return_inverse=True)
                grad_w = np.bincount(place, by_weight, len(used))
                grad_v = np.stack([np.bincount(place, by_vector[:, f], len(used)) for f in range(by_vector.shape[1])], axis=1)
                squares[1][used] += grad_w**2
                squares[2][used] += (grad_v**2).mean(axis=1)
                rate = 0.1 / np.sqrt(squares[1][used])
                w = model.weights[used] - rate * grad_w
                model.weights[used] = np.sign(w) * np.maximum(0, np.abs(w) - rate * penalties[0] * pull[used])
                rate = 0.05 / np.sqrt(squares[2][used])
                v = model.vectors[used] - rate[:, None] * grad_v
                model.vectors[used] = v * np.maximum(0, 1 - rate * penalties[1] * pull[used] / np.maximum(np.sqrt((v * v).sum(axis=1)), 1e-12))[:, None]
            model.bias -= 0.1 * slope / np.sqrt(squares[0])
    return model


def _only(terms: np.ndarray, at: np.ndarray, starts: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms, entries (places in terms) and starts of rows without the terms that aren't left."""
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[left[at]]
    return terms[left], (np.cumsum(left) - 1)[at[left[at]]], np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(starts) - 1))))


def fit(table: pa.Table, factors: int = FACTORS, epochs: int = EPOCHS, seed: int = 7, rare: float = RARE) -> FactorizationMachine:
    """The machine of a training table (label, terms); a sample with one label or none gives its share alone."""
    rng = np.random.default_rng(seed)
    y = table.column("label").to_numpy().astype(np.float64)
    share = (y.sum() + 0.5) / (len(y) + 1)
    bias = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return FactorizationMachine(np.empty(0, dtype=np.int64), bias, np.zeros(0), np.zeros((0, factors)))
    column = table.column("terms").combine_chunks()
    starts = column.offsets.to_numpy().astype(np.int64)
    terms, at = np.unique(column.values.to_numpy()[starts[0] : starts[-1]], return_inverse=True)
    starts = starts - starts[0]
    model = FactorizationMachine(terms.astype(np.int64), bias, np.zeros(len(terms)), rng.normal(0, 0.05, (len(terms), factors)))
    _fitted(model, at, starts, y, SPARSE, epochs, rng, rare)
    left = (model.weights != 0) | (np.abs(model.vectors).sum(axis=1) > 1e-6)
    terms, at, starts = _only(model.terms, at, starts, left)
    model = FactorizationMachine(terms, model.bias, model.weights[left], model.vectors[left])
    return _fitted(model, at, starts, y, SLIGHT, epochs, rng, rare)


def scorer(model: FactorizationMachine):
    """A column function: the probability that a text has label 1."""
    place = {int(h): k for k, h in enumerate(model.terms)}

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, tuple[int, ...]] = {}

        def places(text: str | None) -> list[int]:
            if len(known) > 400_000:
                known.clear()
            found: set[int] = set()
            for w in set(_WORD.findall((text or "").lower())):
                own = known.get(w)
                if own is None:
                    own = known[w] = tuple(place[t] for t in terms_of(w) if t in place)
                found.update(own)
            return sorted(found)

        for batch in batches:
            scores = [np.empty(0)]
            for first in range(0, len(batch), AT_ONCE):
                rows = [places(text) for text in batch.iloc[first : first + AT_ONCE]]
                starts = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int64)
                logits = model.logits(np.fromiter(chain.from_iterable(rows), dtype=np.int64, count=int(starts[-1])), starts)
                scores.append(1 / (1 + np.exp(-np.clip(logits, -30, 30))))
            yield pd.Series(np.concatenate(scores))

    return F.pandas_udf(run, "double")


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, **how) -> FactorizationMachine:
    return fit(in_order(_hashed(training_texts(docs, labels, label, sample))), **how)


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted.

    The model is fitted on at most `sample` labelled rows that are not held out. A null or empty
    text has no terms and gets the score of the bias; without labels all rows get one score. A
    very long text counts each term once. An empty table gives an empty result.
    Repeated rows get equal scores; columns other than doc_id and text are not read.
    """
    text: Column = scorer(train(docs, labels, label, sample))(F.col("text"))
    rows = docs.select("doc_id", "text").withColumn("score", text)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
