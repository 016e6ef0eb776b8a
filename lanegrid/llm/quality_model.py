"""Text quality by logistic regression on hashed word n-grams, trained with follow-the-regularised-leader.

Features of a text are its hashed word unigrams and bigrams, of the words themselves and of
their shapes (letter case, digits, marks, repetition of the word before), each valued by its
share of the text's words, square-rooted. The model is a weight per bucket; FTRL-proximal
with L1 and L2 terms learns it in numpy from a bounded sample of labelled rows, and scoring is
a sparse dot product over every whole text.

Defined results: a null or empty text gets the score of the bias alone; a text of any length is
scored whole, a long one alone; equal texts get equal scores, so ties and repeated rows stay ties;
extra columns are passed on, and one named like the score is replaced; without any labelled row
every score is 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanegrid.llm import flat
from lanegrid.llm.labels import training_rows
from lanegrid.runtime import small_batches


@dataclass
class Model:
    weights: np.ndarray
    bias: float


_UPPER = np.isin(np.arange(256), np.arange(ord("A"), ord("Z") + 1))
_LOWER = np.isin(np.arange(256), np.arange(ord("a"), ord("z") + 1)) | (np.arange(256) >= 0x80)
_DIGIT = np.isin(np.arange(256), np.arange(ord("0"), ord("9") + 1))
_MARK = ~(_UPPER | _LOWER | _DIGIT | flat.SPACES)


def features(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Distinct (text, bucket) pairs with their values, by text, and how many texts there are."""
    data, at = flat.flat(texts)
    n = len(at) - 1
    start, end, owner = flat.spans(data, at)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), n
    words = flat.span_hashes(flat.LOWER[data], start, end)

    def some(table):  # how many bytes of the kind a word has: none, one, some, or all
        total = np.zeros(len(data) + 1, np.int32)
        np.cumsum(table[data], out=total[1:])
        return total[end] - total[start]

    size = end - start
    kinds = [some(t) for t in (_UPPER, _LOWER, _DIGIT, _MARK)]
    last = data[end - 1]
    shape = np.zeros(len(start), np.uint64)
    for k in kinds:
        shape = shape * np.uint64(4) + (np.minimum(k, 2) + (k == size)).astype(np.uint64).clip(0, 3)
    again = np.zeros(len(start), np.uint64)
    again[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    shape = flat.mix64(((shape * np.uint64(2) + again) * np.uint64(256) + np.where(_MARK[last], last, 0)).astype(np.uint64) + np.uint64(1))
    keys, owners = [], []
    for kind, values in enumerate((words, shape)):
        for width in (1, 2):
            h, first = flat.windows(values, owner, width)
            keys.append(flat.mix64(h + np.uint64(2 * kind + width)) >> np.uint64(64 - bits))
            owners.append(owner[first])
    pairs = (np.concatenate(owners) << bits) | np.concatenate(keys).astype(np.int64)
    pairs, count = np.unique(pairs, return_counts=True)
    doc = pairs >> bits
    value = np.sqrt(count / np.bincount(owner, minlength=n)[doc])
    return doc, pairs & ((1 << bits) - 1), value, n


def train(rows: list[tuple[str, int]], bits: int = 18, epochs: int = 3, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.05, l2: float = 0.1, seed: int = 5) -> Model:
    """FTRL-proximal over (text, label) rows, one text at a time in a seeded order."""
    z, n2 = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)  # the last entry is the bias
    cut, parts = [0], []
    for i in range(0, len(rows), 500):
        doc, bucket, value, n = features(pa.array([t for t, _ in rows[i : i + 500]], pa.large_string()), bits)
        edge = np.searchsorted(doc, np.arange(n + 1))
        parts += [(bucket[a:b].astype(np.int32), value[a:b].astype(np.float32)) for a, b in zip(edge[:-1], edge[1:], strict=True)]
    rng = np.random.default_rng(seed)

    def weights(i):
        return np.where(np.abs(z[i]) <= l1, 0.0, (np.sign(z[i]) * l1 - z[i]) / ((beta + np.sqrt(n2[i])) / alpha + l2))

    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            i = np.append(parts[r][0], 1 << bits)
            x = np.append(parts[r][1], 1.0)
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - rows[r][1]) * x
            s = (np.sqrt(n2[i] + g * g) - np.sqrt(n2[i])) / alpha
            z[i] += g - s * w
            n2[i] += g * g
    w = weights(np.arange((1 << bits) + 1))
    return Model(w[:-1].astype(np.float32), float(w[-1]))


def score_texts(model: Model, texts: pa.Array) -> np.ndarray:
    bits = len(model.weights).bit_length() - 1
    doc, bucket, value, n = features(texts, bits)
    margin = np.bincount(doc, weights=model.weights[bucket] * value, minlength=n) + model.bias
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 4000, **options) -> Model:
    """A model from at most ``max_rows`` labelled rows of ``docs`` that are not held out."""
    return train([(r["_text"], r["_y"]) for r in training_rows(docs, labels, label, max_rows)], **options)


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with a score between 0 and 1; the weights travel in one broadcast of fixed size."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def _score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fitted = shared.value
        for texts in batches:
            batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string(), from_pandas=True)], ["text"])
            parts = [score_texts(fitted, part.column(0)) for part in flat.blocks(batch, "text")]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return docs.withColumn(into, F.round(_score(F.col(text)), 6))
