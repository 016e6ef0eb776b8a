"""Toxicity by a small convolutional text classifier.

A word's vector is the sum of two hashed embeddings, of the word and of its first four
letters. Filters of one, two and three words slide over the whole text, the maximum over all
positions of each filter feeds a logistic output. Weights are trained in numpy on a bounded
sample of labelled rows; scoring covers every whole text. Because a filter is linear in its
words, each bucket's contribution to each filter is tabulated once, and a text is scored by
table look-ups and a maximum. Thresholds are calibrated by language on one in CALIBRATION of the
sampled rows, which training leaves out; the language is never an input of the score.

Defined results: a null or empty text gets the score of a text without words; a text of any length
is scored whole; rows without a language, and languages with few calibration rows, share one
threshold; of thresholds that are equally good the highest counts; repeated rows get the same score;
extra columns are passed on, and one named like the score is replaced; without any labelled row
every score is 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanegrid.llm import flat
from lanegrid.llm.labels import training_rows
from lanegrid.runtime import small_batches

WIDTHS = (1, 2, 3)
CALIBRATION = 8


@dataclass
class Model:
    """tables: for each filter width, one array (offset, bucket, filter); out: weights of the maxima."""

    tables: list[np.ndarray]
    prefix_tables: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, float] = field(default_factory=dict)
    default_threshold: float = 0.5


def word_buckets(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Hash buckets of all words and of their first four characters, the words' text numbers, and how many texts."""
    data, at = flat.flat(texts)
    data = flat.LOWER[data]
    start, end, owner = flat.spans(data, at, flat.NOT_ALNUM)
    whole = flat.span_hashes(data, start, end)
    stop = np.minimum(end, start + 4)
    for _ in range(3):  # do not cut a character in two
        inside = stop < end
        inside[inside] = (data[stop[inside]] & 0xC0) == 0x80
        stop = stop + inside
    head = flat.span_hashes(data, start, stop)
    shift = np.uint64(64 - bits)
    return (whole >> shift).astype(np.int32), (head >> shift).astype(np.int32), owner, len(at) - 1


def _maxima(model_tables, prefix_tables, bias, words, heads, owner, n, want_at=False):
    """Per text and filter: the largest activation (0 at least), and where it is."""
    peaks, places = [], []
    for width, table, prefix, b in zip(WIDTHS, model_tables, prefix_tables, bias, strict=True):
        filters = table.shape[2]
        peak = np.zeros((n, filters), np.float32)
        place = np.full((n, filters), -1, np.int64)
        count = len(words) - width + 1
        if count > 0:
            act = np.tile(b, (count, 1)).astype(np.float32)
            for k in range(width):
                act += table[k][words[k : k + count]]
                act += prefix[k][heads[k : k + count]]
            ok = np.flatnonzero(owner[:count] == owner[width - 1 :])
            if len(ok):
                act = act[ok]
                own = owner[ok]
                first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                top = np.maximum.reduceat(act, first, axis=0)
                if want_at:
                    stop = np.r_[first[1:], len(own)]
                    for i, (a, z) in enumerate(zip(first, stop, strict=True)):
                        place[own[a]] = np.where(top[i] > 0, ok[a + act[a:z].argmax(0)], -1)
                peak[own[first]] = np.maximum(top, 0)
        peaks.append(peak)
        places.append(place)
    return np.concatenate(peaks, 1), places


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(rows: list[tuple[str, int]], bits: int = 15, dims: int = 6, filters: int = 6, epochs: int = 6, rate: float = 0.1, seed: int = 7) -> Model:
    """Fits embeddings, filters and output by Adagrad on (text, label) rows.

    The first embedding dimension starts at each bucket's smoothed log-odds in the rows, the rest
    at small seeded noise; the gradient of a maximum flows to the place where it was reached.
    """
    rng = np.random.default_rng(seed)
    buckets = 1 << bits
    y = np.array([label for _, label in rows], np.float32)
    words, heads, owner, n = word_buckets(pa.array([t for t, _ in rows], pa.large_string()), bits) if rows else (np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int64), 0)

    def log_odds(ids):
        pairs = np.unique(owner * buckets + ids)
        bad = np.bincount(pairs % buckets, weights=y[pairs // buckets], minlength=buckets)
        every = np.bincount(pairs % buckets, minlength=buckets)
        rest = every - bad
        odds = np.log((bad + 0.3) / (y.sum() + 1)) - np.log((rest + 0.3) / (n - y.sum() + 1))
        return np.where(every > 0, np.clip(odds, -3, 3) * every / (every + 3), 0)

    emb = [rng.normal(0, 0.05, (buckets, dims)) for _ in range(2)]
    for e, ids in zip(emb, (words, heads), strict=True):
        if n:
            e[:, 0] = log_odds(ids) / 2
    kernel = [rng.normal(0, 0.3, (w, dims, filters)) for w in WIDTHS]
    for w, k in zip(WIDTHS, kernel, strict=True):
        k[:, 0, :] = np.abs(k[:, 0, :]) + 0.5 / w
    bias = [np.full(filters, -0.3) for _ in WIDTHS]
    out, out_bias = np.full(filters * len(WIDTHS), 0.15), -1.5
    params = [*emb, *kernel, *bias, out]
    memory = [np.full(p.shape, 1e-3) for p in params]
    bias_memory = 1e-3
    tables = lambda e: [np.einsum("bd,wdf->wbf", e, k).astype(np.float32) for k in kernel]
    size = 256
    edges = np.searchsorted(owner, np.arange(0, n + size, size)) if n else [0]
    for _ in range(epochs if n else 0):
        for part in rng.permutation((n + size - 1) // size):
            lo, hi = part * size, min(n, (part + 1) * size)
            a, z = edges[part], edges[part + 1]
            w_ids, h_ids, own = words[a:z], heads[a:z], owner[a:z] - lo
            present = [np.unique(w_ids), np.unique(h_ids)]
            local = [np.searchsorted(p, ids).astype(np.int32) for p, ids in zip(present, (w_ids, h_ids), strict=True)]
            tab = [[np.einsum("bd,wdf->wbf", e[p], k).astype(np.float32) for k in kernel] for e, p in zip(emb, present, strict=True)]
            peak, places = _maxima(tab[0], tab[1], bias, local[0], local[1], own, hi - lo, want_at=True)
            score = _sigmoid(peak @ out + out_bias)
            err = (score - y[lo:hi]) / (hi - lo)
            grads = [np.zeros_like(p) for p in params]
            grads[-1] = peak.T @ err + 1e-4 * out
            back = np.outer(err, out)
            for j, (w, place) in enumerate(zip(WIDTHS, places, strict=True)):
                g = back[:, j * filters : (j + 1) * filters] * (place >= 0)
                t, f = np.nonzero(place >= 0)
                at, gv = place[t, f], g[t, f]
                grads[2 + len(WIDTHS) + j] = g.sum(0)
                for k in range(w):
                    for e, ids in ((0, w_ids), (1, h_ids)):
                        b = ids[at + k]
                        np.add.at(grads[2 + j][k].T, f, gv[:, None] * emb[e][b])
                        np.add.at(grads[e], b, gv[:, None] * kernel[j][k][:, f].T)
            for p, g, m in zip(params, grads, memory, strict=True):
                m += g * g
                p -= rate * g / np.sqrt(m)
            bias_memory += err.sum() ** 2
            out_bias -= rate * err.sum() / np.sqrt(bias_memory)
    if not n:
        out, out_bias = np.zeros_like(out), 0.0
    return Model(tables(emb[0]), tables(emb[1]), [b.astype(np.float32) for b in bias], out.astype(np.float32), float(out_bias))


def score_texts(model: Model, texts: pa.Array) -> np.ndarray:
    bits = int(model.tables[0].shape[1]).bit_length() - 1
    peak, _ = _maxima(model.tables, model.prefix_tables, model.bias, *word_buckets(texts, bits))
    return _sigmoid(peak @ model.out + model.out_bias).astype(np.float64)


def calibrate(model: Model, rows: list[tuple[str, int, str | None]], least: int = 20, least_toxic: int = 5) -> None:
    """Sets the threshold of each language with enough rows to the one of best F1 on the given rows; others share one, 0.5 where there are too few rows at all."""

    def best(scores, y):
        order = np.argsort(-scores, kind="stable")
        hit = np.cumsum(y[order])
        f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
        i = int(f1.argmax())
        below = scores[order[i + 1]] if i + 1 < len(y) else 0.0
        return float((scores[order[i]] + below) / 2)

    if not rows:
        return
    frame = pd.DataFrame(rows, columns=["text", "y", "lang"])
    frame["score"] = score_texts(model, pa.array(frame["text"], pa.large_string()))
    if frame["y"].sum() >= least_toxic:
        model.default_threshold = best(frame["score"].to_numpy(), frame["y"].to_numpy())
    for lang, part in frame.groupby("lang"):
        if len(part) >= least and part["y"].sum() >= least_toxic:
            model.thresholds[str(lang)] = best(part["score"].to_numpy(), part["y"].to_numpy())


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = 4000, **options) -> Model:
    """A model from at most ``max_rows`` labelled rows of ``docs`` that are not held out."""
    rows = training_rows(docs, labels, label, max_rows)
    model = train([(r["_text"], r["_y"]) for i, r in enumerate(rows) if i % CALIBRATION], **options)
    if "lang" in docs.columns and rows:
        langs = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").join(F.broadcast(docs.sparkSession.createDataFrame([(r["doc_id"],) for r in rows], "doc_id long").distinct()), "doc_id").collect()}
        calibrate(model, [(r["_text"], r["_y"], langs.get(r["doc_id"])) for r in rows[::CALIBRATION]])
    return model


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with a score between 0 and 1; the model travels in one broadcast of fixed size."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def _score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fitted = shared.value
        for texts in batches:
            batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string(), from_pandas=True)], ["text"])
            parts = [score_texts(fitted, part.column(0)) for part in flat.blocks(batch, "text", 1 << 20)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return docs.withColumn(into, F.round(_score(F.col(text)), 6))


def threshold(model: Model, lang):
    """The calibrated threshold of a language column."""
    known = [F.lit(x) for pair in sorted(model.thresholds.items()) for x in pair]
    return F.coalesce(F.create_map(*known)[lang], F.lit(model.default_threshold)) if known else F.lit(model.default_threshold)
