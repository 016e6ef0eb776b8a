"""Quality rules combined by weak supervision.

Every rule votes keep (+1), reject (-1) or abstains (0) on a document's text statistics. The
votes of all documents are counted per vote pattern, expectation-maximisation over those counts
estimates how often each rule rejects good and bad documents, and a document's posterior
probability of being good decides. Several rules look at one trait with a low and a high limit:
where both agree they are found to be accurate, and a low limit that mostly rejects alone is
found to be weak and is outvoted.

Defined results: a null text is an empty one; an empty text has no words and fails the base
rule; a posterior of exactly the threshold keeps; a text of any length is read whole; repeated
rows are judged alike, row by row, and all columns of the input are passed on (statistics are
returned in one struct column, whose name the caller chooses); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanegrid.llm import flat
from lanegrid.runtime import small_batches

STATS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_lines long, n_stutter long, n_letters long, n_capitals long, n_marks long, n_pipes long"
)
_NAMES = [part.split()[0] for part in STATS.split(", ")]
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_CAPITAL = np.isin(np.arange(256), np.arange(ord("A"), ord("Z") + 1))
_LETTER = np.isin(flat.LOWER, np.arange(ord("a"), ord("z") + 1))
REPEAT_WINDOW = 8


def text_stats(texts: pa.Array) -> pd.DataFrame:
    """The statistics of STATS for each text.

    Words are runs of bytes outside ASCII white space. A repeated word stands in an 8-word
    window whose 64-bit hash occurs at least twice in its text.
    """
    data, at = flat.flat(texts)
    n = len(at) - 1
    start, end, owner = flat.spans(data, at)
    words = flat.span_hashes(data, start, end)
    code_point = (data & 0xC0) != 0x80

    covered = np.zeros(len(words) + 1, np.int64)
    key, first = flat.windows(words, owner, REPEAT_WINDOW)
    if len(key):
        key = flat.mix64(key ^ (owner[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        twin = np.zeros(len(key), bool)
        same = ranked[1:] == ranked[:-1]
        twin[1:] |= same
        twin[:-1] |= same
        hit = first[order[twin]]
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + REPEAT_WINDOW, -1)
    repeated = np.cumsum(covered)[:-1] > 0
    stutter = np.zeros(len(words), bool)
    stutter[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])

    lines, again = np.zeros(n, np.int64), np.zeros(n, np.int64)
    raw = data.tobytes()
    for i in range(n):
        held = [x for x in raw[at[i] : at[i + 1]].split(b"\n") if x.strip()]
        lines[i], again[i] = len(held), len(held) - len(set(held))

    count = lambda mask: np.bincount(owner[mask], minlength=n)
    return pd.DataFrame(
        {
            "n_words": np.bincount(owner, minlength=n),
            "word_chars": flat.per_text(code_point & ~flat.SPACES[data], at),
            "n_symbols": flat.per_text(_SYMBOL[data], at),
            "n_dup_lines": again,
            "n_repeat_words": count(repeated),
            "n_lines": lines,
            "n_stutter": count(stutter),
            "n_letters": flat.per_text(_LETTER[data], at),
            "n_capitals": flat.per_text(_CAPITAL[data], at),
            "n_marks": flat.per_text(data == ord("!"), at),
            "n_pipes": flat.per_text(data == ord("|"), at),
        }
    ).astype(np.int64)


def _stats(texts: pd.Series) -> pd.DataFrame:
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string(), from_pandas=True)], ["text"])
    parts = [text_stats(part.column(0)) for part in flat.blocks(batch, "text")]
    return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=_NAMES, dtype=np.int64)


def with_stats(docs: DataFrame, text: str = "text", into: str = "_stats") -> DataFrame:
    """``docs`` with a struct column of text statistics."""
    small_batches(docs.sparkSession)
    return docs.withColumn(into, F.pandas_udf(_stats, STATS)(F.col(text)))


#: name -> (reject when, keep when), on the statistics; neither is an abstention.
RULES: dict[str, Callable[[Callable[[str], Column]], tuple[Column, Column]]] = {
    "symbols": lambda c: (c("n_symbols") * 10 > c("n_words") * 3, c("n_symbols") * 20 <= c("n_words")),
    "symbols_heavy": lambda c: (c("n_symbols") > c("n_words"), c("n_symbols") * 5 <= c("n_words")),
    "table_cells": lambda c: (c("n_pipes") * 5 > c("n_words"), c("n_pipes") * 50 <= c("n_words")),
    "repeats": lambda c: (c("n_repeat_words") * 10 > c("n_words") * 3, c("n_repeat_words") * 20 <= c("n_words")),
    "stutter": lambda c: (c("n_stutter") * 10 > c("n_words") * 3, c("n_stutter") * 20 <= c("n_words")),
    "stutter_heavy": lambda c: (c("n_stutter") * 2 > c("n_words"), c("n_stutter") * 5 <= c("n_words")),
    "dup_lines": lambda c: (c("n_dup_lines") * 2 > c("n_lines"), c("n_dup_lines") * 5 <= c("n_lines")),
    "dup_lines_some": lambda c: (c("n_dup_lines") * 8 > c("n_lines"), c("n_dup_lines") == 0),
    "capitals": lambda c: (c("n_capitals") * 2 > c("n_letters"), c("n_capitals") * 5 <= c("n_letters")),
    "exclaiming": lambda c: (c("n_marks") * 3 > c("n_words"), c("n_marks") * 20 <= c("n_words")),
    "word_length": lambda c: ((c("word_chars") < c("n_words") * 4) | (c("word_chars") > c("n_words") * 7), (c("word_chars") * 2 >= c("n_words") * 9) & (c("word_chars") <= c("n_words") * 6)),
    "length": lambda c: (c("n_words") < 60, c("n_words") >= 100),
}


def base_failed(c: Callable[[str], Column]) -> Column:
    return (c("n_words") < 20) | (c("n_repeat_words") * 100 > c("n_words") * 30)


def pattern(c: Callable[[str], Column]) -> Column:
    """All votes as one base-3 number: digit 0 rejects, 1 abstains, 2 keeps."""
    number = F.lit(0)
    for rule in RULES.values():
        reject, keep = rule(c)
        number = number * 3 + F.when(reject, 0).when(keep, 2).otherwise(1)
    return number


@dataclass
class Model:
    """share: good documents; of_good, of_bad: by rule, how often its votes on such documents reject."""

    share: float
    of_good: np.ndarray
    of_bad: np.ndarray

    def log_odds(self) -> tuple[float, np.ndarray, np.ndarray]:
        """What a document starts with, and what each rule's reject and keep adds."""
        return float(np.log(self.share / (1 - self.share))), np.log(self.of_good / self.of_bad), np.log((1 - self.of_good) / (1 - self.of_bad))


def expectation_maximisation(reject: np.ndarray, keep: np.ndarray, weight: np.ndarray, rounds: int = 500, least: float = 1e-6) -> Model:
    """Fits the model to vote patterns (a row each, 0 or 1 by rule) that occur ``weight`` times.

    Given the class, rules vote independently, and an abstention says nothing. It starts from
    counting rejects: none is good, one is undecided, more are bad. Rates stay between ``least``
    and ``1 - least``; a rule that rejects good documents more often than bad ones says nothing.
    """
    good = np.array([0.95, 0.5, 0.05])[np.minimum(reject.sum(1), 2).astype(int)]

    def rejects(w):
        no, yes = w @ reject, w @ keep
        return np.clip((no + 0.5) / (no + yes + 1), least, 1 - least)

    any_class = rejects(weight)
    for _ in range(rounds):
        of_good, of_bad = rejects(weight * good), rejects(weight * (1 - good))
        inverted = of_good > of_bad
        model = Model((weight @ good + 1) / (weight.sum() + 2), np.where(inverted, any_class, of_good), np.where(inverted, any_class, of_bad))
        start, of_reject, of_keep = model.log_odds()
        new = 1 / (1 + np.exp(-np.clip(start + reject @ of_reject + keep @ of_keep, -50, 50)))
        done = np.abs(new - good).max() < 1e-9
        good = new
        if done:
            break
    return model


def fit(stats: DataFrame, of: Callable[[str], Column] = F.col) -> Model | None:
    """The model of all documents' votes; None without documents.

    Only vote patterns and their counts reach the driver: 3^12 rows at most, however large the corpus.
    """
    counted = stats.groupBy(pattern(of).alias("pattern")).count().collect()
    if not counted:
        return None
    counted.sort()
    number = np.array([r["pattern"] for r in counted], np.int64)
    votes = np.stack([number // 3 ** (len(RULES) - 1 - j) % 3 for j in range(len(RULES))], 1)
    return expectation_maximisation((votes == 0).astype(float), (votes == 2).astype(float), np.array([r["count"] for r in counted], float))


def posterior(model: Model | None, of: Callable[[str], Column] = F.col) -> Column:
    """The probability that a row with these votes is good; null without a model."""
    if model is None:
        return F.lit(None).cast("double")
    start, of_reject, of_keep = model.log_odds()
    odds = F.lit(start)
    for rule, no, yes in zip(RULES.values(), of_reject, of_keep, strict=True):
        reject, keep = rule(of)
        odds = odds + F.when(reject, float(no)).when(keep, float(yes)).otherwise(0.0)
    return F.round(1 / (1 + F.exp(-odds)), 9)


def judge(stats: DataFrame, model: Model | None, of: Callable[[str], Column] = F.col, threshold: float = 0.5) -> DataFrame:
    """Adds ``base_failed``, ``p_good`` and ``kept`` to rows with statistics."""
    kept = ~F.col("base_failed") & (F.coalesce(F.col("p_good"), F.lit(0.0)) >= threshold)
    return stats.withColumns({"base_failed": base_failed(of), "p_good": posterior(model, of)}).withColumn("kept", kept)


def keep_good(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``.

    The statistics are computed once for the fit and again in the pass that filters: no text is
    shuffled, joined or stored in between.
    """
    columns = docs.columns
    name = "_stats"
    while name in columns:
        name += "_"
    of = lambda c: F.col(f"`{name}`.{c}")
    model = fit(with_stats(docs.select(text), text, name), of)
    scored = with_stats(docs, text, name)
    if model is None:
        return docs
    good = ~base_failed(of) & (F.coalesce(posterior(model, of), F.lit(0.0)) >= threshold)
    return scored.where(good).select(*[F.col(f"`{c}`") for c in columns])
