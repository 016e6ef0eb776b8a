"""Approximate matching of labels with dictionaries of any size, by layers that are joins.

Layers, as a ladder: learned; equal after normalising; equal without noise words; one inside the other;
common words; similar spelling. The first layer that matches decides, within it the dictionary's order (for
words the largest share first, for spelling the highest ratio, then the greater name).

* Inside: the shorter text has at least one gram of three letters (two, if it is no longer); its rarest
  one is looked up among all grams of the other side, and pairs are then compared in full.
* Words: two sets that share a part ``t`` of the larger one share a word among the rarest
  ``size - ceil(t * size) + 1`` of each; those words are joined, and pairs are then counted in full.
* Spelling: the ratio is twice the matched letters over both lengths, so lengths decide which texts can meet
  at all. Names are cut by length into blocks, and labels meet the blocks of the lengths that they
  can match. In a block, counts of letters and then the longest common subsequence (both bounds of
  the ratio from above, for all its names at once) leave the few pairs of which the ratio is taken, highest bound
  first, until no bound reaches the best ratio.

No bound drops a match, so results equal those of comparing every label with every name.
"""

from __future__ import annotations

import difflib
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanegrid.plans import dims
from lanegrid.runtime import Scratch

# Fixed values ---------------------------------------------------------------------------------
NOISE = ["india", "region", "area", "zone", "zones", "state", "states", "part", "belt", "corridor", "hub", "sector", "circle"]
SHORTEST_SPELT = 5
GEO_BASE, GEO_PER_LETTER, GEO_MOST = 0.60, 0.02, 0.90
# ----------------------------------------------------------------------------------------------

BLOCK_NAMES, BLOCK_LABELS = 20_000, 2_000
_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "


@dataclass(frozen=True)
class Limits:
    """Least confidence; shares of length and of words; confidence by words; ratio and its weight by spelling."""

    least: float = 0.6
    inside: float = 0.7
    common: float = 0.7
    by_words: float = 0.75
    cutoff: float = 0.6
    weight: float = 0.9


CHARGES = Limits()
COMPANY = Limits(least=0.65)
ZONES = Limits(least=0.55, inside=0.65, common=0.65, by_words=0.78, cutoff=0.58, weight=0.88)


def normalise(label: Column) -> Column:
    """Lower case, other characters than letters and digits as single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(label), "[^a-z0-9 ]", " "), r"\s+", " "))


def strip_noise(label: Column) -> Column:
    """Without noise words; the label itself if nothing is left."""
    rest = F.filter(F.split(label, " "), lambda w: ~w.isin(NOISE))
    return F.when(F.size(rest) > 0, F.array_join(rest, " ")).otherwise(label)


def tokens(label: Column) -> Column:
    return F.array_distinct(F.filter(F.split(label, " "), lambda w: F.length(w) >= 2))


def _grams(text: Column, size: int) -> Column:
    none = F.array().cast("array<string>")
    at = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(at, lambda i: F.substring(text, i, F.lit(size))))).otherwise(none)


def _short_grams(text: Column) -> Column:
    return F.when(F.length(text) >= 3, _grams(text, 3)).otherwise(_grams(text, 2))


def _all_grams(text: Column) -> Column:
    return F.when(F.length(text) > 3, _grams(text, 3)).otherwise(F.concat(_grams(text, 3), _grams(text, 2)))


def _rarest(texts: DataFrame, text: str, index: DataFrame) -> DataFrame:
    """(text, gram): of each text the gram that is rarest in ``index`` (gram, ...); texts with a gram that stands nowhere there are left out."""
    counts = index.groupBy("gram").agg(F.count("*").alias("held"))
    own = texts.select(text, F.explode(_short_grams(F.col(text))).alias("gram")).join(counts, "gram", "left")
    best = own.groupBy(text).agg(F.min(F.struct("held", "gram")).alias("b"), F.count("*").alias("size"), F.count("held").alias("there"))
    return best.where("size = there").select(text, F.col("b.gram").alias("gram"))


def inside(asked: DataFrame, names: DataFrame, share: float) -> DataFrame:
    """(n, dim_order, known): the first name in order that holds ``n`` or is held by it, of lengths within ``share``."""
    in_names = names.select("known", "dim_order", F.explode(_all_grams(F.col("known"))).alias("gram"))
    in_asked = asked.select("n", F.explode(_all_grams(F.col("n"))).alias("gram"))
    held = _rarest(names.select("known", "dim_order"), "known", in_asked).join(names.select("known", "dim_order"), "known").join(in_asked, "gram")
    holding = _rarest(asked, "n", in_names).join(in_names, "gram")
    pairs = held.select("n", "known", "dim_order").unionByName(holding.select("n", "known", "dim_order"))
    close = F.least(F.length("n"), F.length("known")) / F.greatest(F.length("n"), F.length("known")) >= share
    found = pairs.where(close & (F.contains("n", "known") | F.contains("known", "n")))
    return found.groupBy("n").agg(F.min(F.struct("dim_order", "known")).alias("b")).select("n", "b.*")


def by_words(asked: DataFrame, names: DataFrame, share: float) -> DataFrame:
    """(n, dim_order, known): the name with the largest share of common words, at least ``share``; the first of equals."""
    own = names.select("known", "dim_order", tokens(F.col("known")).alias("own")).where(F.size("own") > 0)
    words = asked.select("n", tokens(F.col("n")).alias("words")).where(F.size("words") > 0)
    held = own.select(F.explode("own").alias("word")).groupBy("word").agg(F.count("*").alias("held"))

    def first(rows: DataFrame, key: str, listed: str) -> DataFrame:
        each = rows.select(key, listed, F.explode(listed).alias("word")).join(held, "word", "left")
        rank = F.row_number().over(Window.partitionBy(key).orderBy(F.coalesce("held", F.lit(0)), "word"))
        size = F.size(listed)
        return each.withColumn("_r", rank).where(F.col("_r") <= size - F.ceil(size * F.lit(share) - 1e-9) + 1).select(key, "word")

    near = first(words, "n", "words").join(first(own, "known", "own"), "word").select("n", "known").distinct()
    pairs = near.join(words, "n").join(own, "known")
    common = F.size(F.array_intersect("words", "own")) / F.greatest(F.size("words"), F.size("own"))
    best = pairs.withColumn("common", common).where(F.col("common") >= share)
    return best.groupBy("n").agg(F.min(F.struct(-F.col("common"), "dim_order", "known")).alias("b")).select("n", "b.dim_order", "b.known")


def _codes(texts: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("ascii"), np.uint8).reshape(len(texts), length)


def _counts(codes: np.ndarray) -> np.ndarray:
    return np.stack([(codes == ord(c)).sum(1) for c in _LETTERS], 1).astype(np.int16)


def common_subsequence(label: str, codes: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of ``label`` (64 letters at most) and each row, by bits."""
    masks = np.zeros(256, np.uint64)
    for i, c in enumerate(label):
        masks[ord(c)] |= np.uint64(1 << i)
    v = np.full(len(codes), ~np.uint64(0))
    for j in range(codes.shape[1]):
        u = v & masks[codes[:, j]]
        v = (v + u) | (v - u)
    low = np.uint64((1 << len(label)) - 1)
    return np.bitwise_count(~v & low).astype(np.int64)


def closest(labels: list[str], names: list[str], least: float) -> list[tuple[str, float, str] | None]:
    """For each label the name (all of one length) of the highest ratio, the greater of equals, if it reaches ``least``."""
    length = len(names[0])
    codes = _codes(names, length)
    counts, out = _counts(codes), []
    matcher = difflib.SequenceMatcher()
    for label in labels:
        total = len(label) + length
        matcher.set_seq2(label)
        own = np.array([label.count(c) for c in _LETTERS], np.int16)
        bound = 2.0 * np.minimum(counts, own).sum(1) / total
        at = np.flatnonzero(bound >= least - 1e-9)
        bound = bound[at]
        if len(label) <= 64 and len(at):
            bound = 2.0 * common_subsequence(label, codes[at]) / total
            at, bound = at[bound >= least - 1e-9], bound[bound >= least - 1e-9]
        best = None
        for i in np.argsort(-bound, kind="stable"):
            if best and bound[i] < best[0] - 1e-9:
                break
            name = names[at[i]]
            matcher.set_seq1(name)
            ratio = matcher.ratio()
            if ratio >= least and (best is None or (ratio, name) > best):
                best = (ratio, name)
        out.append(best and (label, *best))
    return out


def by_spelling(asked: DataFrame, names: DataFrame, limits: Limits) -> DataFrame:
    """(n, known, confidence): the name of the most similar spelling, if its confidence suffices."""
    ratio = max(limits.cutoff, (limits.least - 0.0005) / limits.weight - 1e-9)
    span = ratio / (2 - ratio)
    sized = names.select("known", F.length("known").alias("length")).where("length > 0")
    parts = sized.groupBy("length").agg(F.ceil(F.count("*") / BLOCK_NAMES).alias("parts"))
    blocks = sized.join(parts, "length").select("length", F.pmod(F.xxhash64("known"), "parts").alias("part"), F.col("known").alias("text"))
    spelt = asked.where(F.length("n") >= SHORTEST_SPELT).select("n", F.length("n").alias("own"))
    lengths = F.sequence(F.ceil(F.col("own") * span - 1e-9).cast("int"), F.floor(F.col("own") / span + 1e-9).cast("int"))
    meets = spelt.select("n", F.explode(lengths).alias("length")).join(parts, "length")
    many = meets.groupBy("length").agg(F.ceil(F.count("*") / BLOCK_LABELS).alias("slices"))
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
    meets = meets.join(many, "length").select("n", "length", part, F.pmod(F.xxhash64("n"), "slices").alias("slice"))
    slices = meets.select("length", "part", "slice").distinct()
    blocks = blocks.join(slices, ["length", "part"]).select(*[F.col(c).alias(c) for c in ("length", "part", "slice", "text")])

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [] if not left.num_rows or not right.num_rows else closest(left["n"].to_pylist(), right["text"].to_pylist(), ratio)
        rows = [x for x in found if x]
        return pa.table({"n": pa.array([x[0] for x in rows], pa.string()), "ratio": pa.array([x[1] for x in rows], pa.float64()), "known": pa.array([x[2] for x in rows], pa.string())})

    key = ["length", "part", "slice"]
    best = meets.groupBy(*key).cogroup(blocks.groupBy(*key)).applyInArrow(compare, "n string, ratio double, known string")
    best = best.groupBy("n").agg(F.max(F.struct("ratio", "known")).alias("b")).select("n", "b.known")

    def score(n: str, known: str) -> float:
        return round(difflib.SequenceMatcher(None, n, known).ratio() * limits.weight, 3)

    scored = best.withColumn("confidence", F.udf(score, "double", useArrow=True)("n", "known"))
    return scored.where(F.col("confidence") >= limits.least)


def match(labels: DataFrame, known: DataFrame, limits: Limits = CHARGES, learned: DataFrame | None = None, scratch: Scratch | None = None) -> DataFrame:
    """(label, value, confidence, method) of distinct labels by the first layer that matches.

    ``known`` has dim_order, known (normalised, each once) and value of any type; a null value is a name that is
    recognised and skipped. ``learned`` has raw and canonical (of value's type). Null and blank labels match nothing.
    """
    spark = labels.sparkSession
    scratch = scratch or Scratch(spark)
    names = scratch.save(known.select("dim_order", "known", "value"), "names")
    asked = labels.select("label").where(F.trim("label") != "").distinct().withColumn("n", normalise(F.col("label")))
    asked = asked.withColumn("plain", normalise(strip_noise(F.col("n"))))
    if learned is not None:
        taught = learned.groupBy(F.lower(F.trim("raw")).alias("raw")).agg(F.min("canonical").alias("taught"))
        asked = asked.join(taught, F.lower(F.trim("label")) == F.col("raw"), "left").drop("raw")
    else:
        asked = asked.withColumn("taught", F.lit(None).cast(known.schema["value"].dataType))
    exact = names.select(F.col("known").alias("n"), F.col("known").alias("same"))
    plain = names.select(F.col("known").alias("plain"), F.col("known").alias("bare"))
    asked = scratch.save(asked.join(exact, "n", "left").join(plain, "plain", "left"), "asked")
    open_ = asked.where("taught IS NULL AND same IS NULL AND bare IS NULL AND n <> ''").select("n").distinct()
    open_ = scratch.save(open_, "open")
    found = _near(open_, names, limits, scratch)
    at = F.when(F.col("taught").isNotNull(), 0).when(F.col("same").isNotNull(), 1).when(F.col("bare").isNotNull(), 2).otherwise(F.col("layer"))
    sure = F.get(F.array(F.lit(1.0), F.lit(1.0), F.lit(0.95)), at)
    method = F.get(F.array(*map(F.lit, ["learned", "exact", "normalised", "substring", "token", "fuzzy"])), at)
    rows = asked.join(found, "n", "left").withColumn("at", at).where("at IS NOT NULL")
    rows = rows.select("label", "taught", F.coalesce("same", "bare", "known").alias("known"), F.coalesce(sure, "confidence").alias("confidence"), method.alias("method"))
    rows = rows.join(names.select("known", "value"), "known", "left")
    return rows.select("label", F.coalesce("taught", "value").alias("value"), "confidence", "method").where("value IS NOT NULL")


def _near(open_: DataFrame, names: DataFrame, limits: Limits, scratch: Scratch) -> DataFrame:
    """(n, layer, known, confidence) of labels that no name equals, by the layers of inside, words and spelling; no work if there are none."""
    if open_.isEmpty():
        return open_.select("n", F.lit(None).cast("int").alias("layer"), F.lit(None).cast("string").alias("known"), F.lit(None).cast("double").alias("confidence"))
    layers = [
        inside(open_, names, limits.inside).select("n", F.lit(3).alias("layer"), "known", F.lit(0.85).alias("confidence")),
        by_words(open_, names, limits.common).select("n", F.lit(4).alias("layer"), "known", F.lit(limits.by_words).alias("confidence")),
    ]
    found = scratch.save(layers[0].unionByName(layers[1]).groupBy("n").agg(F.min(F.struct("layer", "known", "confidence")).alias("b")).select("n", "b.*"), "near")
    left = open_.join(found.select("n"), "n", "left_anti")
    spelt = by_spelling(left, names, limits).select("n", F.lit(5).alias("layer"), "known", "confidence")
    return found.unionByName(spelt)


def plain_label(text: str) -> str:
    """``normalise`` of a Python text."""
    return " ".join("".join(c if c in _LETTERS else " " for c in text.lower()).split())


def zone_names(spark) -> DataFrame:
    """The zone labels as a dictionary: a name keeps its first place and its last meaning."""
    names: dict[str, list[str]] = {}
    for label, zones in dims.LABEL_ZONES.items():
        names[plain_label(label)] = zones
    return spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(names.items())], "dim_order int, known string, value array<string>").coalesce(1)


def match_zones(labels: DataFrame, least: float = ZONES.least, learned: DataFrame | None = None, scratch: Scratch | None = None) -> DataFrame:
    """(label, value, confidence, method) with lists of zones: canonical codes, the ladder, then state names inside the label."""
    spark = labels.sparkSession
    scratch = scratch or Scratch(spark)
    asked = scratch.save(labels.select("label").where(F.trim("label") != "").distinct(), "zone_labels")
    if asked.isEmpty():
        return asked.select("label", F.lit(None).cast("array<string>").alias("value"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("method"))
    code = F.upper(F.trim("label"))
    canonical = asked.where(code.isin(dims.ZONES)).select("label", F.array(code).alias("value"), F.lit(1.0).alias("confidence"), F.lit("exact").alias("method"))
    others = asked.where(~code.isin(dims.ZONES))
    near = scratch.save(match(others, zone_names(spark), replace(ZONES, least=least), learned, scratch), "zone_matches")
    unknown = others.join(near.select("label"), "label", "left_anti").withColumn("n", normalise(F.col("label")))
    states = [(plain_label(s), z) for s, z in dims.STATE_ZONES.items()]
    ordered = sorted(states, key=lambda x: -len(x[0]))
    hit = reduce(lambda w, s: w.when(F.contains("n", F.lit(s[0])), F.struct(F.array(*map(F.lit, s[1])).alias("value"), F.lit(min(GEO_MOST, GEO_BASE + GEO_PER_LETTER * len(s[0]))).alias("confidence"))), ordered[1:], F.when(F.contains("n", F.lit(ordered[0][0])), F.struct(F.array(*map(F.lit, ordered[0][1])).alias("value"), F.lit(min(GEO_MOST, GEO_BASE + GEO_PER_LETTER * len(ordered[0][0]))).alias("confidence"))))
    geo = unknown.withColumn("g", hit).where("g IS NOT NULL").select("label", "g.*", F.lit("geo").alias("method"))
    return canonical.unionByName(near).unionByName(geo)
