"""N-gram Jaccard join by vertical partitioning.

A document is the set of its distinct 5-word shingles; documents with equal sets are one class.
Classes link when 100 * intersection >= 80 * union.

The global shingle order has FRAGMENTS segments, which are ranges of the shingles' hashes. The
first segment is ordered rarest first (frequencies are counted over all classes; the few
shingles that stand in a large share of a sample of documents go to its end by hash), the others
by hash. Two classes that link share a shingle among the first |x| - ceil(0.8 |x|) + 1 of each, so
only classes that share such a prefix shingle are compared. The links found so far are merged
after each step, and only pairs of different components go on: within one component a further
link changes nothing.

1. Every class with one pivot: of its prefix shingles' pivots (the class with the fewest
   unshared shingles) the one that the most of them have. So a group of near copies of one text
   becomes one component by comparing each of them once.
2. Every class with the other pivots of its prefix shingles.
3. All remaining pairs that share a prefix shingle. Of these only those go on whose parity bitmaps
   (1024 bits, each shingle flips one) differ in few enough places: sets differ in at least as many
   shingles as their bitmaps in bits, so no linked pair is dropped. The join is on written tables,
   so that Spark splits the rows of a hot shingle over tasks. Where classes have many such partners,
   each is first compared with the one that has the most itself, as long as the merges of
   a round settle at least half of the pairs; then what is left is compared.

A comparison is vertical: the global order is cut between its segments into fragments, overlaps
are counted for each fragment apart, and summed per pair.

Hot shingles: a task sends each class it meets once, so copies of one text are combined before
the shuffle. A shingle found in many of the sampled documents is dealt by class over SALTS tasks.
The sample decides the place of work and of such shingles in the order, never the result.

Defined results: words are lower-cased in A-Z; fewer than five words make one shingle; a null or
empty text has no shingles, is linked with nothing and is its own component; a text of any length
is read whole, about 2 MB of texts at a time, a longer one alone; a row without an id has no
component; repeated ids are one document per distinct text, and their smallest id is theirs; of
ids that tie for nothing but order the smallest names the component; an empty table gives an empty
result; other columns are not read, whatever their names; shingles are told apart by 64-bit
hashes, sets by 64-bit sums of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanegrid.llm import flat
from lanegrid.llm.components import components
from lanegrid.llm.sizes import BROADCAST_ROWS
from lanegrid.runtime import Scratch, small_batches

K = 5
PER_CENT = 80
FIRST_SHARE = 0.35
FRAGMENTS = 8
SALTS = 32
SAMPLE_ONE_IN = 64
BLOCK_BYTES = 2 << 20
MOST_HOT = 1_000_000  # a number each
BITMAP_LONGS = 16
FEW_PARTNERS = 8  # on average; so many are compared at once
_FIRST = np.uint64(int(FIRST_SHARE * 2**64))
_FIRST_SIGNED = int(_FIRST) - 2**63
_SIGN = np.uint64(1 << 63)
#: Where the segments of the global order after the first one start.
_CUTS = np.array([int(_FIRST) + (2**64 - int(_FIRST)) * i // (FRAGMENTS - 1) for i in range(FRAGMENTS - 1)], np.uint64)


def shingle_sets(texts: pa.Array, k: int = K) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct shingles of each text, sorted by text and hash: (text number, hash), and how many texts."""
    data, at = flat.flat(texts)
    n = len(at) - 1
    data = flat.LOWER[data]
    start, end, owner = flat.spans(data, at)
    words = flat.span_hashes(data, start, end)
    hashes, first = flat.windows(words, owner, k)
    own = owner[first]
    few = np.bincount(owner, minlength=n)
    for size in range(1, k):
        h, at_word = flat.windows(words, owner, size)
        short = few[owner[at_word]] == size
        hashes = np.concatenate([hashes, flat.mix64(h[short] + np.uint64(size))])
        own = np.concatenate([own, owner[at_word][short]])
    order = np.lexsort((hashes, own))
    own, hashes = own[order], hashes[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (hashes[1:] != hashes[:-1])
    return own[new], hashes[new], n


def signatures(own: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Size of each set, and a 64-bit name that equal sets share."""
    size = np.bincount(own, minlength=n).astype(np.int64)
    total = np.zeros(n, np.uint64)
    some = np.flatnonzero(size)
    if len(own):
        total[some] = np.add.reduceat(flat.mix64(hashes + np.uint64(0x632BE59BD9B4E019)), np.searchsorted(own, some))
    return size, flat.mix64(total + size.astype(np.uint64)).view(np.int64)


def bitmaps(own: np.ndarray, hashes: np.ndarray, n: int) -> pa.Array:
    """Parity bitmaps of the sets: every shingle flips one bit."""
    width = BITMAP_LONGS * 64
    bit = (flat.mix64(hashes ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - width.bit_length() + 1)).astype(np.int64)
    flips = np.bincount(own * width + bit, minlength=n * width).astype(np.uint8) & 1
    longs = np.packbits(flips, bitorder="little").view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * BITMAP_LONGS, BITMAP_LONGS, dtype=np.int32)), pa.array(longs))


def _prefix(size: np.ndarray) -> np.ndarray:
    return size - (PER_CENT * size + 99) // 100 + 1


def _ordered(hashes: np.ndarray) -> np.ndarray:
    """Unsigned order as signed numbers."""
    return (hashes ^ _SIGN).view(np.int64)


def _parts(batches: Iterator[pa.RecordBatch], text: str):
    for batch in batches:
        yield from flat.blocks(batch, text, BLOCK_BYTES)


def _inside(own: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """How many shingles of each set are in the first segment."""
    return np.bincount(own[hashes < _FIRST], minlength=n)


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _parts(batches, "text"):
        own, hashes, n = shingle_sets(part.column("text"))
        size, name = signatures(own, hashes, n)
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("text_hash"), pa.array(size), pa.array(_inside(own, hashes, n)), pa.array(name), bitmaps(own, hashes, n)],
            ["doc_id", "text_hash", "n_shingles", "inside", "name", "bits"],
        )


def _emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles of the first segment, and more in the order of hashes where these do not fill the prefix; each class once per task."""
    sent: set[int] = set()
    for part in _parts(batches, "text"):
        own, hashes, n = shingle_sets(part.column("text"))
        size, name = signatures(own, hashes, n)
        fresh = np.zeros(n, bool)
        for i, x in enumerate(name.tolist()):
            if x not in sent:
                sent.add(x)
                fresh[i] = True
        inside = _inside(own, hashes, n)
        start = np.zeros(n + 1, np.int64)
        np.cumsum(size, out=start[1:])
        wanted = fresh[own] & (np.arange(len(own)) - start[own] < np.maximum(inside, _prefix(size))[own])
        own, hashes = own[wanted], hashes[wanted]
        yield pa.RecordBatch.from_arrays([pa.array(_ordered(hashes)), pa.array(name[own])], ["h", "name"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each set cut between the segments of the global order into FRAGMENTS arrays."""
    for part in _parts(batches, "text"):
        own, hashes, n = shingle_sets(part.column("text"))
        _, name = signatures(own, hashes, n)
        slot = own * FRAGMENTS + np.searchsorted(_CUTS, hashes, side="right")
        filled, first = np.unique(slot, return_index=True)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(slot)].astype(np.int32)), pa.array(hashes.view(np.int64)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(name[filled // FRAGMENTS]), pa.array((filled % FRAGMENTS).astype(np.int32)), lists], ["name", "fragment", "shingles"]
        )


class Join:
    """One run of the join over ``docs`` (doc_id, text)."""

    def __init__(self, docs: DataFrame, scratch: Scratch, text: str = "text", key: str = "doc_id"):
        self.docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
        self.scratch = scratch
        self.parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        small_batches(docs.sparkSession)
        kind = self.docs.schema["doc_id"].dataType.simpleString()
        hashed = self.docs.withColumn("text_hash", F.xxhash64("text"))
        self.named = scratch.save(hashed.mapInArrow(_named, f"doc_id {kind}, text_hash long, n_shingles long, inside long, name long, bits array<long>"), "named")
        self.labels = scratch.spark.createDataFrame([], "node long, label long")
        self.links: list[DataFrame] = []
        self.tried: list[DataFrame] = []

    def hot_shingles(self) -> DataFrame:
        """(h): shingles of at least one in 2000 sampled documents, and eight of them; some hundred thousand at most, however large the corpus."""
        sample = self.docs.where(F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(SAMPLE_ONE_IN)) == 0))
        least = max(8, sample.count() // 2000)
        rows = sample.mapInArrow(_emitted, "h long, name long").groupBy("h").agg(F.count("*").alias("n"))
        return self.scratch.save(rows.where(F.col("n") >= least).select("h"), "hot")

    def prefixes(self) -> DataFrame:
        """(h, name, size, own): prefix shingles that other classes have too; own: the class's number of unshared ones."""
        rows = self.docs.where("doc_id is not null").mapInArrow(_emitted, "h long, name long")
        hot = self.hot_shingles().withColumn("hot", F.lit(True))
        cold = F.lit(-1)
        if hot.limit(MOST_HOT + 1).count() <= MOST_HOT:
            rows = rows.join(F.broadcast(hot), "h", "left")
            rows = rows.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("name"), F.lit(SALTS)).cast("int")).otherwise(cold)).drop("hot")
        else:
            rows = rows.withColumn("salt", cold)
        rows = rows.repartition(self.parts, "h", "salt").groupBy("h", "salt", "name").agg(F.lit(1).alias("_"))
        rows = rows.withColumn("df", F.when(F.col("salt") >= 0, 1 << 62).otherwise(F.count("*").over(Window.partitionBy("h", "salt")))).where("df > 1")
        # a class's sizes come to its rows here, so that the shuffle of all shingles does not carry them
        classes = self.named.where("doc_id is not null and n_shingles > 0").groupBy("name").agg(F.max("n_shingles").alias("size"), F.max("inside").alias("inside"))
        rows = rows.select("h", "name", "df").join(classes, "name")
        rows = rows.withColumn("first", F.col("h") < F.lit(_FIRST_SIGNED))
        by = Window.partitionBy("name")
        rows = rows.withColumns(
            {
                "own": F.col("inside") - F.sum(F.col("first").cast("long")).over(by),
                "place": F.row_number().over(by.orderBy((~F.col("first")).cast("int"), "df", "h")),
                "prefix": F.expr(f"size - ({PER_CENT} * size + 99) div 100 + 1"),
            }
        )
        kept = rows.where(~F.col("first") | (F.col("place") <= F.col("prefix") - F.col("own")))
        return self.scratch.save(kept.select("h", "name", "size", "own"), "prefixes")

    def pivot_pairs(self, rows: DataFrame) -> DataFrame:
        """Every class of ``rows`` (h, name, size, own) with the pivots of its shingles, and for how many of these each is the pivot."""
        pivots = self.scratch.save(rows.groupBy("h").agg(F.min(F.struct("own", "name", "size")).alias("p")), "pivots")
        pairs = rows.join(pivots, "h").where("p.name <> name")
        pairs = pairs.select(F.col("p.name").alias("a"), F.col("name").alias("b"), F.col("p.size").alias("size_a"), F.col("size").alias("size_b"))
        return pairs.where(f"100 * least(size_a, size_b) >= {PER_CENT} * greatest(size_a, size_b)").groupBy("a", "b", "size_a", "size_b").agg(F.count("*").alias("shared"))

    @staticmethod
    def _labelled(rows: DataFrame, labels: DataFrame, name: str = "name", into: str = "label") -> DataFrame:
        """``rows`` with the component of the class ``name``; a class without a link is its own."""
        return rows.join(labels.select(F.col("node").alias(name), F.col("label").alias(into)), name, "left").withColumn(into, F.coalesce(into, name))

    def apart(self, pairs: DataFrame, labels: DataFrame) -> DataFrame:
        """The pairs of different components."""
        both = self._labelled(self._labelled(pairs, labels, "a", "label_a"), labels, "b", "label_b")
        return both.where("label_a <> label_b").select("a", "b", "size_a", "size_b")

    def mixed(self, rows: DataFrame, labels: DataFrame) -> DataFrame:
        """The rows, with the classes' components, of shingles that several components have."""
        rows = self.scratch.save(self._labelled(rows, labels), "labelled")
        several = rows.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("h")
        rows = self.scratch.save(rows.join(self.scratch.save(several, "several"), "h"), "mixed")
        self.scratch.drop("labelled", "several")
        return rows

    def open_pairs(self, rows: DataFrame) -> DataFrame:
        """Pairs of classes of different components in ``rows`` that share a prefix shingle and whose bitmaps allow a link."""
        bits = self.scratch.save(self.named.join(rows.select("name").distinct(), "name", "left_semi").groupBy("name").agg(F.first("bits").alias("bits")), "bits")
        rows = self.scratch.save(rows.join(bits, "name"), "open")
        side = lambda n: rows.select("h", *[F.col(c).alias(f"{c}_{n}" if c != "name" else n) for c in ("name", "size", "label", "bits")])
        differ = sum((F.bit_count(F.get("bits_a", F.lit(i)).bitwiseXOR(F.get("bits_b", F.lit(i)))) for i in range(BITMAP_LONGS)), F.lit(0))
        near = (100 + PER_CENT) * differ <= (100 - PER_CENT) * (F.col("size_a") + F.col("size_b"))
        fits = F.expr(f"100 * least(size_a, size_b) >= {PER_CENT} * greatest(size_a, size_b)")
        on = (F.col("l.h") == F.col("r.h")) & (F.col("a") < F.col("b")) & (F.col("label_a") != F.col("label_b"))
        return side("a").alias("l").join(side("b").alias("r"), on & fits & near).select("a", "b", "size_a", "size_b").distinct()

    @staticmethod
    def untried(pairs: DataFrame, tried: DataFrame) -> DataFrame:
        seen = tried.select("a", "b").unionByName(tried.select(F.col("b").alias("a"), F.col("a").alias("b")))
        return pairs.join(seen, ["a", "b"], "left_anti")

    def fragments(self, pairs: DataFrame, name: str) -> DataFrame:
        """(name, fragment, shingles) of the classes in ``pairs``, each once, read from one document of each.

        A class is read from its least (id, text hash). Only where that row itself is repeated
        are copies of the text shuffled to keep one.
        """
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct()
        rows = self.named.where("doc_id is not null").join(wanted, "name", "left_semi").groupBy("name", "doc_id", "text_hash").agg(F.count("*").alias("n"))
        ids = rows.groupBy("name").agg(F.min(F.struct("doc_id", "text_hash", "n")).alias("one")).select("one.*")
        ids = self.scratch.save(ids, f"{name}_ids")

        def read(ids: DataFrame) -> DataFrame:
            few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
            ids = ids.select("doc_id", "text_hash")
            return self.docs.withColumn("text_hash", F.xxhash64("text")).join(F.broadcast(ids) if few else ids, ["doc_id", "text_hash"])

        found = read(ids.where("n = 1"))
        repeated = ids.where("n > 1")
        if not repeated.isEmpty():
            found = found.unionByName(read(repeated).dropDuplicates(["doc_id", "text_hash"]))
        return self.scratch.save(found.select("text").mapInArrow(_cut, "name long, fragment int, shingles array<long>"), f"{name}_cut")

    def linked(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs that link: overlaps counted per fragment and summed."""
        cut = self.fragments(pairs, name)
        right = pairs.join(cut.select(F.col("name").alias("b"), "fragment", F.col("shingles").alias("of_b")), "b")
        both = right.join(cut.select(F.col("name").alias("a"), "fragment", F.col("shingles").alias("of_a")), ["a", "fragment"])
        shared = both.select("a", "b", "size_a", "size_b", F.size(F.array_intersect("of_a", "of_b")).alias("n"))
        total = shared.groupBy("a", "b", "size_a", "size_b").agg(F.sum("n").alias("n"))
        return total.where(f"100 * n >= {PER_CENT} * (size_a + size_b - n)").select("a", "b")

    def compare(self, pairs: DataFrame, name: str) -> None:
        """Compares the pairs that were not compared yet and merges what links."""
        pairs = self.scratch.save(self.untried(pairs, reduce(DataFrame.unionByName, self.tried)) if self.tried else pairs, f"{name}_pairs")
        if not pairs.isEmpty():
            self.tried.append(pairs)
            self.links.append(self.scratch.save(self.linked(pairs, name), f"{name}_links"))
            self.scratch.drop(f"{name}_cut", f"{name}_ids")
            self.labels = components(reduce(DataFrame.unionByName, self.links), self.scratch, name)

    def compare_open(self, pairs: DataFrame, name: str) -> None:
        """Compares pairs (a < b) of which a class can have many, each class with its partner of most pairs first."""
        before, i = None, 0
        while True:
            pairs = self.scratch.save(self.untried(pairs, reduce(DataFrame.unionByName, self.tried)) if self.tried else pairs, f"{name}_open{i}")
            sides = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("s")).select("s.*")
            degree = self.scratch.save(sides.groupBy("y").agg(F.count("*").alias("n")), f"{name}_degree{i}")
            n, classes = pairs.count(), degree.count()
            if n <= FEW_PARTNERS * classes // 2 or (before is not None and 2 * n > before):
                self.compare(pairs, name)
                return
            best = sides.join(degree, "y").groupBy("x").agg(F.max(F.struct("n", "y")).alias("p"))
            best = best.select(F.least("x", "p.y").alias("a"), F.greatest("x", "p.y").alias("b")).distinct()
            self.compare(pairs.join(best, ["a", "b"], "left_semi"), f"{name}{i}")
            pairs, before, i = self.apart(pairs, self.labels), n, i + 1

    def run(self) -> DataFrame:
        """(doc_id, n_shingles, component_id) of every row."""
        scratch = self.scratch
        rows = self.prefixes()
        pivots = scratch.save(self.pivot_pairs(rows), "pivot_pairs")
        best = pivots.groupBy("b").agg(F.max(F.struct("shared", "a", "size_a", "size_b")).alias("p"))
        self.compare(best.select("p.a", "b", "p.size_a", "p.size_b"), "first")
        self.compare(self.apart(pivots, self.labels), "second")
        rows = self.mixed(rows.drop("own"), self.labels)
        scratch.drop("prefixes", "pivots", "pivot_pairs", "hot")
        self.compare_open(self.open_pairs(rows), "third")
        scratch.drop("mixed", "open", "bits")
        classes = self.named.where("n_shingles > 0 and doc_id is not null").groupBy("name").agg(F.min("doc_id").alias("least"))
        classes = self._labelled(classes, self.labels)
        least = classes.groupBy("label").agg(F.min("least").alias("component_id"))
        by_name = scratch.save(classes.join(least, "label").select("name", "component_id"), "classes")
        rows = self.named.select("doc_id", "n_shingles", "name").join(by_name, "name", "left")
        mine = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
        return rows.select("doc_id", "n_shingles", mine.alias("component_id"))


def join(docs: DataFrame, scratch: Scratch, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id): the smallest id that each document reaches by links."""
    return Join(docs, scratch, text, key).run()


def keep_one(docs: DataFrame, scratch: Scratch, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their component, and rows without an id.

    Of rows with the same id and text one stays, the first by a hash of all its columns.
    """
    found = join(docs, scratch, text, key).where("doc_id is not null and doc_id = component_id").select(F.col("doc_id").alias(key)).distinct()
    kept = docs.where(F.col(key).isNotNull()).join(scratch.save(found, "kept_ids"), key, "left_semi")
    rest = [F.col(f"`{f.name}`") for f in docs.schema.fields if f.name not in (key, text)]
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    one = kept.groupBy(key, text).agg(F.min_by(F.struct(*rest, F.lit(0).alias("_")), F.xxhash64(*hashed)).alias("_rest"))
    kept = one.select(*[F.col(f"`{c}`") if c in (key, text) else F.col(f"_rest.`{c}`") for c in docs.columns])
    return kept.unionByName(docs.where(F.col(key).isNull()))
