"""Benchmark decontamination by winnowing, with DataFrame functions only.

Of every window of consecutive 5-word hashes the smallest (the last of equal ones) is kept as
a fingerprint. A window spans 10 words, so any 10 words that a document shares with a
benchmark item leave the same fingerprint at the same place in both: none is missed. Item
fingerprints join document fingerprints, and each hit is extended over the item's window and
compared word by word. Items of fewer than 10 words are one window and are matched whole.

Only fingerprints (id, text hash, place, hash) are joined; the benchmark's windows are broadcast
if they are small enough, else both sides are shuffled with salted keys. Words are compared in a
second pass over the documents that have a candidate, which a bitmap of fixed size picks out.
A fingerprint that over MOST_SHARED windows have (a common phrase) is not paired with them: its places
bring the WINDOW starts that they can stand for, and there the document's own 10 words are joined with
the windows. Candidates thus grow with the places, not with places times windows.

Defined results: words are lower-cased in A-Z only; a null or empty text has no words and no
hit; an item without words is ignored; an item without an id marks words but is not listed;
rows of one id and one text are one document and get the same result each; rows with one id
and different texts are judged apart; a text of any length is one row throughout, and its
shuffled fingerprints grow with its words, not with their square; an occurrence of several items
counts for each; other columns are passed on, whatever their names, or not read; without
documents there are no rows, and an empty benchmark leaves everything clean.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanegrid.llm.sizes import join_counted, maybe_listed
from lanegrid.runtime import Scratch

SPAN = 10
GRAM = 5
WINDOW = SPAN - GRAM + 1
MOST_SHARED = 16
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def n_words(text: Column) -> Column:
    """The number of words; capital letters count as letters here, which spares lower-casing."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), ""))


def _over(n: Column, make) -> Column:
    """``make(i)`` for i from 0 below ``n``."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), make))


def _hashed(rows: DataFrame) -> DataFrame:
    """Adds ``codes``, a hash per word, and ``least``: for every 10-word window the smallest 5-word hash, its place packed in the low three bits.

    The minimum over six grams is built from minima over two and four; of equal hashes the last
    counts, as its packed number is smaller. Both are null where a text has fewer than 10 words.
    """
    rows = rows.withColumn("codes", F.transform("words", lambda w: F.xxhash64(w)))
    n = F.size("codes") - (SPAN - 1)
    rows = rows.withColumn("grams", F.when(n > 0, _over(n + WINDOW - 1, lambda i: F.shiftleft(F.xxhash64(*[F.get(F.col("codes"), i + k) for k in range(GRAM)]), 3))))
    # each array is zipped as a whole: an array read by index within a lambda could be computed anew for every element
    ahead = lambda c, k: F.slice(F.col(c), k + 1, F.greatest(F.size("codes"), F.lit(0)))
    rows = rows.withColumn("two", F.zip_with("grams", ahead("grams", 1), lambda a, b: F.least(a + 1, b)))
    rows = rows.withColumn("four", F.zip_with("two", ahead("two", 2), lambda a, b: F.least(a + 2, b)))
    rows = rows.withColumn("least", F.when(n > 0, F.slice(F.zip_with("four", ahead("two", 4), lambda a, b: F.least(a + 2, b)), F.lit(1), n)))
    return rows.drop("grams", "two", "four")


def _place(least: Column, i: Column) -> Column:
    return i + (WINDOW - 1) - F.get(least, i).bitwiseAND(F.lit(7)).cast("int")


def _short_key(size: int, i: Column) -> Column:
    return F.xxhash64(*[F.get(F.col("codes"), i + k) for k in range(size)])


def item_windows(items: DataFrame) -> DataFrame:
    """Distinct windows of the items: (size, key, offset, content, item_id)."""
    base = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("words")).where(F.size("words") > 0)
    base = _hashed(base)
    long = base.where(F.size("words") >= SPAN).select("item_id", "words", "least", F.explode(F.sequence(F.lit(0), F.size("least") - 1)).alias("i"))
    long = long.select(
        "item_id",
        F.lit(SPAN).alias("size"),
        F.shiftright(F.get("least", F.col("i")), 3).alias("key"),
        (_place(F.col("least"), F.col("i")) - F.col("i")).alias("offset"),
        F.array_join(F.slice("words", F.col("i") + 1, SPAN), " ").alias("content"),
    )
    short_key = F.coalesce(*[F.when(F.size("words") == size, _short_key(size, F.lit(0))) for size in range(1, SPAN)])
    short = base.where(F.size("words") < SPAN).select(
        "item_id", F.size("words").alias("size"), short_key.alias("key"), F.lit(0).alias("offset"), F.array_join("words", " ").alias("content")
    )
    return long.unionByName(short).distinct()


def marks(docs: DataFrame, short_sizes: list[int], text: str, key: str) -> DataFrame:
    """The fingerprints of the documents: (key, text_hash, size, at, fingerprint), without their words.

    Winnowed 5-word hashes for windows of 10 words, and the hash of every run of words that is
    as long as one of the short items.
    """
    rows = _hashed(docs.select(F.col(key), F.xxhash64(text).alias("text_hash"), words(F.col(text)).alias("words")))
    fresh = lambda i: (i == 0) | (_place(F.col("least"), i) != _place(F.col("least"), i - 1))
    mark = lambda size, at, of: F.struct(F.lit(size).alias("size"), at.alias("at"), of.alias("fingerprint"))
    none = F.array().cast("array<struct<size:int,at:int,fingerprint:bigint>>")
    winnowed = F.transform(
        F.filter(F.sequence(F.lit(0), F.size("least") - 1), fresh), lambda i: mark(SPAN, _place(F.col("least"), i), F.shiftright(F.get("least", i), 3))
    )
    found = [F.when(F.size("codes") >= SPAN, winnowed).otherwise(none)]

    def runs(size: int) -> Column:
        return F.coalesce(_over(F.size("codes") - (size - 1), lambda i: mark(size, i, _short_key(size, i))), none)

    found += [runs(size) for size in short_sizes]
    # outer: else Spark would first filter on the array's size, with all of its steps put into each other
    return rows.select(key, "text_hash", F.concat(*found).alias("marks")).select(key, "text_hash", F.inline_outer("marks")).where("fingerprint is not null")


def find_hits(docs: DataFrame, items: DataFrame, scratch: Scratch, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Every occurrence of an item window, in words, and the window's items: (key, text_hash, start, stop, item_id).

    Fingerprints travel without their documents' words. Those that an item has too are candidates,
    which are collected per document and compared word by word with its text, read once more.
    """
    windows = scratch.save(item_windows(items), "windows")
    sizes = sorted(r["size"] for r in windows.where(F.col("size") < SPAN).select("size").distinct().collect())  # nine at most
    distinct = windows.select("size", F.col("key").alias("fingerprint"), "offset", "content").distinct()
    bytes_of = F.octet_length("content") + 40
    # one row per place and window while few windows share a fingerprint; one row per place, with no window, where many do
    mark = ["size", "fingerprint"]
    shared = distinct.groupBy(*mark).agg((F.count("*") > MOST_SHARED).alias("many"))
    few = distinct.join(shared.where("NOT many").drop("many"), mark)
    many = shared.where("many").select(*mark, F.explode(F.sequence(F.lit(0), F.lit(WINDOW - 1))).alias("offset"), F.lit(None).cast("string").alias("content"))
    sought = scratch.save(few.select(*mark, "offset", "content").unionByName(many), "sought")
    found = join_counted(marks(docs, sizes, text, key), sought, mark, spread="at", row_bytes=F.coalesce(bytes_of, F.lit(40)))
    found = found.withColumn("start", F.col("at") - F.col("offset")).where("start >= 0").select(key, "text_hash", "start", "size", "content")
    found = scratch.save(found.groupBy(key, "text_hash").agg(F.collect_set(F.struct("start", "size", "content")).alias("candidates")), "candidates")
    found = found.withColumnsRenamed({key: "_id", "text_hash": "_hash"})
    own = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    on = own["_key"].eqNullSafe(found["_id"]) & (F.xxhash64(own["_text"]) == found["_hash"])
    read = maybe_listed(own, ["_key", F.xxhash64("_text")], found, ["_id", "_hash"]).join(found.hint("merge"), on)
    read = read.select(F.col("_id").alias(key), F.col("_hash").alias("text_hash"), words(F.col("_text")).alias("words"), "candidates")
    own_words = lambda c: F.array_join(F.slice("words", c["start"] + 1, c["size"]), " ")
    inside = lambda c: c["start"] + c["size"] <= F.size("words")
    met = F.filter("candidates", lambda c: inside(c) & (c["content"].isNull() | (own_words(c) == c["content"])))
    # places of shared fingerprints bring their own words, which the join with the items' windows then tries
    met = F.transform(met, lambda c: F.struct(c["start"].alias("start"), c["size"].alias("size"), F.coalesce(c["content"], own_words(c)).alias("content")))
    hits = read.select(key, "text_hash", met.alias("hits")).select(key, "text_hash", F.inline_outer("hits")).where("start is not null")
    hits = hits.withColumn("stop", F.col("start") + F.col("size"))
    listed = windows.select("item_id", "content", "size")
    return join_counted(hits, listed, ["content", "size"], spread="start", row_bytes=bytes_of).drop("content", "size")


def report(docs: DataFrame, items: DataFrame, scratch: Scratch, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document with a hit: words hit (overlaps once), their intervals, and the items."""
    hits = find_hits(docs, items, scratch, text, key)
    per_doc = hits.groupBy(key, "text_hash").agg(
        F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("items")
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(s["start"], a["upto"]))).alias("n"), F.greatest(a["upto"], s["stop"]).alias("upto")
        ),
        lambda a: a["n"],
    )
    return per_doc.withColumn("n_hit", covered.cast("long"))


def annotate(docs: DataFrame, items: DataFrame, scratch: Scratch, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: key, n_words, n_hit, items (sorted) and spans."""
    found = report(docs, items, scratch, text, key)
    rows = docs.select(F.col(key), F.xxhash64(text).alias("text_hash"), n_words(F.col(text)).cast("long").alias("n_words"))
    on = rows[key].eqNullSafe(found[key]) & (rows["text_hash"] == found["text_hash"])
    return rows.join(found, on, "left").select(
        rows[key],
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        "spans",
    )


def remove_contaminated(docs: DataFrame, items: DataFrame, scratch: Scratch, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` without any hit, with the columns of ``docs``."""
    hits = find_hits(docs, items, scratch, text, key).select(F.col(key).alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    return docs.join(hits, docs[key].eqNullSafe(hits["_id"]) & (F.xxhash64(docs[text]) == hits["_hash"]), "left_anti")
