"""Removal of exact repeats of at least ``SPAN`` bytes, wherever they start.

1. Over each document's bytes the smallest of the 64-byte hashes that a 400-byte string holds is
   the string's anchor. Equal strings have equal anchors, so strings need comparing only within
   one anchor value. Neighbouring strings mostly have the same anchor: maximal runs of starts
   with one anchor value are blocks, one per some 170 bytes of text.
2. Blocks are dealt by anchor value. Blocks with equal bytes are repeats as they stand. Where an
   anchor value has blocks that differ (at the edges of a repeat), or occurs twice within one
   block, one block of each kind is sent as bytes to the task of its anchor, which hashes and
   sorts the strings of its blocks. Anchors with more than MOST_KINDS different blocks are not
   gathered in one task: their strings are dealt by their own hashes instead.
3. Bytes covered by a repeated string are removed; overlapping strings merge into spans.

No suffix or string of the corpus is left out: strings are only ever skipped when no other
string has their anchor. Hashes are 64 bits wide.

Defined results: offsets are UTF-8 bytes; a null or empty text has none; texts under 400 bytes lose
nothing; a text of any length is read whole, about 2 MB of texts at a time, a longer one alone;
repeated rows are documents of their own, so each is a copy of the other; all copies go, the first
included; extra columns are passed on (``spans`` and the result column are replaced); an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanegrid.llm import flat
from lanegrid.llm.sizes import maybe_listed
from lanegrid.runtime import Scratch, small_batches

SPAN = 400
GRAM = 64
WIDTH = SPAN - GRAM + 1
MOST_KINDS = 4096
_STEP = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]


def _doubled(data: np.ndarray, upto: int, want: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Hashes of all byte strings of the wanted powers of two, by start."""
    h, size, out = flat.BYTE_VALUE[data], 1, {}
    while True:
        if size in want:
            out[size] = h
        if size >= upto or len(h) <= size:
            return out
        h = h[:-size] * _STEP[size.bit_length() % 3] + (h[size:] ^ (h[size:] >> np.uint64(29)))
        size *= 2


def string_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 64-byte and of the 400-byte strings at every start of a byte array that has 400 bytes at least."""
    h = _doubled(data, 256, (16, 64, 128, 256))
    n = len(data) - SPAN + 1
    whole = h[256][:n] * _STEP[0] + h[128][256 : 256 + n] * _STEP[1] + h[16][384 : 384 + n]
    return flat.mix64(h[64]), flat.mix64(whole)


def _extreme(values: np.ndarray, width: int, pick) -> np.ndarray:
    """Least or greatest value of every ``width`` neighbours, by block-wise running extremes."""
    n = len(values) - width + 1
    fill = np.uint64(0) if pick is np.maximum else np.uint64(2**64 - 1)
    padded = np.full(-(-len(values) // width) * width, fill, np.uint64)
    padded[: len(values)] = values
    rows = padded.reshape(-1, width)
    ahead = pick.accumulate(rows, axis=1).ravel()
    back = pick.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(back[:n], ahead[width - 1 : width - 1 + n])


def blocks(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Blocks of the texts: anchor, content, text number, first start, number of starts, whether the anchor recurs inside."""
    none = np.zeros(0, np.int64)
    if len(data) < SPAN:
        return none.view(np.uint64), none.view(np.uint64), none, none, none, none.astype(bool)
    gram, whole = string_hashes(data)
    anchor = _extreme(gram, WIDTH, np.minimum)
    n = len(whole)
    text = np.searchsorted(at[1:], np.arange(n), side="right")
    inside = np.arange(n) + SPAN <= at[text + 1]
    fresh = inside.copy()
    fresh[1:] &= ~inside[:-1] | (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    start = np.flatnonzero(fresh)
    if not len(start):
        return none.view(np.uint64), none.view(np.uint64), none, none, none, none.astype(bool)
    over = np.flatnonzero(inside & np.r_[~inside[1:], True] | inside & np.r_[fresh[1:], True])
    stop = over + 1  # ends of runs: as many as starts
    # anchors that recur within a run: positions whose hash is the least of some string
    best = np.full(len(gram), 0, np.uint64)
    valid = np.where(inside, anchor, np.uint64(0))
    best[:] = _extreme(np.concatenate([np.zeros(WIDTH - 1, np.uint64), valid, np.zeros(WIDTH - 1, np.uint64)])[: len(gram) + WIDTH - 1], WIDTH, np.maximum)
    place = np.flatnonzero(gram == best)
    order = np.lexsort((place, gram[place]))
    p, v = place[order], gram[place][order]
    twin = np.flatnonzero((v[1:] == v[:-1]) & (p[1:] - p[:-1] < 2 * SPAN))
    again = np.zeros(len(start) + 1, np.int64)
    if len(twin):  # every run near such a pair
        lo = np.searchsorted(stop, p[twin] - WIDTH, side="left")
        hi = np.searchsorted(start, p[twin + 1] + 1, side="right")
        np.add.at(again, lo, 1)
        np.add.at(again, hi, -1)
    recurs = np.cumsum(again)[:-1] > 0
    pieces = -(-(stop - start) // SPAN)  # so long that its first and last string cover it
    run = np.repeat(np.arange(len(start)), pieces)
    nth = np.arange(len(run)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = start[run] + nth * SPAN
    count = np.minimum(stop[run], first + SPAN) - first
    content = flat.mix64(whole[first] * _STEP[0] + whole[first + count - 1] * _STEP[1] + count.astype(np.uint64))
    return anchor[first], content, text[first], first - at[text[first]], count, recurs[run]


def _with_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from flat.blocks(batch, "text", 2 << 20)


def _emit_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _with_rows(batches):
        anchor, content, text, first, count, recurs = blocks(*flat.flat(part.column("text")))
        ids = pa.array(text)
        yield pa.RecordBatch.from_arrays(
            [pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), part.column("doc").take(ids), part.column("hash").take(ids), pa.array(first), pa.array(count.astype(np.int32)), pa.array(recurs)],
            ["anchor", "content", "doc", "hash", "first", "count", "recurs"],
        )


def _emit_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash, document and start of every string of the blocks asked for."""
    for part in _with_rows(batches):
        data, at = flat.flat(part.column("text"))
        asked = part.column("asked")
        rows = np.repeat(np.arange(part.num_rows), np.diff(asked.offsets.to_numpy()))
        inner = asked.flatten()
        first = inner.field("first").to_numpy(zero_copy_only=False).astype(np.int64)
        count = inner.field("count").to_numpy(zero_copy_only=False).astype(np.int64)
        _, whole = string_hashes(data)
        owner = np.repeat(np.arange(len(first)), count)
        start = np.repeat(first, count) + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        text = rows[owner]
        ids = pa.array(text)
        yield pa.RecordBatch.from_arrays(
            [pa.array(whole[at[text] + start].view(np.int64)), part.column("doc").take(ids), part.column("hash").take(ids), pa.array(start)],
            ["string", "doc", "hash", "start"],
        )


def _emit_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchor, document, first start and bytes of the blocks asked for."""
    for batch in batches:
        for part in flat.blocks(batch, "text", 2 << 20):
            anchors, docs, hashes, firsts, texts = [], [], [], [], []
            ids, own = part.column("doc").to_pylist(), part.column("hash").to_pylist()
            for i, (text, asked) in enumerate(zip(part.column("text").to_pylist(), part.column("asked").to_pylist(), strict=True)):
                raw = (text or "").encode()
                for a in asked:
                    anchors.append(a["anchor"])
                    docs.append(ids[i])
                    hashes.append(own[i])
                    firsts.append(a["first"])
                    texts.append(raw[a["first"] : a["first"] + a["count"] + SPAN - 1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchors, pa.int64()), pa.array(docs, part.schema.field("doc").type), pa.array(hashes, pa.int64()), pa.array(firsts, pa.int64()), pa.array(texts, pa.binary())],
                ["anchor", "doc", "hash", "first", "bytes"],
            )


def compare_blocks(anchor: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings that occur at least twice among the blocks of one anchor: block number, first string, number of strings."""
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(texts), np.uint8)
    _, whole = string_hashes(data)
    count = sizes - SPAN + 1
    start = np.cumsum(sizes) - sizes
    block = np.repeat(np.arange(len(sizes)), count)
    within = np.arange(len(block)) - np.repeat(np.cumsum(count) - count, count)
    key = flat.mix64(whole[start[block] + within] ^ flat.mix64(anchor.view(np.uint64))[block])
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twin = np.zeros(len(key), bool)
    twin[order[1:]] |= same
    twin[order[:-1]] |= same
    fresh = twin.copy()
    fresh[1:] &= ~twin[:-1] | (block[1:] != block[:-1])
    last = twin.copy()
    last[:-1] &= ~twin[1:] | (block[1:] != block[:-1])
    first, stop = np.flatnonzero(fresh), np.flatnonzero(last)
    return block[first], within[first], stop - first + 1


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated intervals of blocks that come in the order of their anchors; whole anchors are compared at once."""

    def intervals(table: pa.Table) -> pa.RecordBatch:
        block, first, n = compare_blocks(table["anchor"].to_numpy(), table["bytes"].to_pylist())
        ids = pa.array(block)
        start = table["first"].to_numpy()[block] + first
        columns = [table["doc"].combine_chunks().take(ids), table["hash"].combine_chunks().take(ids), pa.array(start), pa.array(start + n + SPAN - 1)]
        return pa.RecordBatch.from_arrays(columns, ["doc", "hash", "start", "stop"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        anchor = batch.column("anchor").to_numpy()
        cut = int(np.searchsorted(anchor, anchor[-1]))  # the last anchor may go on in the next batch
        if cut or (held and held[-1].column("anchor")[-1].as_py() != anchor[0]):
            ready = pa.Table.from_batches([*held, batch.slice(0, cut)], batch.schema)
            if ready.num_rows:
                yield intervals(ready)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield intervals(pa.Table.from_batches(held))


def repeats(docs: DataFrame, scratch: Scratch, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc, hash, start, stop): byte intervals covered by repeated strings; they may overlap."""
    rows = docs.select(F.col(key).alias("doc"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["doc"]
    small_batches(docs.sparkSession)
    found = rows.mapInArrow(_emit_blocks, f"anchor long, content long, doc {kind}, hash long, first long, count int, recurs boolean")
    found = scratch.save(found, "blocks")
    parts = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
    # a hot anchor's rows are combined before each shuffle, and joins are on written tables, which Spark can split
    block = ["anchor", "content", "count"]
    copied = scratch.save(found.groupBy(*block).agg(F.count("*").alias("n")).where("n > 1").drop("n"), "copied")
    whole = found.join(copied.hint("merge"), block).select("doc", "hash", F.col("first").alias("start"), (F.col("first") + F.col("count") + SPAN - 1).alias("stop"))
    whole = scratch.save(whole, "whole")
    by_anchor = found.groupBy("anchor").agg(F.min("content").alias("lo"), F.max("content").alias("hi"), F.max("recurs").alias("recurs"))
    unsure = scratch.save(by_anchor.where("lo <> hi or recurs").select("anchor"), "unsure")
    some = scratch.save(maybe_listed(found, ["anchor"], unsure, ["anchor"]).join(unsure.hint("merge"), "anchor"), "some")
    single = some.groupBy(*block).agg(F.min(F.struct("doc", "hash", "first")).alias("one")).select("anchor", "count", "one.*")
    single = scratch.save(single, "single")
    many = scratch.save(single.groupBy("anchor").agg(F.count("*").alias("kinds")).where(F.col("kinds") > MOST_KINDS), "many")
    scratch.drop("blocks", "copied", "unsure", "some")

    def with_text(blocks: DataFrame, name: str) -> DataFrame:
        asked = scratch.save(blocks.groupBy("doc", "hash").agg(F.collect_list(F.struct("anchor", "first", "count")).alias("asked")), name)
        wanted = asked.withColumnsRenamed({"doc": "_doc", "hash": "_hash"}).hint("merge")  # it grows with the corpus: never broadcast
        on = rows["doc"].eqNullSafe(wanted["_doc"]) & (rows["hash"] == wanted["_hash"])
        return rows.join(wanted, on).select("doc", "hash", "text", "asked")

    texts = with_text(single.join(many, "anchor", "left_anti"), "asked").mapInArrow(_emit_texts, f"anchor long, doc {kind}, hash long, first long, bytes binary")
    runs = texts.repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(_compare, f"doc {kind}, hash long, start long, stop long")
    runs = scratch.save(runs, "runs")
    if not many.isEmpty():
        hot = single.join(many, "anchor", "left_semi")
        strings = with_text(hot, "asked_hot").mapInArrow(_emit_strings, f"string long, doc {kind}, hash long, start long")
        strings = scratch.save(strings.distinct(), "strings")
        twice = scratch.save(strings.groupBy("string").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "twice")
        strings = strings.join(twice.hint("merge"), "string").select("doc", "hash", "start").distinct()
        island = F.col("start") - F.row_number().over(Window.partitionBy("doc", "hash").orderBy("start"))
        more = strings.withColumn("island", island).groupBy("doc", "hash", "island").agg(F.min("start").alias("start"), (F.max("start") + SPAN).alias("stop"))
        runs = runs.unionByName(more.drop("island"))
    return whole.unionByName(runs)


def removed_spans(docs: DataFrame, scratch: Scratch, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc, hash, spans): the maximal byte intervals to remove from each document that has any."""
    found = repeats(docs, scratch, text, key)
    per_doc = found.groupBy("doc", "hash").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("all"))
    merged = F.aggregate(
        "all",
        F.struct(
            F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("done"),
            F.lit(-1).cast("long").alias("start"),
            F.lit(-1).cast("long").alias("stop"),
        ),
        lambda a, s: F.when(s["start"] <= a["stop"], F.struct(a["done"].alias("done"), a["start"].alias("start"), F.greatest(a["stop"], s["stop"]).alias("stop"))).otherwise(
            F.struct(
                F.when(a["stop"] >= 0, F.concat(a["done"], F.array(F.struct(a["start"].alias("start"), a["stop"].alias("stop"))))).otherwise(a["done"]).alias("done"),
                s["start"].alias("start"),
                s["stop"].alias("stop"),
            )
        ),
        lambda a: F.concat(a["done"], F.array(F.struct(a["start"].alias("start"), a["stop"].alias("stop")))),
    )
    return per_doc.select("doc", "hash", merged.alias("spans"))


def dedup(docs: DataFrame, scratch: Scratch, text: str = "text", key: str = "doc_id", into: str = "kept") -> DataFrame:
    """``docs`` with ``spans`` (null where nothing goes) and the bytes that stay in ``into``; columns of these names are replaced."""
    docs = docs.drop("spans", into)
    found = scratch.save(removed_spans(docs, scratch, text, key), "spans")

    def cut(batches):
        for batch in batches:
            kept = []
            for value, spans in zip(batch.column(text).to_pylist(), batch.column("spans").to_pylist(), strict=True):
                raw, at, parts = (value or "").encode(), 0, []
                for s in spans or ():
                    parts.append(raw[at : s["start"]])
                    at = s["stop"]
                kept.append(b"".join([*parts, raw[at:]]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kept, pa.binary())], [*batch.schema.names, into])

    on = docs[key].eqNullSafe(found["doc"]) & (F.xxhash64(docs[text]) == found["hash"])
    joined = docs.join(found.hint("merge"), on, "left").select(*[docs[c] for c in docs.columns], found["spans"])
    return joined.mapInArrow(cut, T.StructType(joined.schema.fields + [T.StructField(into, T.BinaryType())]))

