"""Line deduplication with a suffix array over line ids, built by distributed prefix doubling.

Every line of every document starts a suffix of line ids, which ends with its document. A suffix's
rank is its place among all suffixes that start with the same line. Round k sorts the suffixes that
still share their first 2^k lines with others by the pair of ranks at a line and 2^k lines further
on; a sum over the sorted pairs gives the ranks by 2^(k+1) lines, which stay comparable with those
of suffixes that have left. A suffix leaves when it stands alone or has ended; the rounds go on until
all have left, so that equal ranks are equal suffixes. Common prefixes of neighbours in the array
follow by descent over the rounds' ranks: neighbours that 2^k lines still put together and
2^(k+1) part share 2^k lines, and of the rest what the shallower ranks, from the deepest down, show equal.

A run is worth deleting when it has at least ``min_words`` words; how many lines that takes is
known per suffix. The suffixes that share such a run are an interval of the array, cut where the common prefix with
the neighbour before is shorter than the run. The first occurrence
(by id, text hash and line) stays, later copies are deleted; overlapping deletions merge into
the maximal repeated runs.

Defined results: lines are separated by ``\\n``; a null text is returned as it is; a text all of
whose lines are copies becomes empty; rows with the same id and text are one document and are
treated alike; rows of one id with different texts are judged apart; null ids come first in the
order; a text of any length is read whole; an empty line is a line; extra columns are passed on;
an empty table gives an empty result; lines are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanegrid.llm import flat
from lanegrid.llm.sizes import free
from lanegrid.runtime import Scratch, small_batches

MIN_WORDS = 20
_DOC = ["doc", "hash"]
_PLACE = [*_DOC, "line"]
_RANK = ["name", "rank"]


def line_table(column: pa.Array, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per line: text number, line number, hash, and how many lines from here on have ``min_words`` words (0: not so many are left)."""
    data, at = flat.flat(column)
    n = len(at) - 1
    cut = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([at[:-1], cut + 1]), kind="stable")
    end = np.sort(np.concatenate([at[1:], cut]), kind="stable")
    per_text = np.bincount(np.searchsorted(at[1:], cut, side="right"), minlength=n)[:n] + 1
    owner = np.repeat(np.arange(n), per_text)
    first = np.zeros(n + 1, np.int64)
    np.cumsum(per_text, out=first[1:])
    words, _, _ = flat.spans(data, at)
    upto = np.searchsorted(words, start)  # words before each line
    total = np.append(upto, len(words))
    stop = np.searchsorted(total[1:], upto + min_words, side="left") + 1  # lines before this one have enough words
    size = np.where(stop <= first[owner + 1], stop - np.arange(len(start)), 0)
    return owner, np.arange(len(start)) - first[owner], flat.span_hashes(data, start, end), size


def _lines(min_words: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in flat.blocks(batch, "text"):
                owner, line, name, size = line_table(part.column("text"), min_words)
                ids = pa.array(owner)
                left = np.bincount(owner)[owner] - line
                ints = {"line": line, "left": left, "size": size}
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc").take(ids), part.column("hash").take(ids), pa.array(name.view(np.int64)), *[pa.array(x.astype(np.int32)) for x in ints.values()]],
                    ["doc", "hash", "name", *ints],
                )

    return emit


def _shared(rows: DataFrame, by: list[str]) -> DataFrame:
    """The values of ``by`` that more than one row has."""
    return rows.groupBy(*by).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _numbered(rows: DataFrame, by: list[str], value: str, scratch: Scratch, table: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over all rows before them in the order of ``by`` (``before``).

    The rows are sorted over the cluster; only one sum per partition is put in line.
    """
    placed = scratch.save(rows.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()), table)
    upto = lambda window: F.coalesce(F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    parts = placed.groupBy("_part").agg(F.sum(value).alias(value)).select("_part", upto(Window.orderBy("_part")).alias("_offset"))
    within = placed.withColumn("before", upto(Window.partitionBy("_part").orderBy(*by)))
    return within.join(F.broadcast(parts), "_part").withColumn("before", F.col("before") + F.col("_offset")).drop("_part", "_offset")


def suffix_array(docs: DataFrame, scratch: Scratch, min_words: int = MIN_WORDS, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The suffixes of all lines with their ranks, and the common prefixes of neighbours.

    The array (doc, hash, line, left, size, name, rank, shared) is in the order of name and rank; equal ones are equal
    suffixes. ``left`` is the lines of the suffix, ``size`` those with ``min_words`` words (0: not so many are left), and ``shared``
    tells whether others start with the same line. The common prefixes (name, rank, lcp) are in lines, with the rank before;
    ranks that are not listed share nothing with it.
    """
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("doc"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))
    small_batches(docs.sparkSession)
    lines = scratch.save(rows.mapInArrow(_lines(min_words), f"doc {dict(rows.dtypes)['doc']}, hash long, name long, line int, left int, size int"), "lines")
    # tables of shared names are written first: Spark can then split a hot name's rows over tasks in the joins
    names = scratch.save(_shared(lines.select("name"), ["name"]), "shared").withColumn("active", F.lit(True))
    by = Window.partitionBy(*_DOC).orderBy("line")
    first = lines.join(names, "name", "left").withColumns({"active": F.coalesce("active", F.lit(False)), "rank": F.lit(0).cast("long")})
    # rows of one id and text are one document; later rounds ask for the ranks of shared lines and of those behind them
    again, near = F.coalesce(F.lag("line").over(by) == F.col("line"), F.lit(False)), F.max("active").over(by.rangeBetween(-1, 0))
    first = scratch.save(first.withColumns({"again": again, "near": near}).where("not again").drop("again"), "level1")
    scratch.drop("lines", "shared")
    alone, active, settled = first.where("not active"), first.where("active").drop("near"), []
    depth, pair, rounds = 1, [*_RANK, "name2", "rank2"], []
    while not active.isEmpty():
        # sort by the ranks here and ``depth`` lines on, where no line before that one stands; a suffix that has no more lines comes first
        behind = _union([alone.where("near").drop("near"), *settled]).where(F.col("line") >= depth)
        known, ahead = active.unionByName(behind), by.rangeBetween(depth, depth)
        then = {"name2": F.coalesce(F.max("name").over(ahead), F.lit(-(1 << 63))), "rank2": F.coalesce(F.max("rank").over(ahead), F.lit(-1).cast("long"))}
        pairs = scratch.save(known.withColumns(then).where("active").drop("active"), f"pairs{depth}")
        groups = pairs.groupBy(*pair).agg(F.count("*").alias("n"), F.min(F.struct(*_PLACE)).alias("first"))
        groups = _numbered(groups, pair, "n", scratch, f"sorted{depth}")
        starts = scratch.save(groups.groupBy(*_RANK).agg(F.min("before").alias("start")), f"starts{depth}")
        ranks = scratch.save(groups.join(starts, _RANK).withColumn("new", F.col("rank") + F.col("before") - F.col("start")).drop("before", "start"), f"ranks{depth}")
        stays = (F.col("n") > 1) & (F.col("left") >= 2 * depth)
        made = pairs.join(ranks.drop("first"), pair).select(*_PLACE, "left", "size", "name", F.col("new").alias("rank"), stays.alias("active"))
        made = scratch.save(made, f"level{2 * depth}")
        scratch.drop(f"pairs{depth}", f"sorted{depth}", f"starts{depth}")
        rounds.append((depth, active, ranks))
        settled, active, depth = [*settled, made.where("not active")], made.where("active"), 2 * depth
    parts = [alone.drop("near").withColumn("shared", F.lit(False)), *[part.withColumn("shared", F.lit(True)) for part in settled]]
    return _union(parts).drop("active"), _common_prefixes(rounds, scratch)


def _common_prefixes(rounds: list[tuple[int, DataFrame, DataFrame]], scratch: Scratch) -> DataFrame:
    """(name, rank, lcp): from the deepest round on, neighbours that part there and those that parted deeper, whose common prefix grows by its depth where the ranks ahead are equal."""
    held = None
    for depth, level, ranks in reversed(rounds):
        # the first suffixes of a new rank and of the one before it, which was the same rank until this round
        before = ranks.select(*_RANK, (F.col("new") + F.col("n")).alias("new"), F.col("first").alias("other"))
        parted = ranks.where("new > rank").join(before, [*_RANK, "new"]).select("name", F.col("new").alias("rank"), "first", "other", F.lit(depth).alias("lcp"))
        if held is not None:
            for side in ("first", "other"):
                ahead = level.select(*[F.col(c).alias(f"_{c}") for c in _DOC], F.col("line").alias("_line"), F.struct(*_RANK).alias(f"_{side}"))
                at = held[side]
                held = held.join(ahead, at["doc"].eqNullSafe(F.col("_doc")) & (at["hash"] == F.col("_hash")) & (at["line"] + held["lcp"] == F.col("_line")), "left")
                held = held.drop("_doc", "_hash", "_line")
            held = held.withColumn("lcp", F.col("lcp") + F.when(F.col("_first") == F.col("_other"), depth).otherwise(0)).drop("_first", "_other")
            parted = parted.unionByName(held)
        held = scratch.save(parted, f"parted{depth}")
        scratch.drop(f"parted{2 * depth}", f"ranks{depth}")
    if held is None:
        return scratch.spark.createDataFrame([], "name long, rank long, lcp int")
    return held.select(*_RANK, "lcp")


def repeated_units(docs: DataFrame, scratch: Scratch, min_words: int = MIN_WORDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc, hash, line, size): the later copies, each the shortest run from its line with ``min_words`` words."""
    array, common = suffix_array(docs, scratch, min_words, text, key)
    # others have no copy, or are no run; a suffix behind one that is left out shares less than its run with it
    array = array.where("shared and size > 0")
    ranks = array.groupBy(*_RANK, "size").agg(F.min(F.struct(*_PLACE)).alias("first")).join(common, _RANK, "left")
    ranks = ranks.withColumn("cut", F.when(F.col("lcp") >= F.col("size"), 0).otherwise(1))
    ranks = _numbered(ranks, _RANK, "cut", scratch, "cuts").withColumn("interval", F.col("before") + F.col("cut"))
    ranks = scratch.save(ranks.select(*_RANK, "interval", "first"), "intervals")
    first = scratch.save(ranks.groupBy("interval").agg(F.min("first").alias("first")), "first")
    found = array.join(ranks.drop("first").join(first, "interval"), _RANK).where(F.struct(*_PLACE) > F.col("first"))
    return scratch.save(found.select(*_PLACE, "size"), "units")


def removed_lines(units: DataFrame) -> DataFrame:
    """(doc, hash, lines): the numbers of the lines to delete, each once."""
    covered = F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("line"), F.col("line") + F.col("size") - 1))))
    return units.groupBy(*_DOC).agg(covered.alias("lines"))


def dedup(docs: DataFrame, scratch: Scratch, min_words: int = MIN_WORDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with later copies of repeated runs deleted from the text, and columns ``n_lines`` and ``n_removed`` (which replace columns of these names)."""
    lines, parts = free(docs.columns, "_lines"), free(docs.columns, "_parts")
    gone = removed_lines(repeated_units(docs, scratch, min_words, text, key)).withColumnRenamed("lines", lines)
    on = docs[key].eqNullSafe(gone["doc"]) & (F.xxhash64(docs[text]) == gone["hash"])
    joined = docs.join(gone, on, "left").select(*[docs[c] for c in docs.columns], gone[lines]).withColumn(parts, F.split(F.col(text), "\n", -1))
    rest = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(lines))
    kept = F.array_join(F.transform(rest, lambda i: F.get(parts, i)), "\n")
    count = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c))
    return joined.select(
        *[F.when(F.col(lines).isNull(), F.col(text)).otherwise(kept).alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")],
        count(parts).alias("n_lines"),
        count(lines).alias("n_removed"),
    )


def runs(units: DataFrame) -> DataFrame:
    """Maximal deleted runs: (doc, hash, line, n_lines), overlapping and adjoining deletions merged."""
    order = Window.partitionBy(*_DOC).orderBy("line", "size")
    reach = F.max(F.col("line") + F.col("size")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = units.withColumn("fresh", F.coalesce((F.col("line") > reach).cast("int"), F.lit(1)))
    run = marked.withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ends = run.groupBy(*_DOC, "run").agg(F.min("line").alias("line"), F.max(F.col("line") + F.col("size")).alias("stop"))
    return ends.select(*_DOC, "line", (F.col("stop") - F.col("line")).alias("n_lines"))
