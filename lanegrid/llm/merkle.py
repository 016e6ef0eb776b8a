"""A Merkle manifest of a table: leaf digests, one tree per group, a tree over the groups' roots, and proofs.

Rows are ranked within their group by cluster-wide sorts (a hot group is cut by the order columns).
Trees have FAN children per node; all leaves of a tree lie equally deep. Builders are aligned:
each takes FAN ** LEVELS consecutive leaves, a whole subtree, and appends its nodes to the log in
the order in which they are completed, that is in postorder; a next round of builders does the same
on the subtrees' roots. A node's place in the log of its tree follows from its level, its index and
the number of leaves alone (``place``), so that the builders need not talk to each other and the
siblings of a proof are read from the log by their places. No builder or reader holds more than
one subtree of that size, whatever the size of the group.

Digests are lowercase hex of SHA-256; inner nodes hash their children's hex digests end to end. A
proof is a list of (left, right), bottom up: the siblings' digests before and after one's own.

Defined results: a null field is ``-``, any other its number of UTF-8 bytes, ``:`` and its value; groups
are ordered null first, then by bytes; rows are ordered by the key, null first, and rows with equal
keys by their digest, so that repeated rows are leaves of their own; a lone leaf is its tree's root
and a lone tree's root the root of all, with an empty proof; texts of any length are hashed whole; other
columns are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanegrid.runtime import Scratch

FAN, LEVELS = 8, 4
SPAN = FAN**LEVELS
PROOF = "array<struct<left:string,right:string>>"
LOG = "tree string, n long, level int, at long, place long, digest string"
TOP = f"subroot string, root string, above {PROOF}"


def field(value: Column) -> Column:
    """A field as the leaf hashes it."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*fields: Column) -> Column:
    return F.sha2(F.concat(*map(field, fields)).cast("binary"), 256)


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its proof lead to."""
    return F.aggregate(proof, start, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]).cast("binary"), 256))


def siblings(proof: Column) -> Column:
    """The digests of a proof end to end, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "")


def depth(n: int) -> int:
    """Levels above the leaves of a tree of ``n`` leaves."""
    d = 0
    while FAN**d < n:
        d += 1
    return d


def place(level: int, at: int, n: int) -> int:
    """How many nodes of a tree of ``n`` leaves are completed before the ``at``-th one of ``level``.

    Below and beside it, all that its leaves and those before them complete; above, only what ended before its first leaf.
    """
    end = min((at + 1) * FAN**level, n)
    under = sum(-(-end // FAN**h) for h in range(level))
    over = sum(at // FAN ** (h - level) for h in range(level + 1, depth(n) + 1))
    return under + at + over


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def completed(digests: list[str], levels: int) -> Iterator[tuple[int, int, str]]:
    """(level, index, digest) of the nodes over consecutive digests, in the order in which they are completed."""
    waiting: list[list[str]] = [[] for _ in range(levels + 1)]
    made = [0] * (levels + 1)
    for i, digest in enumerate(digests):
        level = 0
        while True:
            yield level, made[level], digest
            made[level] += 1
            waiting[level].append(digest)
            if level == levels or (len(waiting[level]) < FAN and i < len(digests) - 1):
                break
            digest = _hash("".join(waiting[level]))
            waiting[level] = []
            level += 1


def _builder(base: int):
    """Appends the nodes of one aligned subtree whose lowest nodes are of level ``base``; those themselves only at the bottom."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        tree, n, first = rows["tree"].iloc[0], int(rows["n"].iloc[0]), int(rows["at"].iloc[0])
        out = []
        for level, i, digest in completed(list(rows["digest"]), min(LEVELS, depth(n) - base)):
            if level or not base:
                at = first // FAN**level + i
                out.append((tree, n, base + level, at, place(base + level, at, n), digest))
        return pd.DataFrame(out, columns=["tree", "n", "level", "at", "place", "digest"])

    return build


def _reader(base: int, carried: list[str]):
    """Proofs of the nodes of level ``base`` under one subtree, from its part of the log and the proof of its top."""

    def read(rows: pa.Table, log: pa.Table) -> pa.Table:
        log = log.to_pylist()
        upper = next(x for x in log if x["root"] is not None)
        above = [(s["left"], s["right"]) for s in upper["above"]]
        at_place = {x["place"]: x["digest"] for x in log}
        proofs = []
        for at, n in zip(rows["at"].to_pylist(), rows["n"].to_pylist(), strict=True):
            proof = []
            for level in range(base, min(base + LEVELS, depth(n))):
                run, last = at - at % FAN, -(-n // FAN**level)
                find = lambda a, b: "".join(at_place[place(level, j, n)] for j in range(a, b))  # noqa: B023, E731
                proof.append((find(run, at), find(at + 1, min(run + FAN, last))))
                at //= FAN
            proofs.append([{"left": a, "right": b} for a, b in proof + above])
        out = rows.select(["tree", "at", "n", *carried])
        for name in ("subroot", "root"):
            out = out.append_column(name, pa.array([upper[name]] * len(proofs), pa.string()))
        return out.append_column("above", pa.array(proofs, pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))))

    return read


def ranked(rows: DataFrame, order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """``rows`` with ``at``, their number from 0 within ``tree`` by ``order``, and ``n``, the number of rows of the tree.

    One sort over all machines; rows are numbered within its parts, and the parts' counts summed.
    """
    sort = ["tree", *order]
    parts = scratch.save(rows.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("part", F.spark_partition_id()), f"{name}_sorted")
    counts = parts.groupBy("tree", "part").agg(F.count("*").alias("held"))
    before = F.sum("held").over(Window.partitionBy("tree").orderBy("part")) - F.col("held")
    counts = scratch.save(counts.select("tree", "part", before.alias("before"), F.sum("held").over(Window.partitionBy("tree")).alias("n")), f"{name}_counts")
    within = F.row_number().over(Window.partitionBy("tree", "part").orderBy(*order))
    numbered = parts.withColumn("within", within).join(counts, ["tree", "part"])
    return scratch.save(numbered.withColumn("at", F.col("before") + F.col("within") - 1).drop("part", "within", "before"), name)


def _depth(n: Column) -> Column:
    return F.size(F.filter(F.array(*[F.lit(FAN**k) for k in range(21)]), lambda x: x < n))


def append_log(leaves: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The log (tree, n, level, at, place, digest) of all trees over ``leaves`` (tree, at, n, digest)."""
    log, base, rows = None, 0, leaves
    deepest = depth(leaves.agg(F.max("n")).collect()[0][0] or 1)
    while base == 0 or base < deepest:
        cut = rows.withColumn("block", F.floor(F.col("at") / SPAN))
        made = scratch.save(cut.groupBy("tree", "block").applyInPandas(_builder(base), LOG), f"{name}_log{base}")
        log = made if log is None else log.unionByName(made)
        base += LEVELS
        rows = made.where((F.col("level") == base) & (_depth(F.col("n")) > base)).select("tree", "at", "n", "digest")
    return log


def proofs(leaves: DataFrame, log: DataFrame, top: DataFrame, carried: list[str], scratch: Scratch, name: str) -> DataFrame:
    """Proofs of ``leaves`` (tree, at, n and ``carried``), top down; ``top`` has (tree, subroot, root, above) of every tree.

    Every subtree's proof is found once, in the subtree over it, and handed down.
    """
    deepest = depth(leaves.agg(F.max("n")).collect()[0][0] or 1)
    base = max(0, (deepest - 1) // LEVELS * LEVELS)
    sizes = log.where("level = 0 AND at = 0").select("tree", F.greatest(F.lit(0), F.floor((_depth(F.col("n")) - 1) / LEVELS) * LEVELS).alias("last"))
    tops = top.join(sizes, "tree").withColumn("block", F.lit(0).cast("long"))
    below = None
    while True:
        upper = tops.where(F.col("last") == base).drop("last")
        if below is not None:
            upper = upper.unionByName(below.select("tree", F.col("at").alias("block"), "subroot", "root", "above"))
        nodes = log.where((F.col("level") >= base) & (F.col("level") < base + LEVELS))
        block = F.expr(f"at div shiftleft(1L, {FAN.bit_length() - 1} * ({base + LEVELS} - level))")
        part = nodes.select("tree", block.alias("block"), "place", "digest").unionByName(upper, allowMissingColumns=True)
        # a side of its own for Spark: columns with new names, as both sides come from the log
        own = [F.col(c).alias(c) for c in ("tree", "at", "n")]
        rows = leaves if not base else log.where((F.col("level") == base) & (_depth(F.col("n")) > base)).select(*own)
        rows = rows.withColumn("block", F.floor(F.col("at") / SPAN))
        kept = carried if not base else []
        schema = ", ".join(["tree string, at long, n long", *(f"`{c}` {leaves.schema[c].dataType.simpleString()}" for c in kept), TOP])
        found = rows.groupBy("tree", "block").cogroup(part.groupBy("tree", "block")).applyInArrow(_reader(base, kept), schema)
        if not base:
            return found
        below = scratch.save(found, f"{name}_proofs{base}")
        base -= LEVELS


def manifest(rows: DataFrame, by: str, key: str, digest: str, scratch: Scratch) -> DataFrame:
    """All columns of ``rows`` but ``by``, with subroot, root and proof.

    ``digest`` names the leaves' column; the result's own three names must be free, the helpers' too.
    """
    carried = [c for c in rows.columns if c != by]
    tree = F.when(F.col(by).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(by).cast("string")))
    leaves = rows.withColumns({"tree": tree, "digest": F.col(digest)}).drop(by)
    leaves = ranked(scratch.save(leaves, "hashed"), [key, "digest"], scratch, "leaves")
    log = append_log(leaves.select("tree", "at", "n", "digest"), scratch, "groups")
    subroots = log.where(F.col("level") == _depth(F.col("n"))).select(F.lit("").alias("tree"), F.col("tree").alias("group"), F.col("digest"))
    subroots = ranked(subroots, ["group"], scratch, "subroots")
    over = append_log(subroots.select("tree", "at", "n", "digest"), scratch, "root")
    root = over.where(F.col("level") == _depth(F.col("n"))).select("tree", F.lit("").alias("subroot"), F.col("digest").alias("root"), F.array().cast(PROOF).alias("above"))
    named = proofs(subroots, over, root, ["group", "digest"], scratch, "root")
    top = scratch.save(named.select(F.col("group").alias("tree"), F.col("digest").alias("subroot"), "root", "above"), "top")
    return proofs(leaves, log, top, carried, scratch, "groups").select(*carried, "subroot", "root", F.col("above").alias("proof"))
