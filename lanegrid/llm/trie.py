"""A prefix trie of conversations: how many share each beginning, and what sharing would save.

Turns (role, text) get ids from a dictionary in the order of role and text. Equal sequences of ids
are combined before anything else, so that a conversation that is copied often is one row. The
distinct sequences are sorted over all machines by ranges; each range is a shard of a bounded
number of turns and builds a ternary search tree: a node has a turn, links to smaller and larger
turns after the same beginning, and one to the turns that follow it. Sequences are inserted median first,
which keeps those links short. A traversal without recursion lists the nodes in order and adds up,
from the last to the first, members, childless nodes and savings.

Only beginnings of a shard's first or last sequence can also stand in other shards. Such boundary
nodes are merged in two sums: first members, children and ends by beginning; then each shard adds up, along
its two outer paths, what hangs below them, where every boundary node's own share counts
in one shard only, and these sums are added by beginning. Rows of this step grow with the shards,
not with the conversations.

The digest of a node's ends is taken in passing over its sorted members, which are first joined to
pieces of at most PIECE ids; a node in which a third of all conversations end is read as such pieces, one after
another, and never held.

Defined results: null roles and texts are empty; turns are ordered by number, null first, then by
role and text; repeated rows are turns of their own; rows without a conv_id are left out;
conversations without turns are members of the root; texts of any length count whole; other columns are not
read, whatever their names; an empty table has no nodes. One conversation's ids (8 bytes a turn) are held in one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanegrid.llm.merkle import ranked
from lanegrid.llm.sizes import join_counted
from lanegrid.runtime import Scratch

SHARD_TURNS = 200_000
PIECE = 1000
NODES = "shard int, boundary boolean, key binary, parent_key binary, parent_conv_id long, depth long, chars long, n_convs long, conv_id long, ends string, n_children long, n_leaves long, saved long"
_NAMES = [c.split()[0] for c in NODES.split(", ")]
NO_ENDS = hashlib.sha256(b"").hexdigest()


def encode_turns(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, at, turn_id, chars): the turns of each conversation, numbered from 0, as dictionary ids."""
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", empty("role"), empty("text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)).alias("digest")
    rows = scratch.save(rows.select("*", digest), "turns")
    known = rows.groupBy("digest").agg(F.min("role").alias("role"), F.min("text").alias("text"))
    known = scratch.save(known, "distinct_turns").repartitionByRange("role", "text").sortWithinPartitions("role", "text")
    known = scratch.save(known.select("digest", F.monotonically_increasing_id().alias("turn_id"), F.length("text").cast("long").alias("chars")), "dictionary")
    coded = scratch.save(rows.select("conv_id", "turn", "digest"), "coded")
    coded = coded.join(known, "digest").select(F.col("conv_id").alias("tree"), "turn", "turn_id", "chars")
    return ranked(coded, ["turn", "turn_id"], scratch, "numbered").select(F.col("tree").alias("conv_id"), "at", "turn_id", "chars")


def rebuild(turns: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """(conv_id, ids, chars): each conversation with its first h turns taken from the first of its ``every`` neighbours, h = crc32 of its id modulo ``most``."""
    heads = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most))
    convs = turns.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % every).alias("base"), heads.alias("heads"))
    first = turns.where((F.col("conv_id") % every == 0) & (F.col("at") < most - 1)).withColumnRenamed("conv_id", "base")
    lent = convs.join(first, "base").where("at < heads").select("conv_id", "at", "turn_id", "chars")
    own = turns.where(F.col("at") >= heads)
    listed = lent.unionByName(own).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "turn_id", "chars"))).alias("t"))
    none = F.array().cast("array<long>")
    return convs.select("conv_id").join(listed, "conv_id", "left").select("conv_id", F.coalesce("t.turn_id", none).alias("ids"), F.coalesce("t.chars", none).alias("chars"))


def sequences(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """(ids, chars, n_convs, conv_id, ends) of the distinct sequences of ``conversations`` (conv_id, ids, chars)."""
    name = F.unhex(F.sha2(F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").cast("binary"), 256))
    members = scratch.save(conversations.withColumn("name", name), "members")
    combined = members.groupBy("name").agg(F.first("ids").alias("ids"), F.first("chars").alias("chars"), F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    ids = scratch.save(members.select("name", "conv_id"), "member_ids").repartitionByRange("name", "conv_id").sortWithinPartitions("name", "conv_id")
    pieces = scratch.save(ids.mapInPandas(_pieces, "name binary, first long, listed string"), "pieces")
    ends = pieces.repartition("name").sortWithinPartitions("name", "first").mapInPandas(_ends, "name binary, ends string")
    return scratch.save(combined.join(ends, "name").drop("name"), "sequences")


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted ids of each name, joined in runs of at most PIECE."""
    for rows in batches:
        out, start, names, ids = [], 0, list(rows["name"]), list(rows["conv_id"])
        for i in range(1, len(ids) + 1):
            if i == len(ids) or names[i] != names[start] or i - start == PIECE:
                out.append((names[start], ids[start], ",".join(map(str, ids[start:i]))))
                start = i
        yield pd.DataFrame(out, columns=["name", "first", "listed"])


def _ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The digest of each name's pieces, comma-joined, in passing."""
    name, sha = None, None
    for rows in batches:
        out = []
        for key, listed in zip(map(bytes, rows["name"]), rows["listed"], strict=True):
            if key == name:
                sha.update(b",")
            else:
                if sha:
                    out.append((name, sha.hexdigest()))
                name, sha = key, hashlib.sha256()
            sha.update(listed.encode())
        yield pd.DataFrame(out, columns=["name", "ends"])
    if sha:
        yield pd.DataFrame([(name, sha.hexdigest())], columns=["name", "ends"])


class SearchTree:
    """A ternary search tree over sequences of turn ids; node 0 is the root, which has no turn."""

    def __init__(self) -> None:
        self.turn, self.smaller, self.larger, self.below, self.parent = [-1], [0], [0], [0], [0]
        self.depth, self.chars, self.members, self.least, self.ends = [0], [0], [0], [None], [None]

    def _add(self, turn: int, parent: int, chars: int) -> int:
        for field, value in ((self.turn, turn), (self.smaller, 0), (self.larger, 0), (self.below, 0), (self.parent, parent), (self.depth, self.depth[parent] + 1), (self.chars, chars), (self.members, 0), (self.least, None), (self.ends, None)):
            field.append(value)
        return len(self.turn) - 1

    def child(self, node: int, turn: int, chars: int) -> int:
        """The node of ``turn`` after ``node``, made if there is none."""
        links, at = self.below, node
        while nxt := links[at]:
            if self.turn[nxt] == turn:
                return nxt
            links, at = (self.smaller, nxt) if turn < self.turn[nxt] else (self.larger, nxt)
        links[at] = self._add(turn, node, chars)
        return links[at]

    def insert(self, ids: list[int], chars: list[int], n: int, least: int, ends: str) -> int:
        node = 0
        for depth in range(len(ids) + 1):
            if depth:
                node = self.child(node, ids[depth - 1], chars[depth - 1])
            self.members[node] += n
            self.least[node] = least if self.least[node] is None else min(self.least[node], least)
        self.ends[node] = ends
        return node

    def in_order(self) -> list[int]:
        """All nodes, each before those below it, siblings by turn."""
        out, stack = [0], [(self.below[0], False)]
        while stack:
            node, passed = stack.pop()
            if not node:
                continue
            if passed:
                out.append(node)
                stack.append((self.below[node], False))
            else:
                stack += [(self.larger[node], False), (node, True), (self.smaller[node], False)]
        return out

    def path(self, node: int) -> list[int]:
        """The node and those above it, without the root."""
        out = []
        while node:
            out.append(node)
            node = self.parent[node]
        return out


def medians(n: int) -> Iterator[int]:
    """0 to n - 1, the middle before the halves."""
    stack = [(0, n)]
    while stack:
        a, b = stack.pop()
        if a < b:
            yield (a + b) // 2
            stack += [((a + b) // 2 + 1, b), (a, (a + b) // 2)]


def _shard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Nodes of one shard's sorted sequences; boundary nodes with what hangs below them inside the shard only."""
    rows = [r for batch in batches for r in batch[["ids", "chars", "n_convs", "conv_id", "ends"]].itertuples(index=False)]
    if not rows:
        return
    shard, tree, last = TaskContext.get().partitionId(), SearchTree(), {}
    for i in medians(len(rows)):
        node = tree.insert(list(map(int, rows[i].ids)), list(map(int, rows[i].chars)), int(rows[i].n_convs), int(rows[i].conv_id), rows[i].ends)
        if i in (0, len(rows) - 1):
            last[i] = node
    keys = {0: hashlib.sha256(b"").digest()}
    for node in sorted({x for end in last.values() for x in tree.path(end)}, key=tree.depth.__getitem__):
        keys[node] = hashlib.sha256(keys[tree.parent[node]] + tree.turn[node].to_bytes(8, "big")).digest()
    size = len(tree.turn)
    children, leaves, saved = [0] * size, [0] * size, [0] * size
    order = tree.in_order()
    for node in reversed(order):
        if node in keys:
            continue
        leaves[node] += not children[node]
        saved[node] += (tree.members[node] - 1) * tree.chars[node]
        up = tree.parent[node]
        children[up] += 1
        leaves[up] += leaves[node]
        saved[up] += saved[node]
    out = []
    for node in order:
        up, outer = tree.parent[node], node in keys
        above = keys.get(up) if node else None
        out.append((shard, outer, keys.get(node), above, None if above or not node else tree.least[up], tree.depth[node], tree.chars[node], tree.members[node], tree.least[node], tree.ends[node], children[node], leaves[node], saved[node]))
        if len(out) == 10_000:
            yield _frame(out)
            out = []
    yield _frame(out)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=_NAMES)
    frame["parent_conv_id"] = frame["parent_conv_id"].astype("Int64")
    return frame


def _along_paths(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums at and below each boundary node of a shard."""
    rows = rows.sort_values("depth", ascending=False)
    keys, parents = list(map(bytes, rows["key"])), [None if p is None else bytes(p) for p in rows["parent_key"]]
    leaves = dict(zip(keys, map(int, rows["n_leaves"]), strict=True))
    saved = dict(zip(keys, map(int, rows["saved"]), strict=True))
    for key, parent in zip(keys, parents, strict=True):
        if parent is not None:
            leaves[parent] += leaves[key]
            saved[parent] += saved[key]
    return pd.DataFrame({"key": keys, "n_leaves": [leaves[k] for k in keys], "saved": [saved[k] for k in keys]})


def nodes(sequences: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends) of the trie over ``sequences``."""
    turns = sequences.agg(F.sum(F.size("ids") + 1)).collect()[0][0] or 0
    shards = max(int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-turns // SHARD_TURNS))
    made = scratch.save(sequences.repartitionByRange(shards, "ids").sortWithinPartitions("ids").mapInPandas(_shard, NODES), "shards")
    outer = scratch.save(made.where("boundary"), "boundary")
    merged = outer.groupBy("key").agg(
        F.min("parent_key").alias("parent_key"), F.min("depth").alias("depth"), F.max("chars").alias("chars"), F.sum("n_convs").alias("n_convs"),
        F.min("conv_id").alias("conv_id"), F.max("ends").alias("ends"), F.sum("n_children").alias("inner"), F.min("shard").alias("owner"),
    )
    merged = scratch.save(merged, "merged_members")
    followers = merged.where("parent_key IS NOT NULL").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("outer"))
    merged = scratch.save(merged.join(followers, "key", "left").withColumn("n_children", F.col("inner") + F.coalesce("outer", F.lit(0))), "merged")
    own = merged.select("key", F.col("owner").alias("shard"), (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("chars")).alias("more"))
    shares = outer.join(own, ["key", "shard"], "left").select(
        "shard", "key", "parent_key", "depth", (F.col("n_leaves") + F.coalesce("leaf", F.lit(0))).alias("n_leaves"), (F.col("saved") + F.coalesce("more", F.lit(0))).alias("saved")
    )
    sums = shares.groupBy("shard").applyInPandas(_along_paths, "key binary, n_leaves long, saved long")
    sums = sums.groupBy("key").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    above = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    outer_nodes = merged.join(sums, "key").join(above, "parent_key", "left")
    inner = made.where("NOT boundary").withColumnRenamed("saved", "saved_tokens")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    edge = join_counted(inner.where("parent_key IS NOT NULL").drop("parent_conv_id"), above, ["parent_key"], spread="conv_id")
    parts = [outer_nodes.select(*columns), edge.select(*columns), inner.where("parent_key IS NULL").select(*columns)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("ends", F.coalesce("ends", F.lit(NO_ENDS)))
