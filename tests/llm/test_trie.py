"""The conversation trie against plain dictionaries, on hot groups, shards that cut nodes, and odd rows."""

import hashlib
import random
import zlib

import pytest

from lanegrid.llm import trie
from lanegrid.runtime import Scratch


def rebuilt(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    heads = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    return {c: own.get(c - c % 100, [])[: heads[c]] + own[c][heads[c] :] for c in own}


def plain(conversations):
    """{path: row} with every node worked out by itself."""
    members = {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, own in members.items():
        below = [p for p in members if p[: len(path)] == path]
        kids = lambda q: [p for p in members if len(p) == len(q) + 1 and p[: len(q)] == q]
        ends = ",".join(str(c) for c in sorted(own) if len(conversations[c]) == len(path))
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p)
        out.append((min(own), len(path), min(members[path[:-1]]) if path else None, len(own), len(kids(path)), sum(not kids(p) for p in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def made(spark, rows, schema="conv_id long, turn long, role string, text string"):
    scratch = Scratch(spark)
    turns = trie.encode_turns(spark.createDataFrame(rows, schema), scratch)
    out = trie.nodes(trie.sequences(trie.rebuild(turns), scratch), scratch)
    return sorted((tuple(r) for r in out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends").collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain(spark, seed):
    """Few texts, so that shards cut through nodes; a third of all conversations are equal."""
    rng = random.Random(seed)
    rows = []
    for c in range(240):
        texts = ["same", "é€"] if c % 3 == 0 else [rng.choice("abc") * rng.randint(1, 2) for _ in range(rng.randint(1, 7))]
        rows += [(c * 7, i, rng.choice(["user", "bot"]) if c % 3 else "user", t) for i, t in enumerate(texts)]
    assert made(spark, rows) == plain(rebuilt(rows))


def test_odd_rows(spark):
    """Nulls in every column, repeated rows and turn numbers, conversations left without turns, a long text and a long conversation."""
    rows = [(None, 0, "user", "x"), (5, None, None, None), (5, 0, "b", "y"), (5, 0, "a", "y"), (5, 0, "a", "y"), (101, 0, "u", "t" * 200_000), (100, 0, "u", "first")]
    rows += [(c, 0, "u", "only") for c in range(900, 930)] + [(300, i, "u", str(i)) for i in range(150)] + [(2**53 + 1, 0, "u", "only")]
    assert made(spark, rows) == plain(rebuilt(rows))
    assert made(spark, []) == []


def test_search_tree_is_balanced():
    tree = trie.SearchTree()
    for i in trie.medians(1023):
        tree.insert([i], [1], 1, i, "")
    deepest, stack = 0, [(tree.below[0], 1)]
    while stack:
        node, d = stack.pop()
        deepest = max(deepest, d)
        stack += [(x, d + 1) for x in (tree.smaller[node], tree.larger[node]) if x]
    assert deepest == 10 and [tree.turn[x] for x in tree.in_order()] == [-1, *range(1023)]
