"""The Merkle manifest against a plain version, and its odd rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lanegrid.llm import merkle
from lanegrid.runtime import Scratch


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def levels(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def proof(tree, i):
    out = ""
    for row in tree[:-1]:
        run = i - i % 8
        out += "".join(d for k, d in enumerate(row[run : run + 8], run) if k != i)
        i //= 8
    return out


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 64, 65, 513, 1000])
def test_places_are_postorder(n):
    log = list(merkle.completed([sha(str(i)) for i in range(n)], merkle.depth(n)))
    assert [merkle.place(level, at, n) for level, at, _ in log] == list(range(len(log)))
    assert log[-1][2] == levels([sha(str(i)) for i in range(n)])[-1][0]


def test_field(spark):
    rows = spark.createDataFrame([(1, "é€", None), (None, "", 5)], "a long, b string, c long")
    got = [r[0] for r in rows.select(merkle.leaf(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == [sha("1:15:é€-"), sha("-0:1:5")]


def check(rows, got):
    """rows: (key, group, digest); got: the manifest's rows, which must be those of plain trees."""
    groups = {}
    for key, group, digest in rows:
        groups.setdefault(group, []).append((key is not None, key or 0, digest))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([d for *_, d in sorted(groups[g])]) for g in order}
    top = levels([trees[g][-1][0] for g in order])
    expected = []
    for k, g in enumerate(order):
        for i, (there, key, digest) in enumerate(sorted(groups[g])):
            expected.append((key if there else None, digest, trees[g][-1][0], top[-1][0], proof(trees[g], i) + proof(top, k)))
    found = [(r["key"], r["digest_"], r["subroot"], r["root"], "".join(s["left"] + s["right"] for s in r["proof"])) for r in got]
    assert sorted(found, key=repr) == sorted(expected, key=repr)


def test_deep_trees(spark):
    """More leaves than one builder takes, groups beside them, and more groups than a node has children."""
    rows = [(i, "hot" if i < 6000 else f"g{i % 11}" if i % 97 else None, sha(str(i))) for i in range(6500)]
    frame = spark.createDataFrame(rows, "key long, group string, digest_ string")
    made = merkle.manifest(frame, "group", "key", "digest_", Scratch(spark))
    check(rows, made.collect())
    folded = made.select((merkle.fold(F.col("digest_"), F.col("proof")) == F.col("root")).alias("ok"), (merkle.fold(F.lit(sha("x")), F.col("proof")) == F.col("root")).alias("bad"))
    assert folded.where("NOT ok OR bad").count() == 0


def test_odd_rows(spark):
    rows = [(None, None, sha("a")), (3, "", sha("b")), (3, "", sha("b")), (3, "", sha("c")), (2**62 + 1, "é", sha("d")), (2**62, "é", sha("e")), (None, "z", sha("f"))]
    frame = spark.createDataFrame(rows, "key long, group string, digest_ string")
    check(rows, merkle.manifest(frame, "group", "key", "digest_", Scratch(spark)).collect())
    assert merkle.manifest(frame.limit(0), "group", "key", "digest_", Scratch(spark)).count() == 0
    long = spark.createDataFrame([(1, "x" * 3_000_000)], "a long, b string").select(merkle.leaf(F.col("a"), F.col("b"))).collect()[0][0]
    assert long == sha("1:13000000:" + "x" * 3_000_000)
