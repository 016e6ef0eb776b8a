"""Byte-level BPE against the library whose ids it must give, on whole texts and odd ones."""

import hashlib
import random
import struct

import public_tokenizers as vocabulary
import pytest
import tiktoken
from pyspark.sql import functions as F

from lanegrid.llm import bpe, queries
from lanegrid.runtime import Scratch

FILE = vocabulary.path("byte_bpe_multi_50k.tiktoken")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain():
    return tiktoken.Encoding("own", pat_str=vocabulary.PATTERN, mergeable_ranks=bpe.load(FILE), special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(FILE, vocabulary.PATTERN)


def odd_texts():
    rng = random.Random(4)
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    texts = [None, "", " ", "\n\n", "a" * 1200, "ab" * 500, "x" * 64, "x" * 65, "aaa bbb\n\n  ccc\t\t x", "naïve café €𝄞 中文字符", " 　x  y\u0085z"]
    texts += ["<|endoftext|> it's we'LL 12345 !!??", "\x00\x01\x7f�", "é" * 300, pick("etaoin", 1500), pick("etaoinshrdlué中", 800)]
    texts += [pick("etaoinshrdlu", rng.randint(1, 90)) for _ in range(60)]
    return texts + [" ".join(texts[-60:]), texts[-1], texts[-1]]


@pytest.mark.parametrize("cached", [0, bpe.CACHED_WORDS])
def test_odd_texts(spark, codec, plain, cached):
    """Cached words or none: the same ids; nulls, long words, repeats, clashing names."""
    frame = spark.createDataFrame([(i, t, "own") for i, t in enumerate(odd_texts())], "doc_id long, text string, _known string")
    made = codec.encode(frame, Scratch(spark), cached=cached)
    assert made.columns == ["doc_id", "text", "_known", "ids"]
    for r in made.withColumn("raw", codec.decode(F.col("ids"))).withColumn("le", bpe.little_endian(F.col("ids"))).collect():
        expected = plain.encode_ordinary(r["text"] or "")
        assert r["ids"] == expected, r["doc_id"]
        assert bytes(r["raw"]) == (r["text"] or "").encode() and bytes(r["le"]) == struct.pack(f"<{len(expected)}I", *expected)
        assert r["_known"] == "own"


def test_empty_table(spark, codec):
    assert codec.encode(spark.createDataFrame([], "doc_id long, text string"), Scratch(spark)).count() == 0


def test_merges_that_make_lower_ranks(spark, tmp_path):
    """A vocabulary in which a merge opens a pair of a lower rank: one place at a time, in long words too."""
    import base64

    pieces = [bytes([b]) for b in range(256)] + [b"bca", b"ab", b"abc", b"ca", b"bc", b"abab"]
    order = {p: i for i, p in enumerate(pieces)}
    order[b"abc"], order[b"ab"] = order[b"ab"], order[b"abc"]
    path = tmp_path / "ranks"
    path.write_text("\n".join(f"{base64.b64encode(p).decode()} {r}" for p, r in order.items()))
    own, check = bpe.Codec(str(path), vocabulary.PATTERN), tiktoken.Encoding("x", pat_str=vocabulary.PATTERN, mergeable_ranks=order, special_tokens={})
    rng = random.Random(8)
    texts = ["".join(rng.choice("abc") for _ in range(n)) for n in (3, 9, 40, 64, 65, 250)]
    rows = own.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), Scratch(spark)).collect()
    assert all(r["ids"] == check.encode_ordinary(r["text"]) for r in rows)


def test_full_buckets(spark, codec, plain):
    """All known words in one bucket: the most frequent ones are found, those beyond the tried places are folded."""
    words = ["oronthan", "zzqar", "ileandor", "rathonwe", "ouxelqu", "tzefgro", "wholnde", "essarnt", "beqiln", "gnurrof"]
    frame = spark.createDataFrame([(" ".join(w for i, w in enumerate(words) for _ in range(i + 2)),)], "text string")
    folded = codec.frequent(frame, "text", Scratch(spark))
    known = frame.withColumn("k", codec.known_words(folded, 1)).cache()
    kept = known.select("k.all.words").collect()[0]["words"]
    assert [w.strip() for w in kept[:2]] == ["gnurrof", "beqiln"]
    ids = known.select(F.flatten(codec.encode_words(codec.words(F.col("text")), F.col("k"), 1)).alias("ids")).collect()[0]["ids"]
    assert ids == plain.encode_ordinary(frame.collect()[0]["text"])


def test_steps_without_costly_forms(spark, codec):
    """No step of a fold looks for a number by value, which Spark ends by an exception, or gets a transformed array's item, whose type it works out each time."""
    state = F.struct(F.array("id").alias("all"), F.col("id").alias("starts"))
    step = spark.range(1).select(codec._step(codec._literal(), state))._jdf.queryExecution().analyzed().toString()
    narrow = spark.range(1).select(bpe._let(F.col("id"), lambda x: x + x))._jdf.queryExecution().analyzed().toString()
    assert "aggregate(" in narrow and "transform(" not in narrow
    assert "array_position(" not in step and "transform(" not in step


def test_query(spark, plain):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op12_bpe(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = plain.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
