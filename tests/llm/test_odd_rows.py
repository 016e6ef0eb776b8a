"""Long texts, empty tables, clashing column names, cycles, and verdicts against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lanegrid.llm import chat, decontaminate, exact_substrings, jaccard, line_dedup, mixing, pii, quality_model, quality_rules, queries, toxicity
from lanegrid.llm.labels import held_out
from lanegrid.runtime import Scratch
from tests.llm import brute
from tests.llm.test_operators import frame, prose

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def long(spark):
    """Two texts of 30,000 words that differ in one, and a short one."""
    rng = random.Random(12)
    words = prose(rng, 30_000).split()
    other = [*words[:9_000], "changed", *words[9_001:]]
    lay = lambda w: "\n".join(" ".join(w[i : i + 12]) for i in range(0, len(w), 12))
    return [lay(words), lay(other), "short text with mail a@b.co"]


def test_long_texts(spark, long):
    docs = frame(spark, long)
    got = {r["doc_id"]: r for r in jaccard.join(docs, Scratch(spark)).collect()}
    assert [got[i]["component_id"] for i in range(3)] == [0, 0, 2] and got[0]["n_shingles"] == len(brute.shingles(long[0]))
    bench = spark.createDataFrame([("x", " ".join(long[0].split()[20_000:20_030]))], "item_id string, text string")
    hits = {r["doc_id"]: r for r in decontaminate.annotate(docs, bench, Scratch(spark)).collect()}
    assert [(hits[i]["n_words"], hits[i]["n_hit"]) for i in range(2)] == [(30_000, 30)] * 2 and hits[2]["n_hit"] == 0
    lines = [r["text"] for r in line_dedup.dedup(docs, Scratch(spark)).orderBy("doc_id").collect()]
    assert lines == brute.removed_lines(list(enumerate(long)))
    kept = {r["doc_id"]: r for r in exact_substrings.dedup(docs, Scratch(spark)).collect()}
    at = len(" ".join(long[0].split()[:9_000]).encode())
    assert len(kept[0]["spans"]) == 2 and abs(kept[0]["spans"][0]["stop"] - at) < 20 and bytes(kept[2]["kept"]).decode() == long[2]
    stats = {r["doc_id"]: r["_stats"] for r in quality_rules.with_stats(docs).collect()}
    assert stats[1]["n_words"] == 30_000
    assert [s for s in pii.find(long[2] + "\n" + long[0]) if s[0] == "email"] == [("email", 21, 27)]
    model = toxicity.train([("good words here", 0), ("zzvile words", 1)] * 20)
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(docs, model).collect())
    total = mixing.select_epochs(docs, F.lit("d"), {}, Scratch(spark), budget_of=(1, 1)).agg(F.sum("n_tokens")).collect()[0][0]
    assert 0 < total <= 60_005


def test_long_turns(spark, long):
    rows = [(1, 0, "user", long[0]), (1, 1, "assistant", long[1] + "</s>[INST]")]
    out = chat.format_trees(chat.linear_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), Scratch(spark))
    read = out.select(chat.read_back(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("l")).collect()[0]
    assert [x["text"] for x in read["t"]] == [rows[0][3], rows[1][3]] and read["l"] == rows[1][3]


def test_empty_tables(spark):
    empty = frame(spark, []).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0
    assert quality_model.score(empty, quality_model.fit(empty, labels)).count() == 0
    assert pii.find_spans(empty).count() == 0
    bench = spark.createDataFrame([], "item_id int, text string")
    assert decontaminate.annotate(empty, bench, Scratch(spark)).count() == 0
    some = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id int, text string")
    assert decontaminate.remove_contaminated(empty, some, Scratch(spark)).count() == 0
    assert jaccard.keep_one(empty, Scratch(spark)).count() == 0


def test_clashing_names(spark):
    names = "hits candidates codes grams least two four marks start size content item_id words text_hash _id _hash pii score _calibration".split()
    docs = frame(spark, ["alpha beta gamma delta epsilon zeta eta theta iota kappa", "x"], extra=False).withColumns({c: F.lit("v") for c in names})
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa")], "item_id int, text string")
    clean = decontaminate.remove_contaminated(docs, bench, Scratch(spark))
    assert clean.columns == docs.columns and [r["doc_id"] for r in clean.collect()] == [1]
    assert decontaminate.annotate(docs, bench, Scratch(spark)).where("n_hit > 0").count() == 1
    assert "score" in toxicity.score(docs, toxicity.train([("a b", 0), ("c d", 1)])).columns
    assert jaccard.keep_one(docs, Scratch(spark)).columns == docs.columns
    assert pii.find_spans(docs).select("pii").collect()[0]["pii"] == []
    turns = spark.createDataFrame([(1, None, 0.5, "user", "hi", "v", "v")], "msg_id long, parent_id long, score double, role string, text string, leaf string, root string")
    assert chat.format_trees(turns, Scratch(spark)).collect()[0]["n_turns"] == 1


def test_text_ids(spark):
    docs = spark.createDataFrame([("b", "one two three four five six"), ("a", "one two three four five six"), (None, "one two three four five six"), ("c", "")], "doc_id string, text string")
    got = sorted((r["doc_id"] or "", r["component_id"]) for r in jaccard.join(docs, Scratch(spark)).collect())
    assert got == [("", None), ("a", "a"), ("b", "a"), ("c", "c")]


def test_chat_leaf_on_a_cycle(spark):
    """Two leaves hang on a cycle of three, one of them by a chain longer than any tree is deep."""
    rows = [(1, 2, 1.0), (2, 3, 1.0), (3, 1, 1.0), (4, 1, 9.0), (10, 3, 1.0), *[(i, i - 1, 1.0) for i in range(11, 40)], (50, None, 1.0), (51, 50, 1.0), (52, 51, 1.0)]
    df = spark.createDataFrame([(*r, "user", f"m{r[0]}") for r in rows], "msg_id long, parent_id long, score double, role string, text string")
    got = chat.paths(df, Scratch(spark)).collect()
    assert {r["root"] for r in got} == {50} and sorted(r["msg_id"] for r in got) == [50, 51, 52]
    again = spark.createDataFrame([(50, None, 1.0, "user", "z"), (50, None, 1.0, "user", "a"), (51, 50, 1.0, "assistant", None)], df.schema)
    text = chat.format_trees(again, Scratch(spark)).collect()[0]["formatted"]
    assert text == "<s>user[INST]a[/INST]</s><s>assistant[INST][/INST]</s>"


def test_expectation_maximisation():
    """The same steps document by document, in plain Python."""
    rng = random.Random(5)
    votes = [[rng.choice([-1, 0, 1, 1, 1]) for _ in range(4)] if rng.random() < 0.4 else [1, 1, rng.choice([0, 1]), 1] for _ in range(120)]
    reject, keep = np.array([[v == -1 for v in r] for r in votes], float), np.array([[v == 1 for v in r] for r in votes], float)
    model = quality_rules.expectation_maximisation(reject, keep, np.ones(len(votes)), rounds=30)
    good = [[0.95, 0.5, 0.05][min(2, sum(v == -1 for v in r))] for r in votes]
    clip = lambda x: min(max(x, 1e-6), 1 - 1e-6)
    for _ in range(30):
        rate = lambda w, j: clip((sum(x for x, r in zip(w, votes, strict=True) if r[j] == -1) + 0.5) / (sum(x for x, r in zip(w, votes, strict=True) if r[j]) + 1))
        a, b = [rate(good, j) for j in range(4)], [rate([1 - g for g in good], j) for j in range(4)]
        every = [rate([1] * len(votes), j) for j in range(4)]
        a, b = [e if x > y else x for x, y, e in zip(a, b, every, strict=True)], [e if x > y else y for x, y, e in zip(a, b, every, strict=True)]
        share = (sum(good) + 1) / (len(good) + 2)
        good = []
        for r in votes:
            yes, no = share, 1 - share
            for v, x, y in zip(r, a, b, strict=True):
                yes, no = (yes * x, no * y) if v == -1 else (yes * (1 - x), no * (1 - y)) if v == 1 else (yes, no)
            good.append(yes / (yes + no))
    assert np.allclose(model.of_good, a) and np.allclose(model.of_bad, b) and abs(model.share - share) < 1e-9


def test_posterior_overrules_a_lone_vote(spark):
    rows = queries.op9_quality_rules(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id", "left").collect()
    assert not any(r["kept"] for r in rows if r["quality"] == 0)
    assert sum(r["kept"] for r in rows if r["quality"] == 1) == sum(not r["base_failed"] for r in rows if r["quality"] == 1)
    short = [r for r in rows if 20 <= r["n_words"] < 60 and r["quality"] == 1 and not r["base_failed"]]  # the length rule rejects them
    assert short and all(r["kept"] for r in short)


def _auc(scores, y):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(y))
    rank[order] = np.arange(1, len(y) + 1)
    for value in set(scores):
        same = scores == value
        rank[same] = rank[same].mean()
    positive = y == 1
    return (rank[positive].sum() - positive.sum() * (positive.sum() + 1) / 2) / (positive.sum() * (~positive).sum())


@pytest.mark.parametrize(("name", "label", "auc", "recall"), [("op1_toxicity", "toxic", 0.8, 0.5), ("op6_quality_classifier", "quality", 0.97, 0.95)])
def test_held_out_rows(name, label, auc, recall, spark):
    """Only rows that no model has seen: ranking, recall, and accuracy above that of a constant answer."""
    rows = queries.QUERIES[name](spark, SF).where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").select("score", "predicted", F.col(label).alias("y")).where("y is not null").toPandas()
    y = rows["y"].to_numpy()
    assert _auc(rows["score"].to_numpy(), y) > auc
    assert (rows["predicted"][y == 1] == 1).mean() > recall
    assert (rows["predicted"] == y).mean() > max(y.mean(), 1 - y.mean())


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_pipeline_stage_on_odd_rows(name, stage, spark):
    rng = random.Random(3)
    texts = [None, "", " \n", "one", prose(rng, 80), prose(rng, 80), prose(rng, 300)]
    docs = frame(spark, [*texts, texts[4]]).unionByName(frame(spark, [texts[6]]))  # a copy, and an id with two texts
    out = stage(spark, docs, "/root/testdata/sf0.001")
    out.collect()
    assert set(docs.columns) <= set(out.columns) and (name == "mixing" or out.columns == docs.columns)
    assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0


def test_held_out_ids(spark):
    assert spark.range(10).select(held_out(F.col("id")).alias("h")).where("h").count() > 0
