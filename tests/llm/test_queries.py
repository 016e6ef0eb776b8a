"""The registered corpus queries: SQL twins, brute force, and the pipeline."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lanegrid.llm import queries
from tests.compare import assert_same
from tests.conftest import SF
from tests.llm import brute


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twin(name, spark, duck):
    assert_same(queries.QUERIES[name](spark, SF), duck, queries.ORACLES[name])


def test_pii_query(spark, texts):
    for r in queries.op7_pii(spark, SF).collect():
        base = brute.base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(sum(k == kind for k, _, _ in base) for kind in ("email", "ip", "card", "phone"))


def test_exact_substring_query(spark, texts):
    ids = sorted(texts)
    masks = dict(zip(ids, brute.removed_bytes([texts[i] for i in ids]), strict=True))
    for r in queries.op8_exact_substrings(spark, SF).collect():
        raw, mask = masks[r["doc_id"]]
        assert (r["n_bytes"], r["n_removed"]) == (len(raw), sum(mask))
        assert r["n_spans"] == sum(1 for i in range(len(mask)) if mask[i] and not (i and mask[i - 1]))
        assert r["kept_sha256"] == hashlib.sha256(bytes(b for b, m in zip(raw, mask, strict=True) if not m)).hexdigest()


def test_quality_rules_query(spark, texts):
    for r in queries.op9_quality_rules(spark, SF).collect():
        stats = brute.text_stats(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == stats
        assert r["base_failed"] == (stats[0] < 20 or 100 * stats[4] > 30 * stats[0])
        assert not (r["base_failed"] and r["kept"])


@pytest.mark.parametrize(("name", "label"), [("op1_toxicity", "toxic"), ("op6_quality_classifier", "quality")])
def test_classifier_queries(name, label, spark):
    rows = queries.QUERIES[name](spark, SF)
    assert rows.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    judged = rows.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").select((F.col("predicted") == F.col(label)).cast("int").alias("ok"))
    assert judged.agg(F.avg("ok")).collect()[0][0] > 0.85


def test_pipeline_stage_by_stage(spark, texts, duck):
    """Each stage on what its predecessor kept, against brute force."""
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    docs = documents
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = corpus_pipeline.Scratch(spark).save(stage(spark, docs, SF), f"t{i}")
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name != "mixing":
            assert docs.columns == documents.columns
        if name == "quality_rules":
            failed = {k for k, t in before.items() if (s := brute.text_stats(t))[0] < 20 or 100 * s[4] > 30 * s[0]}
            assert after.items() <= before.items() and not failed & set(after)
            assert len(after) > 0.6 * len(before)
        elif name == "line_dedup":
            ids = sorted(before)
            kept = dict(zip(ids, brute.removed_lines([(k, before[k]) for k in ids]), strict=True))
            assert after == {k: t for k, t in kept.items() if t == before[k] or (t and t.split())}
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect() if r["text"] != before[r["doc_id"]])
        elif name == "jaccard_join":
            assert set(after) == {k for k, c in brute.jaccard_components(before).items() if k == c}
        elif name == "decontamination":
            assert set(after) == {k for k, t in before.items() if not brute.contamination(t, bench)[1]}
        else:
            tokens = {k: len(brute.SPACE_WORDS.findall(t or "")) for k, t in before.items()}
            spent = docs.agg(F.sum("n_tokens")).collect()[0][0]
            assert 0.4 * sum(tokens.values()) < spent <= sum(tokens.values()) * 3 // 5
            assert all(r["n_tokens"] == tokens[r["doc_id"]] for r in docs.collect())
