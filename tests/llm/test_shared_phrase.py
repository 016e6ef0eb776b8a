"""Decontamination when one phrase stands in every item and every document."""

import random

import pytest
from pyspark.sql import functions as F

from lanegrid.llm import decontaminate
from lanegrid.runtime import Scratch
from tests.llm import brute
from tests.llm.test_operators import prose


def shared(rng, n_docs, n_items):
    """Items of 17 and documents of 85 words around one phrase of 5; every tenth document holds an item's words around it."""
    phrase = prose(rng, 5)
    items = [f"{prose(rng, 6)} {phrase} {prose(rng, 6)}" for _ in range(n_items)]
    docs = []
    for i in range(n_docs):
        inner = " ".join(items[i % n_items].split()[2:13]) if i % 10 == 0 else phrase
        docs.append(f"{prose(rng, 40)} {inner} {prose(rng, 40)}")
    return docs, items


class Seen(Scratch):
    """Counts the candidates that are written."""

    def save(self, df, name):
        out = super().save(df, name)
        if name == "candidates":
            self.candidates = out.agg(F.sum(F.size("candidates"))).collect()[0][0]
        return out


def run(spark, docs, items):
    scratch = Seen(spark)
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame([(str(i), t) for i, t in enumerate(items)], "item_id string, text string")
    return scratch, {r["doc_id"]: r for r in decontaminate.annotate(table, bench, scratch).collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, seed):
    docs, items = shared(random.Random(seed), 30, 60)
    _, got = run(spark, docs, items)
    for i, text in enumerate(docs):
        _, hit, found = brute.contamination(text, [(str(k), t) for k, t in enumerate(items)])
        assert (got[i]["n_hit"], got[i]["items"]) == (hit, sorted(found))


def test_candidates_grow_with_the_documents(spark):
    """Twice the documents and items: about twice the candidates, not four times."""
    sizes = []
    for n in (300, 600):
        docs, items = shared(random.Random(7), n, n)
        scratch, got = run(spark, docs, items)
        sizes.append(scratch.candidates)
        assert sum(r["n_hit"] > 0 for r in got.values()) == n // 10
    assert sizes[1] < 3 * sizes[0] and sizes[1] < 40 * 600
