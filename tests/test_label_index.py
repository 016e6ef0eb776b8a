"""The label index against every label compared with every name."""

import difflib
import random
import re
from dataclasses import replace

import numpy as np
import pytest

from lanegrid.operators import label_index as ix
from lanegrid.operators import labels as op
from lanegrid.plans import dims


def plain(text):
    return re.sub(r"\s+", " ", re.sub("[^a-z0-9 ]", " ", text.lower())).strip()


def words(text):
    return {w for w in text.split() if len(w) >= 2}


def ladder(label, names, limits):
    """(value, confidence, method) or None; names: [(known, value)] in order."""
    n, table = plain(label), dict(names)
    bare = plain(" ".join(w for w in n.split() if w not in ix.NOISE) or n)
    for form, sure, method in ((n, 1.0, "exact"), (bare, 0.95, "normalised")):
        if form in table:
            return table[form], sure, method
    if not n:
        return None
    for known, value in names:
        if (n in known or known in n) and min(len(n), len(known)) / max(len(n), len(known)) >= limits.inside:
            return value, 0.85, "substring"
    best, at = 0.0, None
    for known, value in names:
        share = len(words(n) & words(known)) / max(len(words(n)), len(words(known)), 1)
        if share > best:
            best, at = share, (value,)
    if best >= limits.common:
        return at[0], limits.by_words, "token"
    near = difflib.get_close_matches(n, [k for k, _ in names], n=1, cutoff=limits.cutoff) if len(n) >= 5 else []
    if near:
        confidence = round(difflib.SequenceMatcher(None, n, near[0]).ratio() * limits.weight, 3)
        if confidence >= limits.least:
            return table[near[0]], confidence, "fuzzy"
    return None


def misspelt(rng, text):
    for _ in range(rng.randint(0, 4)):
        i = rng.randrange(len(text) + 1)
        text = rng.choice([text[:i] + rng.choice("aeost ") + text[i:], text[:i] + text[i + 1 :], text[:i] + text[i : i + 2][::-1] + text[i + 2 :]])
    return text


def dictionary(spark, names):
    return spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(names)], "dim_order int, known string, value string")


def check(spark, labels, names, limits):
    got = {r["label"]: (r["value"], r["confidence"], r["method"]) for r in ix.match(spark.createDataFrame([(x,) for x in labels], "label string"), dictionary(spark, names), limits).collect()}
    for label in set(labels):
        expected = ladder(label, names, limits) if label and label.strip() else None
        assert got.get(label) == (expected if expected and expected[0] is not None else None), label


@pytest.mark.parametrize("limits", [ix.CHARGES, ix.ZONES, replace(ix.ZONES, least=0.7)])
def test_equals_all_pairs(spark, limits):
    """Charge labels misspelt, shortened, lengthened and reordered, with nulls, blanks and repeats."""
    rng = random.Random(5)
    names = list(op.CHARGE_LABELS.items())[:260]
    labels = [None, "", "  ", "%%%", "a", "fuel", "FUEL  zone", "Fuel!"] + [misspelt(rng, rng.choice(names)[0]) for _ in range(220)]
    labels += [" ".join(rng.sample(x.split(), len(x.split()))) for x, _ in rng.sample(names, 30)] + [rng.choice(names)[0] + " per kg" for _ in range(20)] + labels[20:30]
    labels += ["".join(rng.choice("abcdefg rst") for _ in range(rng.randint(3, 30))) for _ in range(40)] + ["x" * 90, "oda charges " * 8]
    check(spark, labels, names, limits)


def test_many_names_in_blocks(spark, monkeypatch):
    """Names and labels cut into several blocks each."""
    monkeypatch.setattr(ix, "BLOCK_NAMES", 50)
    monkeypatch.setattr(ix, "BLOCK_LABELS", 7)
    rng = random.Random(6)
    names = [(f"{a} {b}", f"v{a}{b}") for a in ("north", "sorth", "wexham", "carlow", "brindle") for b in sorted({"".join(rng.choice("abcdeiklmnorst") for _ in range(rng.randint(4, 9))) for _ in range(90)})]
    check(spark, [misspelt(rng, rng.choice(names)[0]) for _ in range(90)], names, ix.CHARGES)


def test_learned_first(spark):
    learned = spark.createDataFrame([(" Petrol Thing ", "fuel"), ("docket", "odaCharges")], "raw string, canonical string")
    got = {r["label"]: (r["value"], r["method"]) for r in ix.match(spark.createDataFrame([("PETROL thing",), ("Docket",)], "label string"), op.dictionary(spark), learned=learned).collect()}
    assert got == {"PETROL thing": ("fuel", "learned"), "Docket": ("odaCharges", "learned")}


def test_zones(spark):
    """Canonical codes, spelling, words, and states inside longer labels."""
    labels = ["n1", "Southrn", "Southern Region", "long haul route via Andhra Pradesh and then onwards", "goa xyzzy route", "Westren India", "zzz qqq", None, "North-East"]
    got = {r["label"]: (r["value"], round(r["confidence"], 3), r["method"]) for r in ix.match_zones(spark.createDataFrame([(x,) for x in labels], "label string")).collect()}
    south = ["S1", "S2", "S3", "S4"]
    assert got["n1"] == (["N1"], 1.0, "exact") and got["Southrn"] == (south, 0.85, "substring") and got["Southern Region"] == (south, 0.95, "normalised")
    assert got["long haul route via Andhra Pradesh and then onwards"] == (["E2", "S2", "S3"], 0.88, "geo") and got["goa xyzzy route"] == (["W2"], 0.66, "geo")
    assert got["Westren India"][0] == ["W1", "W2"] and got["Westren India"][2] == "fuzzy"
    assert "zzz qqq" not in got and got["North-East"][0] == ["NE1", "NE2"]
    names = [(k, "x") for k in dict.fromkeys(ix.plain_label(x) for x in dims.LABEL_ZONES)]
    assert ladder("Westren India", names, ix.ZONES)[1] == got["Westren India"][1]


def test_common_subsequence():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc ") for _ in range(12)) for _ in range(50)]
    def plain_length(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = row[:]
            for j, y in enumerate(b):
                row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
        return row[-1]
    for label in ("abcabc", "c a b", "a" * 64, "".join(rng.choice("abc ") for _ in range(40))):
        assert ix.common_subsequence(label, ix._codes(texts, 12)).tolist() == [plain_length(label, t) for t in texts]
    assert np.all(ix.common_subsequence("zzz", ix._codes(texts, 12)) == 0)
