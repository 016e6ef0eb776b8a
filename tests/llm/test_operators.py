"""Corpus operators against plain Python versions, and on odd rows."""

import hashlib
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lanegrid.llm import chat, components, decontaminate, exact_substrings, flat, jaccard, line_dedup, mixing, pii, quality_model, quality_rules, sizes, toxicity
from lanegrid.llm.labels import held_out
from lanegrid.runtime import Scratch
from tests.llm import brute

#: Columns whose names the operators use themselves.
EXTRA = "_stats hash name lines _lines _parts label key spans kept doc words score bits _h _l _s domain epoch text_hash size at".split()


def prose(rng, n, alphabet="abcdefgh"):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 6))) for _ in range(n))


def corpus():
    """Documents with copies, near copies, shared passages, odd texts."""
    rng = random.Random(3)
    passage = prose(rng, 120)
    docs = [prose(rng, rng.randint(30, 200)) for _ in range(12)]
    docs += [docs[0], docs[0], docs[1] + " tail", docs[2].replace("a ", "b ", 1), docs[3] + "\n" + passage, passage + "\n" + docs[4], "x " * 900, None, "", "   \n\t ", "one", "one", "two words", "ÀÉ ß naïve ☃ " * 30]
    docs += ["\n".join([docs[5][:150], docs[6][:150], docs[7]]), "\n".join([docs[5][:150], docs[6][:150], "other end"])]
    docs += ["Word " * 3 + prose(rng, 60) + " mail a.b+c@d-e.co.uk and 10.0.0.1, 4111 1111 1111 1111 or +1 (017) 555-7713."]
    return docs


def frame(spark, texts, extra=True):
    rows = [(i, t, ["en", "de", None][i % 3], f"src{i % 4}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(1) for c in EXTRA}) if extra else df


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus()).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, []).limit(0)


def test_words_and_hashes_do_not_depend_on_neighbours():
    texts = ["Ab  cd\n", None, "", "cd", "é" * 3, "ab cd"]
    data, at = flat.flat(pa.array(texts))
    start, end, owner = flat.spans(data, at)
    words = [bytes(data[a:b]).decode() for a, b in zip(start, end, strict=True)]
    assert words == ["Ab", "cd", "cd", "ééé", "ab", "cd"]
    assert owner.tolist() == [0, 0, 3, 4, 5, 5]
    h = flat.span_hashes(data, start, end)
    assert h[1] == h[2] == h[5] and len(set(h.tolist())) == 4
    assert (flat.span_hashes(data, start, end, limit=1) == h).all()


def test_quality_statistics(spark, docs):
    texts = corpus()
    got = {r["doc_id"]: r["_stats"] for r in quality_rules.with_stats(docs).select("doc_id", "_stats").collect()}
    for i, t in enumerate(texts):
        s = got[i]
        assert (s["n_words"], s["word_chars"], s["n_symbols"], s["n_dup_lines"], s["n_repeat_words"]) == brute.text_stats(t)


def test_quality_filter(spark, docs, empty):
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert set(range(12)) <= ids  # plain prose stays
    assert 18 not in ids and 20 not in ids  # one word over and over, and no text
    assert quality_rules.keep_good(empty).count() == 0


def test_pii(spark, docs):
    for text in [*corpus(), "a@b@c.de x@y.z.9", "1.2.3.4.5.6.7.8 999.1.1.1 00010.0.0.1", "+++1 2345678901", "4111-1111-1111-1111-", "İ a@b.co", "+1 2 +44 (20) 7946 0958", "1" * 4000 + ".1.1.1"]:
        assert [s for s in pii.find(text) if s[0] in pii.BASE_KINDS] == brute.base_spans(text)
    text = 'see https://me:secret@host/x token = "24be64439e3e49cf46b2" IBAN: GB82 WEST 1234 5698 7654 32 passport: X1234567'
    assert {k for k, _, _ in pii.find(text)} >= {"credential", "secret", "iban", "identifier"}
    got = {r["doc_id"]: [tuple(s) for s in r["pii"]] for r in pii.find_spans(docs).select("doc_id", "pii").collect()}
    assert all(got[i] == pii.find(t) for i, t in enumerate(corpus()))
    assert pii.redact(frame(spark, ["a b@c.de d", None])).select("text").collect() == [("a <email> d",), (None,)]


@pytest.mark.parametrize("few", [True, False])
def test_decontamination(spark, docs, few, monkeypatch):
    texts = corpus()
    items = [(1, texts[0][20:180]), (2, "ONE"), (3, None), (None, " ".join(texts[1].split()[3:20])), (5, texts[4].upper()), (6, "two, words!"), (1, texts[0][20:180])]
    if not few:
        monkeypatch.setattr(sizes, "BROADCAST_ROWS", 0)
    bench = spark.createDataFrame(items, "item_id int, text string")
    got = {r["doc_id"]: r for r in decontaminate.annotate(docs, bench, Scratch(spark)).collect()}
    for i, t in enumerate(texts):
        assert (got[i]["n_words"], got[i]["n_hit"], set(got[i]["items"])) == brute.contamination(t, items), i
    clean = decontaminate.remove_contaminated(docs, bench, Scratch(spark))
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.select("doc_id").collect()} == {i for i in got if not got[i]["n_hit"]}
    assert decontaminate.remove_contaminated(docs, bench.limit(0), Scratch(spark)).count() == docs.count()


def test_jaccard_components(spark, docs, empty):
    texts = corpus()
    got = {r["doc_id"]: r for r in jaccard.join(docs, Scratch(spark)).collect()}
    expected = brute.jaccard_components({i: t for i, t in enumerate(texts)})
    assert {i: r["component_id"] for i, r in got.items()} == expected
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(brute.shingles(t)) for i, t in enumerate(texts)}
    kept = jaccard.keep_one(docs, Scratch(spark))
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {i for i, c in expected.items() if i == c}
    assert jaccard.join(empty, Scratch(spark)).count() == 0


def test_jaccard_near_copies_whose_pivot_is_a_copy(spark):
    """Copies with some words replaced: many linked through the original alone, others not at all."""
    rng = random.Random(8)
    base = prose(rng, 120).split()
    texts = [None]
    for _ in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = prose(rng, 1, "xyz") + str(rng.random())
        texts.append(" ".join(words))
    texts.append(" ".join(base))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join(frame(spark, texts), Scratch(spark)).collect()}
    assert got == brute.jaccard_components(dict(enumerate(texts)))


def test_jaccard_hot_group_is_not_compared_in_all_pairs(spark, monkeypatch):
    """Of 60 linked near copies the open pairs are settled by comparing far fewer than all 1770."""
    rng = random.Random(21)
    base = prose(rng, 150).split()
    texts = [" ".join([*base[:i], f"other{i}", *base[i + 1 :]]) for i in range(20, 140, 2)]
    compared, linked = [], jaccard.Join.linked
    monkeypatch.setattr(jaccard.Join, "linked", lambda self, pairs, name: compared.append(pairs.count()) or linked(self, pairs, name))
    run = jaccard.Join(frame(spark, texts), Scratch(spark))
    of = run.named.select(F.col("name").alias("a"), F.col("n_shingles").alias("size_a"))
    run.compare_open(of.join(of.select(F.col("a").alias("b"), F.col("size_a").alias("size_b")), F.expr("a < b")), "open")
    assert sum(compared) < 240
    assert {r["label"] for r in run.labels.collect()} == {min(r["a"] for r in of.collect())}
    assert run.labels.count() == len(texts)


def test_jaccard_links_of_repeated_rows(spark):
    """Equal rows, and one id with several texts, make no pair more alike than its texts are."""
    rng = random.Random(11)
    texts = []
    for share in (30, 60, 75, 114):  # words of 120 in common with the text before
        base = prose(rng, 120).split()
        texts += [" ".join(base), " ".join(base[:share] + prose(rng, 120 - share, "stuvwxyz").split())]
    rows = [(i // 3, t) for i, t in enumerate(texts)] * 2 + [(90 + i, t) for i, t in enumerate(texts)] + [(0, texts[5])] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string")
    component = brute.jaccard_components(dict(enumerate(texts)))
    assert len(set(component.values())) == 7  # only the last two are near copies
    least = {}
    for i, t in rows:
        of = component[texts.index(t)]
        least[of] = min(i, least.get(of, i))
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join(df, Scratch(spark)).collect())
    assert got == sorted((i, len(brute.shingles(t)), least[component[texts.index(t)]]) for i, t in rows)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 200), (300, 100), (7, 7)]
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(chain, "a long, b long"), Scratch(spark), "t").collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 200: 100, 300: 100}


def test_line_dedup(spark, docs, empty):
    texts = corpus()
    out = line_dedup.dedup(docs, Scratch(spark))
    assert set(docs.columns) <= set(out.columns)
    got = {r["doc_id"]: r["text"] for r in out.select("doc_id", "text").collect()}
    assert [got[i] for i in range(len(texts))] == brute.removed_lines(list(enumerate(texts)))
    assert line_dedup.dedup(empty, Scratch(spark)).count() == 0
    units = line_dedup.repeated_units(docs, Scratch(spark))
    assert {r["doc"] for r in line_dedup.runs(units).collect()} == {r["doc"] for r in units.select("doc").collect()}


def test_line_dedup_long_runs(spark):
    rng = random.Random(5)
    lines = [prose(rng, rng.randint(0, 3)) for _ in range(300)]
    texts = ["\n".join(lines), "\n".join(lines[40:200]), "\n".join([*lines[:90], "other", *lines[90:]]), "\n".join(lines[10:14])]
    got = [r["text"] for r in line_dedup.dedup(frame(spark, texts, extra=False), Scratch(spark)).orderBy("doc_id").collect()]
    assert got == brute.removed_lines(list(enumerate(texts)))


@pytest.mark.parametrize("most", [4096, 1])
def test_exact_substrings(spark, docs, empty, most, monkeypatch):
    monkeypatch.setattr(exact_substrings, "MOST_KINDS", most)
    texts = corpus() + [("ab" * 700), prose(random.Random(1), 300)[:401], prose(random.Random(1), 300)[1:402]]
    got = {r["doc_id"]: r for r in exact_substrings.dedup(frame(spark, texts), Scratch(spark)).select("doc_id", "spans", "kept").collect()}
    for i, (raw, mask) in enumerate(brute.removed_bytes(texts)):
        assert bytes(got[i]["kept"]) == bytes(b for b, m in zip(raw, mask, strict=True) if not m), i
    assert exact_substrings.dedup(empty, Scratch(spark)).count() == 0


def test_mixing_budgets(spark):
    leaves = [("d0", "en", "a", 1000, 5), ("d0", "en", "b", 10, 1), ("d0", "de", "a", 300, 3), ("d1", "en", "c", 50, 2), ("(none)", "(none)", "(none)", 400, 2), ("d1", "de", "z", 0, 1)]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long, docs long")
    weights = {"domain": {"d0": 5, "d1": 3}, "lang": {"en": 2}}
    got = {(r["domain"], r["lang"], r["source"]): r["budget"] for r in mixing.leaf_budgets(df, weights, (4, 5), 2).collect()}
    cap = lambda *path: sum(2 * x[3] for x in leaves if x[: len(path)] == path)
    w = lambda level, k: weights.get(level, {}).get(k, 1)
    total = sum(x[3] for x in leaves) * 4 // 5
    expected = {}
    by_domain = brute.water_fill(total, {k: (w("domain", k), cap(k)) for k in {x[0] for x in leaves}})
    for dom, b in by_domain.items():
        by_lang = brute.water_fill(b, {k: (w("lang", k), cap(dom, k)) for k in {x[1] for x in leaves if x[0] == dom}})
        for lang, b2 in by_lang.items():
            for source, b3 in brute.water_fill(b2, {k: (1, cap(dom, lang, k)) for k in {x[2] for x in leaves if x[:2] == (dom, lang)}}).items():
                expected[dom, lang, source] = b3
    assert got == expected


def test_mixing_takes_prefixes(spark, docs, empty):
    domain = F.when(F.col("source") == "src1", "d1")
    rows = mixing.mix(docs, domain, {}, Scratch(spark)).collect()
    again = mixing.mix(docs, domain, {}, Scratch(spark)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    per = {}
    for r in rows:
        per.setdefault((r["doc_id"], r["epoch"]), 0)
        per[r["doc_id"], r["epoch"]] += 1
    assert set(per.values()) == {1}
    total = docs.select(F.sum(mixing.n_tokens(F.col("text")))).collect()[0][0]
    assert 0 < sum(r["n_tokens"] for r in rows) <= total * 3 // 5
    assert mixing.mix(empty, domain, {}, Scratch(spark)).count() == 0


def test_chat_round_trip(spark):
    rng = random.Random(2)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "/", "\n", "é", "user", ""]
    rows = [(c, t, rng.choice(["user", "assistant", "we[INST]ird", None]), rng.choice([None, "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))])) for c in range(15) for t in range(rng.randint(1, 9))]
    rows += rows[:2]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_trees(chat.linear_messages(df), Scratch(spark))
    read = out.select("root.conv_id", chat.read_back(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    by = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0], r[1], r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
        by.setdefault(c, []).append((role or "", text or ""))
    assert {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in read} == by
    assert {r["conv_id"]: r["loss"] for r in read} == {c: "".join(t for role, t in v if role == "assistant") for c, v in by.items()}
    assert chat.format_trees(chat.linear_messages(df.limit(0)), Scratch(spark)).count() == 0


def test_chat_trees(spark):
    rng = random.Random(4)
    messages = [(i, None if i < 3 else rng.choice([rng.randrange(i), 999]), rng.choice([None, 0.5, 1.0, 2.0]), "user", f"m{i}") for i in range(60)]
    messages += [(201, 200, 1.0, "user", "a"), (202, 201, 1.0, "user", "b"), (203, 202, 1.0, "user", "c")]  # a chain
    messages += [(301, 302, 9.0, "user", "x"), (302, 301, 9.0, "user", "y"), messages[5]]  # a cycle, and a repeated row
    df = spark.createDataFrame(messages, "msg_id long, parent_id long, score double, role string, text string")
    got = {}
    for r in chat.paths(df, Scratch(spark)).collect():
        got.setdefault(r["root"], []).append((-r["depth_left"], r["msg_id"]))
    expected = brute.best_paths([m[:3] for m in messages if m[0] not in (301, 302)])
    assert {k: [m for _, m in sorted(v)] for k, v in got.items()} == expected


def test_classifiers_learn_and_hold_out(spark):
    rng = random.Random(6)
    texts, labels = [], []
    for i in range(600):
        bad = rng.random() < 0.3
        words = prose(rng, rng.randint(20, 60)).split()
        if bad:
            words.insert(rng.randrange(len(words)), "zzvile" + rng.choice(["", "x", "y"]))
        texts.append(" ".join(words) if i else None)
        labels.append((i, int(bad), int(bad)))
    docs = frame(spark, texts, extra=False)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    held = {r["doc_id"] for r in docs.where(held_out(F.col("doc_id"))).select("doc_id").collect()}
    import zlib

    assert held == {i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0}
    tox = toxicity.fit(docs, known)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, tox).select("doc_id", "score").collect()}
    right = sum((scores[i] >= 0.5) == bool(y) for i, y, _ in labels if i in held)
    assert right / len(held) > 0.9
    assert all(0 <= s <= 1 for s in scores.values())
    junk = frame(spark, [t if not labels[i][1] else (t or "").upper() + " !!" for i, t in enumerate(texts)], extra=False)
    quality = quality_model.fit(junk, known)
    scores = {r["doc_id"]: r["score"] for r in quality_model.score(junk, quality).select("doc_id", "score").collect()}
    assert sum((scores[i] >= 0.3) == bool(y) for i, y, _ in labels if i in held) / len(held) > 0.95
    nothing = toxicity.fit(docs, known.limit(0))
    assert {r["score"] for r in toxicity.score(docs.limit(5), nothing).select("score").collect()} == {0.5}
    assert {r["score"] for r in quality_model.score(docs.limit(5), quality_model.fit(docs, known.limit(0))).select("score").collect()} == {0.5}


def test_repeated_and_null_ids(spark):
    a, b = "alpha beta gamma delta epsilon " * 20, prose(random.Random(9), 150)
    rows = [(1, a), (1, a), (1, b), (None, a), (None, b), (2, b)]
    df = spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    bench = spark.createDataFrame([(7, b)], "item_id int, text string")
    assert decontaminate.annotate(df, bench, Scratch(spark)).where("n_hit > 0").count() == 3
    assert line_dedup.dedup(df, Scratch(spark)).count() == 6
    assert jaccard.join(df, Scratch(spark)).count() == 6
    assert quality_rules.keep_good(df).count() <= 6
    assert mixing.mix(df, F.lit("d"), {}, Scratch(spark), budget_of=(1, 1)).select("doc_id", "text").distinct().count() == 5
    kept = exact_substrings.dedup(df, Scratch(spark))
    assert kept.count() == 6 and kept.where("doc_id = 1 and spans is null").count() == 0
    assert hashlib.sha256(b"").hexdigest() == hashlib.sha256(bytes(kept.where("doc_id = 2").collect()[0]["kept"])).hexdigest()


def test_line_suffix_array(spark):
    """All suffixes in order, equal ranks for equal suffixes only, and the common prefix of every two neighbours, beyond the 20 words."""
    rng = random.Random(15)
    texts = ["\n".join(rng.choice(["", "a", "b", "c d"]) for _ in range(rng.randint(1, 40))) for _ in range(30)] + ["a\n" * 70, "a\n" * 70, "b\n" + "a\n" * 50, None, ""]
    rows = [(i if i else None, t) for i, t in enumerate(texts)] + [(3, texts[3])]
    array, common = line_dedup.suffix_array(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark), min_words=2)
    lcp = {(r["name"], r["rank"]): r["lcp"] for r in common.collect()}
    lines = [(t or "").split("\n") for t in texts]
    got = sorted(((r["name"], r["rank"], r["doc"] or 0, r["line"], r["left"]) for r in array.collect()))
    assert sorted(x[2:4] for x in got) == [(i, k) for i, t in enumerate(texts) if t is not None for k in range(len(lines[i]))]
    name = {lines[x[2]][x[3]]: x[0] for x in got}
    suffix = [[name[s] for s in lines[x[2]][x[3] :]] for x in got]
    assert suffix == sorted(suffix) and [len(s) for s in suffix] == [x[4] for x in got]
    for (a, x), (b, y) in zip(zip(got, suffix, strict=True), list(zip(got, suffix, strict=True))[1:], strict=False):
        shared = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
        assert (a[:2] == b[:2]) == (x == y)
        assert x == y or lcp.get(b[:2], 0) == shared
