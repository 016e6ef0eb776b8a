"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from lanegrid.llm import bpe, chat, decontaminate, exact_substrings, jaccard, line_dedup, merkle, mixing, oracles, pii, quality_model, quality_rules, toxicity, trie
from lanegrid.llm.labels import held_out
from lanegrid.runtime import Scratch, spread, table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table; one that comes in fewer parts than there are cores is dealt over them."""
    return spread(table(spark, sf_dir, "documents"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    limit = toxicity.threshold(model, F.col("lang"))
    return toxicity.score(docs.select("doc_id", "text", "lang"), model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.round(limit, 6).alias("lang_threshold"),
        (F.col("score") >= limit).alias("flagged"),
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontaminate.annotate(documents(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "benchmark"), Scratch(spark))
    return rows.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.dedup(documents(spark, sf_dir).select("doc_id", "text"), Scratch(spark))
    return rows.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def source_domain():
    """The domain of a source: its number modulo three."""
    return F.concat(F.lit("domain"), F.expr("try_cast(regexp_extract(source, '[0-9]+$', 0) AS INT) % 3"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    rows = mixing.select_epochs(docs, source_domain(), oracles.WEIGHTS, Scratch(spark))
    return rows.select("doc_id", "domain", "lang", "source", "n_tokens", "epoch")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(documents(spark, sf_dir), Scratch(spark))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality_model.fit(docs, table(spark, sf_dir, "labels"))
    return quality_model.score(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(documents(spark, sf_dir).select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    digest = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(count, pii.BASE_KINDS), F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("pii")).alias("spans")
    )


def op8_exact_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_substrings.dedup(documents(spark, sf_dir).select("doc_id", "text"), Scratch(spark))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return rows.select(
        "doc_id",
        F.coalesce(F.octet_length("text").cast("long"), F.lit(0).cast("long")).alias("n_bytes"),
        F.coalesce(removed, F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce(F.size("spans").cast("long"), F.lit(0).cast("long")).alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = quality_rules.with_stats(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "_stats.*")
    stats = Scratch(spark).save(stats, "stats")
    return quality_rules.judge(stats, quality_rules.fit(stats)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good"
    )


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql(r"SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    made = chat.format_trees(chat.linear_messages(turns), Scratch(spark))
    read = made.withColumns({"turns": chat.read_back(F.col("formatted")), "learnt": chat.read_loss(F.col("formatted"), F.col("loss_spans"))})
    return read.select(
        F.col("root.conv_id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc_id, text = F.col("doc_id"), F.col("text")
    digest = lambda text: merkle.leaf(doc_id, F.col("source"), F.col("lang"), F.col("n_chars"), text)
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0
    leaves = documents(spark, sf_dir).select(doc_id, "lang", digest(text).alias("leaf"), F.when(tampered, digest(lowered)).alias("altered"))
    rows = merkle.manifest(leaves, "lang", "doc_id", "leaf", Scratch(spark))
    rows = rows.withColumn("folded_root", merkle.fold(F.coalesce("altered", "leaf"), F.col("proof")))
    return rows.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(merkle.siblings(F.col("proof")).cast("binary"), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = bpe.Codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    coded = codec.encode(documents(spark, sf_dir).select("doc_id", "text"), Scratch(spark))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(bpe.little_endian(F.col("ids")), 256).alias("ids_sha256"),
        F.sha2(codec.decode(F.col("ids")), 256).alias("decoded_sha256"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    turns = trie.encode_turns(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), scratch)
    return trie.nodes(trie.sequences(trie.rebuild(turns), scratch), scratch).withColumnRenamed("ends", "ends_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_decontamination": op2_decontamination,
    "op3_line_dedup": op3_line_dedup,
    "op4_mixing": op4_mixing,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_pii": op7_pii,
    "op8_exact_substrings": op8_exact_substrings,
    "op9_quality_rules": op9_quality_rules,
    "op10_chat": op10_chat,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_bpe": op12_bpe,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLES: dict[str, str] = {"op2_decontamination": oracles.OP2, "op3_line_dedup": oracles.OP3, "op4_mixing": oracles.OP4, "op5_jaccard_join": oracles.OP5, "op10_chat": oracles.OP10, "op11_merkle_manifest": oracles.OP11, "op13_prefix_trie": oracles.OP13}


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # it imports this module

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = _pipeline
