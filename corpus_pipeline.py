"""The corpus pipeline: quality rules, line deduplication, near-duplicates, decontamination, mixing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's ``docs``. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanegrid.llm import decontaminate, jaccard, line_dedup, mixing, quality_rules
from lanegrid.llm.oracles import WEIGHTS
from lanegrid.llm.queries import source_domain
from lanegrid.runtime import Scratch, table


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules reject go."""
    return quality_rules.keep_good(docs)


def delete_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go; ``n_chars`` follows the text; texts left without a word go."""
    out = line_dedup.dedup(docs, Scratch(spark))
    changed = F.col("n_removed") > 0
    out = out.where(~changed | (F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")) > 0))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies the document with the smallest id stays."""
    return jaccard.keep_one(docs, Scratch(spark))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 10 consecutive words, or all of a shorter item, of the benchmark go."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"), Scratch(spark))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture to target weights, one row per document and epoch."""
    return mixing.mix(docs, source_domain(), WEIGHTS, Scratch(spark))


STAGES = [
    ("quality_rules", keep_good_quality),
    ("line_dedup", delete_repeated_lines),
    ("jaccard_join", keep_one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: Expectation-maximisation has no SQL twin; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"{i}_{name}")
    return docs
