"""Labelled rows for fitting: which rows may be learnt from, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text is divisible by five; such rows are never learnt from. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, text: str = "text", max_chars: int = 16_000_000) -> list:
    """At most ``max_rows`` labelled rows (text, label) in a seeded order, and about ``max_chars`` characters of them.

    Both bounds are parameters of the fit alone. The sample is the first rows by a hash of the
    id, so it is the same on every run; each label's share of it is the share among labelled
    rows. Ids that have several labels are left out.
    """
    known = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min(label).alias("_y"), F.max(label).alias("_y2"))
        .where("_y = _y2")
        .select("doc_id", F.col("_y").cast("int").alias("_y"), F.xxhash64(F.lit(17), "doc_id").alias("_order"))
    )
    chosen = known.orderBy("_order", "doc_id").limit(max_rows)
    rows = (
        docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("_text"))
        .join(F.broadcast(chosen), "doc_id")  # max_rows rows at most
        .select("doc_id", "_y", "_order", "_text", F.length("_text").alias("_chars"))
    )
    total = rows.agg(F.sum("_chars")).collect()[0][0] or 0
    if total > max_chars:
        share = max_chars / total
        rows = rows.where(F.pmod(F.xxhash64(F.lit(29), "doc_id"), F.lit(1_000_000)) < int(1_000_000 * share))
    return sorted(rows.select("_order", "doc_id", "_y", "_text").collect(), key=lambda r: (r["_order"], r["doc_id"], r["_text"]))
