"""Charges of vendors from several sources: merging, ambiguities, encoding, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanegrid.functions import charges as fn
from lanegrid.operators import labels

ALIASES = {"fuelSurcharge": "fuel", "docketCharge": "docketCharges"}


def canonical_fields(rows: DataFrame) -> DataFrame:
    table = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return rows.withColumn("field", F.coalesce(table[F.col("field")], F.col("field")))


def merge(candidates: DataFrame) -> DataFrame:
    """(vendor_id, field, charge, source): the richest candidate of each field, the first of equals (by file_order)."""
    rows = canonical_fields(candidates).withColumn("rich", fn.richness(F.col("charge")))
    best = F.max_by(F.struct("charge", "file_order", "rich"), F.struct("rich", -F.col("file_order")))
    return rows.where("rich > 0").groupBy("vendor_id", "field").agg(best.alias("w")).select("vendor_id", "field", "w.charge", F.col("w.file_order").alias("source"), F.col("w.rich").alias("rich"))


def ambiguities(candidates: DataFrame) -> DataFrame:
    """Candidates as rich as the winner up to their file but different from it: (vendor_id, field, kept_source, other_source)."""
    rows = canonical_fields(candidates).withColumn("rich", fn.richness(F.col("charge"))).where("rich > 0")
    before = Window.partitionBy("vendor_id", "field").orderBy("file_order").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("w", F.max(F.struct("rich", (-F.col("file_order")).alias("o"), "charge")).over(before)).where("w is not null")
    same = fn.equivalent(F.col("w.charge"), F.col("charge"))
    return rows.where((F.col("rich") == F.col("w.rich")) & ~same).select("vendor_id", "field", (-F.col("w.o")).alias("kept_source"), F.col("file_order").alias("other_source"))


def wide(merged: DataFrame, fields: list[str]) -> DataFrame:
    """One row per vendor with a charge struct per field: the fields are known, so one pass does."""
    return merged.groupBy("vendor_id").agg(*[F.first(F.when(F.col("field") == f, F.col("charge")), ignorenulls=True).alias(f) for f in fields])


def encode(row: DataFrame) -> DataFrame:
    """The stored price record: scalars with defaults, pairs, and the remote delivery charge."""
    c = F.col
    return row.select(
        "vendor_id",
        fn.scalar_of(c("docketCharges")).alias("docketCharges"),
        fn.scalar_of(c("minCharges")).alias("minCharges"),
        fn.scalar_of(c("greenTax")).alias("greenTax"),
        F.coalesce(F.nullif(c("fuel.v"), F.lit(0.0)), F.nullif(c("fuel.scalar"), F.lit(0.0)), F.lit(0.0)).alias("fuel"),
        fn.vf_of(c("rovCharges")).alias("rovCharges"),
        fn.oda_encode(c("odaCharges")).alias("odaCharges"),
        F.lit(0.5).alias("minWeight"),
        F.lit(5000.0).alias("divisor"),
    )


def enabled(merged: DataFrame) -> DataFrame:
    """(vendor_id, fields): the fields that carry value, sorted."""
    return merged.where(fn.has_value(F.col("charge"))).groupBy("vendor_id").agg(F.array_sort(F.collect_set("field")).alias("fields"))


def from_source(candidates: DataFrame) -> DataFrame:
    """(vendor_id, fields): fields for which any source has a value, by their canonical name."""
    return canonical_fields(candidates).where("charge is not null").groupBy("vendor_id").agg(F.array_sort(F.collect_set("field")).alias("fields"))


def inline(cells: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Charges written in one cell, such as ``Fuel Surcharge-20%``: (keys of ``cells``, field, v, f) of labels that the dictionary knows."""
    pattern = r"^\s*([A-Za-z][A-Za-z .()/]*?)\s*[-:=–]+\s*(.*\d.*)$"
    parts = cells.withColumns({"label": F.nullif(F.trim(F.regexp_extract("cell", pattern, 1)), F.lit("")), "_rest": F.regexp_extract("cell", pattern, 2)})
    found = labels.match(parts, dictionary).select("label", F.col("value").alias("field"))
    pair = parts.join(found, "label").withColumn("_vf", fn.parse_vf(F.col("_rest")))
    return pair.select(*[c for c in cells.columns if c != "cell"], "field", "_vf.v", "_vf.f")
