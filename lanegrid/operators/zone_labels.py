"""Vendors' zone labels as canonical zones: by table, by spelling, and by the pincodes under a label."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanegrid.operators.coverage import label_zones, with_zone
from lanegrid.operators.label_index import match_zones
from lanegrid.plans import dims
from lanegrid.runtime import Scratch

LEAST_EXPANDED, LEAST_SURE, LEAST_COVERAGE = 0.65, 0.7, 40.0


def expand_labels(rows: DataFrame, label: str, least: float = LEAST_EXPANDED, scratch: Scratch | None = None) -> DataFrame:
    """Adds ``zones``: by the label's table as ``label_zones`` does, else of the most similar known label; null if there is none.

    Only distinct labels that the table lacks are compared.
    """
    scratch = scratch or Scratch(rows.sparkSession)
    known = label_zones(rows, label)
    unknown = scratch.save(known.where(F.col("zones").isNull() & F.col(label).isNotNull()).select(F.col(label).alias("label")).distinct(), "unknown_labels")
    found = scratch.save(match_zones(unknown, least, scratch=scratch).select(F.col("label").alias("_label"), F.col("value").alias("_zones")), "spelt_labels")
    joined = known.join(found, F.when(F.col("zones").isNull(), F.col(label)) == F.col("_label"), "left")
    return joined.withColumn("zones", F.coalesce("zones", "_zones")).drop("_label", "_zones")


def resolve_vendor_zone(rows: DataFrame, master: DataFrame, label: str = "label", scratch: Scratch | None = None) -> DataFrame:
    """Adds ``resolved``: the master's zone if the label covers it, else the label's first zone; null for an unknown label."""
    named = expand_labels(rows, label, scratch=scratch).withColumnRenamed("zones", "candidates")
    joined = named.join(master.select("pincode", "zone"), "pincode", "left")
    return joined.withColumn("resolved", F.when(F.array_contains("candidates", F.col("zone")), F.col("zone")).otherwise(F.get("candidates", F.lit(0))))


def resolve_labels(pins: DataFrame, master: DataFrame, least_coverage: float = LEAST_COVERAGE, scratch: Scratch | None = None) -> DataFrame:
    """(vendor_id, label, zones, method) of the labels of ``pins`` (vendor_id, label, pincode).

    In order: the label is a canonical code; the dictionary knows it or something like it with a confidence of LEAST_SURE;
    the zones that hold at least ``least_coverage`` percent of its pincodes, the fullest first (the one with the least
    pincode of equals); the dictionary with less confidence; else no zones. Null labels are left out.
    """
    scratch = scratch or Scratch(pins.sparkSession)
    rows = scratch.save(pins.where("label IS NOT NULL").select("vendor_id", "label", "pincode"), "labelled_pins")
    labels = rows.select("vendor_id", "label").distinct()
    code = F.upper(F.trim("label"))
    near = match_zones(labels.where(~code.isin(dims.ZONES)).select("label").distinct(), LEAST_SURE, scratch=scratch)
    near = scratch.save(near.select("label", F.col("value").alias("named"), "confidence", F.col("method").alias("layer")), "label_matches")
    counted = with_zone(rows, master).where("zone IS NOT NULL").groupBy("vendor_id", "label", "zone").agg(F.count("*").alias("n"), F.min("pincode").alias("first_pin"))
    share = F.round(F.col("n") * 100 / F.sum("n").over(Window.partitionBy("vendor_id", "label")), 1)
    full = counted.withColumn("percent", share).where(F.col("percent") >= least_coverage)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("percent")).alias("p"), "first_pin", "zone")))
    held = full.groupBy("vendor_id", "label").agg(F.transform(ordered, lambda x: x["zone"]).alias("held"))
    joined = labels.join(near, "label", "left").join(held, ["vendor_id", "label"], "left")
    sure = F.col("confidence") >= LEAST_SURE
    ladder = (
        F.when(code.isin(dims.ZONES), F.struct(F.array(code).alias("zones"), F.lit("canonical").alias("method")))
        .when(sure, F.struct(F.col("named").alias("zones"), F.col("layer").alias("method")))
        .when(F.col("held").isNotNull(), F.struct(F.col("held").alias("zones"), F.lit("pincodes").alias("method")))
        .when(F.col("named").isNotNull(), F.struct(F.col("named").alias("zones"), F.col("layer").alias("method")))
        .otherwise(F.struct(F.array().cast("array<string>").alias("zones"), F.lit("none").alias("method")))
    )
    return joined.withColumn("_l", ladder).select("vendor_id", "label", "_l.zones", "_l.method")
