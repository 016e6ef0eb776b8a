"""Rate matrices in cell grids: from-to-rate lists, and zones across and down.

Grids are written once, as their headers, columns and data are read one after another; what is found about a sheet is
one small row that is joined back to its data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanegrid.functions.charges import parse_number
from lanegrid.operators.coverage import label_zones
from lanegrid.operators.label_index import match_zones
from lanegrid.operators.rates import money
from lanegrid.operators.sheet_cells import KEY, cell, first_row, is_zone_token, position
from lanegrid.runtime import Scratch

# Fixed values ---------------------------------------------------------------------------------
FROM_NAMES = ["from", "from zone", "origin", "origin zone", "source", "source zone", "o zone"]
TO_NAMES = ["to", "to zone", "destination", "dest", "destination zone", "dest zone", "d zone"]
RATE_NAMES = ["rate", "rate per kg", "rate per kg rs", "rate rs", "price", "price per kg", "freight rate", "rs per kg"]
LEAST_HEADER, LEAST_ORIGIN = 0.70, 0.65
NUMBER = r"^\d+(\.\d+)?$"
# ----------------------------------------------------------------------------------------------


def _enough(cells: DataFrame, least_origins: int) -> DataFrame:
    size = F.size(F.collect_set("origin").over(Window.partitionBy(*KEY)))
    return cells.withColumn("_n", size).where(F.col("_n") >= least_origins).drop("_n")


def long_matrix(grid: DataFrame, least_origins: int = 3, least_rows: int = 4, scratch: Scratch | None = None) -> DataFrame:
    """Rates of sheets of at least ``least_rows`` rows with from, to and rate columns.

    Labels are expanded, unknown ones stand for themselves; later rows overwrite.
    """
    grid = (scratch or Scratch(grid.sparkSession)).save(grid, "long_grid")
    named = grid.withColumns({n: position(F.col("cells"), names) for n, names in (("f", FROM_NAMES), ("t", TO_NAMES), ("r", RATE_NAMES))})
    found = F.col("f").isNotNull() & F.col("t").isNotNull() & F.col("r").isNotNull() & (F.col("f") != F.col("t")) & ~F.get("cells", F.lit(0)).startswith("#")
    large = grid.groupBy(*KEY).agg(F.count("*").alias("_rows")).where(F.col("_rows") >= least_rows).drop("_rows")
    head = first_row(named, found, 20, ["f", "t", "r"]).join(large, KEY)
    rows = grid.join(head, KEY).where("row_idx > header_idx")
    rows = rows.select(*KEY, "row_idx", cell(F.col("cells"), F.col("f")).alias("from"), cell(F.col("cells"), F.col("t")).alias("to"), parse_number(cell(F.col("cells"), F.col("r"))).alias("rate"))
    rows = rows.where((F.col("rate") > 0) & (F.col("from") != "") & (F.col("to") != ""))
    own = lambda c: F.explode(F.coalesce("zones", F.array(F.upper(c))))
    rows = label_zones(rows, "from").withColumn("origin", own("from")).drop("zones")
    rows = label_zones(rows, "to").withColumn("dest", own("to"))
    return _enough(rows.groupBy(*KEY, "origin", "dest").agg(F.max_by("rate", "row_idx").alias("rate")), least_origins)


def wide_header(grid: DataFrame) -> DataFrame:
    """(KEY, header_idx, head): the last row of the first cluster (gaps of 3 at most) of rows with two or more zone tokens, among the first 35."""
    hits = grid.where(F.col("row_idx") < 35).where(F.size(F.filter("cells", is_zone_token)) >= 2)
    by = Window.partitionBy(*KEY).orderBy("row_idx")
    gap = F.coalesce((F.col("row_idx") - F.lag("row_idx").over(by) > 3).cast("int"), F.lit(0))
    cluster = hits.withColumn("_gap", gap).withColumn("_cluster", F.sum("_gap").over(by)).where("_cluster = 0")
    return cluster.groupBy(*KEY).agg(F.max("row_idx").alias("header_idx"), F.max_by("cells", "row_idx").alias("head"))


def _resolve(labels: DataFrame, hubs: DataFrame | None, least: float, scratch: Scratch, name: str) -> DataFrame:
    """(vendor_id, label, zones) of distinct upper-case labels: by the vendor's hub key, by table, by spelling.

    Numbers are never compared by spelling, nor is anything of a vendor that has a hub key: what the key lacks is an unknown hub.
    """
    rows = labels.select("vendor_id", "label").where("label <> ''").distinct()
    if hubs is not None:
        own = hubs.select("vendor_id", F.col("hub").alias("label"), F.col("zone").alias("_hub"))
        rows = rows.join(own, ["vendor_id", "label"], "left").join(hubs.select("vendor_id", F.lit(True).alias("_keyed")).distinct(), "vendor_id", "left")
    else:
        rows = rows.withColumns({"_hub": F.lit(None).cast("string"), "_keyed": F.lit(None).cast("boolean")})
    known = label_zones(rows, "label").withColumn("zones", F.coalesce(F.when(F.col("_hub").isNotNull(), F.array("_hub")), "zones"))
    known = scratch.save(known, f"{name}_known")
    spelt = match_zones(known.where(F.col("zones").isNull() & F.col("_keyed").isNull() & ~F.col("label").rlike(NUMBER)).select("label").distinct(), least, scratch=Scratch(rows.sparkSession))
    found = known.join(spelt.select("label", F.col("value").alias("_spelt")), "label", "left")
    usable = F.col("_keyed").isNull() & ~F.col("label").rlike(NUMBER)
    out = found.select("vendor_id", "label", F.coalesce("zones", F.when(usable, F.col("_spelt"))).alias("zones")).where("zones IS NOT NULL")
    return scratch.save(out, f"{name}_resolved")


def wide_matrix(grid: DataFrame, least_origins: int = 3, hubs: DataFrame | None = None, scratch: Scratch | None = None) -> DataFrame:
    """Rates of sheets with zones across and down; close samples take the highest, others the mean.

    Columns are assigned by the vendor's hub key (``hubs``: vendor_id, hub, zone), else by label, else by spelling; a sheet needs
    three. The origin stands in the column left of them that has most zone tokens in the eight rows under the header (the first of
    equals, the first column if none has any); a row whose own cell there is no token takes the first column's, if that is one.
    """
    scratch = scratch or Scratch(grid.sparkSession)
    grid = scratch.save(grid, "wide_grid")
    head = scratch.save(wide_header(grid), "wide_heads")
    columns = head.select(*KEY, F.posexplode("head").alias("col", "label")).withColumn("label", F.upper(F.trim(F.coalesce("label", F.lit("")))))
    columns = columns.join(_resolve(columns, hubs, LEAST_HEADER, scratch, "columns"), ["vendor_id", "label"])
    assigned = columns.groupBy(*KEY).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("col", "zones")))).alias("zones_at"), F.min("col").alias("first_col"), F.count("*").alias("_n"))
    head = head.join(assigned.where("_n >= 3").drop("_n"), KEY).drop("head")
    sample = grid.join(head, KEY).where("row_idx > header_idx AND row_idx <= header_idx + 8")
    left = sample.select(*KEY, F.posexplode("cells").alias("col", "value"), "first_col").where((F.col("col") < F.least(F.lit(8), "first_col")) & is_zone_token(F.col("value")))
    hits = left.groupBy(*KEY, "col").agg(F.count("*").alias("n")).groupBy(*KEY).agg(F.max_by("col", F.struct("n", -F.col("col"))).alias("origin_col"))
    head = scratch.save(head.join(hits, KEY, "left").withColumn("origin_col", F.coalesce("origin_col", F.lit(0))), "wide_columns")
    upper = lambda at: F.upper(F.coalesce(cell(F.col("cells"), at), F.lit("")))
    first: Column = upper(F.lit(0))
    own: Column = upper(F.col("origin_col"))
    label = F.when((F.col("origin_col") > 0) & ~is_zone_token(own) & is_zone_token(first), first).otherwise(own)
    rows = grid.join(head, KEY).where("row_idx > header_idx").select(*KEY, label.alias("label"), "cells", "zones_at")
    rows = rows.join(_resolve(rows, hubs, LEAST_ORIGIN, scratch, "origins"), ["vendor_id", "label"]).select(*KEY, F.explode("zones").alias("origin"), "cells", "zones_at")
    long = rows.select(*KEY, "origin", F.posexplode("cells").alias("col", "value"), "zones_at")
    long = long.select(*KEY, "origin", F.explode(F.element_at("zones_at", F.col("col"))).alias("dest"), parse_number(F.col("value")).alias("rate")).where("rate > 0")
    close = F.max("rate") - F.min("rate") < 3
    return _enough(long.groupBy(*KEY, "origin", "dest").agg(money(F.when(close, F.max("rate")).otherwise(F.avg("rate"))).alias("rate")), least_origins)
