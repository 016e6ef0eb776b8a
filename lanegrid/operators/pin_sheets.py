"""Lists of pincodes in cell grids, with a header or without one.

A sheet's layout is one row: where its data begins and which column has which role. It comes from the first header row
with a pincode column; failing that from profiles of the first columns, the first one that has pincodes enough;
failing that from the first cell that lists several.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanegrid.functions.pincodes import extract_pincodes_cell, is_oda, is_refused, parse_pincode_cell, valid_pincode, zone_hint
from lanegrid.operators.sheet_cells import KEY, cell, first_row
from lanegrid.runtime import Scratch

# Fixed values ---------------------------------------------------------------------------------
PIN_NAMES = [
    "pincode", "pin", "pin code", "postal", "zip", "zip code", "pin no", "pinno", "postal code", "pincodes", "pin codes", "pin_code", "pincode no",
    "pincode number", "destination pincode", "origin pincode", "src pincode", "dest pincode", "to pincode", "from pincode", "delivery pincode",
    "service pincode", "zipcode",
]
PIN_PARTS = ["pincode", "postal code", "zip code", "pin code", "pin no", "dest pin", "destination pin", "loc code"]
DELIVERY_NAMES = [
    "delivery", "deliverable", "delivered", "del", "delivery status", "is deliverable", "is serviceable", "serviceable", "serviceability", "service",
    "served", "is served", "active",
]
ODA_FLAGS = ["oda", "is oda", "is_oda", "edl", "out of delivery", "out_of_delivery", "non serviceable", "non-serviceable", "restricted", "oda area", "oda zone"]
ODA_PARTS = ["oda", "edl", "out of delivery", "non serviceable", "non-serviceable", "special area", "remote"]
STATE_NAMES = ["state", "state code", "statecode", "state_code", "st", "state name"]
CATEGORY_NAMES = ["category", "cat", "type", "service type", "shipment type"]
ODA_SHEETS = ["oda", "out of delivery", "out_of_delivery", "edl", "special zone", "special area", "remote area", "non serviceable", "non-serviceable"]
HEADER_ROWS, PROFILE_ROWS, PROFILE_COLUMNS, CATEGORY_ROWS, LISTED_ROWS = 20, 150, 8, 300, 30
LEAST_PINS, LEAST_LISTED = 3, 10
# ----------------------------------------------------------------------------------------------


def _name(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def _any_part(text: Column, parts: list[str]) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | F.contains(text, F.lit(p))
    return found


def _is_pin_header(c: Column) -> Column:
    """A pincode header: one of the names, or at most three words with a telling part (a longer cell is a title)."""
    name = _name(c)
    return name.isin(PIN_NAMES) | (_any_part(name, PIN_PARTS) & (F.size(F.split(name, r"\s+")) <= 3))


def _role(c: Column) -> Column:
    name = _name(c)
    return (
        F.when(_any_part(name, DELIVERY_NAMES), "delivery").when(name.isin(ODA_FLAGS), "flag").when(_any_part(name, ODA_PARTS), "oda").when(name.isin(STATE_NAMES), "state")
    )


def _at(flags: Column, last: bool = False) -> Column:
    """Index of the first (or last) true element, null if none."""
    if last:
        back = F.array_position(F.reverse(flags), True)
        return F.when(back > 0, F.size(flags) - back).cast("int")
    return F.nullif(F.array_position(flags, True), F.lit(0)).cast("int") - 1


def with_header(grid: DataFrame) -> DataFrame:
    """(KEY, start, pin, zone, state, oda, flag, delivery): the layout of sheets with a pincode header."""
    pins = F.transform("cells", lambda c: F.coalesce(_is_pin_header(c), F.lit(False)))
    head = first_row(grid.withColumn("pin", _at(pins)), F.col("pin").isNotNull(), HEADER_ROWS, ["pin", "cells"])
    roles = F.transform("cells", lambda c, i: F.when(i != F.col("pin"), _role(c)))
    head = head.withColumn("roles", roles)
    where = lambda role: F.transform("roles", lambda r: F.coalesce(r == role, F.lit(False)))
    flag = _at(where("flag"), last=True)
    # a column that only speaks of remote areas counts while none is found and no flag stands left of it
    oda = F.when(_at(where("flag")).isNull() | (_at(where("oda")) < _at(where("flag"))), _at(where("oda")))
    other = lambda test: F.transform("cells", lambda c, i: (i != F.col("pin")) & test(_name(c)))
    laid = head.select(
        *KEY, F.col("header_idx").cast("int").alias("header_idx"), "pin", _at(where("delivery"), last=True).alias("delivery"), flag.alias("flag"), oda.alias("oda"),
        _at(where("state"), last=True).alias("state"), _at(other(lambda n: F.contains(n, F.lit("zone")))).alias("zone"), _at(other(lambda n: n.isin(CATEGORY_NAMES))).alias("category"),
    )
    asked = laid.where("category IS NOT NULL AND oda IS NULL AND flag IS NULL").select(*KEY, "header_idx", "category")
    rows = grid.join(asked, KEY).where(f"row_idx > header_idx AND row_idx < header_idx + {CATEGORY_ROWS}")
    marked = rows.where(F.upper(cell(F.col("cells"), F.col("category"))).startswith("ODA")).select(*KEY, F.lit(True).alias("_marked")).distinct()
    laid = laid.join(marked, KEY, "left").withColumn("oda", F.coalesce("oda", F.when(F.col("_marked"), F.col("category"))))
    return laid.select(*KEY, (F.col("header_idx") + 1).alias("start"), "pin", "zone", "state", "oda", "flag", "delivery")


def by_profile(grid: DataFrame) -> DataFrame:
    """(KEY, start, pin): of sheets the first of PROFILE_COLUMNS columns with LEAST_PINS pincodes in the first PROFILE_ROWS rows."""
    cells = grid.where(F.col("row_idx") < PROFILE_ROWS).select(*KEY, F.posexplode(F.slice("cells", 1, PROFILE_COLUMNS)).alias("pin", "value"))
    counts = cells.where(valid_pincode(F.col("value")).isNotNull()).groupBy(*KEY, "pin").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_PINS)
    return counts.groupBy(*KEY).agg(F.lit(0).alias("start"), F.min("pin").cast("int").alias("pin"))


def by_listed_cells(grid: DataFrame) -> DataFrame:
    """(KEY, start, pin): of sheets the first cell, by row, that lists LEAST_PINS pincodes, if its column lists LEAST_LISTED from there on."""
    cells = grid.select(*KEY, "row_idx", F.posexplode("cells").alias("col", "value")).withColumn("n", F.size(extract_pincodes_cell(F.col("value"))))
    seeds = cells.where((F.col("row_idx") < LISTED_ROWS) & (F.col("n") >= LEAST_PINS)).select(*KEY, F.col("row_idx").alias("start"), F.col("col").alias("pin"))
    held = cells.where("n > 0").withColumnRenamed("col", "pin").join(seeds, [*KEY, "pin"]).where("row_idx >= start")
    full = held.groupBy(*KEY, "start", "pin").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_LISTED)
    first = full.groupBy(*KEY).agg(F.min(F.struct("start", "pin")).alias("s"))
    return first.select(*KEY, F.col("s.start").cast("int").alias("start"), F.col("s.pin").cast("int").alias("pin"))


def pincode_list(grid: DataFrame, least: int = LEAST_PINS, scratch: Scratch | None = None) -> DataFrame:
    """(KEY, pincode, zone_label, oda) of sheets that list pincodes.

    Cells with several pincodes give each of them, without flags. Others are read with their row: remote by mark or
    by a category that begins so; refused rows go unless they are marked as remote; the zone is that of the zone
    column, the state's where there is none. A sheet with fewer than ``least`` pincodes is none; one that is named after
    remote areas and marks none is remote as a whole.
    """
    scratch = scratch or Scratch(grid.sparkSession)
    grid = scratch.save(grid, "pin_grid")
    named = scratch.save(with_header(grid), "pin_headers")
    rest = grid.join(named.select(*KEY), KEY, "left_anti")
    profiled = scratch.save(by_profile(rest), "pin_profiles")
    listed = by_listed_cells(rest.join(profiled.select(*KEY), KEY, "left_anti")).withColumn("only_lists", F.lit(True))
    layout = scratch.save(named.unionByName(profiled, True).unionByName(listed, True), "pin_layouts")
    rows = grid.join(layout, KEY).where("row_idx >= start")
    get = lambda n: cell(F.col("cells"), F.col(n))
    many = extract_pincodes_cell(get("pin"))
    rows = rows.select(*KEY, F.when((F.size(many) > 1) | F.col("only_lists"), many).alias("many"), parse_pincode_cell(get("pin")).alias("one"), *[get(n).alias(n) for n in ("zone", "state", "oda", "flag", "delivery")], F.col("zone").isNotNull().alias("zoned"))
    single = F.col("many").isNull()
    oda = single & (is_oda(F.col("oda")) | is_oda(F.col("flag")))
    label = F.when(single, F.when(F.col("zoned"), zone_hint(F.col("zone"), F.col("state"))).otherwise(zone_hint(None, F.col("state"))))
    pins = F.explode(F.coalesce("many", F.array("one")))
    read = rows.where(~single | oda | ~is_refused(F.col("delivery"))).select(*KEY, pins.alias("pincode"), label.alias("zone_label"), oda.alias("oda")).where("pincode IS NOT NULL")
    sheet = Window.partitionBy(*KEY)
    counted = read.withColumns({"_n": F.count("*").over(sheet), "_marked": F.max("oda").over(sheet)}).where(F.col("_n") >= least)
    whole = ~F.col("_marked") & _any_part(F.lower("sheet"), ODA_SHEETS)
    return counted.withColumn("oda", F.col("oda") | whole).drop("_n", "_marked")
