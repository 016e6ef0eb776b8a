"""Detectors over cell grids: (sheet keys, row_idx, cells array<string>) to rates, pincodes, slabs and charges.

``KEY`` names the columns that identify a sheet; every operator works on all sheets at once.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanegrid.functions.charges import let, parse_number, parse_vf
from lanegrid.functions.pincodes import parse_pincode_cell
from lanegrid.operators import labels, zone_sheets
from lanegrid.operators.coverage import label_zones
from lanegrid.operators.label_index import COMPANY, plain_label
from lanegrid.operators.pin_sheets import pincode_list
from lanegrid.operators.rates import money
from lanegrid.operators.sheet_cells import KEY, cell, first_row, header_name, is_zone, position
from lanegrid.operators.zone_sheets import long_matrix, wide_matrix
from lanegrid.plans import dims

__all__ = ["KEY", "long_matrix", "pincode_list", "wide_matrix"]

# Fixed values ---------------------------------------------------------------------------------
KV_WORDS = r"(?i)\b(?:dwb|docket|minimum|min|cod|dacc|fod|ngt|volumetric|fuel|handling|rov|fov|oda|insurance|topay|prepaid)\b"
AIR = r"(?i)\bby\s*air\b|\bair\s*(?:freight|mode|rates?)\b"
ROAD = r"(?i)\bby\s*(?:road|surface|ground)\b|\bsurface\s*(?:freight|mode|rates?)\b"
CORNER = r"(?i)^\s*(?:from[/\\]?to|to[/\\]?from|from|to|origin[/\\]?dest(?:ination)?|o(?:rig)?[/\\]d(?:est)?|from\s*station|zone|lanes?|route)\s*$"
DEST_HEADER = r"(?i)\b(?:destination|dest|to\s*city|city|location|consignee\s*city|deliver(?:y|ing)?\s*(?:city|location)?|hub|station|branch)\b"
RATE_HEADER = r"(?i)\b(?:rate|rates?|charge|charges?|freight|per\s*kg|rs\.?/kg|pricing|amount|cost)\b"
STATE_HEADER = r"(?i)\b(?:state|province|region)\b"
ORIGIN_SIGNAL = r"(?i)\b(?:ex[:\s]+|from[:\s]+|origin[:\s]*|dispatching\s+from[:\s]+|base[:\s]+(?:city|location)[:\s]+)([A-Z][A-Z /&,.-]{2,40})"
AIR_LABEL = r"(?i)\bby\s+air\b"
ROAD_LABEL = r"(?i)\bby\s+(?:road|surface|ground|express)\b"
RATE_UNITS = r"(?i)(?:rs\.?\s*|per\s*kg|/\s*kg)"
#: Preference of a station sheet's rate columns, highest first: (score, words that the header has, words that it has not).
STATION_RATES = [(6, ["out card"], []), (6, ["out_card"], []), (5, ["base", "rate"], []), (4, ["freight", "rate"], []), (3, ["surface"], []), (2, ["rate"], ["express", "topay", "to pay"]), (1, ["rate"], [])]
DEFAULT_STATION = "OKL"
COMPANY_FIELDS = {
    "company": "name", "company name": "name", "transporter": "name", "transporter name": "name", "carrier": "name", "carrier name": "name",
    "vendor": "name", "vendor name": "name", "name": "name", "organisation": "name", "organization": "name", "firm": "name", "firm name": "name",
    "party name": "name", "party": "name",
    "gst": "gstNo", "gst no": "gstNo", "gst no.": "gstNo", "gst number": "gstNo", "gstin": "gstNo", "gst registration": "gstNo", "gst reg": "gstNo",
    "gst registration no": "gstNo", "gst id": "gstNo", "gstn": "gstNo",
    "pan": "panNo", "pan no": "panNo", "pan no.": "panNo", "pan number": "panNo", "pan card": "panNo", "permanent account number": "panNo",
    "cin": "cin", "cin no": "cin", "company identification number": "cin",
    "phone": "phone", "phone no": "phone", "phone number": "phone", "mobile": "phone", "mobile no": "phone", "mobile number": "phone", "contact": "phone",
    "contact no": "phone", "contact number": "phone", "tel": "phone", "telephone": "phone", "landline": "phone",
    "email": "email", "email id": "email", "email address": "email", "e-mail": "email", "e mail": "email",
    "address": "address", "registered address": "address", "office address": "address", "branch address": "address", "head office": "address", "hq": "address",
    "city": "city", "town": "city", "district": "city", "origin city": "city", "origin": "city", "hub city": "city", "hub": "city",
    "state": "state", "state name": "state", "province": "state",
    "pincode": "contact_pincode", "pin": "contact_pincode", "zip": "contact_pincode", "zip code": "contact_pincode", "postal code": "contact_pincode",
    "website": "website", "url": "website", "web": "website",
    "mode": "transportMode", "transport mode": "transportMode", "service type": "serviceType", "service": "serviceType", "category": "serviceType", "type": "serviceType",
    "rating": "rating", "score": "rating", "approval": "approvalStatus", "approval status": "approvalStatus", "status": "status",
    "vendor code": "vendorCode", "vendor_code": "vendorCode", "vendor id": "vendorCode", "vendor no": "vendorCode", "carrier code": "vendorCode",
}
CHARGE_WORDS = r"(?i)\b(rate|charge|freight|surcharge|oda|fuel|gst|tax|per\s*kg|minimum|slab|basic|zone|weight|transit|pickup|delivery|docket|consignment|insurance|rov|fov)\b"
PLACEHOLDER = r"(?i)^[-–—na/]+$"
NO_VALUE = ["", "none", "null", "na", "n/a", "-"]
#: Charges whose plain number is an amount, never a percentage.
ALWAYS_FIXED = ["topayCharges", "codCharges", "docketCharges", "daccCharges", "dodCharges", "fmCharges", "appointmentCharges", "prepaidCharges"]
SHEET_CAPS = {"docketCharges": 2000, "daccCharges": 10000, "codCharges": 5000, "topayCharges": 5000, "greenTax": 2000, "appointmentCharges": 10000}
# ----------------------------------------------------------------------------------------------


def wide_header(grid: DataFrame) -> DataFrame:
    """(KEY, header_idx, first_col, head): a matrix's header whose zone columns are named as in the table."""
    head = zone_sheets.wide_header(grid).where(F.size(F.filter("head", lambda c: is_zone(c))) >= 3)
    return head.withColumn("first_col", F.array_position(F.transform("head", lambda c: is_zone(c)), True) - 1)


def hub_key(grid: DataFrame, least: int = 3) -> DataFrame:
    """(vendor_id, hub, zone) of sheets named like a hub key, of known zones, if there are enough."""
    rows = grid.where(F.lower("sheet").rlike("hub.*key|hub.*city|city.*key")).withColumns({"h": position(F.col("cells"), ["hub", "hub code", "code"]), "z": position(F.col("cells"), ["zone"])})
    head = first_row(rows, F.col("h").isNotNull() & F.col("z").isNotNull(), 5, ["h", "z"])
    pairs = rows.drop("h", "z").join(head, KEY).where("row_idx > header_idx").select(*KEY, F.upper(cell(F.col("cells"), F.col("h"))).alias("hub"), F.upper(cell(F.col("cells"), F.col("z"))).alias("zone"), "row_idx")
    pairs = pairs.where((F.col("hub") != "") & F.col("zone").isin(dims.ZONES)).groupBy(*KEY, "hub").agg(F.max_by("zone", "row_idx").alias("zone"))
    return pairs.withColumn("_n", F.count("*").over(Window.partitionBy(*KEY))).where(F.col("_n") >= least).select("vendor_id", "hub", "zone")


def place_zones(rows: DataFrame, places: DataFrame, place: str = "place") -> DataFrame:
    """Adds ``zone`` of a city or state: exact name first, then a name that contains or is contained (four letters or more), the first in the dictionary.

    ``places`` (name, zone, dim_order) is a dictionary of fixed size and is broadcast; the containment
    layer runs on the distinct names that the exact one left.
    """
    name = F.upper(F.trim(F.col(place)))
    known = F.broadcast(places.select(F.upper("name").alias("_name"), "zone", "dim_order"))
    asked = rows.select(name.alias("_asked")).distinct()
    exact = asked.join(known, F.col("_asked") == F.col("_name")).select("_asked", "zone", "dim_order")
    rest = asked.join(exact.select("_asked"), "_asked", "left_anti").where(F.length("_asked") >= 4)
    inside = rest.join(known, (F.length("_name") >= 4) & (F.contains("_asked", "_name") | F.contains("_name", "_asked"))).select("_asked", "zone", "dim_order")
    best = exact.unionByName(inside).groupBy("_asked").agg(F.min_by("zone", "dim_order").alias("zone"))
    return rows.withColumn("_asked", name).join(best, "_asked", "left").drop("_asked")


def cell_zones(rows: DataFrame, column: str, places: DataFrame, master: DataFrame, into: str = "zones") -> DataFrame:
    """Adds the zones of a cell: a zone code or region label, else a city or state of ``places``, else a pincode of ``master``; null for corner labels and others."""
    asked = rows.select(F.upper(F.trim(column)).alias("_cell")).distinct().where((F.col("_cell") != "") & ~F.col("_cell").rlike(CORNER))
    labels = F.broadcast(dims.label_zones(rows.sparkSession).select(F.col("label").alias("_cell"), F.col("zones").alias("_known")))
    pins = master.select(F.lpad(F.col("pincode").cast("string"), 6, "0").alias("_cell"), F.col("zone").alias("_pin_zone")).dropDuplicates(["_cell"])
    found = place_zones(asked, places, "_cell").join(labels, "_cell", "left").join(pins, "_cell", "left")
    one = F.coalesce("zone", "_pin_zone")
    found = found.select("_cell", F.coalesce("_known", F.when(one.isNotNull(), F.array(one))).alias(into)).where(F.col(into).isNotNull())
    return rows.withColumn("_cell", F.upper(F.trim(column))).join(found, "_cell", "left").drop("_cell")


def close_or_mean(samples: DataFrame, by: list[str]) -> DataFrame:
    """(by, rate): the highest of samples within 5 of each other, else their mean."""
    return samples.groupBy(*by).agg(money(F.when(F.max("rate") - F.min("rate") <= 5, F.max("rate")).otherwise(F.avg("rate"))).alias("rate"))


def city_matrix(grid: DataFrame, places: DataFrame, master: DataFrame, context: list[str] | None = None, air_from: float = 60.0) -> DataFrame:
    """(KEY, origin, dest, rate) of sheets with places across and down.

    The header is the first of 20 rows with three or more cells that name zones, cities, states
    or pincodes; origins stand left of its first such cell. A blank origin, or one that names a
    user, means ``context`` (E1 unless given). Origins whose lowest rate is over ``air_from`` go,
    unless all of a sheet's are.
    """
    top = grid.where("row_idx < 20").select(*KEY, "row_idx", F.posexplode("cells").alias("col", "cell"))
    named = cell_zones(top, "cell", places, master).where("zones is not null")
    by_row = named.groupBy(*KEY, "row_idx").agg(F.count("*").alias("n"), F.min("col").alias("first_col"), F.max("col").alias("last_col")).where("n >= 3")
    head = by_row.groupBy(*KEY).agg(F.min("row_idx").alias("header_idx"), F.min_by("first_col", "row_idx").alias("first_col"), F.min_by("last_col", "row_idx").alias("last_col"))
    across = named.withColumnsRenamed({"row_idx": "header_idx", "zones": "dests"}).drop("cell").join(head.select(*KEY, "header_idx"), [*KEY, "header_idx"]).drop("header_idx")
    rows = grid.join(head, KEY).where("row_idx > header_idx and size(cells) > last_col")
    rows = rows.withColumn("from", F.upper(cell(F.col("cells"), F.greatest(F.col("first_col") - 1, F.lit(0)))))
    rows = cell_zones(rows, "from", places, master, "origins")
    unnamed = F.col("from").isin("", "-", "NONE") | F.col("from").contains("USER")
    rows = rows.withColumn("origins", F.coalesce("origins", F.when(unnamed, F.array(*map(F.lit, context or ["E1"]))))).where("origins is not null")
    values = rows.select(*KEY, "origins", F.posexplode("cells").alias("col", "value")).join(across, [*KEY, "col"])
    rate = F.replace(F.trim("value"), F.lit(","), F.lit("")).try_cast("double")
    samples = values.select(*KEY, "origins", "dests", rate.alias("rate")).where("rate between 0.5 and 500")
    samples = samples.withColumn("origin", F.explode("origins")).withColumn("dest", F.explode("dests"))
    matrix = close_or_mean(samples, [*KEY, "origin", "dest"])
    least = F.min("rate").over(Window.partitionBy(*KEY, "origin"))
    marked = matrix.withColumn("_air", least > air_from)
    return marked.withColumn("_all", F.min("_air").over(Window.partitionBy(*KEY))).where("_all or not _air").drop("_air", "_all")


def city_rate_card(grid: DataFrame, places: DataFrame, master: DataFrame, air_from: float = 60.0, default_origin: str = "N1") -> DataFrame:
    """(KEY, origin, dest, rate) of sheets that list destinations and rates from one origin.

    A sheet may have several headers (a destination and a rate column); each begins a section
    that lasts to the next. A section is by air if the nearest mode label in its header row or the
    five rows above says so; labels inside switch from their row on. Rows before the first header
    are a section of their own if the first one looks like data. The origin is named before the
    first header. A destination without a zone takes its state's. Sheets whose lowest rate
    outside the special zones is over ``air_from`` are dropped.
    """
    text = F.array_join(F.transform("cells", lambda c: F.trim(c)), " ")
    at = lambda pattern: F.nullif(F.array_position(F.transform("cells", lambda c: F.coalesce(c, F.lit("")).rlike(pattern)), True), F.lit(0)) - 1
    label = F.when(text.rlike(AIR_LABEL), "air").when(text.rlike(ROAD_LABEL), "road")
    rows = grid.withColumns({"_d": at(DEST_HEADER), "_r": at(RATE_HEADER), "_s": at(STATE_HEADER), "_label": label, "_text": text})
    rows = rows.withColumn("_head", F.col("_d").isNotNull() & F.col("_r").isNotNull())
    ordered = Window.partitionBy(*KEY).orderBy("row_idx")
    near = F.last("_label", ignorenulls=True).over(ordered.rangeBetween(-5, 0))
    columns = F.when(F.col("_head"), F.struct("_d", "_r", "_s", F.coalesce(near, F.lit("road")).alias("mode"), F.col("row_idx").alias("section")))
    rows = rows.withColumn("_columns", columns).withColumn("_in", F.last("_columns", ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    # the part before the first header: data if row 0 has a name and a number in its third cell
    sheet_wide = Window.partitionBy(*KEY)
    value = lambda i: F.trim(F.get("cells", F.lit(i)))
    data_first = (F.col("row_idx") == 0) & (value(0) != "") & ~value(0).rlike(RATE_HEADER) & F.replace(value(2), F.lit(","), F.lit("")).rlike(r"^\d+(?:\.\d+)?$")
    rows = rows.withColumns({"_first": F.min(F.when(F.col("_head"), F.col("row_idx"))).over(sheet_wide), "_data_first": F.max(F.coalesce(data_first, F.lit(False))).over(sheet_wide)})
    rows = rows.where("_first is not null")
    place = F.trim(F.regexp_extract("_text", ORIGIN_SIGNAL, 1))
    signals = rows.where(F.col("row_idx") < F.col("_first")).withColumn("place", place).where("place <> ''")
    signals = cell_zones(signals.groupBy(*KEY).agg(F.min_by("place", "row_idx").alias("place")), "place", places, master)
    origins = signals.select(*KEY, F.get("zones", F.lit(0)).alias("_origin"))

    lead = F.struct(F.lit(0).cast("bigint").alias("_d"), F.lit(2).cast("bigint").alias("_r"), F.lit(1).cast("bigint").alias("_s"), F.lit("road").alias("mode"), F.lit(-1).alias("section"))
    kind = "struct<_d:bigint,_r:bigint,_s:bigint,mode:string,section:int>"
    body = rows.withColumn("_in", F.coalesce(F.col("_in").cast(kind), F.when(F.col("_data_first"), lead.cast(kind)))).where("_in is not null and not _head and _in.mode = 'road'")
    inside = Window.partitionBy(*KEY, "_in.section").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, 0)
    body = body.withColumn("_mode", F.coalesce(F.last("_label", ignorenulls=True).over(inside), F.lit("road"))).where("_label is null and _mode = 'road'")
    get = lambda c: F.upper(cell(F.col("cells"), F.col(c)))
    rate = F.trim(F.regexp_replace(F.replace(get("_in._r"), F.lit(","), F.lit("")), RATE_UNITS, "")).try_cast("double")
    body = body.select(*KEY, get("_in._d").alias("dest_cell"), F.coalesce(get("_in._s"), F.lit("")).alias("state_cell"), rate.alias("rate"))
    body = body.where(~F.col("dest_cell").isin("", "DESTINATION", "DEST", "CITY") & (F.col("rate") > 0) & (F.col("rate") <= 500))
    body = cell_zones(cell_zones(body, "dest_cell", places, master, "by_place"), "state_cell", places, master, "by_state")
    samples = body.withColumn("dest", F.explode(F.coalesce("by_place", "by_state")))
    card = close_or_mean(samples, [*KEY, "dest"])
    regular = F.min(F.when(~F.col("dest").startswith("X"), F.col("rate"))).over(sheet_wide)
    card = card.withColumn("_least", regular).where(F.coalesce(F.col("_least") <= air_from, F.lit(True))).drop("_least")
    return card.join(origins, KEY, "left").select(*KEY, F.coalesce("_origin", F.lit(default_origin)).alias("origin"), "dest", "rate")


def station_rates(grid: DataFrame, places: DataFrame, stations: DataFrame, master: DataFrame, least_rate: float = 0.5, most_rate: float = 150.0, default_origin: str = "N1") -> DataFrame:
    """(KEY, origin, dest, rate) of sheets with a pincode and a rate from one station per row.

    The header is the first of 12 rows with a pincode column and a rate or distance column. Of the
    columns in or above it the one whose name is preferred most holds the rate. The origin is the
    first station among 100 rows, by ``stations`` (code, zone), else as a place; sheets with more
    than five stations there are none of this kind. A destination is its pincode's zone.
    """
    low = F.transform("cells", lambda c: F.lower(F.trim(F.coalesce(c, F.lit("")))))
    at = lambda test: F.nullif(F.array_position(F.transform("_low", test), True), F.lit(0)) - 1
    last = lambda test: F.array_max(F.filter(F.transform("_low", lambda c, i: F.when(test(c), i)), lambda i: i.isNotNull()))
    score = lambda c: F.coalesce(*[F.when(reduce(lambda x, y: x & y, [c.contains(w) for w in has] + [~c.contains(w) for w in hasnt]), F.lit(n)) for n, has, hasnt in STATION_RATES], F.lit(0))
    top = grid.where("row_idx < 12").withColumn("_low", low)
    top = top.withColumns(
        {
            "pin": at(lambda c: c.contains("pin")),
            "rate": at(lambda c: c.contains("rate") | c.contains("out card") | c.contains("out_card")),
            "km": at(lambda c: c.isin("km", "kms", "distance")),
            "station": last(lambda c: c.contains("from") & (c.contains("station") | (c == "from"))),
            "scores": F.transform("_low", score),
        }
    )
    head = first_row(top, F.col("pin").isNotNull() & (F.col("rate").isNotNull() | F.col("km").isNotNull()), 12, ["pin", "rate", "station"])
    scored = top.join(head.select(*KEY, "header_idx"), KEY).where("row_idx <= header_idx").select(*KEY, "row_idx", F.posexplode("scores").alias("col", "score")).where("score > 0")
    best = scored.groupBy(*KEY).agg(F.max_by("col", F.struct("score", -F.col("row_idx"), -F.col("col"))).alias("best"))
    head = head.join(best, KEY, "left").withColumn("rate", F.when(F.col("rate").isNotNull(), F.coalesce("best", "rate"))).drop("best")
    rows = grid.join(head.withColumnsRenamed({"rate": "_rate", "pin": "_pin", "station": "_station"}), KEY).where("row_idx > header_idx")
    rows = rows.withColumn("_place", F.row_number().over(Window.partitionBy(*KEY).orderBy("row_idx")))
    named = rows.where("_place <= 100").withColumn("station", F.upper(cell(F.col("cells"), F.col("_station")))).where(~F.col("station").isin("", "NAN", "NONE"))
    stated = named.groupBy(*KEY).agg(F.count_distinct("station").alias("_n"), F.min_by("station", "row_idx").alias("station"))
    origins = head.select(*KEY).join(stated, KEY, "left").where("coalesce(_n, 1) <= 5").withColumn("station", F.coalesce("station", F.lit(DEFAULT_STATION)))
    codes = stations.select(F.col("code").alias("station"), F.col("zone").alias("_by_code"))
    origins = cell_zones(origins.join(codes, "station", "left"), "station", places, master)
    origins = origins.select(*KEY, F.coalesce("_by_code", F.get("zones", F.lit(0)), F.lit(default_origin)).alias("origin"))
    pin = F.trim(F.get("cells", F.col("_pin").cast("int"))).try_cast("double").cast("int")
    rate = F.replace(cell(F.col("cells"), F.col("_rate")), F.lit(","), F.lit("")).try_cast("double")
    samples = rows.select(*KEY, pin.alias("pincode"), rate.alias("rate")).where(F.col("pincode").between(100000, 999999) & F.col("rate").between(least_rate, most_rate))
    samples = samples.join(master.select("pincode", F.col("zone").alias("dest")).dropDuplicates(["pincode"]), "pincode").join(origins, KEY)
    return close_or_mean(samples, [*KEY, "origin", "dest"])


def grounded_matrix(grid: DataFrame, master: DataFrame, least_origins: int = 3) -> DataFrame:
    """Medians of rates in sheets with a pincode per row and an origin zone per column; the row's zone is the master's."""
    head = wide_header(grid)
    rows = grid.join(head, KEY).where("row_idx > header_idx")
    rows = rows.select(*KEY, parse_pincode_cell(cell(F.col("cells"), F.col("first_col") - 1)).alias("pincode"), F.posexplode("cells").alias("col", "value"), "head", "first_col").where("pincode is not null and col >= first_col")
    cells = rows.select(*KEY, "pincode", F.upper(F.get("head", F.col("col"))).alias("origin"), parse_number(F.col("value")).alias("rate")).where(F.col("origin").isin(dims.ZONES) & (F.col("rate") > 0))
    out = cells.join(master.select("pincode", F.col("zone").alias("dest")), "pincode").groupBy(*KEY, "origin", "dest").agg(money(F.median("rate")).alias("rate"))
    return out.withColumn("_n", F.size(F.collect_set("origin").over(Window.partitionBy(*KEY)))).where(F.col("_n") >= least_origins).drop("_n")


def drop_air_rows(grid: DataFrame) -> DataFrame:
    """Rows after an air marker go until a road marker; rows before any marker stay, marker rows go."""
    text = F.array_join("cells", " ")
    mode = F.when(text.rlike(AIR), "air").when(text.rlike(ROAD), "road")
    by = Window.partitionBy(*KEY).orderBy("row_idx").rowsBetween(Window.unboundedPreceding, 0)
    marked = grid.withColumn("_mark", mode).withColumn("_mode", F.last("_mark", ignorenulls=True).over(by))
    return marked.where(F.col("_mark").isNull() & (F.coalesce("_mode", F.lit("road")) == "road")).drop("_mark", "_mode")


def surface_row(grid: DataFrame) -> DataFrame:
    """Sheets with a charge header (three or more charge words in the first 8 rows) over two or more number rows: the header and the first number row only."""
    words = F.size(F.filter("cells", lambda c: c.rlike(KV_WORDS)))
    numbers = F.size(F.filter("cells", lambda c: parse_number(c).isNotNull()))
    flagged = grid.withColumns({"_w": words, "_n": numbers})
    head = first_row(flagged, F.col("_w") >= 3, 8, [])
    below = flagged.join(head, KEY).where((F.col("row_idx") > F.col("header_idx")) & (F.col("_n") >= 2))
    firsts = below.groupBy(*KEY, "header_idx").agg(F.count("*").alias("c"), F.min("row_idx").alias("first")).where("c >= 2")
    rows = grid.join(firsts, KEY, "left")
    return rows.where("first is null or row_idx = header_idx or row_idx = first").drop("header_idx", "c", "first")


def charge_sheets(grid: DataFrame) -> DataFrame:
    """Keys of sheets that may hold charges: no destination header with times or rates, and no three rows of delivery times at the top."""
    text = F.array_join("cells", " ")
    header = (F.col("row_idx") < 20) & text.rlike(r"(?i)\bdestination\b") & text.rlike(r"(?i)\btat\b|\btransit\s*(?:time|days?)\b|\bdelivery\s*(?:time|days?)\b|\brates?\b|\bper\s*kg\b|\bmin(?:imum)?\s*weight\b")
    times = (F.col("row_idx") < 8) & text.rlike(r"(?i)\b\d+\s*[-–]\s*\d+\s*(?:hrs?|days?)\b")
    marked = grid.groupBy(*KEY).agg(F.max(header.cast("int")).alias("h"), F.sum(times.cast("int")).alias("t"))
    return marked.where("h = 0 and t < 3").select(*KEY)


def horizontal_pairs(grid: DataFrame) -> DataFrame:
    """(KEY, label, value): the first charge header among six rows with four or more numbers right below, turned into pairs."""
    by = Window.partitionBy(*KEY).orderBy("row_idx")
    rows = grid.withColumn("values", F.lead("cells").over(by))
    words = F.size(F.filter("cells", lambda c: c.rlike(KV_WORDS)))
    numbers = F.size(F.filter("values", lambda c: parse_number(c).isNotNull()))
    head = first_row(rows, (words >= 3) & (numbers >= 4), 6, ["cells", "values"])
    pairs = head.select(*KEY, F.explode(F.arrays_zip(F.col("cells").alias("label"), F.col("values").alias("value"))).alias("p"))
    return pairs.select(*KEY, "p.label", "p.value").where("label <> '' and value <> ''")


def weight_bounds(text: Column) -> Column:
    """(min_kg, max_kg) of a weight slab: ``a-b``, ``up to b``, ``above a``."""
    n = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)"), 1), lambda x: x.cast("double"))
    low = F.lower(text)
    open_top = low.rlike(r"above|over|\+|>")
    up_to = low.rlike(r"up\s*to|below|<")
    lo = F.when(up_to, 0.0).otherwise(F.get(n, F.lit(0)))
    hi = F.when(open_top, F.lit(None).cast("double")).when(up_to, F.get(n, F.lit(0))).otherwise(F.get(n, F.lit(1)))
    return F.struct(lo.alias("min_kg"), hi.alias("max_kg"))


def weight_slabs(grid: DataFrame, least: int = 2) -> DataFrame:
    """(KEY, min_kg, max_kg, zone, rate) of sheets with a weight column and two or more zone columns in the first 20 rows."""
    zones = F.size(F.filter("cells", lambda c: is_zone(c)))
    head = first_row(grid, F.get("cells", F.lit(0)).rlike(r"(?i)weight|slab|kg") & (zones >= 2), 20, ["cells"]).withColumnRenamed("cells", "head")
    rows = grid.join(head, KEY).where("row_idx > header_idx and size(cells) > 1").withColumn("_b", weight_bounds(F.get("cells", F.lit(0)))).where("_b.min_kg is not null")
    out = rows.select(*KEY, "row_idx", "_b.min_kg", "_b.max_kg", F.posexplode("cells").alias("col", "value"), "head").where("col > 0")
    out = out.select(*KEY, "row_idx", "min_kg", "max_kg", F.upper(F.get("head", F.col("col"))).alias("zone"), parse_number(F.col("value")).alias("rate")).where("rate is not null")
    return out.withColumn("_n", F.size(F.collect_set("row_idx").over(Window.partitionBy(*KEY)))).where(F.col("_n") >= least).drop("_n", "row_idx")


def distance_matrix(grid: DataFrame) -> DataFrame:
    """(KEY, min_km, max_km, min_kg, max_kg, charge) of sheets with a distance column and two or more weight ranges; NIL and FREE are 0."""
    ranges = F.size(F.filter("cells", lambda c: c.rlike(r"(?i)\d+.*kg")))
    head = first_row(grid, F.get("cells", F.lit(0)).rlike(r"(?i)distance|kms?\b") & (ranges >= 2), 20, ["cells"]).withColumnRenamed("cells", "head")
    rows = grid.join(head, KEY).where("row_idx > header_idx").withColumn("_d", weight_bounds(F.get("cells", F.lit(0)))).where("_d.min_kg is not null")
    out = rows.select(*KEY, "_d", F.posexplode("cells").alias("col", "value"), "head").where("col > 0").withColumn("_w", weight_bounds(F.get("head", F.col("col")))).where("_w.min_kg is not null")
    charge = F.when(F.upper(F.trim("value")).isin("NIL", "NA", "-", "FREE"), 0.0).otherwise(F.coalesce(parse_number(F.col("value")), F.lit(0.0)))
    return out.select(*KEY, F.col("_d.min_kg").alias("min_km"), F.col("_d.max_kg").alias("max_km"), "_w.min_kg", "_w.max_kg", charge.alias("charge"))


def weight_bands(grid: DataFrame) -> DataFrame:
    """(KEY, min_kg, max_kg, minimum, per_kg) of sheets with lower, upper, minimum and additional columns."""
    names = {"lo": ["lower limit", "lower", "from kg"], "hi": ["upper limit", "upper", "to kg"], "m": ["min rs", "minimum", "min"], "k": ["additional/kg", "additional", "per kg"]}
    named = grid.withColumns({n: position(F.col("cells"), v) for n, v in names.items()})
    head = first_row(named, F.col("lo").isNotNull() & F.col("hi").isNotNull() & F.col("m").isNotNull(), 20, list(names))
    rows = grid.join(head, KEY).where("row_idx > header_idx")
    value = lambda n: parse_number(cell(F.col("cells"), F.col(n)))
    return rows.select(*KEY, value("lo").alias("min_kg"), value("hi").alias("max_kg"), value("m").alias("minimum"), value("k").alias("per_kg")).where("min_kg is not null")


def per_box(grid: DataFrame) -> DataFrame:
    """(KEY, per_box, minimum) of the first row about handling per box: the smallest number up to 100, the largest over it."""
    text = F.lower(F.array_join("cells", " "))
    rows = grid.where(text.contains("handling") & text.rlike(r"per\s*(box|carton|piece)")).withColumn("n", F.transform(F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)"), 1), lambda x: x.cast("double")))
    first = rows.groupBy(*KEY).agg(F.min_by("n", "row_idx").alias("n"))
    return first.select(*KEY, F.array_min(F.filter("n", lambda x: x <= 100)).alias("per_box"), F.array_max(F.filter("n", lambda x: x > 100)).alias("minimum"))


def company_rows(grid: DataFrame) -> DataFrame:
    """(KEY, field, value) of sheets that name a company or have two company fields.

    Among the first five rows a row of one cell is a title: its parts between bars are ``key: value``
    pairs or a name, and a cell without bars is the name, unless it speaks of charges. The first of
    them counts. Rows of a known key and a value overrule titles, and the last of a field counts;
    keys are matched by the dictionary of fields, exactly or by ``labels.match`` from 0.7. A tax
    number that is none is passed over.
    """
    known = F.create_map(*[F.lit(x) for pair in COMPANY_FIELDS.items() for x in pair])
    filled = F.filter(F.transform("cells", lambda c: F.trim(F.coalesce(c, F.lit("")))), lambda c: c != "")
    titles = grid.where("row_idx < 5").select(*KEY, "row_idx", filled.alias("c")).where("size(c) = 1").select(*KEY, "row_idx", F.get("c", F.lit(0)).alias("title"))
    parts = titles.select(*KEY, "row_idx", F.contains("title", F.lit("|")).alias("_bars"), F.posexplode(F.split("title", r"\|")).alias("at", "part")).withColumn("part", F.trim("part")).where("part <> ''")
    pair = F.col("_bars") & F.contains("part", F.lit(":"))
    key = F.lower(F.trim(F.substring_index("part", ":", 1)))
    value = F.trim(F.expr("substring(part, instr(part, ':') + 1)"))
    field = F.when(pair, F.when((value != "") & ~value.rlike(PLACEHOLDER), known[key]))
    value = F.when(field == "city", F.trim(F.regexp_replace(value, r"\s*\([A-Z][A-Z0-9]{0,3}\)\s*$", ""))).otherwise(value)
    bare = ~pair & (F.length("part") >= 4) & ~F.col("part").rlike(r"^[0-9]") & ~F.col("part").rlike(CHARGE_WORDS) & (F.col("_bars") | ~F.col("part").rlike(PLACEHOLDER))
    titled = parts.select(*KEY, "row_idx", "at", F.coalesce(field, F.when(bare, "name")).alias("field"), F.when(bare, F.col("part")).otherwise(value).alias("value")).where("field is not null")
    titled = titled.groupBy(*KEY, "field").agg(F.min_by("value", F.struct("row_idx", "at")).alias("value"))

    rows = grid.where("size(cells) >= 2").select(*KEY, "row_idx", F.lower(cell(F.col("cells"), F.lit(0))).alias("label"), cell(F.col("cells"), F.lit(1)).alias("value"))
    rows = rows.where(~F.lower("value").isin(NO_VALUE)).withColumn("field", known[F.col("label")])
    close = labels.match(rows.where("field is null and label <> ''"), labels.dictionary(grid.sparkSession, {plain_label(k): v for k, v in COMPANY_FIELDS.items()}), replace(COMPANY, least=0.7)).where("confidence >= 0.7").select("label", F.col("value").alias("_close"))
    rows = rows.join(close, "label", "left").withColumn("field", F.coalesce("field", "_close")).where("field is not null")
    gst = F.upper(F.regexp_replace("value", r"\s+", ""))
    rows = rows.withColumn("value", F.when(F.col("field") != "gstNo", F.col("value")).when(gst.rlike(r"^\d{2}[A-Z]{5}\d{4}[A-Z]\d[A-Z0-9]{2}$"), gst)).where("value is not null")
    listed = rows.groupBy(*KEY, "field").agg(F.max_by("value", "row_idx").alias("value"))
    every = titled.withColumn("_r", F.lit(0)).unionByName(listed.withColumn("_r", F.lit(1))).groupBy(*KEY, "field").agg(F.max_by("value", "_r").alias("value"))
    sheet = Window.partitionBy(*KEY)
    counted = every.withColumns({"_n": F.count("*").over(sheet), "_name": F.max((F.col("field") == "name").cast("int")).over(sheet)})
    return counted.where("_n >= 2 or _name = 1").drop("_n", "_name")


def charge_values(grid: DataFrame, known: DataFrame) -> DataFrame:
    """(KEY, field, v, f, scalar, row_idx): charges of rows with a label and, to its right, a value.

    The label is the first cell, or the second where the first is empty; it means the longest name
    of ``known`` that it is or holds as whole words, else what ``labels.match`` finds from 0.65; names
    known to be no charge are skipped. ``cft`` values under 200 become divisors. Of the value's
    percentage and amount both are kept; one alone is a scalar, but an amount for fields that are
    always fixed. Values over a field's cap go. The first row of a field counts, a pair before a scalar.
    """
    text = F.transform("cells", lambda c: F.trim(F.coalesce(c, F.lit(""))))
    rows = grid.withColumn("_c", text).where("size(_c) >= 2")
    first = F.get("_c", F.lit(0))
    rows = rows.withColumn("_at", F.when(first != "", 0).when(F.get("_c", F.lit(1)) != "", 1)).where("_at is not null")
    rows = rows.withColumn("label", F.trim(F.regexp_replace(F.lower(F.get("_c", F.col("_at"))), r"\s+", " "))).where(~F.col("label").startswith("#"))
    rows = rows.withColumn("_v", F.filter(F.expr("slice(_c, _at + 2, size(_c))"), lambda c: c != "")).where("size(_v) > 0")
    asked = rows.select("label").distinct().withColumn("n", labels.normalise(F.col("label")))
    names = F.broadcast(known.select("known", "value", "dim_order"))  # the dictionary: of fixed size
    whole = F.contains(F.concat(F.lit(" "), "n", F.lit(" ")), F.concat(F.lit(" "), "known", F.lit(" "))) & ((F.length("known") >= 3) | (F.col("n") == F.col("known")))
    held = asked.join(names, whole).groupBy("label").agg(F.min_by(F.struct("value"), F.struct(-F.length("known"), "dim_order")).alias("held"))
    rest = labels.match(asked.join(held, "label", "left_anti").select("label"), known, 0.65).where("confidence >= 0.65").select("label", F.struct(F.col("value")).alias("held"))
    # each value is parsed once, and before the join, whose few labels meet in few tasks
    joined = F.array_join("_v", " ")
    number = F.get(F.filter(F.transform("_v", parse_number), lambda x: x.isNotNull()), F.lit(0))
    rows = rows.withColumn("_p", F.struct(joined.alias("text"), let(joined, parse_vf).alias("vf"), number.alias("number")))
    rows = rows.join(held.unionByName(rest), "label").withColumn("field", F.col("held.value")).where("field is not null")
    cft = (F.col("field") == "divisor") & F.col("label").rlike("cft|cfactor|k factor")
    cap = F.create_map(*[F.lit(x) for pair in SHEET_CAPS.items() for x in pair])[F.col("field")]
    plain = F.col("field").isin("fuel", "divisor", "minWeight")

    def charge(p: Column) -> Column:
        v, f, number = p["vf"]["v"], p["vf"]["f"], p["number"]
        both = v.isNotNull() & f.isNotNull()
        fixed = F.col("field").isin(ALWAYS_FIXED) & v.isNotNull() & f.isNull()
        percent = F.contains(p["text"], F.lit("%"))
        divisor = F.when((number > 0) & (number < 200), F.round(28316.8 / number, 0))
        return F.struct(
            F.when(cft, None).when(both, v).when(fixed, F.when(percent, v).otherwise(0.0)).when(f.isNotNull() & ~plain, None).alias("v"),
            F.when(cft, None).when(both, f).when(fixed, F.when(percent, 0.0).otherwise(v)).when(f.isNotNull() & ~plain, f).alias("f"),
            F.when(cft, divisor).when(both | fixed | (f.isNotNull() & ~plain), None).otherwise(F.coalesce(v, f, number)).alias("scalar"),
            F.col("row_idx").alias("row_idx"),
        )

    def counted(c: Column) -> Column:
        return F.when(F.coalesce(c["v"], c["f"], c["scalar"]).isNotNull() & ~F.coalesce(F.coalesce(c["f"], c["scalar"]) > cap, F.lit(False)), c)

    out = rows.select(*KEY, "field", let(F.col("_p"), lambda p: let(charge(p), counted)).alias("_b")).where("_b is not null")
    best = out.groupBy(*KEY, "field").agg(F.min_by("_b", F.struct(F.col("_b.scalar").isNotNull(), F.col("_b.row_idx"))).alias("b"))
    return best.select(*KEY, "field", "b.*")


def dispatch(candidates: DataFrame) -> DataFrame:
    """The matrix that counts for each vendor: by priority of its sheet's name, then by rank of its detector, then by sheet."""
    low = F.lower("sheet")
    priority = F.when(low.rlike("matrix|zone"), 0).when(low.rlike("pin"), 1).when(low.rlike("charge"), 2).otherwise(3)
    rank = F.dense_rank().over(Window.partitionBy("vendor_id").orderBy("_p", "detector", "sheet"))
    return candidates.withColumn("_p", priority).withColumn("_r", rank).where("_r = 1").drop("_p", "_r")


def first_seen(rates: DataFrame) -> DataFrame:
    """Per vendor, origin and destination the rate of the first table (table_idx, then row_idx)."""
    return rates.groupBy("vendor_id", "origin", "dest").agg(F.min_by("rate", F.struct("table_idx", "row_idx")).alias("rate"))


def words_to_grid(words: DataFrame, by: list[str], row_height: float = 8.0, gap: float = 12.0) -> DataFrame:
    """(by, row_top, cells): word boxes (top, left, right, text) into rows of one height and cells split at wide gaps."""
    rows = words.withColumn("row_top", F.floor(F.col("top") / row_height) * row_height)
    order = Window.partitionBy(*by, "row_top").orderBy("left", "right", "text")
    split = F.coalesce((F.col("left") - F.lag("right").over(order) > gap).cast("int"), F.lit(0))
    placed = rows.withColumn("_s", split).withColumn("_cell", F.sum("_s").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    word_list = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("left", "right", "text"))), lambda w: w["text"]), " ")
    cells = placed.groupBy(*by, "row_top", "_cell").agg(word_list.alias("cell"))
    return cells.groupBy(*by, "row_top").agg(F.transform(F.array_sort(F.collect_list(F.struct("_cell", "cell"))), lambda c: c["cell"]).alias("cells"))


def ocr_words_to_grid(words: DataFrame, by: list[str], least_confidence: float = 30.0) -> DataFrame:
    """(by, row, cells): recognised words (top, left, right, height, confidence, text) of confidence over a limit.

    Words are taken from the top. One that lies further below its row's first word than 0.6 of the page's median height
    (4 at least) begins a new row, so that a row of a slanted page ends where it has drifted that far; a new cell
    begins after a gap of more than two median widths (8 at least). Pages with fewer than two rows or two cells
    have no grid. The tops of a page are held in one task.
    """
    sure = words.where(F.col("confidence") > least_confidence)
    sizes = sure.groupBy(*by).agg(F.median("height").alias("_h"), F.median(F.col("right") - F.col("left")).alias("_w"))
    rows = sure.join(sizes, by)
    tops = rows.select(*by, "top", F.greatest(F.lit(4.0), 0.6 * F.col("_h")).alias("within")).distinct()

    def anchored(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values("top")
        number, first, out = -1, None, []
        for top, within in zip(page["top"], page["within"], strict=True):
            if first is None or top - first > within:
                number, first = number + 1, top
            out.append(number)
        return page[[*by, "top"]].assign(row=out)

    schema = ", ".join([*(f"`{c}` {tops.schema[c].dataType.simpleString()}" for c in by), "top double, row long"])
    numbered = tops.withColumn("top", F.col("top").cast("double")).groupBy(*by).applyInPandas(anchored, schema)
    rows = rows.withColumn("top", F.col("top").cast("double")).join(numbered, [*by, "top"])
    across = Window.partitionBy(*by, "row").orderBy("left", "right", "top", "text")
    split = F.coalesce((F.col("left") - F.lag("right").over(across) > F.greatest(F.lit(8.0), 2 * F.col("_w"))).cast("int"), F.lit(0))
    rows = rows.withColumn("_s", split).withColumn("_cell", F.sum("_s").over(across.rowsBetween(Window.unboundedPreceding, 0)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("left", "right", "top", "text"))), lambda w: w["text"]), " ")
    cells = rows.groupBy(*by, "row", "_cell").agg(joined.alias("cell"))
    grid = cells.groupBy(*by, "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("_cell", "cell"))), lambda c: c["cell"]).alias("cells"))
    page = Window.partitionBy(*by)
    sized = grid.withColumns({"_n": F.count("*").over(page), "_most": F.max(F.size("cells")).over(page)})
    return sized.where("_n >= 2 and _most >= 2").drop("_n", "_most")


def assemble(candidates: DataFrame) -> DataFrame:
    """Per vendor and field the value of the best source (source_rank, lowest first)."""
    return candidates.where("value is not null").groupBy("vendor_id", "field").agg(F.min_by(F.struct("value", "source_rank"), "source_rank").alias("b")).select("vendor_id", "field", "b.*")


def with_cubic_feet(candidates: DataFrame, stated: DataFrame) -> DataFrame:
    """``candidates`` (vendor_id, field, value, source_rank) and, before all of them, the divisors of ``stated`` (vendor_id, kg_per_cft) weights between 0 and 200 kg."""
    kg = F.col("kg_per_cft")
    divisors = stated.where((kg > 0) & (kg < 200)).select("vendor_id", F.lit("divisor").alias("field"), F.round(28316.8 / kg, 0).alias("value"), F.lit(0).alias("source_rank"))
    return candidates.unionByName(divisors)


def row_windows(grid: DataFrame, size: int = 6, step: int = 3) -> DataFrame:
    """(KEY, window, text): overlapping windows of rows, for classification; each row goes to two windows at most."""
    at = F.col("row_idx")
    last = F.floor(at / step)
    spread = grid.withColumn("window", F.explode(F.sequence(F.greatest(F.lit(0), last - (size // step - 1)), last)))
    return spread.groupBy(*KEY, "window").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "cells"))), lambda r: F.array_join(r["cells"], " ")), "\n").alias("text"))


def switch_categories(windows: DataFrame, hold: int = 3, least: float = 0.35) -> DataFrame:
    """Adds ``section``: the category in force; it switches after ``hold`` windows in a row of another category with confidence over ``least``."""
    ordered = F.array_sort(F.collect_list(F.struct("window", "category", "confidence")))
    start = F.struct(F.lit("UNKNOWN").alias("now"), F.lit("").alias("next"), F.lit(0).alias("n"), F.array().cast("array<struct<window:bigint,section:string>>").alias("out"))

    def step(s: Column, w: Column) -> Column:
        strong = (w["confidence"] > least) & (w["category"] != s["now"])
        n = F.when(strong & (w["category"] == s["next"]), s["n"] + 1).when(strong, 1).otherwise(0)
        now = F.when(n >= hold, w["category"]).otherwise(s["now"])
        return F.struct(
            now.alias("now"),
            F.when(strong & (n < hold), w["category"]).otherwise("").alias("next"),
            F.when(n >= hold, 0).otherwise(n).alias("n"),
            F.concat(s["out"], F.array(F.struct(w["window"].cast("long").alias("window"), now.alias("section")))).alias("out"),
        )

    folded = windows.groupBy(*KEY).agg(F.aggregate(ordered, start, step, lambda s: s["out"]).alias("o"))
    return folded.select(*KEY, F.explode("o").alias("x")).select(*KEY, "x.window", "x.section")
