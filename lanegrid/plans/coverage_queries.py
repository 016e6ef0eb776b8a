"""Queries of the coverage family and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanegrid.functions import pincodes as pf
from lanegrid.operators import coverage as cov
from lanegrid.operators import zone_labels
from lanegrid.plans import dims
from lanegrid.plans.fixtures import claims, master, sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None, **views: str):
    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = sql(oracle, **views)
        return f

    return register


ISLANDS = """SELECT {by}, min(pincode) AS lo, max(pincode) AS hi, count(*) AS n
    FROM (SELECT {by}, pincode, pincode - row_number() OVER (PARTITION BY {by} ORDER BY pincode) AS g FROM (SELECT DISTINCT {by}, pincode FROM {rows})) GROUP BY {by}, g"""


# ---- pincodes and cells ---------------------------------------------------------------------


@query("load_master", "SELECT pincode, upper(trim(zone)) AS zone, upper(trim(city)) AS city, upper(trim(state)) AS state FROM master WHERE pincode BETWEEN 100000 AND 999999")
def load_master(spark: SparkSession, d: str) -> DataFrame:
    return cov.unique_master(master(spark, d))


CELL = "CASE c_custkey % 4 WHEN 0 THEN CAST(pincode AS VARCHAR) WHEN 1 THEN ' ' || pincode || '.0 ' WHEN 2 THEN left(CAST(pincode AS VARCHAR), 3) || ',' || right(CAST(pincode AS VARCHAR), 3) ELSE 'PIN-' || pincode END"


def _cells(spark, d):
    pin, k = F.col("pincode").cast("string"), F.col("c_custkey") % 4
    cell = (
        F.when(k == 0, pin).when(k == 1, F.concat(F.lit(" "), pin, F.lit(".0 "))).when(k == 2, F.concat(F.left(pin, F.lit(3)), F.lit(","), F.right(pin, F.lit(3)))).otherwise(F.concat(F.lit("PIN-"), pin))
    )
    return master(spark, d).select("c_custkey", cell.alias("cell"))


@query("valid_pincode", f"SELECT c_custkey, CAST(floor(TRY_CAST(replace(trim(cell), ',', '') AS DOUBLE)) AS INT) AS pin FROM (SELECT c_custkey, {CELL} AS cell FROM master) WHERE TRY_CAST(replace(trim(cell), ',', '') AS DOUBLE) IS NOT NULL")
def valid_pincode(spark, d):
    return _cells(spark, d).select("c_custkey", pf.valid_pincode(F.col("cell")).alias("pin")).where("pin is not null")


@query("parse_pincode_cell", f"SELECT c_custkey, CAST(TRY_CAST(regexp_replace(cell, '[^0-9.]', '', 'g') AS DOUBLE) AS INT) AS pin FROM (SELECT c_custkey, {CELL} AS cell FROM master)")
def parse_pincode_cell(spark, d):
    return _cells(spark, d).select("c_custkey", pf.parse_pincode_cell(F.col("cell")).alias("pin"))


RANGE_CELL = "CASE c_custkey % 3 WHEN 0 THEN pincode || ' to ' || (pincode + c_custkey % 4) WHEN 1 THEN pincode || '-' || (pincode + 600) ELSE 'pins ' || left(CAST(pincode AS VARCHAR), 3) || ' ' || right(CAST(pincode AS VARCHAR), 3) || ', ' || (pincode + 1) END"


@query(
    "extract_pincodes_cell",
    f"""SELECT c_custkey, CAST(p AS INT) AS pincode FROM (
        SELECT c_custkey, unnest(CASE WHEN c_custkey % 3 = 0 THEN range(pincode, pincode + c_custkey % 4 + 1) WHEN c_custkey % 3 = 1 THEN [pincode, pincode + 600] ELSE [pincode, pincode + 1] END) AS p FROM master) WHERE p <= 999999""",
)
def extract_pincodes_cell(spark, d):
    pin, k = F.col("pincode"), F.col("c_custkey") % 3
    text = pin.cast("string")
    cell = (
        F.when(k == 0, F.concat(text, F.lit(" to "), pin + F.col("c_custkey") % 4))
        .when(k == 1, F.concat(text, F.lit("-"), pin + 600))
        .otherwise(F.concat(F.lit("pins "), F.left(text, F.lit(3)), F.lit(" "), F.right(text, F.lit(3)), F.lit(", "), pin + 1))
    )
    return master(spark, d).select("c_custkey", F.explode(pf.extract_pincodes_cell(cell)).alias("pincode"))


@query(
    "dense_text_pincodes",
    r"SELECT state, CAST(len(f) AS INT) AS n FROM (SELECT state, regexp_extract_all(string_agg(CAST(pincode AS VARCHAR), ' '), '\b([1-9][0-9]{5})\b') AS f FROM master GROUP BY state) WHERE len(f) >= 20",
)
def dense_text_pincodes(spark, d):
    texts = master(spark, d).groupBy("state").agg(F.array_join(F.collect_list(F.col("pincode").cast("string")), " ").alias("text"))
    return texts.select("state", F.size(pf.dense_text_pincodes(F.col("text"))).alias("n")).where("n > 0")


# ---- validation -----------------------------------------------------------------------------

CHECKED = """SELECT vendor_id, c.pincode, claimed_zone, m.zone, p1.zones AS zones1, p2.zones AS zones2,
    CASE WHEN m.zone = claimed_zone THEN 'exact' WHEN m.zone IS NOT NULL THEN 'mismatch'
         WHEN p1.zones IS NOT NULL AND NOT list_contains(p1.zones, claimed_zone) THEN 'impossible_prefix1'
         WHEN p2.zones IS NOT NULL AND NOT list_contains(p2.zones, claimed_zone) THEN 'impossible_prefix2' ELSE 'not_in_master' END AS reason
    FROM claims c LEFT JOIN master m ON m.pincode = c.pincode
    LEFT JOIN prefixes p1 ON p1.prefix = left(CAST(c.pincode AS VARCHAR), 1) LEFT JOIN prefixes p2 ON p2.prefix = left(CAST(c.pincode AS VARCHAR), 2)"""


def _checked(spark, d):
    return cov.check_zone(claims(spark, d).drop("state", "city"), master(spark, d))


@query("pin_in_zone_check", "SELECT vendor_id, pincode, claimed_zone, reason, reason IN ('exact', 'not_in_master') AS ok FROM checked", checked=CHECKED)
def pin_in_zone_check(spark, d):
    return _checked(spark, d).select("vendor_id", "pincode", "claimed_zone", "reason", "ok")


@query(
    "bulk_zone_validation",
    """SELECT claimed_zone, CASE reason WHEN 'exact' THEN 'valid' WHEN 'mismatch' THEN 'database_mismatch' WHEN 'not_in_master' THEN 'warning' ELSE 'invalid' END AS status,
       reason IN ('exact', 'mismatch', 'not_in_master') AS kept, count(*) AS n FROM checked GROUP BY ALL""",
    checked=CHECKED,
)
def bulk_zone_validation(spark, d):
    return cov.zone_validation(_checked(spark, d)).groupBy("claimed_zone", "status", "kept").agg(F.count("*").alias("n"))


@query(
    "filter_impossible",
    """SELECT vendor_id, pincode, claimed_zone, coalesce(zone = claimed_zone, FALSE) OR zone IS NULL AS strict_kept FROM checked
       WHERE coalesce(zone = claimed_zone, FALSE) OR zones1 IS NULL OR list_contains(zones1, claimed_zone)""",
    checked=CHECKED,
)
def filter_impossible(spark, d):
    kept = cov.drop_impossible(_checked(spark, d))
    strict = cov.drop_impossible(_checked(spark, d), strict=True).select("vendor_id", "pincode", "claimed_zone").withColumn("strict_kept", F.lit(True)).distinct()
    return kept.join(strict, ["vendor_id", "pincode", "claimed_zone"], "left").select("vendor_id", "pincode", "claimed_zone", F.coalesce("strict_kept", F.lit(False)).alias("strict_kept"))


FLAG_ROWS = """SELECT c_custkey, pincode, CASE c_custkey % 5 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' WHEN 2 THEN 'ODA-II' WHEN 3 THEN '' ELSE NULL END AS oda_cell,
    CASE c_custkey % 7 WHEN 0 THEN 'N' WHEN 1 THEN 'not serviceable' ELSE 'Y' END AS delivery FROM master"""


@query(
    "serviceability_flags",
    "SELECT c_custkey, pincode, oda_cell IN ('Yes', 'ODA-II') AS oda FROM (SELECT c_custkey, pincode, coalesce(oda_cell, '') AS oda_cell, delivery FROM flags) WHERE delivery = 'Y' OR oda_cell IN ('Yes', 'ODA-II')",
    flags=FLAG_ROWS,
)
def serviceability_flags(spark, d):
    k = F.col("c_custkey")
    rows = master(spark, d).select(
        "c_custkey",
        "pincode",
        F.when(k % 5 == 0, "Yes").when(k % 5 == 1, "no").when(k % 5 == 2, "ODA-II").when(k % 5 == 3, "").alias("oda_cell"),
        F.when(k % 7 == 0, "N").when(k % 7 == 1, "not serviceable").otherwise("Y").alias("delivery"),
    )
    flagged = rows.withColumn("oda", pf.is_oda(F.col("oda_cell")))
    return flagged.where(F.col("oda") | ~pf.is_refused(F.col("delivery"))).select("c_custkey", "pincode", "oda")


@query(
    "zone_hint_row",
    "SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE upper(zone) END AS from_zone, upper(trim(state)) AS from_state FROM master",
)
def zone_hint_row(spark, d):
    rows = master(spark, d).withColumn("label", F.when(F.col("c_custkey") % 6 == 0, " n/a ").otherwise(F.lower("zone")))
    return rows.select("c_custkey", pf.zone_hint(F.col("label"), F.col("state")).alias("from_zone"), pf.zone_hint(None, F.col("state")).alias("from_state"))


TITLE = "list_aggregate(list_transform(string_split(lower(trim({c})), ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), 'string_agg', ' ')"


@query(
    "clean_geo_hint",
    f"SELECT c_custkey, {TITLE.format(c='city')} AS city, CASE WHEN replace(lower(trim(state)), ' ', '') = 'tamilnadu' THEN 'Tamil Nadu' ELSE {TITLE.format(c='state')} END AS state FROM hints WHERE lower(trim(city)) NOT IN ('unknown') AND lower(trim(state)) NOT IN ('tbd')",
    hints="SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN ' Unknown ' ELSE city END AS city, CASE c_custkey % 11 WHEN 0 THEN 'TBD' WHEN 1 THEN 'tamil nadu' WHEN 2 THEN 'TAMILNADU' ELSE state END AS state FROM master",
)
def clean_geo_hint(spark, d):
    k = F.col("c_custkey")
    rows = master(spark, d).select(
        "c_custkey",
        pf.clean_place(F.when(k % 9 == 0, " Unknown ").otherwise(F.col("city"))).alias("city"),
        pf.clean_state(F.when(k % 11 == 0, "TBD").when(k % 11 == 1, "tamil nadu").when(k % 11 == 2, "TAMILNADU").otherwise(F.col("state"))).alias("state"),
    )
    return rows.where("city is not null and state is not null")


# ---- look-ups -------------------------------------------------------------------------------


@query("pin_zone_join", "SELECT vendor_id, c.pincode, coalesce(m.zone, '_unknown') AS zone FROM claims c LEFT JOIN master m ON c.pincode = m.pincode")
def pin_zone_join(spark, d):
    return cov.with_zone(claims(spark, d).select("vendor_id", "pincode"), master(spark, d)).select("vendor_id", "pincode", F.coalesce("zone", F.lit("_unknown")).alias("zone"))


LIKELY = """SELECT vendor_id, c.pincode, CASE WHEN m.zone IS NOT NULL THEN [m.zone] ELSE coalesce(p2.zones, p1.zones, (SELECT list(zone ORDER BY zone_order) FROM zones)) END AS zones
    FROM claims c LEFT JOIN master m ON m.pincode = c.pincode LEFT JOIN prefixes p1 ON p1.prefix = left(CAST(c.pincode AS VARCHAR), 1)
    LEFT JOIN prefixes p2 ON p2.prefix = left(CAST(c.pincode AS VARCHAR), 2)"""


@query("likely_zones", "SELECT vendor_id, pincode, array_to_string(zones, ' ') AS zones FROM likely", likely=LIKELY)
def likely_zones(spark, d):
    return cov.likely_zones(claims(spark, d).select("vendor_id", "pincode"), master(spark, d)).select("vendor_id", "pincode", F.array_join("zones", " ").alias("zones"))


@query("resolve_flat_pincodes", "SELECT vendor_id, pincode, CASE WHEN len(zones) = 1 THEN zones[1] END AS resolved FROM likely", likely=LIKELY)
def resolve_flat_pincodes(spark, d):
    return cov.resolve_flat(claims(spark, d).select("vendor_id", "pincode"), master(spark, d)).select("vendor_id", "pincode", "resolved")


#: A label for every region: known, cut at signs, or misspelt, and the zones it must give.
REGION_LABELS = """(VALUES ('North', 'NORTH', 'N1 N2 N3 N4'), ('South', 'Southrn', 'S1 S2 S3 S4'), ('East', 'EAST', 'E1 E2'), ('West', 'Westren India', 'W1 W2'),
    ('Central', 'Centrall', 'C1 C2'), ('North East', 'north-east', 'NE1 NE2'), ('Special', 'X1/X2+X3', 'X1 X2 X3')) r(region, label, zones)"""


@query("expand_zone_label", f"SELECT vendor_id, pincode, r.label, r.zones FROM claims JOIN zones z ON z.zone = claimed_zone JOIN {REGION_LABELS} ON r.region = z.region")
def expand_zone_label(spark, d):
    region = F.col("region")
    label = (
        F.when(region == "North East", "north-east").when(region == "Special", "X1/X2+X3").when(region == "South", "Southrn")
        .when(region == "West", "Westren India").when(region == "Central", "Centrall").otherwise(F.upper("region"))
    )
    rows = claims(spark, d).join(F.broadcast(dims.zones(spark)), F.col("zone") == F.col("claimed_zone")).select("vendor_id", "pincode", label.alias("label"))
    return zone_labels.expand_labels(rows, "label").withColumn("zones", F.array_join("zones", " "))


#: Vendor 1 misspells the south and has a label that nothing is like, vendor 2 prices one zone; labels are looked up in lists typed here.
RESOLVED = """SELECT vendor_id, c.pincode, m.zone, l.zones AS candidates, CASE WHEN list_contains(l.zones, m.zone) THEN m.zone ELSE l.zones[1] END AS resolved
    FROM (SELECT *, CASE WHEN vendor_id = 2 THEN 'ZONE A' WHEN vendor_id = 1 AND claimed_zone LIKE 'S%' THEN 'Southrn' WHEN vendor_id = 1 AND claimed_zone = 'C1' THEN 'zzz qqq' ELSE claimed_zone END AS label FROM claims) c
    LEFT JOIN (SELECT zone AS label, [zone] AS zones FROM zones UNION ALL VALUES ('ZONE A', ['N1', 'N2']), ('Southrn', ['S1', 'S2', 'S3', 'S4'])) l ON l.label = c.label LEFT JOIN master m ON m.pincode = c.pincode"""


def _resolved(spark, d):
    vendor, zone = F.col("vendor_id"), F.col("claimed_zone")
    label = F.when(vendor == 2, "ZONE A").when((vendor == 1) & zone.startswith("S"), "Southrn").when((vendor == 1) & (zone == "C1"), "zzz qqq").otherwise(zone)
    return zone_labels.resolve_vendor_zone(claims(spark, d).select("vendor_id", "pincode", label.alias("label")), master(spark, d))


@query("resolve_vendor_zone", "SELECT vendor_id, pincode, resolved FROM resolved_rows", resolved_rows=RESOLVED)
def resolve_vendor_zone(spark, d):
    return _resolved(spark, d).select("vendor_id", "pincode", "resolved")


@query("zone_overrides", "SELECT vendor_id, pincode, max(resolved) AS zone FROM resolved_rows WHERE zone IS NOT NULL AND resolved <> zone GROUP BY ALL", resolved_rows=RESOLVED)
def zone_overrides(spark, d):
    return cov.zone_overrides(_resolved(spark, d), "resolved")


# ---- ranges and serviceability --------------------------------------------------------------

LISTS = f"""SELECT vendor_id, zone, string_agg(CASE WHEN n >= 3 THEN lo || '-' || hi END, ',' ORDER BY lo) AS ranges,
    string_agg(CASE WHEN n < 3 THEN CASE WHEN n = 1 THEN CAST(lo AS VARCHAR) ELSE lo || ',' || hi END END, ',' ORDER BY lo) AS singles
    FROM ({ISLANDS.format(by="vendor_id, zone", rows="{rows}")}) GROUP BY vendor_id, zone"""


def _lists(df, ranges="ranges", singles="singles"):
    text = F.array_join(F.transform(ranges, lambda r: F.concat_ws("-", r["s"], r["e"])), ",")
    return df.withColumns({ranges: F.nullif(text, F.lit("")), singles: F.nullif(F.array_join(F.col(singles).cast("array<string>"), ","), F.lit(""))})


@query("compress_ranges", "SELECT * FROM lists", lists=LISTS.format(rows="(SELECT vendor_id, claimed_zone AS zone, pincode FROM claims)"))
def compress_ranges(spark, d):
    pins = claims(spark, d).select("vendor_id", F.col("claimed_zone").alias("zone"), "pincode")
    return _lists(cov.compress_ranges(pins, ["vendor_id", "zone"]))


EFFECTIVE = """SELECT c.vendor_id, c.pincode, m.zone, c.claimed_zone AS effective, c.oda FROM
    (SELECT vendor_id, pincode, max(claimed_zone) AS claimed_zone, max(oda) AS oda FROM claims GROUP BY ALL) c JOIN master m ON m.pincode = c.pincode"""
SERVICE = """SELECT e.vendor_id, e.effective AS zone, count(*) AS served_count, count(*) FILTER (WHERE e.zone = effective) AS own_count, any_value(t.total) AS total,
    CASE WHEN count(*) FILTER (WHERE e.zone = effective) = 0 THEN 'NOT_SERVED' WHEN count(*) FILTER (WHERE e.zone = effective) >= 0.999 * any_value(t.total) THEN 'FULL_ZONE' ELSE 'ONLY_SERVED' END AS mode,
    round(count(*) FILTER (WHERE e.zone = effective) * 100 / any_value(t.total), 2) AS coverage_percent
    FROM effective e LEFT JOIN (SELECT zone, count(*) AS total FROM master GROUP BY zone) t ON t.zone = effective GROUP BY ALL"""
SERVICE_VIEWS = {
    "effective": EFFECTIVE,
    "service": SERVICE,
    "own_lists": LISTS.format(rows="(SELECT vendor_id, zone, pincode FROM effective WHERE zone = effective)"),
    "cross_lists": LISTS.format(rows="(SELECT vendor_id, effective AS zone, pincode FROM effective WHERE zone <> effective)"),
    "oda_lists": LISTS.format(rows="(SELECT vendor_id, effective AS zone, pincode FROM effective WHERE oda)"),
}


def _service(spark, d):
    return cov.build_serviceability(claims(spark, d), master(spark, d))


@query("coverage_mode", "SELECT vendor_id, zone, mode, own_count AS served, total FROM service WHERE own_count > 0", effective=EFFECTIVE, service=SERVICE)
def coverage_mode(spark, d):
    m = master(spark, d)
    own = cov.effective_zones(claims(spark, d), m).where("zone = effective").groupBy("vendor_id", "zone").agg(F.count("*").alias("served"))
    return own.join(m.groupBy("zone").agg(F.count("*").alias("total")), "zone").select("vendor_id", "zone", cov.coverage_mode(F.col("served"), F.col("total")).alias("mode"), "served", "total")


@query(
    "build_serviceability",
    """SELECT s.vendor_id, s.zone, mode, total, served_count, coverage_percent, CASE WHEN mode = 'ONLY_SERVED' THEN o.ranges END AS served_ranges,
       CASE WHEN mode = 'ONLY_SERVED' THEN o.singles END AS served_singles, c.ranges AS cross_ranges, c.singles AS cross_singles, x.ranges AS oda_ranges, x.singles AS oda_singles
       FROM service s LEFT JOIN own_lists o ON (o.vendor_id, o.zone) = (s.vendor_id, s.zone) LEFT JOIN cross_lists c ON (c.vendor_id, c.zone) = (s.vendor_id, s.zone)
       LEFT JOIN oda_lists x ON (x.vendor_id, x.zone) = (s.vendor_id, s.zone)""",
    **SERVICE_VIEWS,
)
def build_serviceability(spark, d):
    out = _service(spark, d).drop("n_ranges")
    for name in ("served", "cross", "oda"):
        out = _lists(out, f"{name}_ranges", f"{name}_singles")
    return out


@query("oda_block", "SELECT vendor_id, zone, ranges, singles, n FROM oda_lists JOIN (SELECT vendor_id, effective AS zone, count(*) AS n FROM effective WHERE oda GROUP BY ALL) USING (vendor_id, zone)", **SERVICE_VIEWS)
def oda_block(spark, d):
    rows = cov.effective_zones(claims(spark, d), master(spark, d)).where("oda").select("vendor_id", F.col("effective").alias("zone"), "pincode")
    n = rows.groupBy("vendor_id", "zone").agg(F.count("*").alias("n"))
    return _lists(cov.compress_ranges(rows, ["vendor_id", "zone"])).join(n, ["vendor_id", "zone"])


@query(
    "state_expansion",
    """SELECT vendor_id, pincode FROM claims UNION SELECT h.vendor_id, m.pincode FROM
       (SELECT vendor_id, m.state FROM claims c JOIN master m ON m.pincode = c.pincode GROUP BY ALL HAVING count(*) >= 2) h
       JOIN (SELECT state FROM master GROUP BY state HAVING count(*) <= 4000 AND count(DISTINCT zone) <= 2) s USING (state) JOIN master m USING (state)""",
)
def state_expansion(spark, d):
    return cov.state_expansion(claims(spark, d), master(spark, d))


STATS = """SELECT vendor_id, region, CAST(sum(served_count) AS BIGINT) AS served, CAST(sum(CASE WHEN mode <> 'NOT_SERVED' OR served_count > 0 THEN 1 ELSE 0 END) AS BIGINT) AS zones_served,
    round(avg(CASE WHEN mode <> 'NOT_SERVED' THEN coverage_percent END), 2) AS avg_coverage,
    coalesce(string_agg(CASE WHEN mode <> 'NOT_SERVED' THEN zone END, ' ' ORDER BY zone), '') AS active_zones FROM service JOIN zones USING (zone) GROUP BY ROLLUP (vendor_id, region) HAVING vendor_id IS NOT NULL"""


@query(
    "coverage_stats",
    "SELECT s.*, region_total, round(served * 100 / region_total, 2) AS percent FROM stats s LEFT JOIN (SELECT region, count(*) AS region_total FROM master JOIN zones USING (zone) GROUP BY region) USING (region)",
    effective=EFFECTIVE, service=SERVICE, stats=STATS,
)
def coverage_stats(spark, d):
    return cov.coverage_stats(_service(spark, d), master(spark, d)).withColumn("active_zones", F.array_join("active_zones", " "))


DECODED = """SELECT vendor_id, pincode, arg_max(zone, zone_order) AS zone FROM (
    SELECT vendor_id, effective AS zone, pincode FROM effective
    UNION ALL SELECT vendor_id, zone, m.pincode FROM service s JOIN master m USING (zone) WHERE mode = 'FULL_ZONE') JOIN zones USING (zone) GROUP BY ALL"""


@query("decode_index", "SELECT * FROM decoded", effective=EFFECTIVE, service=SERVICE, decoded=DECODED)
def decode_index(spark, d):
    return cov.decode(_service(spark, d), master(spark, d))


@query("cross_zone_map", "SELECT d.vendor_id, CAST(d.pincode AS VARCHAR) AS pincode, d.zone AS pricing_zone, m.zone AS own_zone FROM decoded d JOIN master m ON m.pincode = d.pincode WHERE m.zone <> d.zone", effective=EFFECTIVE, service=SERVICE, decoded=DECODED)
def cross_zone_map(spark, d):
    m = master(spark, d).select("pincode", F.col("zone").alias("own_zone"))
    out = cov.decode(_service(spark, d), master(spark, d)).join(m, "pincode").where("own_zone <> zone")
    return out.select("vendor_id", F.col("pincode").cast("string").alias("pincode"), F.col("zone").alias("pricing_zone"), "own_zone")


@query(
    "range_lookup",
    f"SELECT c.vendor_id, c.pincode, r.zone FROM (SELECT DISTINCT vendor_id, pincode FROM claims) c JOIN ({ISLANDS.format(by='vendor_id, zone', rows='(SELECT vendor_id, claimed_zone AS zone, pincode FROM claims WHERE oda)')}) r ON r.vendor_id = c.vendor_id AND c.pincode BETWEEN lo AND hi",
)
def range_lookup(spark, d):
    rows = claims(spark, d)
    oda = rows.where("oda").select("vendor_id", F.col("claimed_zone").alias("zone"), "pincode").distinct()
    return cov.range_lookup(rows.select("vendor_id", "pincode").distinct(), cov.islands(oda, ["vendor_id", "zone"])).select("vendor_id", "pincode", "zone")


@query(
    "recover_unknown_pins",
    f"SELECT l.vendor_id, l.pincode, zones[1] AS zone, {TITLE.format(c='city')} AS city, {TITLE.format(c='state')} AS state FROM likely l JOIN claims c ON (c.vendor_id, c.pincode) = (l.vendor_id, l.pincode) WHERE l.pincode NOT IN (SELECT pincode FROM master)",
    likely=LIKELY,
)
def recover_unknown_pins(spark, d):
    m = master(spark, d)
    lost = claims(spark, d).join(m.select("pincode"), "pincode", "left_anti")
    hinted = lost.select("vendor_id", "pincode", pf.clean_place(F.col("city")).alias("city"), pf.clean_state(F.col("state")).alias("hint")).where("city is not null and hint is not null")
    return cov.likely_zones(hinted, m).select("vendor_id", "pincode", F.get("zones", F.lit(0)).alias("zone"), "city", F.col("hint").alias("state"))


@query("expand_ranges", "SELECT DISTINCT vendor_id, claimed_zone AS zone, pincode FROM claims")
def expand_ranges(spark, d):
    pins = claims(spark, d).select("vendor_id", F.col("claimed_zone").alias("zone"), "pincode")
    packed = cov.compress_ranges(pins, ["vendor_id", "zone"])
    return packed.select("vendor_id", "zone", F.explode(pf.expand_ranges(F.col("ranges"), F.col("singles"))).alias("pincode"))


# ---- reconciliation -------------------------------------------------------------------------

ENCODED = "SELECT vendor_id, pincode, zone, effective, oda FROM effective WHERE pincode % 13 <> 0"


def _encoded(spark, d):
    return cov.effective_zones(claims(spark, d), master(spark, d)).where("pincode % 13 <> 0")


@query(
    "reconcile_source",
    """SELECT vendor_id, pincode, 'missing' AS side, pincode IN (SELECT pincode FROM master) AS in_master FROM (SELECT vendor_id, pincode FROM claims EXCEPT SELECT vendor_id, pincode FROM encoded)
       UNION ALL SELECT vendor_id, pincode, 'extra', pincode IN (SELECT pincode FROM master) FROM (SELECT vendor_id, pincode FROM encoded EXCEPT SELECT vendor_id, pincode FROM claims WHERE NOT oda)""",
    effective=EFFECTIVE, encoded=ENCODED,
)
def reconcile_source(spark, d):
    source, encoded, m = claims(spark, d), _encoded(spark, d), master(spark, d).select("pincode").withColumn("in_master", F.lit(True))
    key = ["vendor_id", "pincode"]
    missing = source.select(*key).distinct().join(encoded, key, "left_anti").withColumn("side", F.lit("missing"))
    extra = encoded.select(*key).join(source.where("not oda"), key, "left_anti").withColumn("side", F.lit("extra"))
    return missing.unionByName(extra).join(m, "pincode", "left").select(*key, "side", F.coalesce("in_master", F.lit(False)).alias("in_master"))


@query("zone_mismatch_pairs", "SELECT vendor_id, effective AS vendor_zone, zone AS master_zone, count(*) AS n, array_to_string(list_slice(list(pincode ORDER BY pincode), 1, 5), ' ') AS samples FROM effective WHERE zone <> effective GROUP BY ALL", effective=EFFECTIVE)
def zone_mismatch_pairs(spark, d):
    rows = cov.effective_zones(claims(spark, d), master(spark, d)).where("zone <> effective")
    pairs = ["vendor_id", "effective", "zone"]
    ranked = rows.withColumns({"n": F.count("*").over(Window.partitionBy(*pairs)), "i": F.row_number().over(Window.partitionBy(*pairs).orderBy("pincode"))}).where("i <= 5")
    samples = F.array_join(F.array_sort(F.collect_list("pincode")).cast("array<string>"), " ").alias("samples")
    return ranked.groupBy("vendor_id", F.col("effective").alias("vendor_zone"), F.col("zone").alias("master_zone"), "n").agg(samples)


@query("zone_counts", "SELECT vendor_id, coalesce(zone, 'UNKNOWN') AS zone, count(*) AS n FROM claims c LEFT JOIN master m ON c.pincode = m.pincode GROUP BY ALL")
def zone_counts(spark, d):
    rows = cov.with_zone(claims(spark, d).select("vendor_id", "pincode"), master(spark, d))
    return rows.groupBy("vendor_id", F.coalesce("zone", F.lit("UNKNOWN")).alias("zone")).agg(F.count("*").alias("n"))


DISTRIBUTION = "SELECT vendor_id, claimed_zone AS label, zone, count(*) AS n, round(count(*) * 100 / sum(count(*)) OVER (PARTITION BY vendor_id, claimed_zone), 1) AS percent, min(m.pincode) AS first_pin FROM claims c JOIN master m ON c.pincode = m.pincode GROUP BY vendor_id, claimed_zone, zone"


def _distribution(spark, d):
    rows = cov.with_zone(claims(spark, d).select("vendor_id", F.col("claimed_zone").alias("label"), "pincode"), master(spark, d)).where("zone is not null")
    n = rows.groupBy("vendor_id", "label", "zone").agg(F.count("*").alias("n"), F.min("pincode").alias("first_pin"))
    return n.withColumn("percent", F.round(F.col("n") * 100 / F.sum("n").over(Window.partitionBy("vendor_id", "label")), 1))


@query("zone_distribution", "SELECT vendor_id, label, zone, percent FROM dist", dist=DISTRIBUTION)
def zone_distribution(spark, d):
    return _distribution(spark, d).select("vendor_id", "label", "zone", "percent")


@query("dominant_zone", "SELECT vendor_id, label, CASE WHEN max(percent) >= 60 THEN arg_max(zone, (percent, -first_pin)) END AS zone FROM dist GROUP BY ALL", dist=DISTRIBUTION)
def dominant_zone(spark, d):
    top = F.max_by("zone", F.struct("percent", -F.col("first_pin")))
    return _distribution(spark, d).groupBy("vendor_id", "label").agg(F.when(F.max("percent") >= 60, top).alias("zone"))


@query("covering_zones", "SELECT vendor_id, label, string_agg(zone, ' ' ORDER BY percent DESC, zone) AS zones FROM dist WHERE percent >= 10 GROUP BY ALL", dist=DISTRIBUTION)
def covering_zones(spark, d):
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("percent")).alias("p"), "zone")))
    return _distribution(spark, d).where("percent >= 10").groupBy("vendor_id", "label").agg(F.array_join(F.transform(ordered, lambda x: x["zone"]), " ").alias("zones"))


#: Labels of every step of the ladder: codes; misspelt names; names that only their pincodes explain; a state inside, and nothing at all.
LABELLED = """SELECT vendor_id, pincode, CASE vendor_id WHEN 0 THEN lower(claimed_zone) WHEN 1 THEN CASE left(claimed_zone, 1) WHEN 'S' THEN 'Southrn' WHEN 'W' THEN 'Westren India' ELSE 'Centrall' END
    WHEN 2 THEN 'qzx ' || claimed_zone ELSE CASE WHEN pincode % 2 = 0 THEN 'qzx mixed' ELSE 'goa xyzzy lane' END END AS label FROM claims"""


@query(
    "resolve_zone_labels",
    """SELECT vendor_id, label, CASE WHEN vendor_id = 0 THEN upper(label) WHEN label = 'Southrn' THEN 'S1 S2 S3 S4' WHEN label = 'Westren India' THEN 'W1 W2' WHEN label = 'Centrall' THEN 'C1 C2'
         ELSE coalesce(string_agg(zone, ' ' ORDER BY percent DESC, first_pin) FILTER (WHERE percent >= 40), CASE WHEN label LIKE 'goa%' THEN 'W2' ELSE '' END) END AS zones,
       CASE WHEN vendor_id = 0 THEN 'canonical' WHEN label IN ('Southrn', 'Centrall') THEN 'substring' WHEN label = 'Westren India' THEN 'fuzzy' WHEN max(percent) >= 40 THEN 'pincodes' WHEN label LIKE 'goa%' THEN 'geo' ELSE 'none' END AS method
       FROM (SELECT vendor_id, label, zone, min(m.pincode) AS first_pin, round(count(*) FILTER (WHERE zone IS NOT NULL) * 100 / nullif(sum(count(zone)) OVER (PARTITION BY vendor_id, label), 0), 1) AS percent
         FROM labelled l LEFT JOIN master m ON m.pincode = l.pincode GROUP BY vendor_id, label, zone) GROUP BY vendor_id, label""",
    labelled=LABELLED,
)
def resolve_zone_labels(spark, d):
    vendor, zone = F.col("vendor_id"), F.col("claimed_zone")
    misspelt = F.when(zone.startswith("S"), "Southrn").when(zone.startswith("W"), "Westren India").otherwise("Centrall")
    odd = F.when(F.col("pincode") % 2 == 0, "qzx mixed").otherwise("goa xyzzy lane")
    label = F.when(vendor == 0, F.lower(zone)).when(vendor == 1, misspelt).when(vendor == 2, F.concat(F.lit("qzx "), zone)).otherwise(odd)
    rows = claims(spark, d).select("vendor_id", "pincode", label.alias("label"))
    return zone_labels.resolve_labels(rows, master(spark, d)).withColumn("zones", F.array_join("zones", " "))


@query(
    "coverage_report",
    """SELECT vendor_id, label, CAST(sum(n) AS BIGINT) AS n, CASE WHEN max(percent) >= 60 THEN arg_max(zone, (percent, -first_pin)) END AS dominant,
       round(sum(CASE WHEN zone = label THEN n ELSE 0 END) * 100 / sum(n), 1) AS match_percent, round(sum(CASE WHEN zone <> label THEN n ELSE 0 END) * 100 / sum(n), 1) AS mismatch_percent FROM dist GROUP BY ALL""",
    dist=DISTRIBUTION,
)
def coverage_report(spark, d):
    rows = cov.label_zones(_distribution(spark, d), "label")
    match = F.array_contains("zones", F.col("zone"))
    share = lambda c: F.round(F.sum(F.when(c, F.col("n")).otherwise(0)) * 100 / F.sum("n"), 1)
    return rows.groupBy("vendor_id", "label").agg(
        F.sum("n").alias("n"),
        F.when(F.max("percent") >= 60, F.max_by("zone", F.struct("percent", -F.col("first_pin")))).alias("dominant"),
        share(match).alias("match_percent"),
        share(~match).alias("mismatch_percent"),
    )


@query(
    "zone_breakdown",
    """SELECT vendor_id, zone, coalesce(s.served, 0) AS source_served, coalesce(s.oda, 0) AS source_oda, coalesce(e.served, 0) AS encoded_served, coalesce(e.oda, 0) AS encoded_oda,
       coalesce(e.served, 0) - coalesce(s.served, 0) AS delta, CASE WHEN coalesce(e.served, 0) = coalesce(s.served, 0) THEN 'ok' ELSE 'differs' END AS status
       FROM (SELECT vendor_id, effective AS zone, count(*) AS served, count(*) FILTER (WHERE oda) AS oda FROM effective GROUP BY ALL) s
       FULL JOIN (SELECT vendor_id, effective AS zone, count(*) AS served, count(*) FILTER (WHERE oda) AS oda FROM encoded GROUP BY ALL) e USING (vendor_id, zone)""",
    effective=EFFECTIVE, encoded=ENCODED,
)
def zone_breakdown(spark, d):
    def count(df, side):
        return df.groupBy("vendor_id", F.col("effective").alias("zone")).agg(F.count("*").alias(f"{side}_served"), F.count(F.when(F.col("oda"), 1)).alias(f"{side}_oda"))

    both = count(cov.effective_zones(claims(spark, d), master(spark, d)), "source").join(count(_encoded(spark, d), "encoded"), ["vendor_id", "zone"], "full_outer").fillna(0)
    delta = F.col("encoded_served") - F.col("source_served")
    return both.withColumns({"delta": delta, "status": F.when(delta == 0, "ok").otherwise("differs")})


@query(
    "duplicate_breakdown",
    """SELECT kind, count(*) AS n FROM (SELECT pincode, CASE WHEN count(*) = 1 AND max(oda) THEN 'once_oda' WHEN count(*) = 1 THEN 'once_plain' WHEN max(oda) AND NOT min(oda) THEN 'both' ELSE 'other' END AS kind
       FROM claims WHERE pincode % 13 = 0 OR pincode NOT IN (SELECT pincode FROM master) GROUP BY pincode) GROUP BY kind""",
)
def duplicate_breakdown(spark, d):
    lost = claims(spark, d).join(_encoded(spark, d).select("vendor_id", "pincode"), ["vendor_id", "pincode"], "left_anti")
    kinds = lost.groupBy("pincode").agg(F.count("*").alias("c"), F.max("oda").alias("hi"), F.min("oda").alias("lo"))
    kind = F.when((F.col("c") == 1) & F.col("hi"), "once_oda").when(F.col("c") == 1, "once_plain").when(F.col("hi") & ~F.col("lo"), "both").otherwise("other")
    return kinds.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("prefix_histogram", "SELECT left(CAST(pincode AS VARCHAR), 3) AS prefix, count(*) AS n, min(pincode) AS first_pin, max(pincode) AS last_pin FROM claims WHERE pincode NOT IN (SELECT pincode FROM master) GROUP BY ALL")
def prefix_histogram(spark, d):
    lost = claims(spark, d).join(master(spark, d).select("pincode"), "pincode", "left_anti")
    return lost.groupBy(F.substring(F.col("pincode").cast("string"), 1, 3).alias("prefix")).agg(F.count("*").alias("n"), F.min("pincode").alias("first_pin"), F.max("pincode").alias("last_pin"))


@query("merge_pins", "SELECT vendor_id, pincode, max(oda) AS oda, arg_max(city, (CAST(oda AS INT), city)) AS city FROM claims GROUP BY ALL")
def merge_pins(spark, d):
    """Served pins of all files once each, ODA if any says so; of the hints that of the last file (ODA lists come last)."""
    return claims(spark, d).groupBy("vendor_id", "pincode").agg(F.max("oda").alias("oda"), F.max_by("city", F.struct(F.col("oda").cast("int"), "city")).alias("city"))


# ---- sets and lists -------------------------------------------------------------------------


@query("union_pins", "SELECT pincode FROM claims WHERE vendor_id = 0 UNION SELECT pincode FROM claims WHERE vendor_id = 1")
def union_pins(spark, d):
    rows = claims(spark, d)
    return rows.where("vendor_id = 0").select("pincode").union(rows.where("vendor_id = 1").select("pincode")).distinct()


@query("except_pins", "SELECT pincode FROM master EXCEPT SELECT pincode FROM claims WHERE vendor_id = 0")
def except_pins(spark, d):
    return master(spark, d).select("pincode").subtract(claims(spark, d).where("vendor_id = 0").select("pincode"))


@query("intersect_pins", "SELECT pincode FROM claims WHERE vendor_id = 0 AND oda INTERSECT SELECT pincode FROM claims WHERE vendor_id = 1")
def intersect_pins(spark, d):
    rows = claims(spark, d)
    return rows.where("vendor_id = 0 and oda").select("pincode").intersect(rows.where("vendor_id = 1").select("pincode"))


@query("served_minus_oda", "SELECT vendor_id, pincode FROM claims EXCEPT SELECT vendor_id, pincode FROM claims WHERE oda")
def served_minus_oda(spark, d):
    rows = claims(spark, d)
    return rows.select("vendor_id", "pincode").subtract(rows.where("oda").select("vendor_id", "pincode"))


@query(
    "all_zones_union",
    "SELECT zone, a IS NOT NULL AS in_a, b IS NOT NULL AS in_b FROM (SELECT claimed_zone AS zone, count(*) AS a FROM claims WHERE vendor_id = 0 GROUP BY ALL) FULL JOIN (SELECT claimed_zone AS zone, count(*) AS b FROM claims WHERE vendor_id = 3 GROUP BY ALL) USING (zone)",
)
def all_zones_union(spark, d):
    side = lambda v, n: claims(spark, d).where(F.col("vendor_id") == v).groupBy(F.col("claimed_zone").alias("zone")).agg(F.count("*").alias(n))
    return side(0, "a").join(side(3, "b"), "zone", "full_outer").select("zone", F.col("a").isNotNull().alias("in_a"), F.col("b").isNotNull().alias("in_b"))


@query(
    "ghost_zones",
    """SELECT vendor_id, origin FROM (SELECT DISTINCT vendor_id, origin FROM rates WHERE rate > 6) r WHERE NOT starts_with(origin, 'X')
       AND NOT EXISTS (SELECT 1 FROM claims c WHERE c.vendor_id = r.vendor_id AND c.claimed_zone = r.origin AND c.oda)""",
)
def ghost_zones(spark, d):
    from lanegrid.plans.fixtures import rates

    origins = rates(spark, d).where("rate > 6").select("vendor_id", "origin").distinct().where(~F.col("origin").startswith("X"))
    served = claims(spark, d).where("oda").select("vendor_id", F.col("claimed_zone").alias("origin"))
    return origins.join(served, ["vendor_id", "origin"], "left_anti")


@query("topk_reports", "SELECT effective AS vendor_zone, zone AS master_zone, count(*) AS n FROM effective WHERE zone <> effective GROUP BY ALL ORDER BY n DESC, vendor_zone, master_zone LIMIT 5", effective=EFFECTIVE)
def topk_reports(spark, d):
    rows = cov.effective_zones(claims(spark, d), master(spark, d)).where("zone <> effective")
    counted = rows.groupBy(F.col("effective").alias("vendor_zone"), F.col("zone").alias("master_zone")).agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "vendor_zone", "master_zone").limit(5)


@query("sorted_missing_pins", "SELECT vendor_id, string_agg(CAST(pincode AS VARCHAR), ' ' ORDER BY pincode) AS pins FROM (SELECT DISTINCT vendor_id, pincode FROM claims WHERE pincode NOT IN (SELECT pincode FROM master)) GROUP BY vendor_id")
def sorted_missing_pins(spark, d):
    """Claimed pincodes that the master lacks, in order."""
    gone = claims(spark, d).select("vendor_id", "pincode").distinct().join(master(spark, d).select("pincode"), "pincode", "left_anti")
    return gone.groupBy("vendor_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("pincode")), lambda p: p.cast("string")), " ").alias("pins"))


@query("sorted_mismatches", "SELECT vendor_id, vendor_zone, master_zone, n, row_number() OVER (PARTITION BY vendor_id ORDER BY n DESC, vendor_zone, master_zone) AS place FROM (SELECT vendor_id, effective AS vendor_zone, zone AS master_zone, count(*) AS n FROM effective WHERE zone <> effective GROUP BY ALL)", effective=EFFECTIVE)
def sorted_mismatches(spark, d):
    """Pairs of claimed and master zone per vendor, the most frequent first."""
    rows = cov.effective_zones(claims(spark, d), master(spark, d)).where("zone <> effective")
    counted = rows.groupBy("vendor_id", F.col("effective").alias("vendor_zone"), F.col("zone").alias("master_zone")).agg(F.count("*").alias("n"))
    return counted.withColumn("place", F.row_number().over(Window.partitionBy("vendor_id").orderBy(F.desc("n"), "vendor_zone", "master_zone")))


@query("sorted_outputs", "SELECT vendor_id, string_agg(DISTINCT claimed_zone, ' ' ORDER BY claimed_zone) AS active_zones FROM claims GROUP BY ALL")
def sorted_outputs(spark, d):
    return claims(spark, d).groupBy("vendor_id").agg(F.array_join(F.array_sort(F.collect_set("claimed_zone")), " ").alias("active_zones"))



@query(
    "merge_serviceability",
    """SELECT vendor_id, piece, zone, n FROM (SELECT *, dense_rank() OVER (PARTITION BY vendor_id ORDER BY zones DESC, piece) AS r FROM (SELECT b.*, z.zones FROM blocks b JOIN (SELECT vendor_id, piece, count(DISTINCT zone) AS zones FROM blocks GROUP BY ALL) z
       ON z.vendor_id = b.vendor_id AND z.piece = b.piece)) WHERE r = 1""",
    blocks="SELECT vendor_id, CAST(pincode % 3 AS INT) AS piece, claimed_zone AS zone, count(*) AS n FROM claims WHERE NOT (pincode % 3 = 0 AND claimed_zone IN ('N1', 'C1')) GROUP BY ALL",
)
def merge_serviceability(spark, d):
    rows = claims(spark, d).withColumn("piece", F.col("pincode") % 3).where(~((F.col("piece") == 0) & F.col("claimed_zone").isin("N1", "C1")))
    return cov.fullest_blocks(rows.groupBy("vendor_id", "piece", F.col("claimed_zone").alias("zone")).agg(F.count("*").alias("n")))


@query(
    "normalize_serviceability",
    """SELECT vendor_id, zone, CASE i % 4 WHEN 0 THEN 'FULL_MINUS_EXCEPT' WHEN 1 THEN 'ONLY_SERVED' WHEN 2 THEN 'ONLY_SERVED' ELSE 'NOT_SERVED' END AS mode, CASE WHEN i % 4 = 0 THEN lo || '-' || hi END AS except_ranges,
       CASE WHEN i % 4 IN (1, 2) THEN lo || '-' || hi END AS served_ranges, CASE WHEN i % 4 = 2 THEN 0 ELSE hi - lo END AS total FROM entries WHERE zone <> 'Q9'""",
    entries="SELECT vendor_id, CASE WHEN claimed_zone = 'C2' THEN 'Q9' ELSE claimed_zone END AS zone, min(pincode) % 7 AS i, min(pincode) AS lo, max(pincode) AS hi FROM claims GROUP BY ALL",
)
def normalize_serviceability(spark, d):
    z = F.col("claimed_zone")
    entries = claims(spark, d).groupBy("vendor_id", F.when(z == "C2", "Q9").otherwise(z).alias("zone")).agg((F.min("pincode") % 7).alias("i"), F.min("pincode").alias("lo"), F.max("pincode").alias("hi"))
    i = F.col("i") % 4
    one = F.array(F.struct(F.col("lo").alias("s"), F.col("hi").alias("e")))
    size = F.col("hi") - F.col("lo")
    raw = entries.select(
        "vendor_id",
        "zone",
        F.when(i == 0, "EXCLUDING").when(i == 1, "INCLUDING").when(i == 2, "ONLY_SERVED").otherwise("odd").alias("mode"),
        F.when(i > 3, one).alias("exceptRanges"),
        F.when(i == 0, one).alias("excludedRanges"),
        F.when(i == 2, one).alias("servedRanges"),
        F.when(i == 1, one).alias("includedRanges"),
        F.when(i == 0, size).alias("totalInZone"),
        F.when(i.isin(1, 3), size).alias("totalCount"),
    )
    text = lambda c: F.array_join(F.transform(c, lambda r: F.concat_ws("-", r["s"], r["e"])), ",").alias(c)
    return cov.normalize_service(raw).select("vendor_id", "zone", "mode", text("except_ranges"), text("served_ranges"), "total")
