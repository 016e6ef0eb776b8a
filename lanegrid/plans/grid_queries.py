"""Queries of the grid family over sheets derived from the tables, and their DuckDB twins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from lanegrid.operators import coverage as cov
from lanegrid.operators import grids as op
from lanegrid.operators import labels
from lanegrid.operators import rates as rate_op
from lanegrid.operators import text as text_op
from lanegrid.plans import dims
from lanegrid.plans.fixtures import claims, master, rates, sql
from lanegrid.plans.rate_queries import MATRIX
from lanegrid.plans.text_queries import CLASSIFIED
from lanegrid.runtime import Scratch, spread, table

SPREAD = "round2(CASE WHEN max(rate) - min(rate) <= 5 THEN max(rate) ELSE avg(rate) END)"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None, **views: str):
    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = sql(oracle, **views)
        return f

    return register


def _matrix(spark, d):
    return rate_op.pick_rate(rates(spark, d), 5.0, inclusive=True)


def sheet(rows, sheet: str, order: list[str], cells: list, heads: list[list[str]]):
    """A grid per vendor: the head rows, then one row of cells per row of ``rows`` in order."""
    number = F.row_number().over(Window.partitionBy("vendor_id").orderBy(*order)) + (len(heads) - 1)
    body = rows.select("vendor_id", F.lit(sheet).alias("sheet"), number.cast("int").alias("row_idx"), F.array(*[c.cast("string") for c in cells]).alias("cells"))
    top = rows.select("vendor_id").distinct().select("vendor_id", F.lit(sheet).alias("sheet"), F.posexplode(F.array(*[F.array(*map(F.lit, h)) for h in heads])).alias("row_idx", "cells"))
    return top.unionByName(body)


def long_sheet(spark, d, matrix=None):
    return sheet(matrix or _matrix(spark, d), "rates", ["origin", "dest"], [F.col("origin"), F.col("dest"), F.concat(F.lit("Rs. "), F.col("rate"))], [["# vendor sheet", "", ""], ["From Zone", "To-Zone", "rate_per_kg"]])


def wide_sheet(spark, d, matrix=None):
    """Origins down and all twenty zones across; a cell without a rate is NIL."""
    wide = (matrix or _matrix(spark, d)).groupBy("vendor_id", "origin").pivot("dest", dims.ZONES).agg(F.first("rate"))
    cells = [F.col("origin"), *[F.coalesce(F.col(z).cast("string"), F.lit("NIL")) for z in dims.ZONES]]
    return sheet(wide, "zone matrix", ["origin"], cells, [["Rate card"], ["Origin", *dims.ZONES]])


def pin_sheet(spark, d):
    rows = claims(spark, d)
    oda = F.when(F.col("oda"), "Yes").otherwise("")
    delivery = F.when(F.col("pincode") % 11 == 0, "NS").otherwise("Y")
    cells = [F.col("pincode"), F.col("state"), F.when(F.col("pincode") % 9 == 0, "N/A").otherwise(F.col("claimed_zone")), oda, delivery]
    return sheet(rows, "pincodes", ["pincode", "claimed_zone"], cells, [["Places that we serve, by pincode"], ["Pincode", "State", "Zone", "ODA", "Delivery Status"]])


#: Sheets with fewer than three origins are no matrix.
MANY = "SELECT * FROM matrix WHERE rate > 0 AND vendor_id IN (SELECT vendor_id FROM matrix WHERE rate > 0 GROUP BY vendor_id HAVING count(DISTINCT origin) >= 3)"


@query("detect_long_matrix", "SELECT vendor_id, 'rates' AS sheet, origin, dest, rate FROM many", matrix=MATRIX, many=MANY)
def detect_long_matrix(spark, d):
    return op.long_matrix(long_sheet(spark, d))


@query("detect_wide_matrix", "SELECT vendor_id, 'zone matrix' AS sheet, origin, dest, rate FROM many", matrix=MATRIX, many=MANY)
def detect_wide_matrix(spark, d):
    return op.wide_matrix(wide_sheet(spark, d))


@query(
    "detect_pincode_list",
    "SELECT vendor_id, 'pincodes' AS sheet, pincode, CASE WHEN pincode % 9 <> 0 THEN claimed_zone END AS zone_label, oda FROM claims WHERE oda OR pincode % 11 <> 0",
)
def detect_pincode_list(spark, d):
    return op.pincode_list(pin_sheet(spark, d))


@query(
    "hub_key_join",
    "SELECT CAST(s_suppkey % 4 AS INT) AS vendor_id, s_suppkey AS supplier, list_extract(z, CAST(s_nationkey % 20 + 1 AS INT)) AS zone FROM supplier, (SELECT list(zone ORDER BY zone_order) AS z FROM zones) WHERE s_suppkey % 4 IN (SELECT s_suppkey % 4 FROM supplier GROUP BY ALL HAVING count(DISTINCT s_nationkey) >= 3)",
)
def hub_key_join(spark, d):
    """A hub key sheet per vendor, from suppliers' nations; suppliers get their hub's zone."""
    rows = table(spark, d, "supplier").withColumn("vendor_id", (F.col("s_suppkey") % 4).cast("int")).withColumn("hub", F.concat(F.lit("H"), F.col("s_nationkey")))
    zone = F.element_at(F.array(*map(F.lit, dims.ZONES)), (F.col("s_nationkey") % 20 + 1).cast("int"))
    keys = sheet(rows.select("vendor_id", "hub", zone.alias("zone")).distinct(), "Hub City Key", ["hub"], [F.col("hub"), F.col("zone")], [["Hub Code", "Zone"]])
    return rows.join(op.hub_key(keys), ["vendor_id", "hub"]).select("vendor_id", F.col("s_suppkey").alias("supplier"), "zone")


def places(spark, d):
    nation = table(spark, d, "nation")
    zone = F.element_at(F.array(*map(F.lit, dims.ZONES)), (F.col("n_nationkey") % 20 + 1).cast("int"))
    return nation.select(F.col("n_name").alias("name"), zone.alias("zone"), F.col("n_nationkey").alias("dim_order"))


PLACES = "SELECT upper(n_name) AS name, list_extract(z, CAST(n_nationkey % 20 + 1 AS INT)) AS zone, n_nationkey AS dim_order FROM nation, (SELECT list(zone ORDER BY zone_order) AS z FROM zones)"


@query(
    "city_state_zone_join",
    """SELECT c_custkey, place, (SELECT arg_min(p.zone, p.dim_order) FROM places p WHERE (upper(trim(place)) = p.name) OR (NOT EXISTS (SELECT 1 FROM places q WHERE q.name = upper(trim(place))) AND length(upper(trim(place))) >= 4 AND length(p.name) >= 4
       AND (contains(upper(trim(place)), p.name) OR contains(p.name, upper(trim(place)))))) AS zone FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN lower(n_name) WHEN 1 THEN 'near ' || n_name || ' city' ELSE 'nowhere' END AS place FROM customer JOIN nation ON n_nationkey = c_nationkey)""",
    places=PLACES,
)
def city_state_zone_join(spark, d):
    k, n = F.col("c_custkey") % 3, F.col("n_name")
    place = F.when(k == 0, F.lower(n)).when(k == 1, F.concat(F.lit("near "), n, F.lit(" city"))).otherwise("nowhere")
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", place.alias("place"))
    return op.place_zones(rows, places(spark, d))


@query(
    "station_zone_join",
    "SELECT c_custkey, coalesce(p.zone, 'N1') AS zone FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'ZZZ' ELSE left(n_name, 3) END AS code FROM customer JOIN nation ON n_nationkey = c_nationkey) c LEFT JOIN (SELECT left(name, 3) AS code, arg_min(zone, dim_order) AS zone FROM places GROUP BY ALL) p USING (code)",
    places=PLACES,
)
def station_zone_join(spark, d):
    """Station codes (first three letters) to zones; N1 where there is none."""
    code = F.when(F.col("c_custkey") % 5 == 0, "ZZZ").otherwise(F.left("n_name", F.lit(3)))
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", code.alias("code"))
    known = places(spark, d).groupBy(F.left("name", F.lit(3)).alias("code")).agg(F.min_by("zone", "dim_order").alias("zone"))
    return rows.join(known, "code", "left").select("c_custkey", F.coalesce("zone", F.lit("N1")).alias("zone"))


@query("classify_header_row", "SELECT vendor_id, CAST(1 AS INT) AS row_idx, CAST(20 AS BIGINT) AS zone_cells FROM (SELECT DISTINCT vendor_id FROM matrix)", matrix=MATRIX)
def classify_header_row(spark, d):
    """Rows with three or more cells that name zones, by the label dictionary."""
    cells = wide_sheet(spark, d).select("vendor_id", "row_idx", F.posexplode("cells").alias("col", "label"))
    zones = cov.label_zones(cells, "label").where("zones is not null")
    return zones.groupBy("vendor_id", "row_idx").agg(F.count("*").alias("zone_cells")).where("zone_cells >= 3")


@query(
    "pincode_grounded_matrix",
    "SELECT vendor_id, 'pin rates' AS sheet, origin, m.zone AS dest, round2(median(5 + zone_order * 0.5 + pincode % 7)) AS rate FROM (SELECT DISTINCT vendor_id, pincode FROM claims) c JOIN master m USING (pincode) CROSS JOIN (SELECT zone AS origin, zone_order FROM zones WHERE zone_order < 4) GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY vendor_id, origin, m.zone"),
)
def pincode_grounded_matrix(spark, d):
    rows = claims(spark, d).select("vendor_id", "pincode").distinct()
    cells = [F.col("pincode"), *[5 + i * 0.5 + F.col("pincode") % 7 for i in range(4)]]
    grid = sheet(rows, "pin rates", ["pincode"], cells, [["Pin", *dims.ZONES[:4]]])
    return op.grounded_matrix(grid, master(spark, d))


MARKED = """SELECT vendor_id, origin, dest, rate, row_number() OVER (PARTITION BY vendor_id ORDER BY origin, dest) AS i FROM matrix"""


@query("split_air_road_rows", "SELECT vendor_id, count(*) AS n FROM marked WHERE i % 10 NOT IN (2, 3, 4) GROUP BY ALL", matrix=MATRIX, marked=MARKED)
def split_air_road_rows(spark, d):
    """Row 2 and every tenth after it says By Air, every row 4 of ten says By Road."""
    i = F.row_number().over(Window.partitionBy("vendor_id").orderBy("origin", "dest"))
    rows = _matrix(spark, d).withColumn("i", i)
    first = F.when(F.col("i") % 10 == 2, "Rates By Air").when(F.col("i") % 10 == 4, "Rates By Road").otherwise(F.col("origin"))
    grid = rows.select("vendor_id", F.lit("mixed").alias("sheet"), F.col("i").alias("row_idx"), F.array(first, F.col("dest"), F.col("rate").cast("string")).alias("cells"))
    return op.drop_air_rows(grid).groupBy("vendor_id").agg(F.count("*").alias("n"))


SERVICES = "SELECT CAST(s_suppkey AS INT) AS vendor_id, CAST(s_nationkey + 10 AS VARCHAR) AS a, CAST(s_suppkey % 50 AS VARCHAR) AS b, CAST(s_suppkey % 7 * 100 AS VARCHAR) AS c FROM supplier"


def service_sheet(spark, d):
    """Per vendor a charge header over two services' rows."""
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").cast("int").alias("vendor_id"), (F.col("s_nationkey") + 10).alias("a"), (F.col("s_suppkey") % 50).alias("b"), (F.col("s_suppkey") % 7 * 100).alias("c"))
    both = rows.withColumn("service", F.explode(F.array(F.lit("surface"), F.lit("zair"))))
    head = [["Charges"], ["Service", "Docket", "Fuel", "Minimum", "Handling"]]
    return sheet(both, "charges", ["service"], [F.col("service"), F.col("a"), F.col("b"), F.col("c"), F.lit(5)], head)


@query("pick_surface_row", "SELECT vendor_id, 'surface' AS service, a AS docket FROM services", services=SERVICES)
def pick_surface_row(spark, d):
    rows = op.surface_row(service_sheet(spark, d)).where("row_idx > 1")
    return rows.select("vendor_id", F.get("cells", F.lit(0)).alias("service"), F.get("cells", F.lit(1)).alias("docket"))


@query("horizontal_kv", "SELECT vendor_id, unnest(['Service', 'Docket', 'Fuel', 'Minimum', 'Handling']) AS label, unnest(['surface', a, b, c, '5']) AS value FROM services", services=SERVICES)
def horizontal_kv(spark, d):
    return op.horizontal_pairs(service_sheet(spark, d)).select("vendor_id", "label", "value")


@query("is_charge_table", "SELECT vendor_id, 'charges' AS sheet FROM services UNION ALL SELECT vendor_id, 'network' FROM services WHERE vendor_id % 3 = 0", services=SERVICES)
def is_charge_table(spark, d):
    """Two thirds of the network sheets are tables of destinations and delivery times."""
    v = table(spark, d, "supplier").select(F.col("s_suppkey").cast("int").alias("vendor_id"))
    kind = F.col("vendor_id") % 3
    text = F.when(kind == 0, F.array(F.lit("Fuel"), F.lit("20%"))).when(kind == 1, F.array(F.lit("Destination"), F.lit("Rate (Per Kg)"))).otherwise(F.array(F.lit("Agra"), F.lit("24-48 hrs")))
    network = v.select("vendor_id", F.lit("network").alias("sheet"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("row_idx"), text.alias("cells"))
    return op.charge_sheets(service_sheet(spark, d).unionByName(network))


@query(
    "detect_weight_slabs",
    "SELECT vendor_id, lo AS min_kg, hi AS max_kg, zone, CAST(base + add + zone_order AS DOUBLE) AS rate FROM (SELECT CAST(s_suppkey AS INT) AS vendor_id, s_nationkey + 5 AS base FROM supplier) CROSS JOIN (VALUES (0.0::DOUBLE, 50.0::DOUBLE, 3), (51.0::DOUBLE, 100.0::DOUBLE, 2), (100.0::DOUBLE, NULL, 1)) t(lo, hi, add) CROSS JOIN (SELECT zone, zone_order FROM zones WHERE zone_order < 3)",
)
def detect_weight_slabs(spark, d):
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").cast("int").alias("vendor_id"), (F.col("s_nationkey") + 5).alias("base"))
    slab = F.explode(F.array(*[F.struct(F.lit(t).alias("slab"), F.lit(a).alias("add")) for t, a in (("Up to 50 kg", 3), ("51 - 100 kg", 2), ("Above 100 kg", 1))]))
    rows = rows.select("vendor_id", "base", slab.alias("s")).select("vendor_id", "base", "s.*")
    cells = [F.col("slab"), *[F.col("base") + F.col("add") + i for i in range(3)]]
    return op.weight_slabs(sheet(rows, "slabs", ["slab"], cells, [["Weight Slab", *dims.ZONES[:3]]])).drop("sheet")


@query(
    "detect_oda_matrix",
    "SELECT vendor_id, lo AS min_km, hi AS max_km, wlo AS min_kg, whi AS max_kg, CASE WHEN hi = 25 THEN 0.0 ELSE CAST(base + w * 100 AS DOUBLE) END AS charge FROM (SELECT CAST(s_suppkey AS INT) AS vendor_id, s_nationkey + 400 AS base FROM supplier) CROSS JOIN (VALUES (0.0::DOUBLE, 25.0::DOUBLE), (26.0::DOUBLE, 50.0::DOUBLE)) t(lo, hi) CROSS JOIN (VALUES (0.0::DOUBLE, 100.0::DOUBLE, 0), (101.0::DOUBLE, 500.0::DOUBLE, 1)) u(wlo, whi, w)",
)
def detect_oda_matrix(spark, d):
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").cast("int").alias("vendor_id"), (F.col("s_nationkey") + 400).alias("base"), F.explode(F.array(F.lit("0-25 Km"), F.lit("26-50 Km"))).alias("km"))
    cells = [F.col("km"), *[F.when(F.col("km") == "0-25 Km", "NIL").otherwise((F.col("base") + i * 100).cast("string")) for i in range(2)]]
    return op.distance_matrix(sheet(rows, "oda", ["km"], cells, [["Distance (Kms)", "0-100 Kgs", "101-500 Kgs"]])).drop("sheet")


@query(
    "detect_oda_bands",
    "SELECT CAST(s_suppkey AS INT) AS vendor_id, CAST(b AS DOUBLE) AS min_kg, CAST(b + 99 AS DOUBLE) AS max_kg, CAST(s_nationkey * 10 + b AS DOUBLE) AS minimum, 2.5::DOUBLE AS per_kg FROM supplier CROSS JOIN (VALUES (1), (101)) t(b)",
)
def detect_oda_bands(spark, d):
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").cast("int").alias("vendor_id"), "s_nationkey", F.explode(F.array(F.lit(1), F.lit(101))).alias("b"))
    cells = [F.col("b"), F.col("b") + 99, F.col("s_nationkey") * 10 + F.col("b"), F.lit(2.5)]
    return op.weight_bands(sheet(rows, "oda", ["b"], cells, [["ODA charges"], ["Lower Limit", "Upper Limit", "Min Rs", "Additional/kg"]])).drop("sheet")


@query("detect_per_box", "SELECT CAST(s_suppkey AS INT) AS vendor_id, CAST(s_nationkey + 1 AS DOUBLE) AS per_box, CAST(200 + s_nationkey AS DOUBLE) AS minimum FROM supplier")
def detect_per_box(spark, d):
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").cast("int").alias("vendor_id"), "s_nationkey")
    text = F.concat(F.lit("Handling Rs "), F.col("s_nationkey") + 1, F.lit(" per box, minimum "), F.col("s_nationkey") + 200)
    return op.per_box(sheet(rows, "charges", ["s_nationkey"], [text], [["Charges"]])).drop("sheet")


def charge_rows(spark, d):
    """Key and value rows from parts: dictionary labels as keys, prices as values."""
    keys = F.array(*map(F.lit, labels.CHARGE_LABELS))
    key = F.element_at(keys, (F.col("p_partkey") % len(labels.CHARGE_LABELS) + 1).cast("int"))
    return table(spark, d, "part").select((F.col("p_partkey") % 50).cast("int").alias("vendor_id"), F.col("p_partkey").alias("row_idx"), key.alias("label"), F.concat(F.lit("Rs "), F.col("p_size")).alias("value"))


_KEYS = "[" + ", ".join(f"'{k}'" for k in labels.CHARGE_LABELS) + "]"
KNOWN = "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in labels.CHARGE_LABELS.items() if v) + ") t(known, field)"


@query(
    "extract_charge_rows",
    f"SELECT vendor_id, field, min(row_idx) AS row_idx, arg_min(value, row_idx) AS value FROM (SELECT CAST(p_partkey % 50 AS INT) AS vendor_id, p_partkey AS row_idx, {_KEYS}[p_partkey % {len(labels.CHARGE_LABELS)} + 1] AS label, CAST(p_size AS DOUBLE) AS value FROM part) JOIN known ON known = label GROUP BY vendor_id, field",
    known=KNOWN,
)
def extract_charge_rows(spark, d):
    """Charges of key and value rows: labels matched by the dictionary, the first row of a field counts."""
    rows = charge_rows(spark, d)
    found = labels.match(rows, labels.dictionary(spark)).select("label", F.col("value").alias("field"))
    out = rows.join(found, "label").withColumn("n", op.parse_number(F.col("value"))).where("n is not null")
    return out.groupBy("vendor_id", "field").agg(F.min("row_idx").alias("row_idx"), F.min_by("n", "row_idx").alias("value"))


@query("extract_company_rows", "SELECT CAST(s_suppkey AS INT) AS vendor_id, s_name AS companyName, '9812345678' AS contactPhone FROM supplier")
def extract_company_rows(spark, d):
    """Company fields of key and value rows; a sheet counts if it has a name or two fields."""
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").cast("int").alias("vendor_id"), F.explode(F.map_from_arrays(F.array(F.lit("Company Name"), F.lit("Phone"), F.lit("Motto")), F.array(F.col("s_name"), F.lit("9812345678"), F.lit("fast")))).alias("label", "value"))
    names = {"company name": "companyName", "name": "companyName", "phone": "contactPhone", "gst no": "gstNo"}
    known = F.broadcast(labels.dictionary(spark, names).select("known", F.col("value").alias("field")))
    fields = rows.join(known, labels.normalise(F.col("label")) == F.col("known"))
    wide = fields.groupBy("vendor_id").pivot("field", ["companyName", "contactPhone"]).agg(F.first("value"))
    return wide.where("companyName is not null or contactPhone is not null")


#: Per supplier a company sheet: a title with bars for some, then keys and values.
COMPANY_SHEET = """SELECT CAST(s_suppkey AS INT) AS vendor_id, s_suppkey AS k, s_name, '98' || s_nationkey AS s_phone, 'Road ' || s_nationkey AS s_address FROM supplier"""


@query(
    "extract_company_sheet",
    """SELECT vendor_id, field, value FROM (SELECT vendor_id, k, unnest(['name', 'city', 'vendorCode', 'phone', 'gstNo', 'address']) AS field, unnest([CASE k % 4 WHEN 3 THEN NULL ELSE s_name END, CASE WHEN k % 4 = 0 THEN 'New Delhi' END,
        CASE WHEN k % 4 = 0 THEN 'V' || k WHEN k % 4 = 1 THEN 'C' || k END, CASE WHEN k % 4 <> 3 THEN s_phone END, CASE WHEN k % 4 = 2 THEN '29ABCDE1234F1Z5' END, CASE WHEN k % 4 = 3 AND k % 8 = 3 THEN s_address WHEN k % 4 <> 3 THEN s_address END]) AS value FROM company_sheet)
       WHERE value IS NOT NULL AND k % 4 <> 3""",
    company_sheet=COMPANY_SHEET,
)
def extract_company_sheet(spark, d):
    """Titles with bars, plain titles, and rows of keys and values; sheets with one field that is no name are none."""
    k, lit = F.col("s_suppkey"), F.lit
    n = k % 4
    title = F.when(n == 0, F.concat("s_name", lit(" | Vendor Code: V"), k, lit(" | Origin: New Delhi (N1) | GST: -"))).when(n == 1, F.col("s_name")).otherwise("Freight charges")
    rows = [F.array(title), F.array(lit("Phone"), F.when(n == 3, "na").otherwise(F.concat(lit("98"), "s_nationkey"))), F.array(lit("Address"), F.when(n == 3, "-").otherwise(F.concat(lit("Road "), "s_nationkey")))]
    rows += [F.when(n == 1, F.array(lit("carrier code"), F.concat(lit("C"), k))).otherwise(F.array(lit("GST No"), F.when(n == 2, "29 abcde 1234 f1z5").otherwise("18% as applicable")))]
    rows += [F.when(n == 2, F.array(lit("Company Name"), F.col("s_name"))).otherwise(F.array(lit("motto"), lit("fast")))]
    grid = table(spark, d, "supplier").select(k.cast("int").alias("vendor_id"), lit("company").alias("sheet"), F.posexplode(F.array(*rows)).alias("row_idx", "cells"))
    return op.company_rows(grid).drop("sheet")


CHARGE_SHEET = f"""SELECT CAST(p_partkey // 40 AS INT) AS vendor_id, p_partkey AS row_idx, p_size AS s, CAST(p_partkey % 5 AS INT) AS shape, {_KEYS}[p_partkey % {len(labels.CHARGE_LABELS)} + 1] AS label FROM part"""


@query(
    "extract_charge_sheet",
    f"""SELECT vendor_id, field, b.v AS v, b.f AS f, b.scalar AS scalar, b.row_idx AS row_idx FROM (SELECT vendor_id, field, arg_min({{'v': v, 'f': f, 'scalar': scalar, 'row_idx': row_idx}}, (scalar IS NOT NULL, row_idx)) AS b FROM (SELECT vendor_id, row_idx, field,
        CAST(CASE WHEN cft THEN NULL WHEN shape = 2 THEN s WHEN fixed AND shape = 1 THEN s WHEN fixed AND shape IN (3, 4) THEN 0 END AS DOUBLE) AS v,
        CAST(CASE WHEN cft THEN NULL WHEN shape = 2 THEN s * 10 WHEN fixed AND shape = 1 THEN 0 WHEN fixed AND shape IN (3, 4) THEN s WHEN shape = 0 AND NOT plain THEN s + 200 END AS DOUBLE) AS f,
        CAST(CASE WHEN cft THEN CASE WHEN shape > 0 THEN round(28316.8 / s, 0) END WHEN shape = 2 OR fixed AND shape > 0 OR (shape = 0 AND NOT plain) THEN NULL WHEN shape = 0 THEN s + 200 ELSE s END AS DOUBLE) AS scalar
        FROM (SELECT *, field IN ('topayCharges', 'codCharges', 'docketCharges', 'daccCharges', 'dodCharges', 'fmCharges', 'appointmentCharges', 'prepaidCharges') AS fixed, field IN ('fuel', 'divisor', 'minWeight') AS plain, field = 'divisor' AND regexp_matches(label, 'cft|cfactor|k factor') AS cft FROM charge_sheet JOIN known ON known = label))
       WHERE coalesce(v, f, scalar) IS NOT NULL GROUP BY vendor_id, field)""",
    charge_sheet=CHARGE_SHEET, known=KNOWN,
)
def extract_charge_sheet(spark, d):
    """Rows of labels (some in the second cell) and values to the right: amounts, percentages, pairs and plain numbers."""
    k, size = F.col("p_partkey"), F.col("p_size")
    label = F.initcap(F.element_at(F.array(*map(F.lit, labels.CHARGE_LABELS)), (k % len(labels.CHARGE_LABELS) + 1).cast("int")))
    n = k % 5
    value = F.when(n == 0, F.concat(F.lit("Rs "), size + 200)).when(n == 1, F.concat(size, F.lit("%"))).when(n == 2, F.concat(size, F.lit("% or Rs "), size * 10)).otherwise(size.cast("string"))
    cells = F.when(k % 3 == 0, F.array(F.lit(""), label, F.lit(""), value)).otherwise(F.array(label, F.lit(""), value))
    rows = spread(table(spark, d, "part").select("p_partkey", "p_size")).select(F.floor(k / 40).cast("int").alias("vendor_id"), F.lit("charges").alias("sheet"), k.alias("row_idx"), cells.alias("cells"))
    return op.charge_values(rows, labels.dictionary(spark)).drop("sheet")


@query("sheet_dispatch", "SELECT vendor_id, 'zone matrix' AS sheet, 1 AS detector, origin, dest, rate FROM many", matrix=MATRIX, many=MANY)
def sheet_dispatch(spark, d):
    matrix = Scratch(spark).save(_matrix(spark, d), "matrix")  # both sheets are made from it
    wide = op.wide_matrix(wide_sheet(spark, d, matrix)).withColumn("detector", F.lit(1))
    return op.dispatch(wide.unionByName(op.long_matrix(long_sheet(spark, d, matrix)).withColumn("detector", F.lit(0))))


@query(
    "sheet_dispatch_all",
    f"""SELECT vendor_id, CASE vendor_id WHEN 0 THEN 'matrix d' WHEN 1 THEN 'matrix a' WHEN 2 THEN 'pin matrix' ELSE 'zone matrix' END AS sheet, CASE vendor_id WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS detector, origin, dest, rate FROM (
         SELECT 0 AS vendor_id, origin, dest, rate FROM (SELECT 'E1' AS origin, m.zone AS dest, {SPREAD} AS rate FROM (SELECT pincode, CAST(2 + pincode % 9 AS DOUBLE) AS rate FROM claims WHERE vendor_id = 0 AND pincode % 17 NOT IN (3, 4)) c JOIN master m USING (pincode) GROUP BY m.zone)
         UNION ALL SELECT vendor_id, origin, dest, rate FROM many WHERE vendor_id IN (1, 3)
         UNION ALL SELECT vendor_id, origin, m.zone, round2(median(5 + zone_order * 0.5 + pincode % 7)) FROM (SELECT DISTINCT vendor_id, pincode FROM claims WHERE vendor_id = 2) c JOIN master m USING (pincode) CROSS JOIN (SELECT zone AS origin, zone_order FROM zones WHERE zone_order < 4) GROUP BY vendor_id, origin, m.zone)""",
    matrix=MATRIX, many=MANY,
)
def sheet_dispatch_all(spark, d):
    """Four detectors over sheets of equal priority: station sheets before long, pincode-grounded and wide ones."""
    known = master(spark, d)
    matrix = Scratch(spark).save(_matrix(spark, d), "matrix")  # the long and the wide sheet are made from it
    renamed = lambda grid, most, name: grid.where(F.col("vendor_id") <= most).withColumn("sheet", F.lit(name))
    pins = claims(spark, d).select("vendor_id", "pincode").distinct()
    grounded = sheet(pins, "pin matrix", ["pincode"], [F.col("pincode"), *[5 + i * 0.5 + F.col("pincode") % 7 for i in range(4)]], [["Pin", *dims.ZONES[:4]]])
    stations = spark.createDataFrame([("OKL", "E1")], "code string, zone string")
    found = [
        op.station_rates(renamed(station_sheet(spark, d), 0, "matrix d"), places(spark, d), stations, known),
        op.long_matrix(renamed(long_sheet(spark, d, matrix), 1, "matrix a")),
        op.grounded_matrix(renamed(grounded, 2, "pin matrix"), known),
        op.wide_matrix(wide_sheet(spark, d, matrix)),
    ]
    ranked = [f.select(*op.KEY, F.lit(i).alias("detector"), "origin", "dest", "rate") for i, f in enumerate(found)]
    return op.dispatch(reduce(lambda a, b: a.unionByName(b), ranked))


@query("assemble_charges", "SELECT vendor_id, field, arg_min(value, r) AS value, min(r) AS source_rank FROM (SELECT CAST(s_suppkey % 20 AS INT) AS vendor_id, CASE WHEN s_nationkey % 3 = 0 THEN 'divisor' ELSE 'fuel' END AS field, CAST(s_suppkey AS DOUBLE) AS value, CAST(s_suppkey // 20 + 1 AS INT) AS r FROM supplier UNION ALL SELECT CAST(s_suppkey AS INT), 'divisor', round(28316.8 / (s_nationkey + 5), 0), 0 FROM supplier WHERE s_suppkey < 10) GROUP BY vendor_id, field")
def assemble_charges(spark, d):
    """Charges of ranked sources; a weight per cubic foot stated anywhere sets the divisor before all of them."""
    k, nation = F.col("s_suppkey"), F.col("s_nationkey")
    rows = table(spark, d, "supplier")
    sources = rows.select((k % 20).cast("int").alias("vendor_id"), F.when(nation % 3 == 0, "divisor").otherwise("fuel").alias("field"), k.cast("double").alias("value"), (F.floor(k / 20) + 1).cast("int").alias("source_rank"))
    stated = rows.where(k < 10).select(k.cast("int").alias("vendor_id"), (nation + 5).cast("double").alias("kg_per_cft"))
    return op.assemble(op.with_cubic_feet(sources, stated))


@query("first_seen_rate", "SELECT vendor_id, origin, dest, arg_min(rate, (seq % 5, seq, rate)) AS rate FROM rates GROUP BY vendor_id, origin, dest")
def first_seen_rate(spark, d):
    return op.first_seen(rates(spark, d).withColumns({"table_idx": F.col("seq") % 5, "row_idx": F.struct("seq", "rate")}))


@query(
    "assemble_document",
    "SELECT vendor_id, field, arg_min(value, r) AS value, min(r) AS source_rank FROM (SELECT vendor_id, origin AS field, max(rate) AS value, CAST(seq % 3 AS INT) AS r FROM rates GROUP BY ALL) GROUP BY vendor_id, field",
)
def assemble_document(spark, d):
    sources = rates(spark, d).groupBy("vendor_id", F.col("origin").alias("field"), (F.col("seq") % 3).cast("int").alias("source_rank")).agg(F.max("rate").alias("value"))
    return op.assemble(sources)


WORDS = "SELECT CAST(l_orderkey % 200 AS INT) AS page, CAST(l_linenumber * 9 AS DOUBLE) AS top, CAST(l_partkey % 60 * 10 AS DOUBLE) AS l, CAST(l_partkey % 60 * 10 + 8 AS DOUBLE) AS r, 'w' || (l_partkey % 60) AS text FROM lineitem"


@query(
    "words_to_grid",
    """SELECT page, row_top, CAST(count(DISTINCT cell) AS INT) AS n_cells, string_agg(text, ' ' ORDER BY l, r, text) AS line FROM (SELECT *, sum(s) OVER (PARTITION BY page, row_top ORDER BY l, r, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cell FROM
       (SELECT *, CASE WHEN l - lag(r) OVER (PARTITION BY page, row_top ORDER BY l, r, text) > 12 THEN 1 ELSE 0 END AS s FROM (SELECT *, floor(top / 8) * 8 AS row_top FROM words))) GROUP BY page, row_top""",
    words=WORDS,
)
def words_to_grid(spark, d):
    left = (F.col("l_partkey") % 60 * 10).cast("double")
    words = table(spark, d, "lineitem").select(
        (F.col("l_orderkey") % 200).cast("int").alias("page"), (F.col("l_linenumber") * 9).cast("double").alias("top"), left.alias("left"), (left + 8).alias("right"), F.concat(F.lit("w"), F.col("l_partkey") % 60).alias("text")
    )
    grid = op.words_to_grid(words, ["page"])
    return grid.select("page", F.col("row_top").cast("double").alias("row_top"), F.size("cells").alias("n_cells"), F.array_join("cells", " ").alias("line"))


OCR = """SELECT CAST(l_orderkey % 200 AS INT) AS page, CAST(l_linenumber * 9 + l_partkey % 3 AS DOUBLE) AS top, CAST(l_partkey % 60 * 10 AS DOUBLE) AS l, CAST(l_partkey % 60 * 10 + 3 AS DOUBLE) AS r, CAST(6 + l_suppkey % 3 AS DOUBLE) AS h, 'w' || (l_partkey % 60) AS text
    FROM lineitem WHERE l_suppkey % 10 > 2"""


@query(
    "ocr_words_to_grid",
    """SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY page) AS n_rows, max(n_cells) OVER (PARTITION BY page) AS most FROM (SELECT page, row, CAST(count(DISTINCT cell) AS INT) AS n_cells, string_agg(text, ' ' ORDER BY l, r, top, text) AS line FROM (SELECT *, sum(s) OVER (PARTITION BY page, row ORDER BY l, r, top, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cell FROM
       (SELECT *, CASE WHEN l - lag(r) OVER (PARTITION BY page, row ORDER BY l, r, top, text) > greatest(8, 2 * w) THEN 1 ELSE 0 END AS s FROM
       (SELECT o.*, w, (SELECT count(*) FROM anchors a WHERE a.page = o.page AND a.top <= o.top) - 1 AS row FROM ocr o JOIN ocr_sizes USING (page)))) GROUP BY page, row)) WHERE n_rows >= 2 AND most >= 2""".replace("SELECT * FROM (SELECT *, count", "SELECT page, CAST(row AS BIGINT) AS row, n_cells, line FROM (SELECT *, count", 1),
    ocr=OCR,
    ocr_sizes="SELECT page, median(h) AS mh, median(r - l) AS w FROM ocr GROUP BY page",
    anchors="""SELECT * FROM (WITH RECURSIVE first_words AS (SELECT page, min(top) AS top FROM ocr GROUP BY page
        UNION ALL SELECT f.page, min(o.top) FROM first_words f JOIN ocr o ON o.page = f.page JOIN ocr_sizes s ON s.page = f.page AND o.top - f.top > greatest(4, 0.6 * s.mh) GROUP BY f.page, f.top) SELECT * FROM first_words)""",
)
def ocr_words_to_grid(spark, d):
    left = (F.col("l_partkey") % 60 * 10).cast("double")
    words = table(spark, d, "lineitem").select(
        (F.col("l_orderkey") % 200).cast("int").alias("page"), (F.col("l_linenumber") * 9 + F.col("l_partkey") % 3).cast("double").alias("top"), left.alias("left"), (left + 3).alias("right"),
        (6 + F.col("l_suppkey") % 3).cast("double").alias("height"), (F.col("l_suppkey") % 10 * 10 + 5).cast("double").alias("confidence"), F.concat(F.lit("w"), F.col("l_partkey") % 60).alias("text"),
    )
    grid = op.ocr_words_to_grid(words, ["page"])
    return grid.select("page", "row", F.size("cells").alias("n_cells"), F.array_join("cells", " ").alias("line"))


#: The long sheets' rows as text, windows of six rows every three, and their categories.
SHEET_ROWS = """SELECT vendor_id, row_idx, line FROM (SELECT DISTINCT vendor_id, unnest([0, 1]) AS row_idx, unnest(['# vendor sheet  ', 'From Zone To-Zone rate_per_kg']) AS line FROM matrix
    UNION ALL SELECT vendor_id, row_number() OVER (PARTITION BY vendor_id ORDER BY origin, dest) + 1, origin || ' ' || dest || ' Rs. ' || CAST(rate AS VARCHAR) FROM matrix)"""
WINDOWS = "SELECT vendor_id, w AS doc_id, string_agg(line, chr(10) ORDER BY row_idx) AS text FROM (SELECT *, unnest(range(greatest(0, row_idx // 3 - 1), row_idx // 3 + 1)) AS w FROM sheet_rows) GROUP BY vendor_id, w"
WINDOW_CLASSES = CLASSIFIED.replace("SELECT doc_id, CASE", "SELECT vendor_id, doc_id AS w, CASE").replace("SELECT doc_id, -r", "SELECT vendor_id, doc_id, -r").replace("SELECT doc_id, list_sort", "SELECT vendor_id, doc_id, list_sort").replace("FROM cards", "FROM windows")
SWITCHED = """SELECT vendor_id, w, now FROM (WITH RECURSIVE walk AS (SELECT DISTINCT vendor_id, CAST(-1 AS BIGINT) AS w, 'UNKNOWN' AS now, '' AS next, 0 AS n FROM window_classes
    UNION ALL SELECT vendor_id, w, CASE WHEN m >= 3 THEN category ELSE now END, CASE WHEN strong AND m < 3 THEN category ELSE '' END, CASE WHEN m >= 3 THEN 0 ELSE m END
      FROM (SELECT *, CASE WHEN strong AND category = next THEN n + 1 WHEN strong THEN 1 ELSE 0 END AS m FROM (SELECT c.vendor_id, c.w, c.category, walk.now, walk.next, walk.n, c.confidence > 0.35 AND c.category <> walk.now AS strong FROM walk JOIN window_classes c ON c.vendor_id = walk.vendor_id AND c.w = walk.w + 1)))
    SELECT * FROM walk)"""


@query("segment_rows", "SELECT vendor_id, 'rates' AS sheet, w AS window, now AS section FROM switched WHERE w >= 0", matrix=MATRIX, sheet_rows=SHEET_ROWS, windows=WINDOWS, window_classes=WINDOW_CLASSES, switched=SWITCHED)
def segment_rows(spark, d):
    """Categories of the rows of the long sheets by windows of six rows; the category switches after three windows."""
    windows = text_op.classify(op.row_windows(long_sheet(spark, d)))
    return op.switch_categories(windows.select(*op.KEY, "window", "category", "confidence"))


#: Zones of the distinct cells in ``asked``: codes and labels, else places, else pincodes; corner labels name none.
CELL_ZONES = r"""SELECT cell, coalesce((SELECT zones FROM labels_dim WHERE label = cell), CASE WHEN z IS NOT NULL THEN [z] END) AS zones FROM (SELECT cell, coalesce(
        (SELECT arg_min(p.zone, p.dim_order) FROM places p WHERE p.name = cell OR (NOT EXISTS (SELECT 1 FROM places q WHERE q.name = cell) AND length(cell) >= 4 AND length(p.name) >= 4 AND (contains(cell, p.name) OR contains(p.name, cell)))),
        (SELECT any_value(zone) FROM master WHERE CAST(pincode AS VARCHAR) = cell)) AS z
    FROM asked WHERE cell <> '' AND NOT regexp_matches(cell, '(?i)^\s*(from[/\\]?to|to[/\\]?from|from|to|origin[/\\]?dest(ination)?|o(rig)?[/\\]d(est)?|from\s*station|zone|lanes?|route)\s*$'))"""

#: Per hundred customers a sheet: two head rows, a header of nations, and nations down with rates across.
CITY_SHEET = """SELECT v AS vendor_id, 0 AS row_idx, ['Rate card'] AS cells FROM (SELECT DISTINCT c_custkey // 100 AS v FROM customer)
    UNION ALL SELECT v, 1, ['near INDIA city', 'CHINA', 'valid this year'] FROM (SELECT DISTINCT c_custkey // 100 AS v FROM customer)
    UNION ALL SELECT v, 2, list_concat(['From / To', 'From/To'], (SELECT list(lower(n_name) ORDER BY n_nationkey) FROM nation)) FROM (SELECT DISTINCT c_custkey // 100 AS v FROM customer)
    UNION ALL SELECT v, CAST(o + 3 AS INT), list_concat(['', CASE o WHEN 3 THEN '-' WHEN 4 THEN 'nowhere' WHEN 5 THEN 'N2' WHEN 7 THEN 'south' ELSE n_name END], list(CASE WHEN rate IS NULL THEN '-' WHEN d = 9 THEN '1,' || CAST(rate + 100 AS VARCHAR) ELSE CAST(rate + CASE o WHEN 6 THEN 70 ELSE 0 END AS VARCHAR) END ORDER BY d))
        FROM (SELECT v, o, d, max(5 + c_custkey % 13) AS rate FROM (SELECT DISTINCT c_custkey // 100 AS v, c_nationkey AS o FROM customer) CROSS JOIN (SELECT n_nationkey AS d FROM nation) LEFT JOIN customer ON c_custkey // 100 = v AND c_nationkey = o AND c_custkey % 25 IN (d, (d + 7) % 25) GROUP BY v, o, d) JOIN nation ON n_nationkey = o GROUP BY v, o, n_name"""


def city_sheet(spark, d):
    customer, nation = table(spark, d, "customer"), table(spark, d, "nation")
    number = F.floor(F.col("c_custkey") / 100).cast("int")
    vendors = customer.select(number.alias("vendor_id")).distinct()
    names = [F.lit(r["n_name"].lower()) for r in nation.orderBy("n_nationkey").select("n_name").collect()]  # the 25 nations
    rates = customer.withColumn("d", F.explode(F.array(F.col("c_custkey") % 25, (F.col("c_custkey") + 18) % 25)))
    rates = rates.groupBy(number.alias("vendor_id"), F.col("c_nationkey").alias("o"), "d").agg(F.max(5 + F.col("c_custkey") % 13).alias("rate"))
    wide = rates.groupBy("vendor_id", "o").agg(F.map_from_entries(F.collect_list(F.struct(F.col("d").cast("int"), "rate"))).alias("m"))
    plain = lambda r: (r + F.when(F.col("o") == 6, 70).otherwise(0)).cast("string")
    value = lambda i: F.when(F.col("m")[i].isNull(), "-").when(i == 9, F.concat(F.lit("1,"), F.col("m")[i] + 100)).otherwise(plain(F.col("m")[i]))
    down = F.when(F.col("o") == 3, "-").when(F.col("o") == 4, "nowhere").when(F.col("o") == 5, "N2").when(F.col("o") == 7, "south").otherwise(F.col("n_name"))
    body = wide.join(nation, F.col("n_nationkey") == F.col("o")).select("vendor_id", (F.col("o") + 3).cast("int").alias("row_idx"), F.concat(F.array(F.lit(""), down), F.transform(F.sequence(F.lit(0), F.lit(24)), value)).alias("cells"))
    heads = vendors.select(
        "vendor_id",
        F.posexplode(F.array(F.array(F.lit("Rate card")), F.array(F.lit("near INDIA city"), F.lit("CHINA"), F.lit("valid this year")), F.array(F.lit("From / To"), F.lit("From/To"), *names))).alias("row_idx", "cells"),
    )
    return heads.unionByName(body).withColumn("sheet", F.lit("city rates"))


CITY_CELLS = "SELECT vendor_id, row_idx, i - 1 AS col, len(cells) AS width, upper(trim(cells[i])) AS cell FROM (SELECT *, unnest(range(1, len(cells) + 1)) AS i FROM city_sheet)"
CITY_HEAD = "SELECT vendor_id, min(row_idx) AS h, arg_min(first_col, row_idx) AS first_col, arg_min(last_col, row_idx) AS last_col FROM (SELECT vendor_id, row_idx, min(col) AS first_col, max(col) AS last_col FROM city_cells JOIN cell_zones USING (cell) WHERE row_idx < 20 AND zones IS NOT NULL GROUP BY vendor_id, row_idx HAVING count(*) >= 3) GROUP BY vendor_id"
CITY_RATES = f"""SELECT vendor_id, origin, dest, {SPREAD} AS rate FROM (SELECT b.vendor_id, unnest(origins) AS origin, dests, rate FROM (
        SELECT c.vendor_id, coalesce(zo.zones, CASE WHEN o.cell IN ('', '-', 'NONE') OR contains(o.cell, 'USER') THEN ['E1'] END) AS origins, zd.zones AS dests, TRY_CAST(replace(c.cell, ',', '') AS DOUBLE) AS rate
        FROM city_cells c JOIN city_head h ON c.vendor_id = h.vendor_id AND c.row_idx > h.h AND c.width > h.last_col
        JOIN city_cells o ON o.vendor_id = c.vendor_id AND o.row_idx = c.row_idx AND o.col = greatest(h.first_col - 1, 0) LEFT JOIN cell_zones zo ON zo.cell = o.cell
        JOIN city_cells t ON t.vendor_id = c.vendor_id AND t.row_idx = h.h AND t.col = c.col JOIN cell_zones zd ON zd.cell = t.cell AND zd.zones IS NOT NULL) b WHERE origins IS NOT NULL AND rate BETWEEN 0.5 AND 500) x, unnest(x.dests) AS u(dest) GROUP BY vendor_id, origin, dest"""


@query(
    "detect_city_matrix",
    """SELECT vendor_id, origin, dest, rate FROM (SELECT *, bool_and(air) OVER (PARTITION BY vendor_id) AS every FROM (SELECT *, min(rate) OVER (PARTITION BY vendor_id, origin) > 60 AS air FROM city_rates)) WHERE every OR NOT air""",
    places=PLACES, city_sheet=CITY_SHEET, city_cells=CITY_CELLS, asked="SELECT DISTINCT cell FROM city_cells", cell_zones=CELL_ZONES, city_head=CITY_HEAD, city_rates=CITY_RATES,
)
def detect_city_matrix(spark, d):
    """Sheets with nations across and down: header, origins and rates are found in the cells."""
    return op.city_matrix(city_sheet(spark, d), places(spark, d), master(spark, d)).select("vendor_id", "origin", "dest", "rate")


#: Per hundred customers a sheet of destinations: an origin, a mode, headers, and mode labels among the rows; every third sheet goes on from another page.
CARD_SHEET = """SELECT v AS vendor_id, i, CASE
        WHEN v % 3 = 1 AND i < 2 THEN [n_name, n_name, '12', '24 Hrs']
        WHEN i = 0 THEN ['EX ' || CASE WHEN v % 2 = 0 THEN 'INDIA' ELSE 'NOWHERE' END] WHEN i = 1 THEN ['By Road']
        WHEN i = 2 THEN ['Destination', 'State', 'Rate (Per Kg)', 'TAT']
        WHEN i % 10 = 5 THEN ['Rates by Air'] WHEN i % 10 = 7 THEN ['Rates by Road']
        WHEN i = 58 THEN [CASE WHEN v % 2 = 0 THEN 'By Air only' ELSE 'By Surface only' END] WHEN i = 60 THEN ['TAT', 'City', 'Freight', 'Region']
        WHEN i > 60 THEN ['2 days', place, CAST(rate AS VARCHAR), n_name] ELSE [place, n_name, 'Rs. ' || CAST(rate AS VARCHAR) || ' per kg', '24 Hrs'] END AS cells
    FROM (SELECT c_custkey // 100 AS v, CAST(c_custkey % 100 AS INT) AS i, n_name, CASE c_custkey % 7 WHEN 0 THEN 'nowhere' WHEN 1 THEN 'near ' || n_name || ' city' ELSE lower(n_name) END AS place, 5 + c_custkey % 13 + CASE WHEN (c_custkey // 100) % 5 = 4 THEN 80 ELSE 0 END AS rate
        FROM customer JOIN nation ON n_nationkey = c_nationkey)"""


def card_sheet(spark, d):
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    rows = rows.select(F.floor(k / 100).cast("int").alias("vendor_id"), (k % 100).cast("int").alias("row_idx"), F.col("n_name").alias("n"), k)
    place = F.when(k % 7 == 0, "nowhere").when(k % 7 == 1, F.concat(F.lit("near "), F.col("n"), F.lit(" city"))).otherwise(F.lower("n"))
    v, i, rate = F.col("vendor_id"), F.col("row_idx"), (5 + k % 13 + F.when(F.col("vendor_id") % 5 == 4, 80).otherwise(0)).cast("string")
    row = lambda *cells: F.array(*[c if not isinstance(c, str) else F.lit(c) for c in cells])
    cells = (
        F.when((v % 3 == 1) & (i < 2), row(F.col("n"), F.col("n"), "12", "24 Hrs"))
        .when(i == 0, row(F.concat(F.lit("EX "), F.when(v % 2 == 0, "INDIA").otherwise("NOWHERE"))))
        .when(i == 1, row("By Road"))
        .when(i == 2, row("Destination", "State", "Rate (Per Kg)", "TAT"))
        .when(i % 10 == 5, row("Rates by Air"))
        .when(i % 10 == 7, row("Rates by Road"))
        .when(i == 58, row(F.when(v % 2 == 0, "By Air only").otherwise("By Surface only")))
        .when(i == 60, row("TAT", "City", "Freight", "Region"))
        .when(i > 60, row("2 days", place, rate, F.col("n")))
        .otherwise(row(place, F.col("n"), F.concat(F.lit("Rs. "), rate, F.lit(" per kg")), "24 Hrs"))
    )
    return rows.select("vendor_id", F.lit("city card").alias("sheet"), "row_idx", cells.alias("cells"))


CARD_ROWS = r"""SELECT *, list_position(list_transform(cells, lambda c: regexp_matches(c, '(?i)\b(destination|dest|to\s*city|city|location|consignee\s*city|deliver(y|ing)?\s*(city|location)?|hub|station|branch)\b')), true) AS dc,
        list_position(list_transform(cells, lambda c: regexp_matches(c, '(?i)\b(rates?|charges?|freight|per\s*kg|rs\.?/kg|pricing|amount|cost)\b')), true) AS rc,
        list_position(list_transform(cells, lambda c: regexp_matches(c, '(?i)\b(state|province|region)\b')), true) AS sc,
        CASE WHEN regexp_matches(array_to_string(cells, ' '), '(?i)\bby\s+air\b') THEN 'air' WHEN regexp_matches(array_to_string(cells, ' '), '(?i)\bby\s+(road|surface|ground|express)\b') THEN 'road' END AS label FROM card_sheet"""
CARD_HEADS = "SELECT h.vendor_id, h.i AS h, h.dc, h.rc, h.sc, coalesce((SELECT arg_max(label, i) FROM card_rows n WHERE n.vendor_id = h.vendor_id AND n.i BETWEEN h.i - 5 AND h.i AND label IS NOT NULL), 'road') AS mode FROM card_rows h WHERE dc > 0 AND rc > 0"
CARD_SECTIONS = r"""SELECT vendor_id, h, dc, rc, sc, mode FROM card_heads UNION ALL SELECT vendor_id, -1, 1, 3, 2, 'road' FROM card_rows JOIN (SELECT vendor_id, min(h) AS first FROM card_heads GROUP BY vendor_id) USING (vendor_id)
    WHERE i = 0 AND first > 0 AND trim(cells[1]) <> '' AND NOT regexp_matches(cells[1], '(?i)\b(rates?|charges?|freight|per\s*kg|rs\.?/kg|pricing|amount|cost)\b') AND regexp_matches(coalesce(cells[3], ''), '^\d+(\.\d+)?$')"""
CARD_BODY = r"""SELECT r.vendor_id, upper(trim(cells[s.dc])) AS cell, upper(trim(CASE WHEN s.sc > 0 THEN cells[s.sc] ELSE '' END)) AS state, TRY_CAST(trim(regexp_replace(replace(cells[s.rc], ',', ''), '(?i)(rs\.?\s*|per\s*kg|/\s*kg)', '', 'g')) AS DOUBLE) AS rate
    FROM card_rows r ASOF JOIN card_sections s ON r.vendor_id = s.vendor_id AND r.i >= s.h WHERE r.i <> s.h AND s.mode = 'road' AND r.label IS NULL
    AND coalesce((SELECT arg_max(label, i) FROM card_rows n WHERE n.vendor_id = r.vendor_id AND n.i > s.h AND n.i < r.i AND label IS NOT NULL), 'road') = 'road'"""
CARD_ORIGIN = r"""SELECT vendor_id, arg_min(place, i) AS cell FROM (SELECT r.vendor_id, i, upper(trim(regexp_extract(array_to_string(cells, ' '), '(?i)\b(ex[:\s]+|from[:\s]+|origin[:\s]*|dispatching\s+from[:\s]+|base[:\s]+(city|location)[:\s]+)([A-Z][A-Z /&,.-]{2,40})', 3))) AS place
    FROM card_rows r JOIN (SELECT vendor_id, min(h) AS first FROM card_heads GROUP BY vendor_id) USING (vendor_id) WHERE i < first) WHERE place <> '' GROUP BY vendor_id"""


@query(
    "detect_city_rate_card",
    f"""SELECT vendor_id, coalesce(oz.zones[1], 'N1') AS origin, dest, rate FROM (SELECT *, min(rate) FILTER (WHERE NOT starts_with(dest, 'X')) OVER (PARTITION BY vendor_id) AS least FROM (SELECT vendor_id, dest, {SPREAD} AS rate FROM
        (SELECT b.vendor_id, b.rate, unnest(coalesce(c.zones, s.zones)) AS dest FROM card_body b LEFT JOIN cell_zones c ON c.cell = b.cell LEFT JOIN cell_zones s ON s.cell = b.state WHERE b.cell NOT IN ('', 'DESTINATION', 'DEST', 'CITY') AND rate > 0 AND rate <= 500) GROUP BY vendor_id, dest))
       LEFT JOIN card_origin o USING (vendor_id) LEFT JOIN cell_zones oz ON oz.cell = o.cell WHERE coalesce(least <= 60, true)""",
    places=PLACES, card_sheet=CARD_SHEET, card_rows=CARD_ROWS, card_heads=CARD_HEADS, card_sections=CARD_SECTIONS, card_body=CARD_BODY, card_origin=CARD_ORIGIN,
    asked="SELECT cell FROM card_body UNION SELECT state FROM card_body UNION SELECT cell FROM card_origin", cell_zones=CELL_ZONES,
)
def detect_city_rate_card(spark, d):
    """Sheets of destinations, states and rates under an ``EX`` origin: sections, modes and zones are found in the cells."""
    return op.city_rate_card(card_sheet(spark, d), places(spark, d), master(spark, d)).select("vendor_id", "origin", "dest", "rate")


#: Per vendor a sheet of pincodes and rates from one station; vendor 3 has many stations.
STATION_SHEET = """SELECT CAST(vendor_id AS INT) AS vendor_id, 0 AS i, ['Station rates'] AS cells FROM (SELECT DISTINCT vendor_id FROM claims)
    UNION ALL SELECT CAST(vendor_id AS INT), 1, ['Branch', 'From Station', 'Express Rate', 'Out Card Rate', 'Km', 'PIN Code'] FROM (SELECT DISTINCT vendor_id FROM claims)
    UNION ALL SELECT CAST(vendor_id AS INT), CAST(1 + row_number() OVER (PARTITION BY vendor_id ORDER BY pincode, state) AS INT), ['b', CASE vendor_id WHEN 0 THEN 'okl' WHEN 1 THEN 'INDIA' WHEN 2 THEN '' ELSE state END, CAST(pincode % 9 * 3 AS VARCHAR), CASE WHEN pincode % 17 = 3 THEN '1,200' WHEN pincode % 17 = 4 THEN 'NA' ELSE CAST(2 + pincode % 9 AS VARCHAR) END, '10', CAST(pincode AS VARCHAR) || CASE WHEN pincode % 3 = 0 THEN '.0' ELSE '' END] FROM claims"""
STATION_HEAD = """SELECT vendor_id, min(i) AS h, arg_min(list_position(list_transform(cells, lambda c: contains(lower(c), 'pin')), true), i) AS pin, arg_min(list_position(list_transform(cells, lambda c: contains(lower(c), 'from') AND contains(lower(c), 'station')), true), i) AS station,
        arg_min(list_position(list_transform(cells, lambda c: contains(lower(c), 'out card')), true), i) AS rate
    FROM station_sheet WHERE i < 12 AND len(list_filter(cells, lambda c: contains(lower(c), 'pin'))) > 0 AND len(list_filter(cells, lambda c: contains(lower(c), 'rate') OR lower(trim(c)) IN ('km', 'kms', 'distance'))) > 0 GROUP BY vendor_id"""
STATION_ORIGIN = """SELECT h.vendor_id, coalesce(first_station, 'OKL') AS cell FROM station_head h LEFT JOIN (SELECT vendor_id, count(DISTINCT s) AS n, arg_min(s, i) AS first_station FROM (SELECT r.vendor_id, r.i, upper(trim(cells[h.station])) AS s FROM station_sheet r JOIN station_head h ON r.vendor_id = h.vendor_id AND r.i > h.h AND r.i <= h.h + 100) WHERE s NOT IN ('', 'NAN', 'NONE') GROUP BY vendor_id) USING (vendor_id) WHERE coalesce(n, 1) <= 5"""


@query(
    "detect_station_rates",
    f"""SELECT vendor_id, origin, dest, {SPREAD} AS rate FROM (SELECT r.vendor_id, CASE o.cell WHEN 'OKL' THEN 'E1' ELSE coalesce(z.zones[1], 'N1') END AS origin, m.zone AS dest, TRY_CAST(replace(cells[h.rate], ',', '') AS DOUBLE) AS rate
        FROM station_sheet r JOIN station_head h ON r.vendor_id = h.vendor_id AND r.i > h.h JOIN station_origin o ON o.vendor_id = r.vendor_id LEFT JOIN cell_zones z ON z.cell = o.cell
        JOIN master m ON m.pincode = CAST(TRY_CAST(cells[h.pin] AS DOUBLE) AS INT)) WHERE rate BETWEEN 0.5 AND 150 GROUP BY vendor_id, origin, dest""",
    places=PLACES, station_sheet=STATION_SHEET, station_head=STATION_HEAD, station_origin=STATION_ORIGIN, asked="SELECT DISTINCT cell FROM station_origin", cell_zones=CELL_ZONES,
)
def detect_station_rates(spark, d):
    """Sheets of pincodes and rates from one station: header, rate column and origin are found in the cells."""
    stations = spark.createDataFrame([("OKL", "E1")], "code string, zone string")
    return op.station_rates(station_sheet(spark, d), places(spark, d), stations, master(spark, d)).select("vendor_id", "origin", "dest", "rate")


def station_sheet(spark, d):
    k = F.col("pincode")
    rows = claims(spark, d)
    station = F.when(F.col("vendor_id") == 0, "okl").when(F.col("vendor_id") == 1, "INDIA").when(F.col("vendor_id") == 2, "").otherwise(F.col("state"))
    rate = F.when(k % 17 == 3, "1,200").when(k % 17 == 4, "NA").otherwise((2 + k % 9).cast("string"))
    cells = [F.lit("b"), station, k % 9 * 3, rate, F.lit("10"), F.concat(k, F.when(k % 3 == 0, ".0").otherwise(""))]
    return sheet(rows, "stations", ["pincode", "state"], cells, [["Station rates"], ["Branch", "From Station", "Express Rate", "Out Card Rate", "Km", "PIN Code"]])
