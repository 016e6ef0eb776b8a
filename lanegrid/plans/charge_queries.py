"""Queries of the charge family and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanegrid.functions import charges as fn
from lanegrid.operators import charges as op
from lanegrid.operators import labels
from lanegrid.plans.fixtures import sql
from lanegrid.runtime import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None, **views: str):
    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = sql(oracle, **views)
        return f

    return register


FIELDS = ["docketCharges", "fuel", "rovCharges", "odaCharges", "minCharges", "greenTax", "fuelSurcharge", "docketCharge"]
_FIELD_LIST = "[" + ", ".join(f"'{f}'" for f in FIELDS) + "]"

#: Candidates from ``part``: vendor, field, file order and one of six shapes of charge.
CANDIDATES = f"""SELECT CAST(p_partkey % 40 AS INT) AS vendor_id, {_FIELD_LIST}[p_size % 8 + 1] AS field, p_partkey AS file_order, CAST(p_partkey % 6 AS INT) AS shape,
    CASE WHEN p_partkey % 6 IN (3, 4, 5) THEN CASE p_partkey % 6 WHEN 3 THEN 'per_kg_minimum' WHEN 4 THEN 'per_shipment' ELSE 'weight_band' END END AS type,
    CASE WHEN p_partkey % 6 = 0 THEN CAST(p_size * 5 AS DOUBLE) END AS scalar,
    CASE WHEN p_partkey % 6 = 1 THEN p_size * 0.25::DOUBLE END AS v, CASE WHEN p_partkey % 6 IN (1, 4) THEN CAST(p_size * 10 AS DOUBLE) END AS f,
    CASE WHEN p_partkey % 6 = 3 THEN p_size * 0.5::DOUBLE END AS perKg, CASE WHEN p_partkey % 6 = 3 THEN CAST(p_size * 20 AS DOUBLE) END AS minimum,
    CASE WHEN p_partkey % 6 = 5 THEN 2 ELSE 0 END AS bands, CAST(p_size AS DOUBLE) AS size FROM part"""
RICH = "CASE shape WHEN 0 THEN CASE WHEN scalar <> 0 THEN 1 ELSE 0 END WHEN 1 THEN CASE WHEN v <> 0 THEN 3 ELSE 0 END WHEN 2 THEN 0 WHEN 3 THEN CASE WHEN perKg <> 0 THEN 5 ELSE 1 END WHEN 4 THEN CASE WHEN f <> 0 THEN 4 ELSE 1 END ELSE 12 END"
NAMED = "CASE field WHEN 'fuelSurcharge' THEN 'fuel' WHEN 'docketCharge' THEN 'docketCharges' ELSE field END"
VIEWS = {
    "candidates": CANDIDATES,
    "graded": f"SELECT * EXCLUDE (field), {NAMED} AS field, {RICH} AS rich FROM candidates",
    "best": "SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (PARTITION BY vendor_id, field ORDER BY rich DESC, file_order) AS place FROM graded WHERE rich > 0) WHERE place = 1",
}


def candidates(spark, d):
    key, size = F.col("p_partkey"), F.col("p_size").cast("double")
    shape = key % 6
    none = F.lit(None).cast("double")
    band = lambda lo, hi, c: F.struct(F.lit(lo).alias("minKg"), F.lit(hi).cast("double").alias("maxKg"), c.alias("charge"))
    charge = F.struct(
        F.when(shape == 3, "per_kg_minimum").when(shape == 4, "per_shipment").when(shape == 5, "weight_band").alias("type"),
        F.when(shape == 0, size * 5).alias("scalar"),
        F.when(shape == 1, size * 0.25).alias("v"),
        F.when(shape.isin(1, 4), size * 10).alias("f"),
        F.when(shape == 3, size * 0.5).otherwise(none).alias("perKg"),
        F.when(shape == 3, size * 20).otherwise(none).alias("minimum"),
        F.when(shape == 5, F.array(band(0.0, 50.0, size * 2), band(50.0, None, size * 4))).alias("bands"),
    )
    field = F.element_at(F.array(*map(F.lit, FIELDS)), (F.col("p_size") % 8 + 1).cast("int"))
    return table(spark, d, "part").select(
        (key % 40).cast("int").alias("vendor_id"), field.alias("field"), key.alias("file_order"), shape.cast("int").alias("shape"), F.when(shape != 2, charge).cast(fn.CHARGE).alias("charge"), size.alias("size")
    )


TEXT = """SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN p_size || '.50' WHEN 1 THEN 'Rs. 1,' || (200 + p_size) WHEN 2 THEN p_size || '.5+0.50' WHEN 3 THEN '1:' || (4700 + p_size) WHEN 4 THEN (1000 + p_size) || '/8'
    WHEN 5 THEN p_size || '%' WHEN 6 THEN 'NIL' WHEN 7 THEN p_size || '% or Rs ' || (900 + p_size) ELSE '₹' || (100 + p_size) || ' kg' END AS cell, p_size FROM part"""


def _texts(spark, d):
    k, size = F.col("p_partkey") % 9, F.col("p_size")
    s = size.cast("string")
    cell = (
        F.when(k == 0, F.concat(s, F.lit(".50"))).when(k == 1, F.concat(F.lit("Rs. 1,"), 200 + size)).when(k == 2, F.concat(s, F.lit(".5+0.50"))).when(k == 3, F.concat(F.lit("1:"), 4700 + size))
        .when(k == 4, F.concat(1000 + size, F.lit("/8"))).when(k == 5, F.concat(s, F.lit("%"))).when(k == 6, "NIL").when(k == 7, F.concat(s, F.lit("% or Rs "), 900 + size)).otherwise(F.concat(F.lit("₹"), 100 + size, F.lit(" kg")))
    )
    return table(spark, d, "part").select("p_partkey", cell.alias("cell"), "p_size")


@query(
    "parse_number",
    """SELECT p_partkey, CAST(CASE p_partkey % 9 WHEN 0 THEN p_size + 0.5 WHEN 1 THEN 1200 + p_size WHEN 2 THEN p_size + 0.5 WHEN 3 THEN 4700 + p_size WHEN 4 THEN (1000 + p_size) / 8
       WHEN 6 THEN NULL WHEN 8 THEN 100 + p_size ELSE p_size END AS DOUBLE) AS n FROM texts""",
    texts=TEXT,
)
def parse_number(spark, d):
    return _texts(spark, d).select("p_partkey", fn.parse_number(F.col("cell")).alias("n"))


@query("charge_num", "SELECT p_partkey, coalesce(TRY_CAST(replace(rtrim(trim(cell), '%'), ',', '') AS DOUBLE), 0) AS n FROM texts", texts=TEXT)
def charge_num(spark, d):
    return _texts(spark, d).select("p_partkey", fn.charge_num(F.col("cell")).alias("n"))


VF_TEXT = """SELECT p_partkey, p_size, CASE p_partkey % 6 WHEN 0 THEN 'Rs. ' || p_size || '.5/Kg or Rs. 1,' || (100 + p_size) || '/consignment (higher)' WHEN 1 THEN '0.5% on invoice value + Rs. ' || (100 + p_size) || ' flat'
    WHEN 2 THEN p_size || '% or Rs ' || (900 + p_size) WHEN 3 THEN p_size || '%' WHEN 4 THEN 'Rs ' || p_size ELSE CAST(60 + p_size AS VARCHAR) END AS cell FROM part"""


@query(
    "parse_vf",
    """SELECT p_partkey, CAST(CASE p_partkey % 6 WHEN 0 THEN p_size + 0.5 WHEN 1 THEN 0.5 WHEN 4 THEN NULL WHEN 5 THEN CASE WHEN 60 + p_size <= 100 THEN 60 + p_size END ELSE p_size END AS DOUBLE) AS v,
       CAST(CASE p_partkey % 6 WHEN 0 THEN 1100 + p_size WHEN 1 THEN 100 + p_size WHEN 2 THEN 900 + p_size WHEN 4 THEN p_size WHEN 5 THEN CASE WHEN 60 + p_size > 100 THEN 60 + p_size END END AS DOUBLE) AS f FROM texts""",
    texts=VF_TEXT,
)
def parse_vf(spark, d):
    k, size = F.col("p_partkey") % 6, F.col("p_size")
    lit = F.lit
    cell = (
        F.when(k == 0, F.concat(lit("Rs. "), size, lit(".5/Kg or Rs. 1,"), 100 + size, lit("/consignment (higher)"))).when(k == 1, F.concat(lit("0.5% on invoice value + Rs. "), 100 + size, lit(" flat")))
        .when(k == 2, F.concat(size, lit("% or Rs "), 900 + size)).when(k == 3, F.concat(size, lit("%"))).when(k == 4, F.concat(lit("Rs "), size)).otherwise((60 + size).cast("string"))
    )
    pair = fn.parse_vf(F.col("cell"))
    return table(spark, d, "part").withColumn("cell", cell).select("p_partkey", pair["v"].alias("v"), pair["f"].alias("f"))


@query("scalar_of", "SELECT file_order, coalesce(nullif(f, 0), nullif(scalar, 0), nullif(v, 0), f, scalar, v, 0) AS n FROM candidates WHERE shape <> 2", candidates=CANDIDATES)
def scalar_of(spark, d):
    return candidates(spark, d).where("charge is not null").select("file_order", fn.scalar_of(F.col("charge")).alias("n"))


@query(
    "vf_of",
    "SELECT file_order, CASE WHEN v IS NOT NULL OR f IS NOT NULL THEN coalesce(v, 0) WHEN scalar <= 100 THEN scalar ELSE 0 END AS v, CASE WHEN v IS NOT NULL OR f IS NOT NULL THEN coalesce(f, 0) WHEN scalar > 100 THEN scalar ELSE 0 END AS f FROM candidates WHERE shape <> 2",
    candidates=CANDIDATES,
)
def vf_of(spark, d):
    pair = fn.vf_of(F.col("charge"))
    return candidates(spark, d).where("charge is not null").select("file_order", pair["v"].alias("v"), pair["f"].alias("f"))


@query(
    "oda_encode",
    """SELECT file_order, type, CASE shape WHEN 0 THEN CASE WHEN scalar BETWEEN 1 AND 30 THEN scalar ELSE 0 END WHEN 1 THEN v WHEN 4 THEN 0 END AS v,
       CASE shape WHEN 0 THEN CASE WHEN scalar BETWEEN 1 AND 30 THEN 0 ELSE scalar END WHEN 1 THEN f WHEN 4 THEN f END AS f, perKg AS per_kg,
       CASE shape WHEN 3 THEN minimum WHEN 5 THEN size * 2 END AS minimum FROM candidates WHERE shape <> 2""",
    candidates=CANDIDATES,
)
def oda_encode(spark, d):
    rows = candidates(spark, d).where("charge is not null").select("file_order", fn.oda_encode(F.col("charge")).alias("o"))
    return rows.select("file_order", "o.type", "o.v", "o.f", F.col("o.perKg").alias("per_kg"), "o.minimum")


@query("charge_richness", "SELECT file_order, rich FROM graded", **VIEWS)
def charge_richness(spark, d):
    return candidates(spark, d).select("file_order", fn.richness(F.col("charge")).alias("rich"))


PAIRS = "SELECT a.file_order AS a, b.file_order AS b, {same} AS same FROM graded a JOIN graded b ON b.file_order = a.file_order + 48 AND a.shape <> 2 AND b.shape <> 2"
SAME = "coalesce(a.scalar, 0) = coalesce(b.scalar, 0) AND coalesce(a.v, 0) = coalesce(b.v, 0) AND coalesce(a.f, 0) = coalesce(b.f, 0) AND a.type IS NOT DISTINCT FROM b.type AND a.perKg IS NOT DISTINCT FROM b.perKg AND a.minimum IS NOT DISTINCT FROM b.minimum AND (a.bands = 0 OR a.size = b.size)"


@query("charges_equivalent", PAIRS.format(same=SAME), **VIEWS)
def charges_equivalent(spark, d):
    rows = candidates(spark, d).where("charge is not null").select("file_order", "charge")
    a, b = rows.toDF("a", "ca"), rows.toDF("b", "cb").withColumn("a", F.col("b") - 48)
    return a.join(b, "a").select("a", "b", fn.equivalent(F.col("ca"), F.col("cb")).alias("same"))


@query("merge_charges", "SELECT vendor_id, field, file_order AS source, rich FROM best", **VIEWS)
def merge_charges(spark, d):
    return op.merge(candidates(spark, d)).select("vendor_id", "field", "source", "rich")


@query(
    "charge_ambiguities",
    f"""SELECT b.vendor_id, b.field, a.file_order AS kept_source, b.file_order AS other_source FROM graded b JOIN graded a ON a.vendor_id = b.vendor_id AND a.field = b.field AND a.rich = b.rich
        AND a.file_order = (SELECT arg_max(x.file_order, (x.rich, -x.file_order)) FROM graded x WHERE x.vendor_id = b.vendor_id AND x.field = b.field AND x.file_order < b.file_order AND x.rich > 0)
        WHERE b.rich > 0 AND NOT ({SAME})""",
    **VIEWS,
)
def charge_ambiguities(spark, d):
    return op.ambiguities(candidates(spark, d))


@query(
    "encode_charges",
    """SELECT vendor_id, coalesce(max(CASE WHEN field = 'docketCharges' THEN n END), 0) AS docket, coalesce(max(CASE WHEN field = 'minCharges' THEN n END), 0) AS minimum, coalesce(max(CASE WHEN field = 'greenTax' THEN n END), 0) AS green,
       coalesce(max(CASE WHEN field = 'fuel' THEN coalesce(nullif(v, 0), nullif(scalar, 0)) END), 0) AS fuel FROM (SELECT *, coalesce(nullif(f, 0), nullif(scalar, 0), nullif(v, 0), 0) AS n FROM best) GROUP BY vendor_id""",
    **VIEWS,
)
def encode_charges(spark, d):
    rows = op.encode(op.wide(op.merge(candidates(spark, d)), FIELDS[:6]))
    return rows.select("vendor_id", F.col("docketCharges").alias("docket"), F.col("minCharges").alias("minimum"), F.col("greenTax").alias("green"), "fuel")


@query(
    "charge_formula_eval",
    """SELECT file_order, kg, CASE shape WHEN 5 THEN CASE WHEN kg <= 50 THEN size * 2 ELSE size * 4 END WHEN 3 THEN greatest(perKg * kg, minimum) WHEN 4 THEN f WHEN 1 THEN f + kg * v / 100
       ELSE CASE WHEN scalar <= 100 THEN kg * scalar / 100 ELSE scalar END END AS charge FROM (SELECT *, CAST(10 + file_order % 100 AS DOUBLE) AS kg FROM candidates WHERE shape <> 2)""",
    candidates=CANDIDATES,
)
def charge_formula_eval(spark, d):
    rows = candidates(spark, d).where("charge is not null").withColumn("kg", (10 + F.col("file_order") % 100).cast("double"))
    return rows.select("file_order", "kg", fn.evaluate(F.col("charge"), F.col("kg")).alias("charge"))


@query("enabled_charges", "SELECT vendor_id, string_agg(field, ' ' ORDER BY field) AS fields FROM best GROUP BY vendor_id", **VIEWS)
def enabled_charges(spark, d):
    return op.enabled(op.merge(candidates(spark, d))).withColumn("fields", F.array_join("fields", " "))


@query("charges_from_source", f"SELECT vendor_id, string_agg(DISTINCT {NAMED}, ' ' ORDER BY {NAMED}) AS fields FROM candidates WHERE shape <> 2 GROUP BY vendor_id", candidates=CANDIDATES)
def charges_from_source(spark, d):
    return op.from_source(candidates(spark, d)).withColumn("fields", F.array_join("fields", " "))


@query("charge_caps", "SELECT file_order, field, f FROM (SELECT file_order, field, size * 60 AS f FROM candidates) WHERE f <= CASE field WHEN 'docketCharges' THEN 2000 WHEN 'greenTax' THEN 2000 ELSE 1e9 END", candidates=CANDIDATES)
def charge_caps(spark, d):
    rows = candidates(spark, d).withColumn("f", F.col("size") * 60)
    return rows.where(fn.under_cap(F.col("field"), F.col("f"))).select("file_order", "field", "f")


@query(
    "handling_basis",
    "SELECT file_order, CASE shape WHEN 3 THEN 'freight' WHEN 1 THEN 'invoice' ELSE 'none' END AS basis, shape = 1 AND v > 0 AS invoice_enabled FROM candidates WHERE shape <> 2",
    candidates=CANDIDATES,
)
def handling_basis(spark, d):
    """Basis of a handling charge: percentages go by invoice value, amounts per kg by freight."""
    c = F.col("charge")
    basis = F.when(c["perKg"].isNotNull(), "freight").when(c["v"].isNotNull(), "invoice").otherwise("none")
    return candidates(spark, d).where("charge is not null").select("file_order", basis.alias("basis"), F.coalesce(c["v"] > 0, F.lit(False)).alias("invoice_enabled"))


@query(
    "handling_encode",
    """SELECT p_partkey, CASE WHEN k = 0 THEN 'per_box' END AS type, CASE WHEN k = 0 THEN s END AS per_box, CASE WHEN k = 0 THEN s * 10 END AS minimum, CASE k WHEN 1 THEN s / 4 WHEN 2 THEN s WHEN 3 THEN 0 END AS v, CASE k WHEN 1 THEN s * 2 WHEN 2 THEN 0 WHEN 3 THEN s + 100 END AS f, CASE WHEN k = 1 AND s > 10 THEN s END AS threshold
       FROM (SELECT p_partkey, p_partkey % 4 AS k, CAST(p_size AS DOUBLE) AS s FROM part)""",
)
def handling_encode(spark, d):
    k, s = F.col("p_partkey") % 4, F.col("p_size").cast("double")
    charge = F.struct(
        F.when(k == 0, "per_box").alias("type"), F.when(k == 2, s).when(k == 3, s + 100).alias("scalar"), F.when(k == 1, s / 4).alias("v"), F.when(k == 1, s * 2).alias("f"),
        F.when(k == 0, s).alias("perBox"), F.when(k == 0, s * 10).alias("minimum"), F.when((k == 1) & (s > 10), s).otherwise(0.0).alias("thresholdWeight"),
    )
    rows = table(spark, d, "part").select("p_partkey", charge.alias("c")).withColumn("h", fn.encode_handling(F.col("c")))
    return rows.select("p_partkey", "h.type", F.col("h.perBox").alias("per_box"), "h.minimum", "h.v", "h.f", F.col("h.thresholdWeight").alias("threshold"))


@query(
    "invoice_encode",
    """SELECT p_partkey, CASE k WHEN 0 THEN s WHEN 1 THEN s / 10 WHEN 2 THEN 0 WHEN 3 THEN 0 END AS percentage, CASE k WHEN 0 THEN 50 WHEN 1 THEN s WHEN 2 THEN 0 WHEN 3 THEN 0 END AS minimum, CASE WHEN k = 3 THEN 'slabs' END AS type, k = 1 OR k = 4 AS on_invoice FROM (SELECT p_partkey, p_partkey % 5 AS k, CAST(p_size AS DOUBLE) AS s FROM part)""",
)
def invoice_encode(spark, d):
    k, s = F.col("p_partkey") % 5, F.col("p_size").cast("double")
    charge = F.struct(
        (k == 2).alias("enabled"), F.when(k == 0, s).otherwise(0.0).alias("percentage"), F.when(k == 0, 50.0).otherwise(0.0).alias("minimumAmount"), F.when(k == 1, s / 10).alias("v"), F.when(k == 1, s).alias("f"),
        F.when(k == 3, F.array(s)).alias("slabs"), F.when(k == 1, "percentage_invoice").when(k == 2, "percentage_freight").alias("type"), F.when(k == 4, "invoice").alias("basis"),
    )
    rows = table(spark, d, "part").select("p_partkey", charge.alias("c")).withColumn("i", fn.encode_invoice(F.col("c")))
    return rows.select("p_partkey", "i.percentage", F.col("i.minimumAmount").alias("minimum"), "i.type", F.coalesce(fn.basis(F.col("c")) == "invoice", F.lit(False)).alias("on_invoice"))


@query(
    "gst_check",
    "SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 0 THEN lpad(CAST(s_nationkey + 1 AS VARCHAR), 2, '0') || 'ABCDE' || lpad(CAST(s_suppkey % 10000 AS VARCHAR), 4, '0') || 'F1Z5' END AS gst FROM supplier",
)
def gst_check(spark, d):
    number = F.concat(F.lpad((F.col("s_nationkey") + 1).cast("string"), 2, "0"), F.lit(" abcde"), F.lpad((F.col("s_suppkey") % 10000).cast("string"), 4, "0"), F.when(F.col("s_suppkey") % 3 == 0, " F1-5").otherwise(" F1Z5"))
    return table(spark, d, "supplier").select("s_suppkey", fn.gst_number(number).alias("gst"))


@query(
    "extraction_confidence",
    "SELECT s_suppkey, CAST(CASE WHEN s_suppkey % 2 = 1 THEN CASE WHEN s_suppkey % 17 >= 10 THEN 62 WHEN s_suppkey % 17 >= 5 THEN 55 ELSE 45 END ELSE [80, 65, 60, 55][s_suppkey % 4 + 1] END AS INT) AS confidence FROM supplier",
)
def extraction_confidence(spark, d):
    k = F.col("s_suppkey")
    source = F.element_at(F.array(*map(F.lit, fn.SOURCE_CONFIDENCE)), (k % 4 + 1).cast("int"))
    return table(spark, d, "supplier").select("s_suppkey", fn.extraction_confidence(source, k % 17, k % 2 == 1).alias("confidence"))


_LABELS = list(labels.CHARGE_LABELS)
_LABEL_SQL = "[" + ", ".join(f"'{k}'" for k in _LABELS) + "]"


@query(
    "inline_charge",
    f"""SELECT p_partkey, k.field, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS DOUBLE) END AS v, CASE WHEN p_partkey % 2 = 1 THEN CAST(p_size AS DOUBLE) END AS f
        FROM part JOIN (SELECT * FROM (VALUES {", ".join(f"('{k}', '{v}')" for k, v in labels.CHARGE_LABELS.items() if v)}) t(known, field)) k ON k.known = {_LABEL_SQL}[p_partkey % {len(_LABELS)} + 1] WHERE p_partkey % 5 <> 0 AND regexp_matches(k.known, '^[a-z]')""",
)
def inline_charge(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    label = F.initcap(F.element_at(F.array(*map(F.lit, _LABELS)), (k % len(_LABELS) + 1).cast("int")))
    cell = F.when(k % 5 == 0, F.col("p_name")).when(k % 2 == 0, F.concat(label, F.lit("-"), size, F.lit("%"))).otherwise(F.concat(label, F.lit(" : Rs "), size))
    return op.inline(table(spark, d, "part").select("p_partkey", cell.alias("cell")), labels.dictionary(spark))
