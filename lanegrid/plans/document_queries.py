"""Queries of the document family and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanegrid.operators import coverage as cov
from lanegrid.operators import documents as op
from lanegrid.operators import rates as rate_op
from lanegrid.plans import coverage_queries as cq

from lanegrid.plans.fixtures import claims, master, rates, sql
from lanegrid.plans.rate_queries import MATRIX
from lanegrid.runtime import spread, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None, **views: str):
    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = sql(oracle, **views)
        return f

    return register


#: Vendor documents from ``supplier``: one in several lacks each field.
DOCS = """SELECT s_suppkey AS vendor_id, CASE WHEN s_suppkey % 17 <> 0 THEN s_name ELSE '' END AS companyName, 'LTL' AS transportMode,
    CASE WHEN s_suppkey % 3 <> 0 THEN '29ABCDE1234F1Z5' END AS gstNo, CASE WHEN s_suppkey % 4 <> 1 THEN '98' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') END AS contactPhone,
    CASE WHEN s_suppkey % 5 = 2 THEN 'a' || s_suppkey || '@example.com' END AS contactEmail, CASE WHEN s_suppkey % 6 = 0 THEN 0.0::DOUBLE ELSE 4.5::DOUBLE END AS rating, s_suppkey % 7 = 0 AS isVerified,
    CASE WHEN s_suppkey % 2 = 0 THEN 'Dock ' || s_nationkey ELSE '' END AS address, CASE WHEN s_suppkey % 9 = 0 THEN 60.0::DOUBLE ELSE CAST(s_suppkey % 30 AS DOUBLE) END AS fuel,
    CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE CAST(s_suppkey % 40 * 50 AS DOUBLE) END AS docketCharges, CAST(s_suppkey % 23 * 300 AS DOUBLE) AS minCharges,
    CASE WHEN s_suppkey % 2 = 0 THEN 0.5::DOUBLE END AS rov_v, NULL::DOUBLE AS rov_f, [NULL, 'per_kg_minimum', 'per_shipment', 'weight_band'][s_suppkey % 4 + 1] AS oda_type,
    CASE WHEN s_suppkey % 8 = 1 THEN 2.5::DOUBLE END AS oda_v, NULL::DOUBLE AS oda_f, CAST(s_suppkey % 21 AS INT) AS origins, CAST(s_suppkey % 19 AS INT) AS active_zones,
    ['2.1', '4.0', '1.3'][s_suppkey % 3 + 1] AS version FROM supplier"""


def docs(spark, d):
    k = F.col("s_suppkey")
    none = F.lit(None).cast("double")
    return table(spark, d, "supplier").select(
        k.alias("vendor_id"),
        F.when(k % 17 != 0, F.col("s_name")).otherwise("").alias("companyName"),
        F.lit("LTL").alias("transportMode"),
        F.when(k % 3 != 0, "29ABCDE1234F1Z5").alias("gstNo"),
        F.when(k % 4 != 1, F.concat(F.lit("98"), F.lpad(k.cast("string"), 8, "0"))).alias("contactPhone"),
        F.when(k % 5 == 2, F.concat(F.lit("a"), k, F.lit("@example.com"))).alias("contactEmail"),
        F.when(k % 6 == 0, 0.0).otherwise(4.5).alias("rating"),
        (k % 7 == 0).alias("isVerified"),
        F.when(k % 2 == 0, F.concat(F.lit("Dock "), F.col("s_nationkey"))).otherwise("").alias("address"),
        F.when(k % 9 == 0, 60.0).otherwise((k % 30).cast("double")).alias("fuel"),
        F.when(k % 11 != 0, (k % 40 * 50).cast("double")).alias("docketCharges"),
        (k % 23 * 300).cast("double").alias("minCharges"),
        F.when(k % 2 == 0, 0.5).alias("rov_v"),
        none.alias("rov_f"),
        F.when(k % 4 == 1, "per_kg_minimum").when(k % 4 == 2, "per_shipment").when(k % 4 == 3, "weight_band").alias("oda_type"),
        F.when(k % 8 == 1, 2.5).alias("oda_v"),
        none.alias("oda_f"),
        (k % 21).cast("int").alias("origins"),
        (k % 19).cast("int").alias("active_zones"),
        F.when(k % 3 == 0, "2.1").when(k % 3 == 1, "4.0").otherwise("1.3").alias("version"),
    )


FILLED = "({c} IS NOT NULL AND {c} <> '')"
_f = lambda c: FILLED.format(c=c)
SCORED = f"""SELECT *, round(CAST(least(100, least(30, origins * 2) + least(25, active_zones * 2) + CASE WHEN {_f('companyName')} THEN 8 ELSE 0 END + 4 + CASE WHEN gstNo IS NOT NULL THEN 5 ELSE 0 END
    + CASE WHEN contactPhone IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN contactEmail IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN rating <> 0 THEN 3 ELSE 0 END + CASE WHEN isVerified THEN 2 ELSE 0 END + CASE WHEN {_f('address')} THEN 2 ELSE 0 END
    + CASE WHEN docketCharges > 0 THEN 3 ELSE 0 END + CASE WHEN fuel > 0 THEN 3 ELSE 0 END + CASE WHEN rov_v <> 0 THEN 3 ELSE 0 END + CASE WHEN coalesce(oda_v, 0) <> 0 OR coalesce(oda_type, '') IN ('per_shipment', 'weight_band') THEN 3 ELSE 0 END
    + CASE WHEN minCharges > 0 THEN 3 ELSE 0 END) AS DOUBLE), 1) AS quality FROM docs"""
BAND = "CASE WHEN quality >= 75 THEN 'green' WHEN quality >= 50 THEN 'yellow' ELSE 'red' END"
VIEWS = {"docs": DOCS, "scored": SCORED}


@query("quality_score", "SELECT vendor_id, quality FROM scored", **VIEWS)
def quality_score(spark, d):
    return op.quality_score(docs(spark, d)).select("vendor_id", "quality")


@query("quality_band", f"SELECT {BAND} AS band, count(*) AS n FROM scored GROUP BY ALL", **VIEWS)
def quality_band(spark, d):
    return op.quality_score(docs(spark, d)).groupBy(op.quality_band(F.col("quality")).alias("band")).agg(F.count("*").alias("n"))


MODE_ROWS = "SELECT c_custkey, ['FULL_ZONE', 'EXCLUDING', 'INCLUDING', 'ONLY_SERVED', 'FULL_MINUS_EXCEPTIONS', 'odd'][c_custkey % 6 + 1] AS mode FROM customer"


@query("mode_normalize", "SELECT c_custkey, ['FULL_ZONE', 'FULL_MINUS_EXCEPT', 'ONLY_SERVED', 'ONLY_SERVED', 'FULL_MINUS_EXCEPT', 'NOT_SERVED'][c_custkey % 6 + 1] AS mode FROM customer")
def mode_normalize(spark, d):
    modes = F.array(*map(F.lit, ["FULL_ZONE", "EXCLUDING", "INCLUDING", "ONLY_SERVED", "FULL_MINUS_EXCEPTIONS", "odd"]))
    mode = F.element_at(modes, (F.col("c_custkey") % 6 + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", op.normalize_mode(mode).alias("mode"))


#: A matrix and coverage with planted faults, for the validators.
FAULTY = "SELECT vendor_id, CASE WHEN origin = 'C2' THEN 'Q1' ELSE origin END AS origin, CASE WHEN dest = 'E1' THEN 'Q2' ELSE dest END AS dest, CASE WHEN dest = 'N1' THEN -rate WHEN dest = 'N2' THEN rate * 100 WHEN dest = 'N3' THEN 0.5 ELSE rate END AS rate FROM (SELECT CAST(vendor_id AS BIGINT) AS vendor_id, origin, dest, rate FROM matrix)"
SERVED = "SELECT DISTINCT CAST(vendor_id AS BIGINT) AS vendor_id, CASE WHEN claimed_zone = 'S1' THEN 'Q3' ELSE claimed_zone END AS zone, CASE claimed_zone WHEN 'W1' THEN 'NOT_SERVED' WHEN 'W2' THEN 'odd' ELSE 'ONLY_SERVED' END AS mode FROM claims"
FAULT_VIEWS = {"docs": DOCS, "matrix": MATRIX, "faulty": FAULTY, "served": SERVED}


def _faulty(spark, d):
    m = rate_op.pick_rate(rates(spark, d), 5.0, inclusive=True)
    o, t, r = F.col("origin"), F.col("dest"), F.col("rate")
    matrix = m.select(
        F.col("vendor_id").cast("long").alias("vendor_id"),
        F.when(o == "C2", "Q1").otherwise(o).alias("origin"),
        F.when(t == "E1", "Q2").otherwise(t).alias("dest"),
        F.when(t == "N1", -r).when(t == "N2", r * 100).when(t == "N3", 0.5).otherwise(r).alias("rate"),
    )
    z = F.col("claimed_zone")
    served = claims(spark, d).select(
        F.col("vendor_id").cast("long").alias("vendor_id"), F.when(z == "S1", "Q3").otherwise(z).alias("zone"), F.when(z == "W1", "NOT_SERVED").when(z == "W2", "odd").otherwise("ONLY_SERVED").alias("mode")
    )
    return docs(spark, d), matrix, served.distinct()


@query(
    "validate_structure",
    f"""SELECT rule, count(*) AS n FROM (SELECT 'version' AS rule FROM docs WHERE version = '1.3' UNION ALL SELECT 'name_missing' FROM docs WHERE NOT {_f('companyName')}
       UNION ALL SELECT 'no_rates' FROM docs WHERE vendor_id NOT IN (SELECT vendor_id FROM faulty) UNION ALL SELECT 'unknown_origin' FROM (SELECT DISTINCT vendor_id FROM faulty WHERE origin = 'Q1')
       UNION ALL SELECT 'unknown_dest' FROM faulty WHERE dest = 'Q2' UNION ALL SELECT 'invalid_rate' FROM faulty WHERE rate < 0
       UNION ALL SELECT 'unknown_zone' FROM served WHERE zone = 'Q3' UNION ALL SELECT 'invalid_mode' FROM served WHERE mode = 'odd') GROUP BY rule""",
    **FAULT_VIEWS,
)
def validate_structure(spark, d):
    return op.validate_structure(*_faulty(spark, d)).groupBy("rule").agg(F.count("*").alias("n"))


@query(
    "validate_full",
    f"""SELECT vendor_id, severity, rule, count(*) AS n FROM (
       SELECT vendor_id, 'error' AS severity, 'non_positive' AS rule FROM faulty WHERE rate <= 0 UNION ALL SELECT vendor_id, 'warning', 'very_high' FROM faulty WHERE rate > 500
       UNION ALL SELECT vendor_id, 'warning', 'very_low' FROM faulty WHERE rate > 0 AND rate < 1 UNION ALL SELECT vendor_id, 'warning', 'min_charges' FROM docs WHERE minCharges > 5000
       UNION ALL SELECT vendor_id, 'warning', 'fuel' FROM docs WHERE fuel > 50 UNION ALL SELECT vendor_id, 'error', 'oda_empty' FROM docs WHERE oda_type = 'per_kg_minimum' AND coalesce(oda_v, 0) = 0
       UNION ALL SELECT vendor_id, 'warning', 'no_service' FROM docs WHERE vendor_id NOT IN (SELECT vendor_id FROM served)
       UNION ALL SELECT vendor_id, CASE WHEN many THEN 'error' ELSE 'warning' END, CASE WHEN many THEN 'origins_without_rates' ELSE 'zone_without_rates' END FROM
           (SELECT w.vendor_id, any_value(w.zone) AS zone, many FROM without w JOIN (SELECT vendor_id, count(*) > 0.2 * (SELECT count(*) FROM active a WHERE a.vendor_id = x.vendor_id) AS many FROM without x GROUP BY vendor_id) USING (vendor_id)
            GROUP BY w.vendor_id, many, CASE WHEN many THEN '' ELSE w.zone END)
       UNION ALL SELECT a.vendor_id, 'warning', 'missing_lane' FROM active a JOIN active b USING (vendor_id) WHERE (a.vendor_id, a.zone) IN (SELECT vendor_id, origin FROM faulty) AND (a.vendor_id, a.zone, b.zone) NOT IN (SELECT vendor_id, origin, dest FROM faulty)
       UNION ALL SELECT vendor_id, 'warning', 'no_name' FROM docs WHERE NOT {_f('companyName')} UNION ALL SELECT vendor_id, 'warning', 'no_gst' FROM docs WHERE gstNo IS NULL
       UNION ALL SELECT vendor_id, 'warning', 'no_contact' FROM docs WHERE contactPhone IS NULL AND contactEmail IS NULL) GROUP BY ALL""",
    **FAULT_VIEWS,
    active="SELECT DISTINCT vendor_id, zone FROM served WHERE mode <> 'NOT_SERVED'",
    without="SELECT vendor_id, zone FROM active WHERE (vendor_id, zone) NOT IN (SELECT vendor_id, origin FROM faulty)",
)
def validate_full(spark, d):
    return op.validate_full(*_faulty(spark, d)).groupBy("vendor_id", "severity", "rule").agg(F.count("*").alias("n"))


DIFF = """SELECT '{part}' AS part, item, a.v AS a, b.v AS b, {delta} AS delta FROM ({side0}) a FULL JOIN ({side1}) b USING (item) WHERE a.v IS DISTINCT FROM b.v"""
_ZONE_SIDE = "SELECT zone AS item, CAST({c} AS VARCHAR) AS v FROM service WHERE vendor_id = {v}"
_RATE_SIDE = "SELECT origin || '>' || dest AS item, CAST(rate AS VARCHAR) AS v, rate AS r FROM matrix WHERE vendor_id = {v}"


@query(
    "document_diff",
    " UNION ALL ".join(
        DIFF.format(part=p, delta="CAST(NULL AS DOUBLE)", side0=_ZONE_SIDE.format(c=c, v=0), side1=_ZONE_SIDE.format(c=c, v=1)) for p, c in (("zones.mode", "mode"), ("zones.served", "served_count"))
    )
    + " UNION ALL " + DIFF.format(part="matrix.rate", delta="round(coalesce(b.r, 0) - coalesce(a.r, 0), 2)", side0=_RATE_SIDE.format(v=0), side1=_RATE_SIDE.format(v=1)),
    matrix=MATRIX, effective=cq.EFFECTIVE, service=cq.SERVICE,
)
def document_diff(spark, d):
    m = rate_op.pick_rate(rates(spark, d), 5.0, inclusive=True)
    service = cov.build_serviceability(claims(spark, d), master(spark, d)).withColumnRenamed("served_count", "served")
    charges = spark.createDataFrame([], "pair int, field string, value double")

    def document(vendor):
        of = lambda df: df.where(F.col("vendor_id") == vendor).withColumn("pair", F.lit(0))
        return {"zones": of(service), "matrix": of(m), "charges": charges}

    return op.diff(document(0), document(1)).drop("pair")


SHARES = f"""SELECT vendor_id, (CASE WHEN {_f('companyName')} THEN 1 ELSE 0 END + CASE WHEN gstNo IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN contactPhone IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN contactEmail IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN {_f('address')} THEN 1 ELSE 0 END) / 5 AS company,
    (CASE WHEN fuel <> 0 THEN 1 ELSE 0 END + CASE WHEN coalesce(docketCharges, 0) <> 0 THEN 1 ELSE 0 END + CASE WHEN minCharges <> 0 THEN 1 ELSE 0 END + CASE WHEN oda_type IS NOT NULL THEN 1 ELSE 0 END) / 4 AS charges,
    CASE WHEN origins > 0 THEN 1 ELSE 0 END AS o, CASE WHEN active_zones > 0 THEN 1 ELSE 0 END AS z, (CASE WHEN fuel > 50 THEN 1 ELSE 0 END + CASE WHEN coalesce(docketCharges, 0) > 1000 THEN 1 ELSE 0 END + CASE WHEN gstNo IS NULL THEN 1 ELSE 0 END) / 3 AS odd FROM docs"""


@query("completeness", "SELECT vendor_id, round(company * 0.3 + charges * 0.25 + o * 0.25 + z * 0.15, 3) AS completeness FROM shares", docs=DOCS, shares=SHARES)
def completeness(spark, d):
    return op.completeness(docs(spark, d)).select("vendor_id", F.round("completeness", 3).alias("completeness"))


@query("anomaly_score", "SELECT vendor_id, round(odd, 4) AS anomaly FROM shares", docs=DOCS, shares=SHARES)
def anomaly_score(spark, d):
    return op.completeness(docs(spark, d)).select("vendor_id", "anomaly")


@query(
    "enhancement_potential",
    """SELECT vendor_id, share AS completeness, likely, n * 15 AS improvement, least(share * 100 + n * 15, 100) AS quality, CASE WHEN n > 2 THEN 'High' WHEN n > 1 THEN 'Medium' ELSE 'Low' END AS potential FROM
       (SELECT *, array_to_string(list_filter(l, lambda x: x IS NOT NULL), ' ') AS likely, CAST(len(list_filter(l, lambda x: x IS NOT NULL)) AS INT) AS n FROM
       (SELECT vendor_id, share, [CASE WHEN gstNo IS NULL THEN 'gst_ml' END, CASE WHEN contactPhone IS NULL THEN 'contact_ml' END, CASE WHEN origins = 0 AND oda_type IS NOT NULL THEN 'zone_rates_ml' END, CASE WHEN share < 0.8 THEN 'business_logic_ml' END] AS l FROM
       (SELECT *, (CASE WHEN companyName <> '' THEN 1 ELSE 0 END + CASE WHEN docketCharges IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN origins > 0 THEN 1 ELSE 0 END + CASE WHEN active_zones > 0 THEN 1 ELSE 0 END) / 4 AS share FROM docs)))""",
    docs=DOCS,
)
def enhancement_potential(spark, d):
    return op.enhancement_potential(docs(spark, d)).withColumn("likely", F.array_join("likely", " "))


EVENTS = "SELECT event_id, unnest(CASE WHEN event_id % 3 = 0 THEN [event_type, 'contact_ml'] ELSE [event_type] END) AS kind, (user_id % 8) / 8 AS confidence, CAST(event_id % 50 AS DOUBLE) AS before, CAST(event_id % 50 + event_id % 5 - 1 AS DOUBLE) AS after FROM events"


@query(
    "enhancement_summary",
    "SELECT kind, count(*) AS n, round(avg(confidence), 4) AS confidence, round(avg(CASE WHEN after > before THEN after - before END) * 100, 2) AS effectiveness, round(avg(CASE WHEN after > before THEN 1 ELSE 0 END), 4) AS success_rate FROM ev GROUP BY kind",
    ev=EVENTS,
)
def enhancement_summary(spark, d):
    e = F.col("event_id")
    rows = table(spark, d, "events").select(
        F.when(e % 3 == 0, F.array(F.col("event_type"), F.lit("contact_ml"))).otherwise(F.array("event_type")).alias("types"),
        ((F.col("user_id") % 8) / 8).alias("confidence"),
        (e % 50).cast("double").alias("before"),
        (e % 50 + e % 5 - 1).cast("double").alias("after"),
    )
    return op.enhancement_summary(rows)


@query(
    "missing_fields",
    "SELECT vendor_id, concat_ws(' ', CASE WHEN companyName = '' THEN 'companyName' END, CASE WHEN gstNo IS NULL THEN 'gstNo' END, CASE WHEN contactPhone IS NULL THEN 'contactPhone' END, CASE WHEN origins = 0 THEN 'zoneRates' END, CASE WHEN active_zones = 0 THEN 'serviceability' END) AS missing FROM docs",
    docs=DOCS,
)
def missing_fields(spark, d):
    return op.missing_fields(docs(spark, d)).withColumn("missing", F.array_join("missing", " "))


@query(
    "manual_input_fields",
    """SELECT vendor_id, field, field = 'customerID' AS required FROM (SELECT vendor_id, unnest([CASE WHEN companyName = '' THEN 'companyName' END, CASE WHEN gstNo IS NULL THEN 'gstNo' END, CASE WHEN contactPhone IS NULL THEN 'contactPhone' END,
       CASE WHEN contactEmail IS NULL THEN 'contactEmail' END, CASE WHEN address = '' THEN 'address' END, 'city', 'state', 'customerID']) AS field FROM docs) WHERE field IS NOT NULL""",
    docs=DOCS,
)
def manual_input_fields(spark, d):
    none = F.lit(None).cast("string")
    return op.manual_input(docs(spark, d).withColumns({"city": none, "state": none, "customerID": none}))


FIELD_ROWS = "SELECT vendor_id, unnest(['fuel', 'docketCharges', 'minCharges']) AS field, unnest([fuel, coalesce(docketCharges, 0), minCharges]) AS value FROM docs"
AUDIT = "SELECT CAST(event_id % 100 AS BIGINT) AS vendor_id, ['fuel', 'docketCharges', 'other'][event_id % 3 + 1] AS matched, event_type AS type, 'raw' || (user_id % 5) AS raw, (event_id % 16) / 16 AS confidence, event_id AS seq FROM events"


def _audit(spark, d):
    e = F.col("event_id")
    return table(spark, d, "events").select(
        (e % 100).alias("vendor_id"),
        F.element_at(F.array(*map(F.lit, ["fuel", "docketCharges", "other"])), (e % 3 + 1).cast("int")).alias("matched"),
        F.col("event_type").alias("type"),
        F.concat(F.lit("raw"), (F.col("user_id") % 5).cast("string")).alias("raw"),
        ((e % 16) / 16).alias("confidence"),
        e.alias("seq"),
    )


@query(
    "review_status",
    """SELECT f.vendor_id, f.field, f.value, coalesce(found, CASE WHEN value = 0 THEN 0 ELSE 1 END) AS confidence,
       CASE WHEN f.field = 'minCharges' AND f.vendor_id % 5 = 0 THEN 'ambiguous' WHEN value = 0 THEN 'missing' WHEN coalesce(found, 1) < 0.75 THEN 'uncertain'
            WHEN value < CASE f.field WHEN 'fuel' THEN 10 WHEN 'docketCharges' THEN 50 ELSE 100 END OR value > CASE f.field WHEN 'fuel' THEN 50 WHEN 'docketCharges' THEN 500 ELSE 2000 END THEN 'suspicious' ELSE 'ok' END AS status
       FROM field_rows f LEFT JOIN (SELECT vendor_id, matched, max(confidence) AS found FROM audit WHERE confidence < 0.9 GROUP BY ALL) a ON a.vendor_id = f.vendor_id AND a.matched = f.field""",
    docs=DOCS, field_rows=FIELD_ROWS, audit=AUDIT,
)
def review_status(spark, d):
    rows = docs(spark, d)
    item = lambda f: F.struct(F.lit(f).alias("field"), F.coalesce(f, F.lit(0.0)).alias("value"))
    fields = rows.select("vendor_id", F.explode(F.array(*map(item, ("fuel", "docketCharges", "minCharges")))).alias("x")).select("vendor_id", "x.*")
    ambiguous = rows.where("vendor_id % 5 = 0").select("vendor_id", F.lit("minCharges").alias("field"))
    return op.review(fields, _audit(spark, d).where("confidence < 0.9"), ambiguous)


@query("audit_dedupe", "SELECT type, raw, matched, min(seq) AS seq, arg_min(confidence, seq) AS confidence FROM audit GROUP BY type, raw, matched", audit=AUDIT)
def audit_dedupe(spark, d):
    return op.dedupe_audit(_audit(spark, d)).select("type", "raw", "matched", "seq", "confidence")


RAW_META = """SELECT s_suppkey AS vendor_id, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS companyName, 'n' || s_suppkey AS name, CASE WHEN s_suppkey % 5 = 0 THEN 'FTL' ELSE '' END AS transportMode, CASE WHEN s_suppkey % 7 = 0 THEN 'Air' END AS serviceType,
    CASE WHEN s_suppkey % 3 = 0 THEN 'C' || s_suppkey END AS customerID, CASE WHEN s_suppkey % 2 = 0 THEN '29 abcde 1234 f1z5' ELSE '18% as applicable' END AS gst, '98' AS phone, CASE WHEN s_suppkey % 4 = 0 THEN 0.0::DOUBLE ELSE 3.5::DOUBLE END AS rating, CASE WHEN s_suppkey % 6 = 0 THEN TRUE END AS verified FROM supplier"""


@query(
    "meta_encode",
    """SELECT vendor_id, coalesce(companyName, name) AS companyName, coalesce(nullif(transportMode, ''), serviceType, 'LTL') AS transportMode, CASE WHEN customerID IS NULL THEN 'regular' ELSE 'temporary' END AS transporterType,
       CASE WHEN starts_with(gst, '29') THEN '29ABCDE1234F1Z5' END AS gstNo, phone AS contactPhone, coalesce(nullif(rating, 0), 4.0) AS rating, coalesce(verified, FALSE) AS isVerified, 'pending_review' AS approvalStatus FROM raw_meta""",
    raw_meta=RAW_META,
)
def meta_encode(spark, d):
    k = F.col("s_suppkey")
    raw = table(spark, d, "supplier").select(
        k.alias("vendor_id"),
        F.when(k % 2 == 0, F.col("s_name")).alias("companyName"),
        F.concat(F.lit("n"), k).alias("name"),
        F.when(k % 5 == 0, "FTL").otherwise("").alias("transportMode"),
        F.when(k % 7 == 0, "Air").alias("serviceType"),
        F.when(k % 3 == 0, F.concat(F.lit("C"), k)).alias("customerID"),
        F.when(k % 2 == 0, "29 abcde 1234 f1z5").otherwise("18% as applicable").alias("gst"),
        F.lit("98").alias("phone"),
        F.when(k % 4 == 0, 0.0).otherwise(3.5).alias("rating"),
        F.when(k % 6 == 0, True).alias("verified"),
    )
    return op.encode_meta(raw)


@query("review_flags", "SELECT vendor_id, isVerified, 'pending_review' AS approvalStatus, TRUE AS needsManualReview, round(round(company * 0.3 + charges * 0.25 + o * 0.25 + z * 0.15, 4), 2) AS completeness FROM shares JOIN docs USING (vendor_id)", docs=DOCS, shares=SHARES)
def review_flags(spark, d):
    return op.review_flags(docs(spark, d).withColumn("approvalStatus", F.lit(None).cast("string")))


@query(
    "name_fallback",
    f"SELECT vendor_id, CASE WHEN companyName <> '' THEN companyName ELSE {cq.TITLE.format(c=chr(39) + 'fast freight ' + chr(39) + ' || vendor_id')} END AS name FROM docs",
    docs=DOCS,
)
def name_fallback(spark, d):
    folder = F.concat(F.lit("fast_freight-"), F.col("vendor_id"))
    return docs(spark, d).select("vendor_id", op.name_or_folder(F.col("companyName"), F.lit(None).cast("string"), folder).alias("name"))


@query(
    "patch_field",
    "SELECT d.vendor_id, coalesce(n.value, companyName) AS companyName, coalesce(TRY_CAST(f.value AS DOUBLE), fuel) AS fuel FROM docs d LEFT JOIN last n ON n.vendor_id = d.vendor_id AND n.field = 'companyName' LEFT JOIN last f ON f.vendor_id = d.vendor_id AND f.field = 'fuel'",
    docs=DOCS, patches="SELECT event_id % 200 AS vendor_id, CASE WHEN event_id % 3 = 0 THEN 'companyName' ELSE 'fuel' END AS field, CASE WHEN event_id % 7 = 0 THEN 'x' || event_id ELSE CAST(event_id % 40 AS VARCHAR) END AS value, event_id AS seq FROM events",
    last="SELECT vendor_id, field, arg_max(value, seq) AS value FROM patches GROUP BY ALL",
)
def patch_field(spark, d):
    e = F.col("event_id")
    patches = table(spark, d, "events").select(
        (e % 200).alias("vendor_id"), F.when(e % 3 == 0, "companyName").otherwise("fuel").alias("field"), F.when(e % 7 == 0, F.concat(F.lit("x"), e)).otherwise((e % 40).cast("string")).alias("value"), e.alias("seq")
    )
    return op.patch(docs(spark, d), patches).select("vendor_id", "companyName", "fuel")


@query("document_ids", "SELECT s_suppkey, 'TRP-' || lpad(CAST(row_number() OVER (ORDER BY s_suppkey) AS VARCHAR), 5, '0') AS doc_code FROM supplier")
def document_ids(spark, d):
    return op.document_ids(table(spark, d, "supplier").select("s_suppkey"), "s_suppkey")


@query("document_stamps", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM events")
def document_stamps(spark, d):
    return op.stamp(table(spark, d, "events"), F.col("ts")).select("event_id", F.col("generatedAt").alias("stamp"))


@query("json_round_trip", "SELECT vendor_id, companyName, fuel, oda_type, origins FROM docs", docs=DOCS)
def json_round_trip(spark, d):
    rows = docs(spark, d)
    text = rows.select(F.to_json(F.struct(*rows.columns)).alias("document"))
    return text.select(F.from_json("document", rows.schema).alias("x")).select("x.vendor_id", "x.companyName", "x.fuel", "x.oda_type", "x.origins")


NAMES = "SELECT p_partkey, p_name || CASE p_partkey % 8 WHEN 0 THEN ' rate card.xlsx' WHEN 1 THEN '_fuel-surcharge.pdf' WHEN 2 THEN ' pincode list.csv' WHEN 3 THEN '.png' WHEN 4 THEN ' company profile.docx' WHEN 5 THEN ' vendor gst address.pdf' WHEN 6 THEN ' docket fees.xlsx' ELSE '.xlsx' END AS name FROM part"


def _names(spark, d):
    k = F.col("p_partkey") % 8
    tails = [" rate card.xlsx", "_fuel-surcharge.pdf", " pincode list.csv", ".png", " company profile.docx", " vendor gst address.pdf", " docket fees.xlsx", ".xlsx"]
    return spread(table(spark, d, "part").select("p_partkey", "p_name")).select("p_partkey", F.concat("p_name", F.element_at(F.array(*map(F.lit, tails)), (k + 1).cast("int"))).alias("name"))


_STEM = "replace(replace(replace(lower(regexp_replace(name, '\\.[^.]*$', '')), '-', ' '), '_', ' '), '.', ' ')"
_KEYS = {k: "[" + ", ".join(f"'{w.replace('_', ' ')}'" for w in v) + "]" for k, v in op.FILE_WORDS.items()}
_LOOSE = "(len(list_filter({keys}, lambda k: contains(stem, k))) * 2 + list_sum(list_transform({keys}, lambda k: len(list_filter(words, lambda w: contains(w, k) OR contains(k, w))))))"
STEMS = f"SELECT p_partkey, name, stem, string_split_regex(stem, '\\s+') AS all_words, list_distinct(list_filter(string_split_regex(stem, '\\s+'), lambda w: w <> '')) AS words FROM (SELECT *, {_STEM} AS stem FROM names)"
_RE = lambda p: p.replace("(?i)", "")


@query(
    "classify_filename",
    f"""SELECT p_partkey, CASE WHEN regexp_matches(stem, '{_RE(op.PROPOSAL)}') THEN 'company_details'
        WHEN regexp_matches(stem, 'pincode|serviceable|serviceability|coverage|network|{_RE(op.RATE_CARD)}') OR list_contains(all_words, 'rate') OR list_contains(all_words, 'rates') THEN 'zone_data'
        WHEN greatest(a, b, c) = 0 THEN CASE WHEN regexp_matches(name, '\\.(png|jpg|jpeg)$') THEN 'company_details' ELSE 'charges' END
        WHEN a = greatest(a, b, c) THEN 'company_details' WHEN b = greatest(a, b, c) THEN 'charges' ELSE 'zone_data' END AS category
        FROM (SELECT *, {_LOOSE.format(keys=_KEYS['company_details'])} AS a, {_LOOSE.format(keys=_KEYS['charges'])} AS b, {_LOOSE.format(keys=_KEYS['zone_data'])} AS c FROM stems)""",
    names=NAMES, stems=STEMS,
)
def classify_filename(spark, d):
    return _names(spark, d).select("p_partkey", op.classify_filename(F.col("name")).alias("category"))


_HITS = "len(list_filter({keys}, lambda k: contains(stem, k)))"


@query(
    "classify_filename_confidence",
    f"SELECT p_partkey, CAST(least(95, 40 + 20 * greatest({', '.join(_HITS.format(keys=k) for k in _KEYS.values())})) AS INT) AS confidence FROM stems",
    names=NAMES, stems=STEMS,
)
def classify_filename_confidence(spark, d):
    return _names(spark, d).select("p_partkey", op.filename_confidence(F.col("name")).alias("confidence"))


@query("filename_hint", "SELECT p_partkey, CASE " + " ".join(f"WHEN regexp_matches(lower(name), '{'|'.join(w)}') THEN '{k}'" for k, w in op.HINT_WORDS.items()) + " ELSE 'UNKNOWN' END AS hint FROM names", names=NAMES)
def filename_hint(spark, d):
    return _names(spark, d).select("p_partkey", op.filename_hint(F.col("name")).alias("hint"))


@query(
    "catalog_summary",
    f"""SELECT s.vendor_id, companyName, quality, {BAND} AS band, active_zones, coalesce(a, 0) AS company_details, coalesce(b, 0) AS charges, coalesce(c, 0) AS zone_data FROM scored s LEFT JOIN
       (SELECT p_partkey % 100 AS vendor_id, count(*) FILTER (WHERE p_size % 3 = 0) AS a, count(*) FILTER (WHERE p_size % 3 = 1) AS b, count(*) FILTER (WHERE p_size % 3 = 2) AS c FROM part GROUP BY ALL) f ON f.vendor_id = s.vendor_id""",
    **VIEWS,
)
def catalog_summary(spark, d):
    kind = F.element_at(F.array(*map(F.lit, op.FILE_WORDS)), (F.col("p_size") % 3 + 1).cast("int"))
    files = table(spark, d, "part").select((F.col("p_partkey") % 100).alias("vendor_id"), kind.alias("category"))
    return op.catalog(op.quality_score(docs(spark, d)), files)


@query("safe_names", "SELECT p_partkey, replace(replace(lower(name), ' ', '_'), '/', '_') AS file FROM names", names=NAMES)
def safe_names(spark, d):
    return _names(spark, d).select("p_partkey", op.safe_name(F.col("name")).alias("file"))


@query(
    "legacy_migrate",
    "SELECT vendor_id, zone, CASE mode WHEN 'FULL_ZONE' THEN 'FULL_ZONE' ELSE 'ONLY_SERVED' END AS mode, served_count, coalesce(oda, 0) AS oda_count FROM service LEFT JOIN (SELECT vendor_id, effective AS zone, count(*) AS oda FROM effective WHERE oda GROUP BY ALL) USING (vendor_id, zone) WHERE mode <> 'NOT_SERVED'",
    effective=cq.EFFECTIVE, service=cq.SERVICE,
)
def legacy_migrate(spark, d):
    """Old documents keep remote pins in a block apart; it is overlaid on the zones that exist, and old mode names go."""
    pins = cov.effective_zones(claims(spark, d), master(spark, d))
    service = cov.build_serviceability(claims(spark, d), master(spark, d)).where("mode <> 'NOT_SERVED'")
    old = service.withColumn("mode", F.when(F.col("mode") == "ONLY_SERVED", "INCLUDING").otherwise(F.col("mode")))
    block = pins.where("oda").groupBy("vendor_id", F.col("effective").alias("zone")).agg(F.count("*").alias("oda_count"))
    return old.join(block, ["vendor_id", "zone"], "left").select("vendor_id", "zone", op.normalize_mode(F.col("mode")).alias("mode"), "served_count", F.coalesce("oda_count", F.lit(0)).cast("long").alias("oda_count"))


