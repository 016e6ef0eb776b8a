"""Queries of the rate family and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanegrid.operators import rates as op
from lanegrid.plans.fixtures import claims, master, rates, sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None, **views: str):
    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = sql(oracle, **views)
        return f

    return register


PICK = "SELECT vendor_id, origin, dest, round2(CASE WHEN count(*) = 1 OR max(rate) - min(rate) {test} THEN max(rate) ELSE avg(rate) END) AS rate FROM rates GROUP BY ALL"
MATRIX = PICK.format(test="<= 5").replace("GROUP BY ALL", "GROUP BY vendor_id, origin, dest")
#: A matrix with gaps, for the operators that fill them.
SPARSE = "SELECT vendor_id, origin, dest, rate FROM matrix WHERE origin NOT IN ('N2', 'E2', 'X3') AND dest NOT IN ('S4', 'W2', 'X1') AND origin <> 'W3' AND dest <> 'W3'"
HAV = "2 * 6371.0 * asin(sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2)))"
DIST = f"SELECT a.zone AS a, b.zone AS b, {HAV.format(a='a', b='b')} AS km FROM coords a CROSS JOIN coords b"
DAMPED = "CASE WHEN {near} > 1 THEN least(2.5, greatest(0.5, 0.65 + 0.35 * {far} / {near})) ELSE 1 END"


def _matrix(spark, d):
    return op.pick_rate(rates(spark, d), 5.0, inclusive=True)


def _sparse(spark, d):
    m = _matrix(spark, d)
    return m.where(~F.col("origin").isin("N2", "E2", "X3", "W3") & ~F.col("dest").isin("S4", "W2", "X1", "W3"))


@query("rate_conflict_3", PICK.format(test="< 3").replace("GROUP BY ALL", "GROUP BY vendor_id, origin, dest"))
def rate_conflict_3(spark, d):
    return op.pick_rate(rates(spark, d), 3.0, inclusive=False)


@query("rate_conflict_5", MATRIX)
def rate_conflict_5(spark, d):
    return _matrix(spark, d)


@query("rate_median", "SELECT vendor_id, origin, dest, round2(median(rate)) AS rate FROM rates GROUP BY vendor_id, origin, dest")
def rate_median(spark, d):
    return op.median_rate(rates(spark, d))


@query(
    "rate_mode",
    """SELECT vendor_id, round2(min(rate)) AS min_rate, round2(max(rate)) AS max_rate, round2(avg(rate)) AS avg_rate,
       CASE WHEN min(rate) > 60 THEN 'air' WHEN min(rate) > 30 THEN 'effective' WHEN max(rate) > 200 THEN 'mixed' ELSE 'road' END AS mode FROM scaled GROUP BY vendor_id""",
    scaled="SELECT vendor_id, rate * CASE vendor_id WHEN 1 THEN 7 WHEN 2 THEN 13 WHEN 3 THEN 11 ELSE 1 END - CASE vendor_id WHEN 3 THEN 40 ELSE 0 END AS rate FROM rates",
)
def rate_mode(spark, d):
    v = F.col("vendor_id")
    factor = F.when(v == 1, 7).when(v == 2, 13).when(v == 3, 11).otherwise(1)
    return op.rate_mode(rates(spark, d).withColumn("rate", F.col("rate") * factor - F.when(v == 3, 40).otherwise(0)))


FLAT = "SELECT vendor_id, origin, dest, CASE WHEN dest IN ('C1', 'S2') THEN 9.5 ELSE rate END AS rate FROM matrix"


def _flat(spark, d):
    return _matrix(spark, d).withColumn("rate", F.when(F.col("dest").isin("C1", "S2"), 9.5).otherwise(F.col("rate")))


@query("matrix_collapsed", "SELECT vendor_id, dest, count(*) AS origins, max(rate) AS rate FROM flat_matrix WHERE rate > 0 GROUP BY vendor_id, dest HAVING count(*) >= 3 AND count(DISTINCT rate) = 1", matrix=MATRIX, flat_matrix=FLAT)
def matrix_collapsed(spark, d):
    return op.collapsed(_flat(spark, d))


@query(
    "matrix_misaligned",
    "SELECT m.vendor_id, m.origin, count(*) AS same, max(o.rate) AS rate FROM rounded m JOIN rounded o ON o.vendor_id = m.vendor_id AND o.origin = m.origin AND o.dest = o.origin WHERE m.dest <> m.origin AND m.rate = o.rate GROUP BY m.vendor_id, m.origin HAVING count(*) >= 2",
    matrix=MATRIX, rounded="SELECT vendor_id, origin, dest, floor(rate / 4) * 4 AS rate FROM matrix",
)
def matrix_misaligned(spark, d):
    return op.misaligned(_matrix(spark, d).withColumn("rate", (F.floor(F.col("rate") / 4) * 4).cast("double")))


@query(
    "drop_air_rows",
    """SELECT vendor_id, origin, dest, rate FROM (SELECT *, min(CASE WHEN air THEN 1 ELSE 0 END) OVER (PARTITION BY vendor_id) AS every FROM
       (SELECT *, min(rate) OVER (PARTITION BY vendor_id, origin) > 60 AS air FROM airy)) WHERE NOT air OR every = 1""",
    matrix=MATRIX, airy="SELECT vendor_id, origin, dest, CASE WHEN vendor_id = 3 OR origin IN ('N1', 'S1') THEN rate + 60 ELSE rate END AS rate FROM matrix",
)
def drop_air_rows(spark, d):
    air = (F.col("vendor_id") == 3) | F.col("origin").isin("N1", "S1")
    return op.drop_air(_matrix(spark, d).withColumn("rate", F.when(air, F.col("rate") + 60).otherwise(F.col("rate"))))


@query(
    "merge_matrix",
    """SELECT vendor_id, piece, origin, dest, rate FROM (SELECT *, dense_rank() OVER (PARTITION BY vendor_id ORDER BY n DESC, piece) AS r FROM
       (SELECT *, count(*) OVER (PARTITION BY vendor_id, piece) AS n FROM pieces)) WHERE r = 1""",
    pieces="SELECT vendor_id, CAST(seq % 3 AS INT) AS piece, origin, dest, max(rate) AS rate FROM rates GROUP BY ALL",
)
def merge_matrix(spark, d):
    pieces = rates(spark, d).groupBy("vendor_id", (F.col("seq") % 3).cast("int").alias("piece"), "origin", "dest").agg(F.max("rate").alias("rate"))
    return op.fullest_matrix(pieces)


RAW = "SELECT vendor_id, CASE WHEN seq % 50 = 0 THEN 'Q9' ELSE origin END AS origin, dest, CASE seq % 40 WHEN 0 THEN 0 WHEN 1 THEN 1500 ELSE rate END AS rate, seq FROM rates"


def _raw(spark, d):
    seq = F.col("seq")
    return rates(spark, d).select(
        "vendor_id", F.when(seq % 50 == 0, "Q9").otherwise(F.col("origin")).alias("origin"), "dest", F.when(seq % 40 == 0, 0.0).when(seq % 40 == 1, 1500.0).otherwise(F.col("rate")).alias("rate"), "seq"
    )


@query("canonical_matrix", "SELECT vendor_id, origin, dest, arg_max(rate, (seq, rate)) AS rate, arg_max(rate, (seq, rate)) > 1000 AS high FROM raw WHERE rate > 0 AND origin <> 'Q9' GROUP BY vendor_id, origin, dest", raw=RAW)
def canonical_matrix(spark, d):
    return op.canonical_matrix(_raw(spark, d))


@query("matrix_issues", "SELECT vendor_id, issue, count(*) AS n FROM (SELECT vendor_id, CASE WHEN origin = 'Q9' THEN 'unknown_origin' WHEN rate <= 0 THEN 'non_positive' WHEN rate > 1000 THEN 'very_high' END AS issue FROM raw) WHERE issue IS NOT NULL GROUP BY ALL", raw=RAW)
def matrix_issues(spark, d):
    return op.matrix_issues(_raw(spark, d)).groupBy("vendor_id", "issue").agg(F.count("*").alias("n"))


@query("symmetric_fill", "SELECT vendor_id, origin, dest, rate, FALSE AS estimated FROM sparse UNION ALL SELECT vendor_id, dest, origin, rate, TRUE FROM sparse s WHERE NOT EXISTS (SELECT 1 FROM sparse t WHERE t.vendor_id = s.vendor_id AND t.origin = s.dest AND t.dest = s.origin)", matrix=MATRIX, sparse=SPARSE)
def symmetric_fill(spark, d):
    return op.symmetric_fill(_sparse(spark, d))


@query("haversine", "SELECT m.pincode, round(" + HAV.format(a="o", b="c") + ", 3) AS km FROM master m JOIN coords c ON c.zone = m.zone JOIN coords o ON o.zone = 'N1'")
def haversine(spark, d):
    km = op.zone_distances(spark).where("a = 'N1'")
    return master(spark, d).join(km, F.col("zone") == F.col("b")).select("pincode", F.round("km", 3).alias("km"))


NEAREST = """SELECT vendor_id, missing, known, km, place FROM (SELECT v.vendor_id, c.zone AS missing, k.origin AS known, d.km, row_number() OVER (PARTITION BY v.vendor_id, c.zone ORDER BY d.km, k.origin) AS place
    FROM (SELECT DISTINCT vendor_id FROM sparse) v CROSS JOIN coords c JOIN (SELECT DISTINCT vendor_id, origin FROM sparse) k ON k.vendor_id = v.vendor_id JOIN dist d ON d.a = c.zone AND d.b = k.origin
    WHERE NOT EXISTS (SELECT 1 FROM sparse s WHERE s.vendor_id = v.vendor_id AND s.origin = c.zone)) WHERE place <= 3"""


@query("nearest_origins", "SELECT vendor_id, missing, known, round(km, 3) AS km, CAST(place AS INT) AS place FROM nearest", matrix=MATRIX, sparse=SPARSE, dist=DIST, nearest=NEAREST)
def nearest_origins(spark, d):
    return op.nearest_origins(_sparse(spark, d)).withColumn("km", F.round("km", 3))


@query(
    "fill_missing_origins",
    f"""SELECT n.vendor_id, n.missing AS origin, s.dest, round2(sum(s.rate * {DAMPED.format(far='m.km', near='k.km')} / (n.km + 1)) / sum(1 / (n.km + 1))) AS rate, TRUE AS estimated
        FROM nearest n JOIN sparse s ON s.vendor_id = n.vendor_id AND s.origin = n.known JOIN dist m ON m.a = n.missing AND m.b = s.dest JOIN dist k ON k.a = n.known AND k.b = s.dest GROUP BY n.vendor_id, n.missing, s.dest""",
    matrix=MATRIX, sparse=SPARSE, dist=DIST, nearest=NEAREST,
)
def fill_missing_origins(spark, d):
    return op.fill_missing_origins(_sparse(spark, d))


GAPS = """SELECT vendor_id, origin, dest, round2(CASE WHEN ref_km > 0 THEN greatest(lo, least(CASE WHEN starts_with(dest, 'X') THEN greatest(hi * 2, top) ELSE hi END, ref_rate * (0.7 + 0.3 * km / ref_km))) ELSE ref_rate END) AS rate FROM (
    SELECT b.vendor_id, b.origin, t.b AS dest, lo, hi, top, t.km, r.km AS ref_km, s.rate AS ref_rate, row_number() OVER (PARTITION BY b.vendor_id, b.origin, t.b ORDER BY abs(r.km - t.km), s.dest) AS place
    FROM (SELECT vendor_id, origin, coalesce(min(rate) FILTER (WHERE NOT starts_with(dest, 'X')), min(rate)) AS lo, coalesce(max(rate) FILTER (WHERE NOT starts_with(dest, 'X')), max(rate)) AS hi, max(rate) AS top FROM {m} GROUP BY ALL) b
    JOIN dist t ON t.a = b.origin JOIN {m} s ON s.vendor_id = b.vendor_id AND s.origin = b.origin JOIN dist r ON r.a = b.origin AND r.b = s.dest
    WHERE NOT EXISTS (SELECT 1 FROM {m} x WHERE x.vendor_id = b.vendor_id AND x.origin = b.origin AND x.dest = t.b) AND (starts_with(t.b, 'X') OR NOT starts_with(s.dest, 'X'))) WHERE place = 1"""


@query("fill_dest_gaps", "SELECT *, TRUE AS estimated FROM gaps", matrix=MATRIX, sparse=SPARSE, dist=DIST, gaps=GAPS.format(m="sparse"))
def fill_dest_gaps(spark, d):
    return op.fill_dest_gaps(_sparse(spark, d))


@query(
    "extrapolate_matrix",
    f"""SELECT w.vendor_id, f.a AS origin, w.dest, CASE WHEN b.km < 1 THEN round2(rate) ELSE round2(greatest(lo * 0.8, least(hi * 2.5, round2(rate * {DAMPED.format(far='f.km', near='b.km')})))) END AS rate, TRUE AS estimated
        FROM whole w JOIN dist b ON b.a = w.origin AND b.b = w.dest JOIN dist f ON f.b = w.dest AND f.a <> w.origin
        JOIN (SELECT vendor_id, min(rate) AS lo, max(rate) AS hi FROM whole GROUP BY vendor_id) l ON l.vendor_id = w.vendor_id""",
    matrix=MATRIX, sparse=SPARSE, dist=DIST, one="SELECT s.* FROM sparse s JOIN (SELECT vendor_id, min(origin) AS origin FROM sparse GROUP BY vendor_id) USING (vendor_id, origin)",
    gaps=GAPS.format(m="one"), whole="SELECT vendor_id, origin, dest, rate FROM one UNION ALL SELECT * FROM gaps",
)
def extrapolate_matrix(spark, d):
    m = _sparse(spark, d)
    return op.extrapolate(m, m.groupBy("vendor_id").agg(F.min("origin").alias("origin")))


_EST = ", ".join(f"('{z}', {a}::DOUBLE, {b}::DOUBLE, {w}::DOUBLE)" for z, (a, b, w) in op.ESTIMATE.items())


@query(
    "estimate_rate",
    f"""SELECT l.vendor_id, l.origin, l.dest, coalesce(round(8.0 * CASE WHEN l.origin = l.dest THEN 1 ELSE 1 + {HAV.format(a='a', b='b')} / 500 END * (a.w + b.w) / 2, 1), 16.0) AS rate, TRUE AS estimated
        FROM (SELECT DISTINCT vendor_id, origin, dest FROM rates) l LEFT JOIN est a ON a.zone = l.origin LEFT JOIN est b ON b.zone = l.dest""",
    est=f"SELECT * FROM (VALUES {_EST}) t(zone, lat, lon, w)",
)
def estimate_rate(spark, d):
    return op.estimate(rates(spark, d).select("vendor_id", "origin", "dest").distinct())


@query(
    "lane_quote",
    """SELECT l.*, a.zone AS origin, b.zone AS dest, CASE WHEN a.zone IS NULL OR b.zone IS NULL THEN 'unknown_zone' WHEN rate IS NULL THEN 'no_rate' ELSE 'ok' END AS status,
       round2(rate * weight) AS base, round2(rate * weight * 0.3) AS fuel, round2(rate * weight * 1.3 * 0.18) AS gst, round2(rate * weight * 1.3 * 1.18) AS total
       FROM lanes l LEFT JOIN master a ON a.pincode = from_pin LEFT JOIN master b ON b.pincode = to_pin LEFT JOIN matrix m ON m.vendor_id = l.vendor_id AND m.origin = a.zone AND m.dest = b.zone""",
    matrix=MATRIX,
    lanes="SELECT vendor_id, pincode AS from_pin, CAST(CASE WHEN pincode % 10 = 9 THEN pincode - 8 ELSE pincode + 1 END AS INT) AS to_pin, CAST(8 * (1 + pincode % 5) AS DOUBLE) AS weight FROM (SELECT DISTINCT vendor_id, pincode FROM claims)",
)
def lane_quote(spark, d):
    pin = F.col("pincode")
    lanes = claims(spark, d).select("vendor_id", "pincode").distinct()
    lanes = lanes.select("vendor_id", pin.alias("from_pin"), F.when(pin % 10 == 9, pin - 8).otherwise(pin + 1).alias("to_pin"), (8.0 * (1 + pin % 5)).alias("weight"))
    return op.quotes(lanes, _matrix(spark, d), master(spark, d))


@query(
    "missing_lane_pairs",
    """SELECT o.vendor_id, o.zone AS origin, t.zone AS dest FROM active o JOIN active t ON t.vendor_id = o.vendor_id
       WHERE EXISTS (SELECT 1 FROM sparse s WHERE s.vendor_id = o.vendor_id AND s.origin = o.zone) AND NOT EXISTS (SELECT 1 FROM sparse s WHERE s.vendor_id = o.vendor_id AND s.origin = o.zone AND s.dest = t.zone)""",
    matrix=MATRIX, sparse=SPARSE, active="SELECT DISTINCT vendor_id, claimed_zone AS zone FROM claims",
)
def missing_lane_pairs(spark, d):
    return op.missing_lanes(_sparse(spark, d), claims(spark, d).select("vendor_id", F.col("claimed_zone").alias("zone")).distinct())
