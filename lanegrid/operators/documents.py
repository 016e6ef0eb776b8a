"""Vendor documents: scoring, validation, differences, review, summaries, migration."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanegrid.functions.charges import gst_number, let
from lanegrid.plans import dims

# Fixed values ---------------------------------------------------------------------------------
META_POINTS = {"companyName": 8, "transportMode": 4, "gstNo": 5, "contactPhone": 3, "contactEmail": 3, "rating": 3, "isVerified": 2, "address": 2}
MANUAL_FIELDS = {
    "companyName": False, "gstNo": False, "contactPhone": False, "contactEmail": False, "address": False, "city": False, "state": False, "customerID": True,
}
REVIEW_RANGES = {"docketCharges": (50, 500), "fuel": (10, 50), "minCharges": (100, 2000), "divisor": (2000, 8000), "gst": (5, 28), "daccCharges": (50, 1000), "greenTax": (0, 200)}
FILE_WORDS = {
    "company_details": ["company", "vendor", "transporter", "profile", "info", "details", "contact", "gst", "pan", "cin", "registration", "address", "about", "overview", "kyc", "onboard", "proposal", "agreement", "contract", "letter", "quotation", "quote", "certificate", "incorporation", "license", "approval", "kyc"],
    "charges": ["charge", "charges", "price", "pricing", "tariff", "fuel", "docket", "oda", "rov", "insurance", "handling", "surcharge", "fee", "fees", "cost", "invoice", "billing"],
    "zone_data": ["zone", "zones", "pincode", "pincodes", "serviceability", "service", "coverage", "matrix", "area", "delivery", "served", "network", "lane", "lanes", "route", "region", "reach", "rate_card", "rate_sheet", "cade_rate", "out_card", "rate_book", "ratebook", "ratecard", "ratesheet"],
}
HINT_WORDS = {
    "ZONE_MATRIX": ["rate", "matrix", "zone", "tariff", "price"],
    "PINCODE_LIST": ["pincode", "serviceable", "coverage", "network", "area"],
    "CHARGES": ["charge", "fee", "surcharge", "oda", "misc"],
    "COMPANY_INFO": ["company", "vendor", "profile", "gst", "pan", "kyc", "info"],
}
PROPOSAL = r"(?i)(proposal|agreement|contract|quotat|quote|letter\s*of|loi\b|mou\b|nda\b|onboard|kyc|profile)"
RATE_CARD = r"(?i)(rate\s*card|rate\s*sheet|cade\s*rate|out\s*card|rate\s*book|ratebook|ratecard|ratesheet)"
EXTENSIONS = ["xlsx", "xls", "csv", "tsv", "pdf", "docx", "pptx", "json", "png", "jpg", "jpeg"]
# ----------------------------------------------------------------------------------------------


def filled(c: Column, kind: str) -> Column:
    if kind == "string":
        return c.isNotNull() & (c != "")
    if kind == "boolean":
        return F.coalesce(c, F.lit(False))
    return c.isNotNull() & (c != 0)


def quality_score(docs: DataFrame, fixed_scoring: bool = False) -> DataFrame:
    """Adds ``quality`` of 0..100: filled fields, origins, active zones and five charges.

    A remote delivery charge per kg with a minimum earns no points, as in the source's rule;
    ``fixed_scoring`` counts it.
    """
    kinds = dict(docs.dtypes)
    meta = sum((F.when(filled(F.col(f), kinds[f]), p).otherwise(0) for f, p in META_POINTS.items()), F.lit(0))
    oda = (F.coalesce("oda_v", F.lit(0.0)) != 0) | (F.coalesce("oda_f", F.lit(0.0)) != 0) | F.coalesce(F.col("oda_type").isin("per_shipment", "weight_band", "distance_weight_matrix"), F.lit(False))
    if fixed_scoring:
        oda = oda | F.coalesce(F.col("oda_type") == "per_kg_minimum", F.lit(False))
    rov = (F.coalesce("rov_v", F.lit(0.0)) != 0) | (F.coalesce("rov_f", F.lit(0.0)) != 0)
    charges = sum((F.when(F.coalesce(c, F.lit(False)), 3).otherwise(0) for c in (F.col("docketCharges") > 0, F.col("fuel") > 0, rov, oda, F.col("minCharges") > 0)), F.lit(0))
    score = meta + F.least(F.lit(30), F.col("origins") * 2) + F.least(F.lit(25), F.col("active_zones") * 2) + charges
    return docs.withColumn("quality", F.round(F.least(score, F.lit(100)).cast("double"), 1))


def quality_band(score: Column) -> Column:
    return F.when(score >= 75, "green").when(score >= 50, "yellow").otherwise("red")


def normalize_mode(mode: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in dims.MODES.items() for x in pair])
    return F.coalesce(table[mode], F.lit("NOT_SERVED"))


def _rule(rows: DataFrame, severity: str, rule: str, detail: Column) -> DataFrame:
    return rows.select("vendor_id", F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))


def _hits(rows: DataFrame, rules: list[tuple[Column, str, str, Column]]) -> DataFrame:
    """(vendor_id, severity, rule, detail): a row for every rule (condition, severity, name, detail) that holds, in one pass over ``rows``."""
    hit = [F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))) for when, severity, rule, detail in rules]
    return rows.select("vendor_id", F.inline(F.filter(F.array(*hit), lambda x: x.isNotNull())))


def validate_structure(docs: DataFrame, matrix: DataFrame, service: DataFrame) -> DataFrame:
    """Structural errors of documents (vendor_id, severity, rule, detail); a valid document has none."""
    c = F.col
    version = c("version")
    cell = F.concat_ws(">", "origin", "dest")
    rules = [
        _hits(docs, [(~version.startswith("2.") & ~version.startswith("4."), "error", "version", version), (~filled(c("companyName"), "string"), "error", "name_missing", F.lit(""))]),
        _rule(docs.join(matrix.select("vendor_id").distinct(), "vendor_id", "left_anti"), "error", "no_rates", F.lit("")),
        _rule(matrix.where(~c("origin").isin(dims.ZONES)).select("vendor_id", "origin").distinct(), "error", "unknown_origin", c("origin")),
        _hits(matrix, [(~c("dest").isin(dims.ZONES), "error", "unknown_dest", cell), (c("rate").isNull() | (c("rate") < 0), "error", "invalid_rate", cell)]),
        _hits(service, [(~c("zone").isin(dims.ZONES), "error", "unknown_zone", c("zone")), (c("zone").isin(dims.ZONES) & ~c("mode").isin(list(dims.MODES)), "error", "invalid_mode", c("zone"))]),
    ]
    return reduce(DataFrame.unionByName, rules)


def validate_full(docs: DataFrame, matrix: DataFrame, service: DataFrame) -> DataFrame:
    """Sanity rules: rates, charges, serviceability, origins without rates (over a fifth is an error), company data."""
    c = F.col
    cell = F.concat_ws(">", "origin", "dest")
    active = service.where("mode <> 'NOT_SERVED'").select("vendor_id", "zone").distinct()
    origins = matrix.select("vendor_id", c("origin").alias("zone")).distinct()
    without = active.join(origins, ["vendor_id", "zone"], "left_anti")
    share = without.groupBy("vendor_id").agg(F.count("*").alias("n")).join(active.groupBy("vendor_id").agg(F.count("*").alias("all")), "vendor_id").withColumn("many", c("n") > 0.2 * c("all"))
    pairs = active.join(origins, ["vendor_id", "zone"]).withColumnRenamed("zone", "origin").join(active.withColumnRenamed("zone", "dest"), "vendor_id")
    rules = [
        _hits(matrix, [(c("rate") <= 0, "error", "non_positive", cell), (c("rate") > 500, "warning", "very_high", cell), ((c("rate") > 0) & (c("rate") < 1), "warning", "very_low", cell)]),
        _hits(
            docs,
            [
                (c("minCharges") > 5000, "warning", "min_charges", F.lit("")),
                (c("fuel") > 50, "warning", "fuel", F.lit("")),
                (F.expr("oda_type = 'per_kg_minimum' and coalesce(oda_v, 0) = 0 and coalesce(oda_f, 0) = 0"), "error", "oda_empty", F.lit("")),
                (~filled(c("companyName"), "string"), "warning", "no_name", F.lit("")),
                (~filled(c("gstNo"), "string"), "warning", "no_gst", F.lit("")),
                (~filled(c("contactPhone"), "string") & ~filled(c("contactEmail"), "string"), "warning", "no_contact", F.lit("")),
            ],
        ),
        _rule(docs.join(service.select("vendor_id").distinct(), "vendor_id", "left_anti"), "warning", "no_service", F.lit("")),
        _rule(service.select("vendor_id").distinct().join(active, "vendor_id", "left_anti"), "warning", "all_unserved", F.lit("")),
        _rule(share.where("many"), "error", "origins_without_rates", c("n")),
        _rule(without.join(share.where("not many"), "vendor_id"), "warning", "zone_without_rates", c("zone")),
        _rule(pairs.join(matrix.select("vendor_id", "origin", "dest"), ["vendor_id", "origin", "dest"], "left_anti"), "warning", "missing_lane", cell),
    ]
    return reduce(DataFrame.unionByName, rules)


def diff(a: dict[str, DataFrame], b: dict[str, DataFrame]) -> DataFrame:
    """Differences of two sets of documents (zones: zone, mode, served; matrix: origin, dest, rate; charges: field, value), matched by ``pair``."""

    def side(df, keys, value, n):
        return df.select("pair", F.concat_ws(">", *keys).alias("item"), F.col(value).cast("string").alias(n), *([F.col("rate").alias(f"_{n}")] if value == "rate" else []))

    def compare(kind, keys, value):
        both = side(a[kind], keys, value, "a").join(side(b[kind], keys, value, "b"), ["pair", "item"], "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
        delta = F.round(F.coalesce("_b", F.lit(0.0)) - F.coalesce("_a", F.lit(0.0)), 2) if value == "rate" else F.lit(None).cast("double")
        return both.select("pair", F.lit(f"{kind}.{value}").alias("part"), "item", "a", "b", delta.alias("delta"))

    parts = [compare("zones", ["zone"], "mode"), compare("zones", ["zone"], "served"), compare("matrix", ["origin", "dest"], "rate"), compare("charges", ["field"], "value")]
    return reduce(DataFrame.unionByName, parts)


def completeness(docs: DataFrame) -> DataFrame:
    """Adds ``completeness`` (0..0.95) and ``anomaly`` (share of three checks that are odd)."""
    share = lambda cols: sum((filled(F.col(c), dict(docs.dtypes)[c]).cast("int") for c in cols), F.lit(0)) / len(cols)
    company = share(["companyName", "gstNo", "contactPhone", "contactEmail", "address"])
    charges = share(["fuel", "docketCharges", "minCharges", "oda_type"])
    score = company * 0.3 + charges * 0.25 + (F.col("origins") > 0).cast("int") * 0.25 + (F.col("active_zones") > 0).cast("int") * 0.15
    odd = (F.coalesce("fuel", F.lit(0.0)) > 50).cast("int") + (F.coalesce("docketCharges", F.lit(0.0)) > 1000).cast("int") + (~filled(F.col("gstNo"), "string")).cast("int")
    return docs.withColumns({"completeness": F.round(score, 4), "anomaly": F.round(odd / 3, 4)})


def enhancement_potential(docs: DataFrame) -> DataFrame:
    """(vendor_id, completeness, likely, improvement, quality, potential)."""
    parts = [filled(F.col("companyName"), "string"), F.col("docketCharges").isNotNull(), F.col("origins") > 0, F.col("active_zones") > 0]
    share = sum((p.cast("int") for p in parts), F.lit(0)) / 4
    likely = F.array_compact(
        F.array(
            F.when(~filled(F.col("gstNo"), "string"), "gst_ml"),
            F.when(~filled(F.col("contactPhone"), "string"), "contact_ml"),
            F.when((F.col("origins") == 0) & F.col("oda_type").isNotNull(), "zone_rates_ml"),
            F.when(share < 0.8, "business_logic_ml"),
        )
    )
    rows = docs.select("vendor_id", share.alias("completeness"), likely.alias("likely")).withColumn("improvement", F.size("likely") * 15)
    potential = F.when(F.col("improvement") > 30, "High").when(F.col("improvement") > 15, "Medium").otherwise("Low")
    return rows.withColumns({"quality": F.least(F.col("completeness") * 100 + F.col("improvement"), F.lit(100.0)), "potential": potential})


def enhancement_summary(events: DataFrame) -> DataFrame:
    """Per kind of enhancement (events: types, before, after, confidence): count, mean confidence, effectiveness, success rate."""
    rows = events.withColumn("kind", F.explode("types")).withColumn("gain", F.col("after") - F.col("before"))
    return rows.groupBy("kind").agg(
        F.count("*").alias("n"),
        F.round(F.avg("confidence"), 4).alias("confidence"),
        F.round(F.avg(F.when(F.col("gain") > 0, F.col("gain"))) * 100, 2).alias("effectiveness"),
        F.round(F.avg((F.col("gain") > 0).cast("double")), 4).alias("success_rate"),
    )


def missing_fields(docs: DataFrame) -> DataFrame:
    gone = [F.when(~filled(F.col(c), "string"), c) for c in ("companyName", "gstNo", "contactPhone")]
    gone += [F.when(F.col("origins") == 0, "zoneRates"), F.when(F.col("active_zones") == 0, "serviceability")]
    return docs.select("vendor_id", F.array_compact(F.array(*gone)).alias("missing"))


def manual_input(docs: DataFrame) -> DataFrame:
    """(vendor_id, field, required): fields that a person has to fill."""
    items = [F.struct(F.lit(f).alias("field"), F.lit(r).alias("required"), filled(F.col(f), "string").alias("there")) for f, r in MANUAL_FIELDS.items()]
    return docs.select("vendor_id", F.explode(F.array(*items)).alias("x")).where("not x.there").select("vendor_id", "x.field", "x.required")


def review(fields: DataFrame, audit: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """Status of charge fields (vendor_id, field, value): missing, uncertain, suspicious, ambiguous or ok."""
    best = audit.groupBy("vendor_id", F.col("matched").alias("field")).agg(F.max("confidence").alias("found"))
    low, high = (F.create_map(*[F.lit(x) for k, r in REVIEW_RANGES.items() for x in (k, r[i])])[F.col("field")] for i in (0, 1))
    rows = fields.join(best, ["vendor_id", "field"], "left").join(ambiguous.select("vendor_id", "field").distinct().withColumn("_amb", F.lit(True)), ["vendor_id", "field"], "left")
    missing = F.coalesce(F.col("value"), F.lit(0.0)) == 0
    confidence = F.coalesce("found", F.when(missing, 0.0).otherwise(1.0))
    status = (
        F.when(F.col("_amb"), "ambiguous").when(missing, "missing").when(F.coalesce("found", F.lit(1.0)) < 0.75, "uncertain").when((F.col("value") < low) | (F.col("value") > high), "suspicious").otherwise("ok")
    )
    return rows.select("vendor_id", "field", "value", confidence.alias("confidence"), status.alias("status"))


def dedupe_audit(audit: DataFrame) -> DataFrame:
    """The first audit row (by seq) of each type, raw label and match."""
    first = F.row_number().over(Window.partitionBy("type", "raw", "matched").orderBy("seq"))
    return audit.withColumn("_n", first).where("_n = 1").drop("_n")


def encode_meta(raw: DataFrame) -> DataFrame:
    """Canonical company fields from whichever spelling is there, with defaults."""
    any_of = lambda *names: F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names])
    customer = any_of("customerID")
    return raw.select(
        "vendor_id",
        any_of("companyName", "name").alias("companyName"),
        F.coalesce(any_of("transportMode", "serviceType"), F.lit("LTL")).alias("transportMode"),
        F.when(customer.isNotNull(), "temporary").otherwise("regular").alias("transporterType"),
        gst_number(F.col("gst")).alias("gstNo"),
        any_of("phone").alias("contactPhone"),
        F.coalesce(F.nullif(F.col("rating"), F.lit(0.0)), F.lit(4.0)).alias("rating"),
        F.coalesce(F.col("verified"), F.lit(False)).alias("isVerified"),
        F.lit("pending_review").alias("approvalStatus"),
    )


def review_flags(docs: DataFrame) -> DataFrame:
    """Flags after automatic changes: trust is never raised, the rating goes."""
    return completeness(docs).select(
        "vendor_id",
        F.coalesce("isVerified", F.lit(False)).alias("isVerified"),
        F.coalesce("approvalStatus", F.lit("pending_review")).alias("approvalStatus"),
        F.lit(True).alias("needsManualReview"),
        F.round("completeness", 2).alias("completeness"),
    )


def name_or_folder(name: Column, known: Column, folder: Column) -> Column:
    """The company's name: from the source, a known company, or the folder in title case."""
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), known, F.initcap(F.regexp_replace(folder, "[_-]", " ")))


def patch(docs: DataFrame, patches: DataFrame) -> DataFrame:
    """Applies patches (vendor_id, field, value as text, seq) to string and number fields; the last of a field counts."""
    last = patches.groupBy("vendor_id", "field").agg(F.max_by("value", "seq").alias("value"))
    wide = last.groupBy("vendor_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("_p"))
    rows = docs.join(wide, "vendor_id", "left")
    kinds = dict(docs.dtypes)
    new = lambda c: F.coalesce(F.col("_p")[c].try_cast(kinds[c]), F.col(c)).alias(c)
    return rows.select("vendor_id", *[new(c) for c in docs.columns if c != "vendor_id"])


def document_ids(docs: DataFrame, order: str) -> DataFrame:
    """Adds ``doc_code`` TRP-00001 ... in the order of a unique key.

    Keys are dealt in buckets of a thousand and those in groups of a thousand buckets; each is ranked
    alone and offset by the counts before it, so no task sees more than a thousand buckets at once
    until there are a thousand million documents.
    """
    rows = docs.withColumn("_b", F.floor(F.col(order) / 1000)).withColumn("_g", F.floor(F.col("_b") / 1000))
    sizes = rows.groupBy("_g", "_b").agg(F.count("*").alias("_n"))
    groups = sizes.groupBy("_g").agg(F.sum("_n").alias("_n"))
    running = lambda by: F.coalesce(F.sum("_n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before_group = groups.select("_g", running(Window.orderBy("_g")).alias("_og"))
    before = sizes.select("_g", "_b", running(Window.partitionBy("_g").orderBy("_b")).alias("_ob"))
    rank = F.row_number().over(Window.partitionBy("_b").orderBy(order))
    ranked = rows.join(before, ["_g", "_b"]).join(before_group, "_g").withColumn("_r", rank + F.col("_ob") + F.col("_og"))
    return ranked.withColumn("doc_code", F.concat(F.lit("TRP-"), F.lpad(F.col("_r").cast("string"), 5, "0"))).drop("_b", "_g", "_ob", "_og", "_r")


def stamp(docs: DataFrame, at: Column | None = None) -> DataFrame:
    """Adds ``generatedAt``: an ISO stamp in UTC of ``at``, by default of the moment at which the query runs."""
    return docs.withColumn("generatedAt", F.date_format(F.to_utc_timestamp(F.current_timestamp() if at is None else at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def _stem(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(name, r"\.[^.]*$", "")), "[-_.]", " ")


def _scores(name: Column, words: Column | None = None) -> Column:
    """A struct of two points per keyword inside the name, and one more per word that holds or is held by it."""
    out = []
    for kind, keys in FILE_WORDS.items():
        table = F.array(*[F.lit(k.replace("_", " ")) for k in keys])
        hits = F.size(F.filter(table, lambda k: F.contains(name, k))) * 2
        if words is not None:
            hits = hits + F.aggregate(table, F.lit(0), lambda a, k: a + F.size(F.filter(words, lambda w: F.contains(w, k) | F.contains(k, w))))
        out.append(hits.alias(kind))
    return F.struct(*out)


def _top(scores: Column) -> Column:
    return F.greatest(*[scores[kind] for kind in FILE_WORDS])


def classify_filename(name: Column) -> Column:
    """company_details, charges or zone_data by the words of a file name."""
    ext = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))

    def by_score(s: Column) -> Column:
        out = F.when(_top(s) == 0, F.when(ext.isin("png", "jpg", "jpeg"), "company_details").otherwise("charges"))
        for kind in FILE_WORDS:
            out = out.when(s[kind] == _top(s), kind)
        return out

    def by_words(stem: Column, words: Column) -> Column:
        zone = F.lit(False)
        for w in ("pincode", "serviceable", "serviceability", "coverage", "network"):
            zone = zone | F.contains(stem, F.lit(w))
        zone = zone | stem.rlike(RATE_CARD) | F.array_contains(words, "rate") | F.array_contains(words, "rates")
        scored = let(F.array_distinct(F.filter(words, lambda w: w != "")), lambda distinct: let(_scores(stem, distinct), by_score))
        return F.when(stem.rlike(PROPOSAL), "company_details").when(zone, "zone_data").otherwise(scored)

    return let(_stem(name), lambda stem: let(F.split(stem, r"\s+"), lambda words: by_words(stem, words)))


def filename_confidence(name: Column) -> Column:
    return let(_stem(name), lambda stem: let(_scores(stem), lambda s: F.least(F.lit(95), F.lit(40) + _top(s) * 10)))


def filename_hint(name: Column) -> Column:
    low, out = F.lower(name), None
    for kind, words in HINT_WORDS.items():
        hit = low.rlike("|".join(words))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("UNKNOWN")


def catalog(docs: DataFrame, files: DataFrame) -> DataFrame:
    """Per vendor: name, quality, band, zones, and file counts per category."""
    kinds = list(FILE_WORDS)
    counts = files.groupBy("vendor_id").pivot("category", kinds).count().fillna(0, kinds)
    return docs.select("vendor_id", "companyName", "quality", quality_band(F.col("quality")).alias("band"), "active_zones").join(counts, "vendor_id", "left").fillna(0, kinds)


def safe_name(name: Column) -> Column:
    """The file name of a vendor's document."""
    return F.regexp_replace(F.lower(name), "[ /]", "_")
