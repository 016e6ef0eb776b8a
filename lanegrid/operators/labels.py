"""Matching of free labels against dictionaries, and a dictionary that learns from confirmations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanegrid.operators.label_index import NOISE, match, normalise, strip_noise, tokens

__all__ = ["NOISE", "match", "normalise", "strip_noise", "tokens"]

# Fixed values ---------------------------------------------------------------------------------
#: field -> names of it, each with or without one of the endings.
CHARGE_NAMES = {
    "docketCharges": ["docket", "lr", "lorry receipt", "lr docket", "bilti", "bilty", "consignment note", "cn", "awb", "booking", "docket charges per lr"],
    "fuel": ["fuel", "fsc", "fs", "fuel sc", "fuel adjustment", "fuel adjustment factor", "petrol", "diesel", "energy", "fuel surcahrge"],
    "minCharges": ["minimum", "min", "min freight", "minimum freight", "minimum chargeable", "min chargeable", "minimum chargable", "min chargable", "minimum chargable freight", "min lr", "minimum billing", "min billing", "floor", "base minimum"],
    "minWeight": ["min weight", "minimum weight", "min wt", "minimum wt", "min chargeable weight", "minimum chargeable weight", "min chargable weight", "minimum chargable weight", "min chg wt", "chargeable weight minimum", "charge weight minimum", "billable weight minimum"],
    "divisor": ["divisor", "vol divisor", "volumetric divisor", "volumetric", "cft", "cft divisor", "1 cft", "1cft", "k factor", "kfactor", "cfactor", "c factor", "volume factor", "vol factor", "dimensional weight divisor", "dim weight divisor", "dim divisor"],
    "greenTax": ["green", "green tax", "environmental", "eco", "pollution"],
    "rovCharges": ["rov", "fov", "fov owner s risk", "fov owners risk", "risk coverage", "risk of value", "owner s risk", "owners risk", "owner risk", "vr", "freight risk", "cargo risk", "risk"],
    "insuranceCharges": ["insurance", "cargo insurance", "transit insurance", "insurance premium", "transit risk"],
    "odaCharges": ["oda", "oda per kg", "oda charges per kg", "out of delivery", "out of delivery area", "oda area", "edl", "extended delivery", "extended delivery location", "remote area", "remote delivery", "special area", "restricted area", "non serviceable", "non serviceable area", "beyond area", "beyond delivery", "hilly area", "interior area", "interior"],
    "codCharges": ["cod", "cod percentage", "cash on delivery", "cod collection", "collect on delivery"],
    "handlingCharges": ["handling", "cargo handling", "loading unloading", "labour", "labor"],
    "daccCharges": ["dacc", "demurrage", "detention"],
    "miscCharges": ["misc", "miscellaneous", "other", "additional", "idc", "indirect", "eway", "e way", "eway bill", "e way bill", "ewaybill"],
    "topayCharges": ["topay", "to pay", "freight topay"],
    "dodCharges": ["dod", "delivery on demand"],
    "appointmentCharges": ["appointment", "apt", "apt handling", "appointment handling", "appointment delivery", "timed delivery", "time slot delivery"],
    "fmCharges": ["fm", "first mile", "pickup", "pick up"],
    "prepaidCharges": ["prepaid", "advance freight"],
    "gst": ["gst"],
}
NAME_ENDINGS = ["", "charge", "charges"]
#: Further endings of names of one word.
WORD_ENDINGS = ["fee", "fees", "cost", "surcharge", "surcharges"]
#: Names whose meaning hangs on the ending, or that have no other form.
CHARGE_EXCEPTIONS = {"collection charges": "codCharges", "collection charge": "fmCharges", "surcharge": "miscCharges", "surcharges": "miscCharges", "indirect cost": "miscCharges", "freight risk": "rovCharges"}
#: Names that are known to be no charge.
NO_CHARGE = [
    "scheduled delivery", "same day delivery", "single piece", "single piece charges", "claim settlement", "claims", "free storage days", "transit time", "delivery time", "tat", "turnaround time", "transit days",
    "service", "services", "remarks", "notes", "terms", "terms and conditions",
]
CONFIRM_GAIN, PASSIVE_GAIN, TAUGHT_GAIN, DECAY = 0.35, 0.15, 0.4, 0.5
PROMOTE_AT, PROMOTE_PASSIVE_AT, PROMOTE_CONFIDENCE = 3, 6, 0.8
# ----------------------------------------------------------------------------------------------


def charge_labels() -> dict[str, str | None]:
    """Label -> field, or None for a label known to be no charge: exceptions, names without an ending, then all endings."""
    known: dict[str, str | None] = {**CHARGE_EXCEPTIONS, **dict.fromkeys(NO_CHARGE)}
    for ending in NAME_ENDINGS + WORD_ENDINGS:
        for field, names in CHARGE_NAMES.items():
            for name in names:
                if ending in NAME_ENDINGS or " " not in name:
                    known.setdefault(f"{name} {ending}".strip(), field)
    return known


CHARGE_LABELS = charge_labels()


def dedupe_adjacent(cells: Column) -> Column:
    """Cells without those that equal the one before."""
    return F.filter(cells, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(cells, i - 1)))


def dictionary(spark, labels: dict[str, str | None] = CHARGE_LABELS) -> DataFrame:
    rows = [(i, k, v) for i, (k, v) in enumerate(labels.items())]
    return spark.createDataFrame(rows, "dim_order int, known string, value string").coalesce(1)


def fold_step(s: Column, e: Column) -> Column:
    """One event (kind) applied to a state (n, corrections, c, promoted)."""
    kind = e["kind"]
    c = F.coalesce(s["c"], F.when(kind == "passive", 0.4).otherwise(0.5))
    n = s["n"] + F.when(kind.isin("confirm", "taught"), 1.0).when(kind == "passive", 0.5).otherwise(0.0)
    new = (
        F.when(kind == "confirm", F.least(F.lit(0.99), c + (1 - c) * CONFIRM_GAIN))
        .when(kind == "passive", F.least(F.lit(0.95), c + (1 - c) * PASSIVE_GAIN))
        .when(kind == "taught", F.least(F.lit(0.99), c + TAUGHT_GAIN))
        .otherwise(F.when(s["c"].isNotNull(), c * DECAY))
    )
    reached = ((kind == "confirm") & (n >= PROMOTE_AT)) | ((kind == "passive") & (n >= PROMOTE_PASSIVE_AT))
    promoted = s["promoted"] | (kind == "taught") | (reached & (new >= PROMOTE_CONFIDENCE))
    corrections = s["corrections"] + F.when((kind == "wrong") & s["c"].isNotNull(), 1).otherwise(0)
    return F.struct(n.alias("n"), corrections.alias("corrections"), new.alias("c"), promoted.alias("promoted"))


def fold_events(events: DataFrame) -> DataFrame:
    """State of each key (type, raw, canonical) after its events in the order of ts and seq.

    Kinds: confirm, passive, wrong (the match was corrected away) and taught (it is the
    correction). Confidence moves by the fixed gains; three confirmations (six for passive ones)
    at 0.8 promote the entry, and teaching promotes at once. The events of a key are held in one
    row; for keys without bound there is the stream, which folds a key's events as they pass.
    """
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0).alias("corrections"), F.lit(None).cast("double").alias("c"), F.lit(False).alias("promoted"))
    ordered = F.array_sort(F.collect_list(F.struct("ts", "seq", "kind")))
    state = events.groupBy("type", "raw", "canonical").agg(F.aggregate(ordered, start, fold_step).alias("s"))
    return state.select("type", "raw", "canonical", F.col("s.n").alias("confirmations"), "s.corrections", F.col("s.c").alias("confidence"), F.col("s.promoted").alias("promoted")).where("confidence is not null")


def best_suggestion(state: DataFrame, least: float = 0.7) -> DataFrame:
    """Per (type, raw) the canonical name of highest confidence; the first by name of equals."""
    rows = state.where(F.col("confidence") >= least)
    return rows.groupBy("type", "raw").agg(F.min_by(F.struct("canonical", "confidence"), F.struct(-F.col("confidence"), "canonical")).alias("b")).select("type", "raw", "b.*")


def learning_stats(state: DataFrame) -> DataFrame:
    return state.groupBy("type").agg(F.count("*").alias("n"), F.sum(F.col("promoted").cast("int")).alias("promoted"), F.round(F.avg("confidence"), 3).alias("confidence"))


def classify_company(rows: DataFrame, companies: DataFrame) -> DataFrame:
    """(doc_id, company, score), the best company of each document, its score at most 0.99.

    0.4 per alias in the text, 0.3 for the name or an alias in the folder, and where the company has
    them 0.5 for its tax number and 0.3 each for its phone number and mail domain in the text.
    ``companies`` (company, aliases, and if known gst, phone, email) is a dictionary of fixed size
    and is broadcast.
    """
    low, folder = F.lower(F.coalesce("text", F.lit(""))), F.lower("folder")
    hits = F.size(F.filter("aliases", lambda a: F.contains(low, a)))
    named = F.contains(folder, F.lower("company")) | F.exists("aliases", lambda a: F.contains(folder, a))
    points = hits * 0.4 + F.when(named, 0.3).otherwise(0.0)
    for c, worth in (("gst", 0.5), ("phone", 0.3), ("email", 0.3)):
        if c in companies.columns:
            points = points + F.when(F.contains(low, F.lower(c)), worth).otherwise(0.0)
    scored = rows.join(F.broadcast(companies)).withColumn("score", F.round(F.least(F.lit(0.99), points), 2)).where("score > 0")
    return scored.groupBy("doc_id").agg(F.min_by(F.struct("company", "score"), F.struct(-F.col("score"), "company")).alias("b")).select("doc_id", "b.*")


def charge_suggestions(found: DataFrame, present: DataFrame, reference: DataFrame, least: float = 0.65) -> DataFrame:
    """Fields that a recognised company usually has and the source lacks: (doc_id, field, value), flagged, never applied."""
    known = found.where(F.col("score") >= least).join(F.broadcast(reference), "company")
    return known.join(present, ["doc_id", "field"], "left_anti").select("doc_id", "company", "field", "value").withColumn("applied", F.lit(False))


