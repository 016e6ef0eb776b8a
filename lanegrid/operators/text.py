"""Text of vendor documents: classification, sections, charges and company data by patterns."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanegrid.runtime import small_batches

# Signals by category as (name, pattern, weight, counted by distinct matches). ------

SIGNALS: dict[str, list[tuple[str, str, float, bool]]] = {
    "AIR_FREIGHT": [
        ("air_mode_words", r"(?i)\b(?:air\s*(?:freight|cargo|express|way\s*bill|awb|shipment|consignment|tariff|rates?|charges?|mode|service)|awb|airway\s*bill|air\s*waybill|aviation\s*(?:cargo|freight|rates?)|by\s*air|air\s*only)\b", 5.0, False),
        ("awb_divisor", r"(?i)\bvolumetric\s*(?:divisor|factor)\s*[=:]\s*6000\b|\b6000\s*(?:divisor|factor)\b", 3.0, False),
    ],
    "VOLUMETRIC": [
        ("cft_formula", r"(?i)\b1\s*cft\s*[=:]\s*\d+", 5.0, False),
        ("dim_formula", r"(?i)\b(?:l\s*[x×]\s*b\s*[x×]\s*h|length\s*[x×]\s*breadth|dimensional\s*weight|volumetric\s*weight\s*[=:=]|k[\s-]*factor\s*[=:]\s*\d{3,}|divisor\s*[=:]\s*\d{3,})\b", 4.0, False),
        ("volumetric_words", r"(?i)\b(?:volumetric|dimensional|cft|cubic\s*(?:feet|foot|inch)|volume\s*weight|vol\.?\s*wt)\b", 1.5, False),
    ],
    "LEGAL": [
        ("legal_words", r"(?i)\b(?:clause|notwithstanding|indemnif|arbitration|jurisdiction|liability|govern(?:ed|ing)\s*by|subject\s*to\s*(?:the\s*)?terms|terms\s*and\s*conditions|t\s*&\s*c)\b", 3.5, False),
        ("legal_refs", r"(?i)\b(?:section\s+\d+|clause\s+\d+|sub-clause)\b", 2.0, False),
    ],
    "ZONE_MATRIX": [
        ("zone_codes", r"\b(N[1-4]|S[1-4]|E[12]|W[12]|C[12]|NE[12]|X[123])\b", 3.0, True),
        ("zone_words", r"(?i)\b(zone|north|south|east|west|central|northeast|metro|roi|rest of india|regional|corridor|route|lane)\b", 1.0, False),
        ("rate_words", r"(?i)\b(rate|per\s*kg|freight|tariff|price|charge|rs\.?|inr)\b", 0.8, False),
        ("numeric_grid", r"(\d+\.?\d*\s+){3,}", 0.5, False),
    ],
    "PINCODE_LIST": [
        ("pin_numbers", r"\b([1-9]\d{5})\b", 2.0, True),
        ("svc_words", r"(?i)\b(pincode|serviceable|serviceability|served|coverage|delivery|network|area|reachable|pin\s*code|postal)\b", 1.5, False),
        ("yn_flags", r"(?i)\b(yes|no|y|n|true|false|oda|edl)\b", 0.5, False),
    ],
    "CHARGES": [
        ("charge_words", r"(?i)\b(fuel|docket|minimum|surcharge|charges?|fee|rov|fov|oda|cod|handling|insurance|divisor|green\s*tax|topay|prepaid|dacc|bilty|lr\b|dsc|fsc|hsd|levy|cess|misc|octroi)\b", 2.5, False),
        ("charge_values", r"(?i)\b(\d+(?:\.\d+)?)\s*(%|per\s*kg|rs\.?|inr|/-)\b", 1.5, False),
        ("key_value", r"(?i)[:\-=]\s*(\d+(?:\.\d+)?)\s*(%|rs)?", 0.8, False),
    ],
    "COMPANY_INFO": [
        ("gst_pattern", r"\b\d{2}[A-Z]{5}\d{4}[A-Z]\d[ZYX]\d\b", 4.0, False),
        ("pan_pattern", r"\b[A-Z]{5}\d{4}[A-Z]\b", 3.5, False),
        ("phone_pattern", r"\b(\+?91[-\s]?)?\d{10}\b", 2.0, False),
        ("email_pattern", r"\b[\w.+-]+@[\w-]+\.\w+\b", 2.0, False),
        ("company_words", r"(?i)\b(pvt\.?\s*ltd|limited|llp|incorporated|company|transporter|logistics|courier|cargo|express|freight|gst\s*no|cin\b|pan\b|registered|head\s*office|branch)\b", 1.0, False),
    ],
    "ODA_LIST": [
        ("oda_words", r"(?i)\b(oda|out\s*of\s*delivery|edl|extended\s*delivery|remote\s*area|special\s*area|restricted|non.?serviceable)\b", 3.5, False),
        ("pin_numbers", r"\b([1-9]\d{5})\b", 1.5, True),
    ],
    "WEIGHT_SLAB": [
        ("weight_ranges", r"(?i)\b(\d+\s*[-–]\s*\d+\s*kg|\d+\s*kg\s*(?:to|[-–])\s*\d+\s*kg|up\s*to\s*\d+\s*kg|above\s*\d+\s*kg|\d+\+\s*kg)\b", 3.5, False),
        ("weight_words", r"(?i)\b(weight|wt\.?|slab|kg\b|kgs\b|per\s*kg|minimum\s*weight|chargeable\s*weight)\b", 1.5, False),
        ("per_kg_rates", r"(?i)\b\d+(?:\.\d+)?\s*/?\s*kg\b", 2.0, False),
    ],
}

EVIDENCE = [
    "docket charge", "docket fee", "fuel surcharge", "fuel charge", "fsc", "minimum charge", "min charge", "minimum freight", "min freight",
    "rov charge", "risk of value", "owner's risk", "owners risk", "fov charge", "insurance charge", "oda charge", "oda charges", "out of delivery area",
    "out-of-delivery", "remote area charge", "special area charge", "handling charge", "green tax", "dacc charge", "dacc",
    "cod charge", "cash on delivery charge", "appointment charge", "topay charge", "to-pay charge", "to pay charge", "prepaid charge",
    "misc charge", "miscellaneous charge", "other charges",
]

#: Section headings by category, in order of preference.
HEADINGS: list[tuple[str, str]] = [
    ("AIR_FREIGHT", r"(?i)^[\s\*\-=>#]*(?:air\s*(?:freight|cargo|express|rates?|tariff|charges?|price|mode|service|zone|only)|aviation\s*(?:freight|cargo|rates?)|airway?\s*bill|awb\s*(?:rates?|charges?)|by\s*air(?:\s*(?:rates?|charges?|tariff))?)[\s\*:\-]*$"),
    ("CHARGES", r"(?i)^[\s\*\-=>#]*(?:surcharge|additional\s*charge|fee\s*schedule|charge\s*details?|tariff|accessorial|ancillary|levy|misc|docket|lr\s*charge|fuel\s*surcharge|oda\s*charge|handling\s*charge|cod\s*charge|freight\s*charges?)[\s\*:\-]*$"),
    ("ZONE_MATRIX", r"(?i)^[\s\*\-=>#]*(?:zone(?:\s*(?:wise|to\s*zone|matrix|rate|price|tariff))?|rate\s*(?:card|matrix|chart)|price\s*(?:matrix|chart)|freight\s*rate)[\s\*:\-]*$"),
    ("TRANSIT_DAYS", r"(?i)^[\s\*\-=>#]*(?:transit\s*(?:time|days?)|delivery\s*(?:time|days?)|tat|eta|lead\s*time|turnaround\s*time|expected\s*(?:days?|delivery)|days?\s*(?:matrix|chart|schedule)|no\.?\s*of\s*days?)[\s\*:\-]*$"),
    ("ODA_LIST", r"(?i)^[\s\*\-=>#]*(?:oda|out[\s-]*of[\s-]*delivery|edl|extended\s*delivery|remote\s*area|special\s*area|non[\s-]*serviceable)[\s\*:\-]*$"),
    ("PINCODE_LIST", r"(?i)^[\s\*\-=>#]*(?:pincode|serviceable|coverage|network|served\s*area|delivery\s*network|service\s*area)[\s\*:\-]*$"),
    ("COMPANY_INFO", r"(?i)^[\s\*\-=>#]*(?:company|vendor|transporter|about\s*us|company\s*profile|contact|registration|gst|kyc)[\s\*:\-]*$"),
    ("VOLUMETRIC", r"(?i)^[\s\*\-=>#]*(?:volumetric|dimensional\s*weight|cft|cubic|k[\s-]*factor|divisor)[\s\*:\-]*$"),
    ("LEGAL", r"(?i)^[\s\*\-=>#]*(?:terms?\s*(?:and|&)\s*conditions?|disclaimer|limitation|liability|t\s*&\s*c|general\s*conditions?)[\s\*:\-]*$"),
    ("WEIGHT_SLAB", r"(?i)^[\s\*\-=>#]*(?:weight[\s-]*(?:slab|band|range|bracket)|slab[\s-]*rate|rate[\s-]*slab|per[\s-]*kg[\s-]*rate)[\s\*:\-]*$"),
]
#: Phrases inside a section by category, in order of preference.
INLINE_MARKERS: list[tuple[str, str]] = [
    ("TRANSIT_DAYS", r"(?i)(?:\b\d+\s*transit\s*days?\b|\btransit\s*(?:time|days?)\b|\bdelivery\s*(?:time|days?)\b|\bdays?\s*in\s*transit\b|\b(?:tat|eta)\b|\blead\s*time\b|\bturnaround\s*time\b)"),
    ("AIR_FREIGHT", r"(?i)\b(?:air\s*(?:freight|cargo|way\s*bill|awb|mode)|awb|airway\s*bill|by\s*air\s*(?:rate|freight|tariff))"),
    ("VOLUMETRIC", r"(?i)\b(?:1\s*cft\s*[=:]\s*\d+|k[\s-]*factor\s*[=:]\s*\d+|volumetric\s*divisor\s*[=:]\s*\d+|dimensional\s*weight\s*formula)"),
    ("LEGAL", r"(?i)\b(?:subject\s*to|governed\s*by|clause\s*\d+|notwithstanding|indemnif|arbitration|jurisdiction)"),
    ("CHARGES", r"(?i)\b(?:docket\s*charge|lr\s*charge|fuel\s*surcharge|oda\s*charge|cod\s*charge|dacc|topay\s*charge|handling\s*charge|green\s*tax|miscellaneous\s*charge)"),
    ("COMPANY_INFO", r"(?i)\b(?:gstin?|gst\s*no|pan\s*(?:no|number|card)|cin\s*no|registered\s*office|head\s*office|contact\s*(?:us|no|number))"),
]

DANGEROUS = ["VOLUMETRIC", "LEGAL", "TRANSIT_DAYS", "AIR_FREIGHT"]
LEAST_SCORE = 1.5
MIXED_GAP = 0.35

#: (field, words of which a match has one, pattern on lower-cased text), in order; group 1 is the value. ``_v`` is a percentage, ``_f`` an amount.
CHARGE_PATTERNS: list[tuple[str, list[str], str]] = [
    ("fuel", ["fuel"], r"fuel\s*(?:surcharge|levy|%|percent|surcahrge)[^\d\n]{0,60}(\d+(?:\.\d+)?)"),
    ("fuel", ["%"], r"f\.?s\.?c\.?\s*[:\-=]?\s*(\d+(?:\.\d+)?)\s*%"),
    ("fuel", ["fuel"], r"(\d+(?:\.\d+)?)\s*%\s*fuel"),
    ("fuel", ["hsd"], r"hsd\s*(?:surcharge)?[^\d\n]{0,60}(\d+(?:\.\d+)?)\s*%"),
    ("fuel", ["diesel"], r"diesel\s*(?:surcharge|levy)[^\d\n]{0,60}(\d+(?:\.\d+)?)\s*%"),
    ("fuel", ["diesel"], r"diesel\s*escalation[^\d\n]{0,20}(\d+(?:\.\d+)?)"),
    ("docketCharges", ["docket", "lr", "bilty", "dwb"], r"(?:docket|lr\b|bilty|dwb)\s*(?:charges?|fee)?[^\d\n]{0,60}(?:rs\.?\s*)?(\d+(?:\.\d+)?)"),
    ("docketCharges", ["lorry"], r"lorry\s*receipt[^\d\n]{0,60}(?:rs\.?\s*)?(\d+(?:\.\d+)?)"),
    ("docketCharges", ["waybill"], r"waybill\s*(?:charges?|fee)?[^\d\n]{0,60}(?:rs\.?\s*)?(\d+(?:\.\d+)?)"),
    ("docketCharges", ["consignment"], r"consignment\s*note[^\d\n]{0,60}(?:rs\.?\s*)?(\d+(?:\.\d+)?)"),
    ("gst", ["gst"], r"gst\s*[:\-=@]\s*(\d+(?:\.\d+)?)\s*%"),
    ("gst", ["gst"], r"(\d+(?:\.\d+)?)\s*%\s*gst\b"),
    ("gst", ["goods"], r"goods\s*and\s*services\s*tax[^\d\n]{0,30}(\d+(?:\.\d+)?)\s*%"),
    ("gst", ["igst"], r"igst\s*[:\-=@]\s*(\d+(?:\.\d+)?)\s*%"),
    ("gst", ["gst"], r"gst[^\d\n]{0,60}@\s*(\d+(?:\.\d+)?)\s*%"),
    ("gst", ["gst"], r"gst\s+at\s+current\s+rate[^\d\n]{0,30}@?\s*(\d+(?:\.\d+)?)\s*%"),
    ("gst", ["gst"], r"gst\s*[:\-]?\s*(\d+(?:\.\d+)?)\s*%\s*(?:applicable|as\s+per|on)"),
    ("gst", ["gst"], r"all\s*rates?\s*(?:are\s*)?subject\s*to\s*gst\s*@\s*(\d+(?:\.\d+)?)\s*%"),
    ("minCharges", ["min"], r"min(?:imum)?\s*(?:charg(?:es?|able)|freight)[^\d\n]{0,60}(?:rs\.?|₹|inr)\s*(\d+(?:\.\d+)?)"),
    ("minCharges", ["sfc"], r"sfc\s*[-:]\s*rs[-\.]\s*(\d+(?:\.\d+)?)"),
    ("minCharges", ["min"], r"min(?:imum)?\s*(?:billing|amount|rate)[^\d\n]{0,60}(?:rs\.?\s*)?(\d+(?:\.\d+)?)"),
    ("minCharges", ["base"], r"base\s*(?:freight|rate|charge)[^\d\n]{0,60}(?:rs\.?\s*)?(\d+(?:\.\d+)?)"),
    ("minCharges", ["floor"], r"floor\s*(?:rate|charge)[^\d\n]{0,60}(?:rs\.?\s*)?(\d+(?:\.\d+)?)"),
    ("minWeight", ["min"], r"min(?:imum)?\s*(?:chargeable\s*)?weight[^\d\n]{0,60}(\d+(?:\.\d+)?)\s*kg"),
    ("minWeight", ["min"], r"min[^\d\n]{0,40}weight[^\d\n]{0,10}(\d+(?:\.\d+)?)\s*kg"),
    ("minWeight", ["min"], r"min(?:imum)?\s*wt\.?[^\d\n]{0,60}(\d+(?:\.\d+)?)\s*kg"),
    ("minWeight", ["sfc"], r"sfc\s*[-:]\s*(\d+(?:\.\d+)?)\s*kg"),
    ("cft_kg", ["cft"], r"1\s*cft\s*[=:]\s*(\d+(?:\.\d+)?)\s*kg"),
    ("divisor", ["divisor", "factor"], r"(?:volumetric\s*divisor|k\s*factor|kfactor|cfactor|vol\s*divisor)[^\d\n]{0,30}(\d+)"),
    ("divisor", ["(in"], r"l\s*[x\*]\s*b\s*[x\*]\s*h\s*\(in\s*cm\)[^\d\n]{0,15}/\s*(\d+)"),
    ("greenTax", ["green"], r"green\s*(?:tax|cess|levy|surcharge)[^\d\n]{0,60}(\d+(?:\.\d+)?)"),
    ("greenTax", ["ngt"], r"ngt\s*charge[^\d\n]{0,60}(?:rs\.?\s*)?(\d+(?:\.\d+)?)"),
    ("greenTax", ["environmental"], r"environmental\s*(?:surcharge|charge|cess)[^\d\n]{0,60}(\d+(?:\.\d+)?)"),
    ("greenTax", ["ecology"], r"ecology\s*(?:charge|cess)[^\d\n]{0,60}(\d+(?:\.\d+)?)"),
    ("greenTax", ["pollution"], r"pollution\s*(?:charge|cess)[^\d\n]{0,60}(\d+(?:\.\d+)?)"),
    ("rovCharges_v", ["%"], r"(?:r\.?o\.?v\.?|f\.?o\.?v\.?|risk\s*(?:of\s*value)?|owner.?s?\s*risk)[^\d\n]{0,60}(\d+(?:\.\d+)?)\s*%"),
    ("rovCharges_f", ["o"], r"(?:r\.?o\.?v\.?|f\.?o\.?v\.?)\s*(?:min(?:imum)?)?[^\d\n]{0,60}(?:rs\.?\s*)?(\d+(?:\.\d+)?)(?!\s*%)"),
    ("odaCharges_perKg", ["higher", "max", "whichever", "greater"], r"o\.?d\.?a\.?\s*(?:charges?)?[^\d\n]{0,60}(?:rs\.?\s*|₹\s*)?(\d+(?:\.\d+)?)\s*/?\s*kg[^\d\n]{0,40}(?:rs\.?\s*|₹\s*)?(?:\d+(?:\.\d+)?)\s*/?\s*(?:consignment|shipment|docket)[^\d\n]{0,25}(?:higher|max|whichever|greater)"),
    ("odaCharges_minimum", ["higher", "max", "whichever", "greater"], r"o\.?d\.?a\.?\s*(?:charges?)?[^\d\n]{0,60}(?:rs\.?\s*|₹\s*)?(?:\d+(?:\.\d+)?)\s*/?\s*kg[^\d\n]{0,40}(?:rs\.?\s*|₹\s*)?(\d+(?:\.\d+)?)\s*/?\s*(?:consignment|shipment|docket)[^\d\n]{0,25}(?:higher|max|whichever|greater)"),
    ("odaCharges_f", ["rs", "₹"], r"o\.?d\.?a\.?\s*(?:charges?)?[^\d\n]{0,60}(?:rs\.?|₹)\s*(\d+(?:\.\d+)?)(?!\s*/?\s*kg)"),
    ("odaCharges_v", ["%"], r"o\.?d\.?a\.?[^\d\n]{0,60}(\d+(?:\.\d+)?)\s*%"),
    ("insuranceCharges_v", ["insurance"], r"insurance[^\d\n]{0,60}(\d+(?:\.\d+)?)\s*%"),
    ("insuranceCharges_f", ["insurance"], r"(?:cargo|transit|goods)\s*insurance[^\d\n]{0,60}(?:rs\.?\s*)?(\d+(?:\.\d+)?)"),
    ("codCharges_v", ["%"], r"c\.?o\.?d\.?\s*(?:charges?)?[^\d\n]{0,60}(\d+(?:\.\d+)?)\s*%"),
    ("codCharges_f", ["rs", "₹", "inr"], r"c\.?o\.?d\.?\s*(?:charges?)?[^\d\n]{0,60}(?:rs\.?|₹|inr)\s*(\d+(?:\.\d+)?)"),
    ("handlingCharges_f", ["handling"], r"handling\s*(?:charges?)[^\d\n]{0,60}(?:rs\.?\s*)?(\d+(?:\.\d+)?)"),
    ("daccCharges", ["dacc"], r"dacc[^\d\n]{0,60}(?:rs\.?\s*)?(\d+(?:\.\d+)?)"),
    ("daccCharges", ["demurrage"], r"demurrage[^\d\n]{0,60}(?:rs\.?\s*)?(\d+(?:\.\d+)?)"),
    ("topayCharges_v", ["pay"], r"to\s*pay\s*(?:charges?|surcharge)[^\d\n]{0,60}(\d+(?:\.\d+)?)\s*%"),
    ("topayCharges_f", ["pay"], r"to\s*pay\s*(?:charges?|surcharge)[^\d\n]{0,60}(?:rs\.?|₹|inr)\s*(\d+(?:\.\d+)?)"),
    ("topayCharges_f", ["pay"], r"to\s*pay\s*[:\-][^\d\n]{0,60}(?:rs\.?|₹|inr)\s*(\d+(?:\.\d+)?)"),
    ("appointmentCharges_f", ["appointment"], r"appointment[^\d\n]{0,60}(?:rs\.?\s*)?(\d+(?:\.\d+)?)"),
]
#: Amounts under another name, taken where the field was not found: (fields, values under, words, pattern).
FALLBACKS = {
    "topayCharges_f": (["topayCharges_v", "topayCharges_f"], 5000, ["fod"], r"fod\s*(?:\(freight\s*on\s*delivery\))?[^\d\n]{0,60}(?:rs\.?\s*)?(\d+(?:\.\d+)?)"),
    "codCharges_f": (["codCharges_v", "codCharges_f"], 5000, ["cod"], r"cod\s*(?:\(cheque[/\\\s]*dd\s*on\s*delivery\))?[^\d\n]{0,60}(?:rs\.?\s*)?(\d+(?:\.\d+)?)"),
    "daccCharges": (["daccCharges"], 10000, ["dacc"], r"dacc\s*(?:\(delivery\s*against\s*consignee\s*copy\))?[^\d\n]{0,60}(?:rs\.?\s*)?(\d+(?:\.\d+)?)"),
}
#: Percentages whose base is named in the match or 40 characters behind it.
BASED = ["rovCharges_v", "insuranceCharges_v"]
#: Of several patterns of these fields the last that matches counts, of others the first.
LAST_COUNTS = ["topayCharges_f"]
TEXT_CAPS = {
    "docketCharges": 2000, "daccCharges": 10000, "codCharges_f": 5000, "handlingCharges_f": 50000, "greenTax": 2000, "minCharges": 50000, "odaCharges_f": 50000, "topayCharges_f": 5000,
    "appointmentCharges_f": 10000,
}
COMPANY_PATTERNS = {
    "gstNo": r"(?i)\b(\d{2}\s*[A-Z]{5}\s*\d{4}\s*[A-Z]\s*\d\s*[A-Z0-9]\s*[A-Z0-9])\b",
    "panNo": r"(?i)\b(?:PAN\s*[:\-]?\s*)?([A-Z]{5}\d{4}[A-Z])\b",
    "contactPhone": r"\b((?:0\d{2,4}[-\s]?\d{6,8}|\+?91[-\s]?\d{10}|\d{10}))\b",
    "contactEmail": r"\b([\w.+-]+@[\w-]+\.[\w.]+)\b",
    "website": r"(?i)\b((?:https?://)?(?:www\.)?[\w-]+\.(?:com|in|co\.in|net|org)(?:/[\w/.-]*)?)\b",
    "cinNo": r"(?i)\b([LUu]\d{5}[A-Z]{2}\d{4}[A-Z]{3}\d{6})\b",
    "address": r"(?i)(?:address|regd\.?\s*office|registered\s*office|head\s*office)\s*[:\-]?\s*([A-Za-z0-9][A-Za-z0-9\s,/\-\.]{8,148}?)(?:\n|$)",
    "pincode": r"(?i)(?:pin(?:code)?|postal\s*code)\s*[:\-]?\s*([1-9]\d{5})\b",
}
#: A pincode inside an address, and one at its end with the signs before it.
ADDRESS_PIN, ADDRESS_END = r"\b([1-9]\d{5})\b", r"[\s\-,]+[1-9]\d{5}\b\s*$"
# ----------------------------------------------------------------------------------------------


def has_charge_evidence(text: Column) -> Column:
    """True if a text names a charge by a phrase that nothing else uses."""
    return F.lower(F.coalesce(text, F.lit(""))).rlike("|".join(p.replace(".", r"\.") for p in EVIDENCE))


#: The patterns of all signals, each once.
_PATTERNS = list(dict.fromkeys(pattern for signals in SIGNALS.values() for _, pattern, _, _ in signals))


def _plain_counts(text: pa.Array) -> pa.Array:
    """Matches of every pattern by Arrow's automata; null for texts with signs that these read otherwise than Spark (beyond ASCII, \\r and \\v)."""
    counts = [pc.count_substring_regex(text, p).cast(pa.int32()) for p in _PATTERNS]
    return pa.StructArray.from_arrays(counts, [f"p{i}" for i in range(len(_PATTERNS))], mask=pc.match_substring_regex(text, r"[^\x00-\x7F]|[\r\x0B]"))


def signal_counts(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds a column per signal: hits, or distinct matches for numbers and codes.

    Hits in plain texts are counted by automata, whose time per character is small and does not
    depend on the pattern; distinct matches are taken by Spark where there is a hit.
    """
    small_batches(rows.sparkSession)
    value = F.coalesce(F.col(text), F.lit(""))
    counted = F.arrow_udf(_plain_counts, "struct<" + ", ".join(f"p{i}: int" for i in range(len(_PATTERNS))) + ">")
    columns = {}
    for category, signals in SIGNALS.items():
        for name, pattern, _, distinct in signals:
            plain = F.col("_plain")[f"p{_PATTERNS.index(pattern)}"]
            if distinct:
                hits = F.when(plain == 0, 0).otherwise(F.size(F.array_distinct(F.regexp_extract_all(value, F.lit(pattern), F.lit(0)))))
            else:
                hits = F.when(plain.isNotNull(), plain).otherwise(F.regexp_count(value, F.lit(pattern)))
            columns[f"{category}.{name}"] = hits
    return rows.withColumn("_plain", counted(value)).withColumns(columns).drop("_plain")


def classify(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``category`` and ``confidence``: weighted signal hits, MIXED if the best two are close, UNKNOWN if all are weak."""
    counted = signal_counts(rows, text)
    scores = {}
    for category, signals in SIGNALS.items():
        parts = []
        for name, _, weight, distinct in signals:
            n = F.col(f"`{category}.{name}`")
            parts.append(F.least(F.lit(3.0), 2 * F.log10(n + 1)) * weight if distinct else F.least(n, F.lit(5)) * weight)
        scores[category] = F.round(sum(parts, F.lit(0.0)), 3)
    ranked = F.array_sort(F.array(*[F.struct((-s).alias("s"), F.lit(i).alias("i"), F.lit(c).alias("c")) for i, (c, s) in enumerate(scores.items())]))
    out = counted.select(*rows.columns, ranked.alias("_r"), sum(scores.values(), F.lit(0.0)).alias("_total"))
    top, second = -F.get("_r", F.lit(0))["s"], -F.get("_r", F.lit(1))["s"]
    close = (second >= LEAST_SCORE) & ((top - second) / F.nullif(top, F.lit(0.0)) < MIXED_GAP)
    category = F.when(top < LEAST_SCORE, "UNKNOWN").when(close, "MIXED").otherwise(F.get("_r", F.lit(0))["c"])
    confidence = F.when(top < LEAST_SCORE, 0.0).otherwise(F.round(top / F.col("_total"), 3))
    return out.withColumns({"category": category, "confidence": confidence}).drop("_r", "_total")


def lines(rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, line) with white space trimmed."""
    return rows.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line")).withColumn("line", F.regexp_replace("line", r"^\s+|\s+$", ""))


def is_boundary(line: Column, previous: Column) -> Column:
    """Page marks, rules, second blank lines, and short lines of two or more words without small letters."""
    blank = line == ""
    capital = (F.length(line) < 80) & ~line.rlike("[a-zß-ÿ]") & (F.size(F.split(line, r"\s+")) >= 2)
    return line.rlike(r"(?i)^---\s*Page\s+\d+") | line.rlike(r"^[\-=_*~.]{4,}$") | (blank & (F.coalesce(previous, F.lit("x")) == "")) | (~blank & capital)


#: What ``\\s`` stands for in patterns.
_WHITE = " \t\n\x0b\f\r"


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def segment(rows: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = 40) -> DataFrame:
    """(key, start_line, end_line, text): blocks of lines between boundaries with at least ``least_chars`` characters.

    Every row is cut for itself, where it stands; rows of one key are texts of their own, and a null text has no blocks.
    """
    trim = lambda x: F.trim(x, F.lit(_WHITE))

    def between(all_lines: Column, ends: Column) -> Column:
        """The lines between every two neighbours of ``ends``."""
        gaps = F.transform(F.slice(ends, F.lit(2), F.size(ends) - 1), lambda end, i: F.struct((F.get(ends, i) + 1).alias("start_line"), end.alias("end_line")))
        block = lambda g: F.array_join(F.slice(all_lines, g["start_line"] + 1, g["end_line"] - g["start_line"]), "\n")
        return F.transform(F.filter(gaps, lambda g: g["end_line"] > g["start_line"]), lambda g: F.struct(g["start_line"], g["end_line"], trim(block(g)).alias("text")))

    def blocks(all_lines: Column) -> Column:
        cuts = F.filter(F.sequence(F.lit(0), F.size(all_lines) - 1), lambda i: _let(F.get(all_lines, i), lambda x: is_boundary(x, F.get(all_lines, i - 1))))
        return _let(F.concat(F.array(F.lit(-1)), cuts, F.array(F.size(all_lines))), lambda ends: between(all_lines, ends))

    found = _let(F.transform(F.split(F.col(text), "\n", -1), trim), blocks)
    cut = rows.where(F.col(text).isNotNull()).select(key, F.explode(found).alias("_block")).select(key, "_block.*")
    return cut.where(F.length("text") >= least_chars)


def categorize(blocks: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``category``, ``confidence`` and ``heading`` to blocks of lines.

    A heading among the first three lines decides (0.95); else a volumetric or legal phrase in the
    first 300 characters (0.88); else the classification of the first 2000 characters, which any
    phrase overrules (0.75) where its confidence is under 0.55.
    """
    line = lambda i: F.trim(F.coalesce(F.get(F.split(text, "\n", 4), F.lit(i)), F.lit("")), F.lit(_WHITE))
    heading_of = lambda x: F.when((x != "") & (F.length(x) <= 120), F.coalesce(*[F.when(x.rlike(p), c) for c, p in HEADINGS]))
    rows = blocks.withColumns({f"_line{i}": line(i) for i in range(3)})
    rows = rows.withColumns({f"_head{i}": heading_of(F.col(f"_line{i}")) for i in range(3)})
    forced = F.coalesce(*[F.col(f"_head{i}") for i in range(3)])
    heading = F.coalesce(*[F.when(F.col(f"_head{i}").isNotNull(), F.col(f"_line{i}")) for i in range(3)])
    start = F.substring(text, 1, 300)
    rows = rows.withColumns({"_forced": forced, "heading": heading, "_inline": F.coalesce(*[F.when(start.rlike(p), c) for c, p in INLINE_MARKERS]), "_start": F.substring(text, 1, 2000)})
    rows = classify(rows, "_start")
    inline = F.col("_inline").isin("VOLUMETRIC", "LEGAL")
    weak = F.col("_inline").isNotNull() & (F.col("confidence") < 0.55)
    category = F.coalesce("_forced", F.when(inline | weak, F.col("_inline")), "category")
    confidence = F.when(F.col("_forced").isNotNull(), 0.95).when(inline, 0.88).when(weak, 0.75).otherwise(F.col("confidence"))
    rows = rows.withColumns({"_c": category, "_p": confidence})
    return rows.select(*blocks.columns, F.col("_c").alias("category"), F.col("_p").alias("confidence"), "heading")


def merge_sections(sections: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adjacent sections of one known category with confidence over 0.3 become one, with the highest confidence."""
    by = Window.partitionBy(key).orderBy("start_line")
    same = (F.col("category") == F.lag("category").over(by)) & (F.col("category") != "UNKNOWN") & (F.col("confidence") > 0.3) & (F.lag("confidence").over(by) > 0.3)
    run = F.sum(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return sections.withColumn("_run", run).groupBy(key, "_run", "category").agg(
        F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.max("confidence").alias("confidence"), F.count("*").alias("n_merged")
    ).drop("_run")


def safe_sections(sections: DataFrame, key: str = "doc_id") -> DataFrame:
    """Sections without the kinds whose numbers look like charges; all of a document that has no others."""
    safe = ~F.col("category").isin(DANGEROUS)
    some = F.max(safe.cast("int")).over(Window.partitionBy(key)) == 1
    return sections.withColumn("_some", some).where(safe | ~F.col("_some")).drop("_some")


def _found(text: Column, words: list[str], pattern: str, group: int = 1) -> Column:
    """A group of the first match; the pattern runs only on texts that have one of the words."""
    some = reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])
    return F.when(some, F.nullif(F.regexp_extract(text, pattern, group), F.lit("")))


def text_charges(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds a column per charge found by its patterns in lower-cased text.

    Of a field's patterns the first whose value is not over the field's cap counts. A pair of ODA
    rates of which the higher counts leaves out single ODA rates. ``1 cft`` gives the divisor
    where none is stated. ``_basis`` says what a percentage is taken of.
    """
    rows = rows.withColumn("_low", F.lower(F.coalesce(F.col(text), F.lit(""))))
    low = F.col("_low")
    values: dict[str, list[Column]] = {}
    based = {}
    for field, words, pattern in CHARGE_PATTERNS:
        value = _found(low, words, pattern).try_cast("double")
        values.setdefault(field, []).append(F.when(value <= TEXT_CAPS[field], value) if field in TEXT_CAPS else value)
        if field in BASED:
            match = _found(low, words, rf"{pattern}[\s\S]{{0,40}}", 0)
            based[field.removesuffix("_v") + "_basis"] = F.when(match.contains("invoice"), "invoice").when(match.contains("freight"), "freight")
    rows = rows.withColumns({f: F.coalesce(*(reversed(v) if f in LAST_COUNTS else v)) for f, v in values.items()} | based)
    out = {}
    for field, (fields, below, words, pattern) in FALLBACKS.items():
        value = _found(low, words, pattern).try_cast("double")
        out[field] = F.coalesce(field, F.when(F.coalesce(*fields).isNull() & (value < below), value))
    for field in ("odaCharges_f", "odaCharges_v"):
        out[field] = F.when(F.col("odaCharges_perKg").isNull(), F.col(field))
    kg = F.col("cft_kg")
    out["divisor"] = F.coalesce("divisor", F.when((kg > 0) & (kg < 200), F.round(28316.8 / kg, 0)))
    return rows.withColumns(out).drop("_low", "cft_kg")


def text_company(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds company fields found by patterns: the first match of each, in its canonical form.

    A pincode at the end of an address leaves it; one inside it counts if none is labelled.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    raw = {f: F.nullif(F.trim(F.regexp_extract(value, p, 1)), F.lit("")) for f, p in COMPANY_PATTERNS.items()}
    phone = F.regexp_replace(raw["contactPhone"], r"[\s\-+()]", "")
    phone = F.when(phone.startswith("0091") & (F.length(phone) == 14), F.substring(phone, 5, 10)).when(phone.startswith("91") & (F.length(phone) == 12), F.substring(phone, 3, 10)).otherwise(phone)
    inside = F.nullif(F.regexp_extract(raw["address"], ADDRESS_PIN, 1), F.lit(""))
    found = {"gstNo": F.upper(raw["gstNo"]), "contactPhone": phone, "contactEmail": F.lower(raw["contactEmail"]), "cinNo": F.upper(raw["cinNo"])}
    placed = {"address": F.trim(F.regexp_replace(raw["address"], ADDRESS_END, "")), "pincode": F.coalesce(raw["pincode"], inside)}
    return rows.withColumns({**raw, **found, **placed})
