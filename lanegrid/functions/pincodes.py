"""Column functions over pincodes and the labels around them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks of service in vendor sheets.
ODA_MARKS = ["yes", "y", "true", "1", "oda", "x", "edl", "out", "yes-oda", "✓", "✔", "☑", "✅"]
REFUSED = ["N", "NO", "FALSE", "0", "NOT SERVICEABLE", "NS", "INACTIVE", "UNSERVICEABLE", "RESTRICTED"]
BLANKS = ["", "NONE", "NULL", "N/A", "NA", "-", "ZONE"]
PLACEHOLDERS = ["unknown", "n/a", "na", "-", "", "none", "null", "tbd"]


def valid_pincode(text: Column) -> Column:
    """The number of a cell if it lies in 100000..999999, else null."""
    number = F.floor(F.expr("1.0D") * F.replace(F.trim(text), F.lit(","), F.lit("")).try_cast("double"))
    return F.when(number.between(100000, 999999), number.cast("int"))


def parse_pincode_cell(text: Column) -> Column:
    """Like ``valid_pincode`` after dropping every character but digits and points."""
    return valid_pincode(F.regexp_replace(text, r"[^0-9.]", ""))


def extract_pincodes_cell(text: Column, widest: int = 500) -> Column:
    """All pincodes of a cell: a written range of at most ``widest``, else every run of six digits, spaces allowed inside."""
    pair = r"^\s*([1-9]\d{5})\s*(?:-|–|to|TO|To)\s*([1-9]\d{5})\s*$"
    low = F.regexp_extract(text, pair, 1).try_cast("int")
    high = F.regexp_extract(text, pair, 2).try_cast("int")
    singles = F.transform(
        F.regexp_extract_all(text, F.lit(r"(?<!\d)([1-9]\d{2} ?\d{3})(?!\d)"), 1), lambda p: F.replace(p, F.lit(" "), F.lit("")).cast("int")
    )
    return F.when((low <= high) & (high - low <= widest), F.sequence(low, high)).otherwise(F.coalesce(singles, F.array().cast("array<int>")))


def dense_text_pincodes(text: Column, least: int = 20) -> Column:
    """All pincodes of a text that has at least ``least`` of them, else none."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b([1-9]\d{5})\b"), 1)
    return F.when(F.size(found) >= least, F.transform(found, lambda p: p.cast("int"))).otherwise(F.array().cast("array<int>"))


def is_oda(text: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return low.isin(ODA_MARKS) | low.startswith("oda")


def is_refused(text: Column) -> Column:
    return F.upper(F.trim(F.coalesce(text, F.lit("")))).isin(REFUSED)


def zone_hint(zone: Column | None, state: Column) -> Column:
    """The zone label of a row; the state only where there is no zone column."""
    label = F.upper(F.trim(state if zone is None else zone))
    return F.when(~label.isin(BLANKS), label)


def clean_place(name: Column) -> Column:
    """Trimmed title case; placeholders are null. A new word starts after a space only."""
    trimmed = F.trim(name)
    return F.when(~F.lower(trimmed).isin(PLACEHOLDERS), F.initcap(trimmed))


def clean_state(name: Column) -> Column:
    cleaned = clean_place(name)
    return F.when(F.lower(F.replace(cleaned, F.lit(" "), F.lit(""))) == "tamilnadu", "Tamil Nadu").otherwise(cleaned)


def expand_ranges(ranges: Column, singles: Column) -> Column:
    """Pincodes of ``array<struct<s,e>>`` and single pincodes."""
    return F.concat(F.flatten(F.transform(ranges, lambda r: F.sequence(r["s"], r["e"]))), singles)
