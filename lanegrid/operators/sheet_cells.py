"""What all detectors over cell grids share: sheet keys, cells, header rows and zone tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanegrid.plans import dims

KEY = ["vendor_id", "sheet"]


def header_name(cell: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(cell), "[-_ ]+", " "))


def position(cells: Column, names: list[str]) -> Column:
    """Index of the first cell with one of the names, or null."""
    return F.nullif(F.array_position(F.transform(cells, lambda c: header_name(c).isin(names)), True), F.lit(0)) - 1


def cell(cells: Column, at: Column) -> Column:
    return F.trim(F.get(cells, at.cast("int")))


def first_row(rows: DataFrame, condition: Column, within: int, keep: list[str]) -> DataFrame:
    """(KEY, header_idx, keep): the first row of each sheet, among the first ``within``, where the condition holds."""
    hits = rows.where((F.col("row_idx") < within) & condition)
    return hits.groupBy(*KEY).agg(F.min("row_idx").alias("header_idx"), *[F.min_by(c, "row_idx").alias(c) for c in keep])


def is_zone(c: Column) -> Column:
    return F.upper(F.trim(c)).isin(dims.ZONES + list(dims.LABEL_ZONES))


def is_zone_token(c: Column) -> Column:
    """Whether a cell names zones: as a whole, as one of its parts at ``/`` and ``+``, or by its first word; numbers never do."""
    whole = F.upper(F.trim(F.coalesce(c, F.lit(""))))
    plain = F.regexp_replace(whole, "[-_]", " ")
    known = lambda x: x.isin(dims.ZONES + list(dims.LABEL_ZONES))
    parts = F.exists(F.split(whole, "[/+]"), lambda p: known(F.trim(p)))
    return ~whole.rlike(r"^\d+(\.\d+)?$") & (known(whole) | known(plain) | parts | known(F.get(F.split(plain, " +"), F.lit(0))))
