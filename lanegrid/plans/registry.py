"""All registered queries of the library's own operators."""

from __future__ import annotations

from lanegrid.plans import charge_queries, coverage_queries, document_queries, grid_queries, label_queries, rate_queries, text_queries

FAMILIES = (coverage_queries, rate_queries, charge_queries, document_queries, text_queries, label_queries, grid_queries)


def queries() -> dict:
    return {name: f for family in FAMILIES for name, f in family.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: text for family in FAMILIES for name, text in family.ORACLES.items()}
