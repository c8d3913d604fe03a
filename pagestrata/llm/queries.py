"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pagestrata.llm import decontamination, language_id, license_scan, line_dedup, mixing, mtree, near_dedup, packing, personal_data, token_counts

MODULES = (language_id, near_dedup, license_scan, personal_data, decontamination, line_dedup, mtree, mixing, packing, token_counts)


def queries() -> dict:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
