"""Every query of the library by name, with its SQL where SQL can express it."""

from __future__ import annotations

from pagestrata.plans import activity, backfill, cases, orderings, pages, similarity

FLAGSHIP = "search_topk"
MODULES = (pages, activity, similarity, backfill, cases, orderings)


def queries() -> dict:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
