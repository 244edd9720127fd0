"""The reference operators bound to the tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from brontide import queries_catalog, queries_cells, queries_plans, queries_registry, queries_review, queries_search  # noqa: F401  they register their queries
from brontide.registry_of_queries import QUERIES, SQL


def queries() -> dict[str, Callable]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
