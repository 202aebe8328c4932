"""All queries of the library over the derived cells, and the SQL that each must match."""

from __future__ import annotations

from . import analysis, changes, fields, platform, terrain  # noqa: F401  (they register their queries)
from .registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
