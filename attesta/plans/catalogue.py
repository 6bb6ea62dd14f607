"""All registered queries of the analytics operators, with their oracle SQL."""

from __future__ import annotations

from . import evidence, graphs, libraries, pools, shelves, texts  # noqa: F401  they register their queries
from .registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(sorted(QUERIES.items()))


def oracle_sql() -> dict[str, str]:
    return dict(sorted(ORACLES.items()))
