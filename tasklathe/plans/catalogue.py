"""All registered queries."""

from __future__ import annotations

from . import change_queries, read_queries, state_queries  # noqa: F401  (registering)
from .registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
