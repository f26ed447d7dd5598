"""All queries of the library on the shared tables, and the SQL that gives the same rows."""

from __future__ import annotations

from .plans import learning, series


def queries() -> dict:
    return series.QUERIES | learning.QUERIES


def oracle_sql() -> dict:
    return series.ORACLE | learning.ORACLE
