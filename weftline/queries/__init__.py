"""Registered queries over the TPC-H-like tables, each with SQL that gives the same rows."""

from __future__ import annotations

from weftline.queries import aggregates, functions, lineages, nested, relational, synchronise, writes
from weftline.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "aggregates", "functions", "lineages", "nested", "relational", "synchronise", "writes"]
