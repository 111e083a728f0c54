"""Registered queries over the driver tables and their DuckDB oracles."""

from rivulet.plans.registry import QUERIES, ORACLES, query, load_all

__all__ = ["QUERIES", "ORACLES", "query", "load_all"]
