"""All queries of the engine, by name, with the DuckDB SQL that checks them."""

from __future__ import annotations

from seaweft.plans import core_queries, inventory_queries, more_queries  # noqa: F401  they register queries
from seaweft.plans.registry import ORACLE_SQL, QUERIES, Query

FLAGSHIP = "m0_port_edges"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES", "Query"]
