"""Queries of the graph engine by name, over the driver's tables, and the SQL each must agree with."""

from __future__ import annotations

from ledgerloom import catalog_exchange, catalog_flow, catalog_graph, catalog_learning

QUERIES: dict = {}
ORACLES: dict = {}
for part in (catalog_flow, catalog_graph, catalog_learning, catalog_exchange):
    QUERIES |= part.QUERIES
    ORACLES |= part.ORACLES
