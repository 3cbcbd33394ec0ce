"""All registered queries of the library's own operators."""

from __future__ import annotations

from skyroute.jobs import geometry_queries, layer_queries, routing_queries, vision_queries

MODULES = (geometry_queries, vision_queries, layer_queries, routing_queries)


def queries() -> dict:
    return {name: f for module in MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
