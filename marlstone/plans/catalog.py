"""All registered queries and SQL twins."""

from __future__ import annotations

from marlstone.plans import claim_queries, context_queries, route_queries, search_queries, state_queries, text_queries

_MODULES = (search_queries, text_queries, context_queries, state_queries, route_queries, claim_queries)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
