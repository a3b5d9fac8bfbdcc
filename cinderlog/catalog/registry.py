"""All registered queries."""

from __future__ import annotations

from cinderlog.catalog import alert_queries, count_queries, ingest_queries, search_queries
from cinderlog.catalog.query import Query

_MODULES = (search_queries, count_queries, ingest_queries, alert_queries)


def all_queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for module in _MODULES:
        for query in module.QUERIES:
            if query.name in found:
                raise ValueError(f"query {query.name} is registered twice")
            found[query.name] = query
    return found
