"""All registered queries and their SQL, by operator id."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


from lotlight.plans import availability_queries, box_queries, learning_queries, metric_queries, relational_queries, stream_queries  # noqa: E402, F401
