"""Queries and their DuckDB oracles, collected from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a query, with the SQL that DuckDB answers alike."""

    def keep(run: Callable) -> Callable:
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return keep


def choose(known: dict[str, Callable], name: str, kind: str) -> Callable:
    """The entry of that name; a miss lists the known ones."""
    if name not in known:
        raise KeyError(f"no {kind} {name!r}; known: {', '.join(sorted(known))}")
    return known[name]


def find(name: str) -> Callable:
    """The query of that name."""
    return choose(QUERIES, name, "query")


from . import grids, hydrology, ingest, optics, relational, scattering, solving, streams, terrain, timelines, worlds  # noqa: E402, F401
