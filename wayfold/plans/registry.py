"""All registered queries of the core, and their SQL."""

from __future__ import annotations

from wayfold.plans import addresses, customers, documents, histories, landing, records, sketches, streams, telemetry, vectors

_MODULES = (customers, addresses, documents, histories, landing, records, sketches, streams, telemetry, vectors)
QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL: dict[str, str] = {k: v for m in _MODULES for k, v in m.SQL.items()}


def flagship(spark, base: str):
    """Active customers by state with two or more moves, with totals."""
    return QUERIES["active_movers_by_state"](spark, base)
