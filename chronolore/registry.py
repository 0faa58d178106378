"""All queries of the engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from chronolore.catalog import Query, asks, facts, ingest, linked, wire

CATALOGS = [m.query for m in (ingest, wire, facts, asks, linked)]
QUERIES: dict[str, Query] = {name: q for c in CATALOGS for name, q in c.queries.items()}
ORACLE_SQL: dict[str, str] = {name: sql for c in CATALOGS for name, sql in c.oracles.items()}
