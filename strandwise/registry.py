"""Every query of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

from strandwise.queries import assembly, candidates, core, more, records

MODULES = [core, assembly, more, records, candidates]
QUERIES: dict = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
