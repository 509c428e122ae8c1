"""All queries of the core, by name, with the SQL that checks them."""

from __future__ import annotations

from ledgerloom.queries import labels, linkage, names, places, relational, scope, skew, survey, training

_MODULES = [scope, relational, names, linkage, survey, places, skew, training, labels]


def queries() -> dict:
    """Name -> callable of the core's queries."""
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Name -> DuckDB SQL of the core's queries."""
    return {k: s for m in _MODULES for k, s in m.ORACLE.items()}
