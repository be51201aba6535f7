"""All queries of the engine by name, and the SQL that must give the same rows.

A plan module lists its queries in ``QUERIES``; a query's SQL is the module's string of the query's name in capitals. A query without one
has no SQL form that is faithful, and is tested on small cases.
"""

from __future__ import annotations

from . import clocks, contracts, forms, lifecycle, parsed, records, screening

MODULES = [screening, records, parsed, lifecycle, forms, contracts, clocks]


def queries() -> dict:
    return {f.__name__: f for m in MODULES for f in m.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {f.__name__: sql for m in MODULES for f in m.QUERIES if (sql := getattr(m, f.__name__.upper(), None))}
