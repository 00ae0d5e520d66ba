"""All queries with their SQL, from the modules of this package."""

from __future__ import annotations

from . import heads, pairing, results, segments, similarity, trajectory, vectors

_MODULES = (similarity, vectors, segments, trajectory, pairing, results, heads)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
