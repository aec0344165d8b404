"""All core queries with their SQL, by name."""

from __future__ import annotations

from . import graphs, problems, retrieval, semantics, stores

MODULES = [problems, retrieval, graphs, semantics, stores]

QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
