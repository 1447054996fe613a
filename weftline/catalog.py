"""Every query of the engine by name, with the SQL that says the same."""

from __future__ import annotations

from .plans import exports, flows, graph, matching, ordered, pages, relational, statistics, textual

_MODULES = (graph, relational, ordered, textual, statistics, matching, flows, exports, pages)

QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
SQL = {name: s for m in _MODULES for name, s in m.SQL.items()}
