"""All core queries and their SQL."""

from __future__ import annotations

from gradewright.plans import composition, gates, hierarchy, learning, practice, text, vectors

_MODULES = (composition, hierarchy, learning, practice, text, vectors, gates)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
FLAGSHIP = "mastery_heatmap"
