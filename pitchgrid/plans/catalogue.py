"""All queries of the core by name, with their SQL where SQL can say the same."""

from __future__ import annotations

from pitchgrid.plans import data_problems, football, integrity, pages, star_queries

_MODULES = [star_queries, football, pages, integrity, data_problems]

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: text for module in _MODULES for name, text in module.SQL.items()}
