"""All queries of the core by name, and the same queries in SQL."""

from __future__ import annotations

from quarryline.plans import amounts, answers, more, tables, values

_PARTS = (amounts, tables, values, answers, more)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
SQL = {name: sql for part in _PARTS for name, sql in part.SQL.items()}
flagship = answers.ranking_by_source
