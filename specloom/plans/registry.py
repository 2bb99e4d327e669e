"""All registered queries of the library and the SQL they are held against."""

from __future__ import annotations

from . import queries_merge, queries_read, queries_scoped, queries_search, queries_text, queries_time

_ALL = [*queries_read.REGISTERED, *queries_text.REGISTERED, *queries_merge.REGISTERED, *queries_scoped.REGISTERED, *queries_time.REGISTERED, *queries_search.REGISTERED]

QUERIES = {name: query for name, query, _ in _ALL}
ORACLE_SQL = {name: sql for name, _, sql in _ALL if sql}
