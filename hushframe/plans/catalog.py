"""Named queries over the driver's tables, each with the SQL that must give the same rows where SQL can express it."""

from hushframe.plans import dom_queries, event_queries, page_queries, request_queries, step_queries, text_queries

_PARTS = (text_queries, page_queries, dom_queries, request_queries, step_queries, event_queries)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLE_SQL = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
