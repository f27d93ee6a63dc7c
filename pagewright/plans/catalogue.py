"""All queries and their SQL twins."""

from . import intake_queries, run_queries, stream_queries, text_queries

_PARTS = (text_queries, run_queries, stream_queries, intake_queries)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
