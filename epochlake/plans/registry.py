"""Registered queries and their DuckDB statements."""

from . import epoch_queries, feature_queries, learn_queries, protocol_queries, signal_queries, stat_queries, store_queries, stream_queries

_parts = [epoch_queries.Q, stat_queries.Q, learn_queries.Q, protocol_queries.Q, signal_queries.Q, store_queries.Q, stream_queries.Q]
QUERIES = dict(feature_queries.QUERIES)
ORACLE_SQL = dict(feature_queries.ORACLE_SQL)
for _q in _parts:
    QUERIES |= _q.queries
    ORACLE_SQL |= _q.sql
