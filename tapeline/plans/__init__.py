"""The registered queries over tapes, each with its SQL."""

from tapeline.plans import market_queries, source_queries, ticks_queries

_PARTS = (ticks_queries, market_queries, source_queries)
QUERIES = {f.__name__: f for part in _PARTS for f in part.QUERIES}
SQL = {name: text for part in _PARTS for name, text in part.SQL.items()}
