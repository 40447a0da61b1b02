"""All queries of the core by name, and their SQL."""

from tessera.plans import corpus_queries, rank_queries, search_queries

_MODULES = (search_queries, rank_queries, corpus_queries)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
