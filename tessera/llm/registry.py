"""Queries of this package by name, and the SQL of those that DuckDB can check."""

from tessera.llm import bpe, language, mojibake, neardup, packing, pages, quality, sentences, spam, termstats

_MODULES = (termstats, neardup, language, spam, quality, pages, mojibake, bpe, packing, sentences)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in getattr(module, "SQL", {}).items()}
