"""Corpora derived from the shared test tables, the registered queries and their DuckDB counterparts."""
