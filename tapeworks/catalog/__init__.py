"""Registered queries (Spark) and their DuckDB oracle texts, keyed by SURVEY ID."""
