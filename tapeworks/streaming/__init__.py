"""Structured Streaming versions of the incremental batch jobs (STR-M1..3)."""
