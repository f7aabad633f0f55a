"""Readers: driver tables, adapter views and raw-payload parsers (SRC-*)."""
