"""Incremental forms of operators whose state merges."""
