"""Incremental forms of aggregates."""
