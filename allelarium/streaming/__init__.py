"""Incremental forms of mergeable aggregates."""
