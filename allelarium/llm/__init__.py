"""Operators of a training-data pipeline: joins, deduplication, tokens, filters, shards."""
