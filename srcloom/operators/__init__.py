"""Operators on the graph's tables: deduplication, resolution, upserts, checks, queries."""
