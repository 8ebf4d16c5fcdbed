"""Relational operators: search, fusion, filters, dedup, graph, splitting, enrichment, statistics."""
