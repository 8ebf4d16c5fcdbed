"""Structured Streaming: incremental indexing, upserts, monitoring."""
