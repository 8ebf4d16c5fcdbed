"""Pipelines and query engines: compositions of operators."""
