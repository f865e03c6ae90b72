"""Structured Streaming forms of ingestion and quota analysis."""
