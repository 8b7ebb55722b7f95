"""Structured Streaming forms of ingest and reporting."""
