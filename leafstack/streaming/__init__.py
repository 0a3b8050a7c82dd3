"""Structured Streaming forms of ingest and rate limiting."""
