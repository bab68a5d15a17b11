"""Structured Streaming forms of ingest, minute series and refresh."""
