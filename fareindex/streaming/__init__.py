"""Incremental ingest and upkeep with Structured Streaming."""
