"""Incremental ingest and encoding."""
