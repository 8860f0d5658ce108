"""Incremental ingest of record files with Structured Streaming."""
