"""Incremental ingestion of record batches with Structured Streaming."""
