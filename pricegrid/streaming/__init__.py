"""Incremental refresh as Structured Streaming jobs."""
