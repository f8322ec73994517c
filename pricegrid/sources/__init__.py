"""Readers, writers, reshaping and incremental merges."""
