"""Streaming ingest and running state."""
