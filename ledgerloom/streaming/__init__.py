"""Streaming ingestion of the statement jobs."""
