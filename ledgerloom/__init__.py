"""Spark jobs that turn statement documents into reconciled tables."""
