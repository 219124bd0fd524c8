"""Readers and writers of the statement jobs."""
