"""Whole jobs and their registered queries of the statement jobs."""
