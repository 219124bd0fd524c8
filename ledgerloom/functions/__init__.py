"""Column functions of the statement jobs."""
