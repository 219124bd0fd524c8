"""DataFrame transforms of the statement jobs."""
