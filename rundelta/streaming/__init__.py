"""streaming of the reserving engine."""
