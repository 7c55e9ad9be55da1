"""sources of the reserving engine."""
