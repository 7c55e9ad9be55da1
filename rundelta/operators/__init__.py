"""operators of the reserving engine."""
