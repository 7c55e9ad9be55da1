"""functions of the reserving engine."""
