"""plans of the reserving engine."""
