"""Sources of the triple-analytics library."""
