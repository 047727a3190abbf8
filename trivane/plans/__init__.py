"""Plans of the triple-analytics library."""
