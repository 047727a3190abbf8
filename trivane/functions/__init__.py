"""Functions of the triple-analytics library."""
