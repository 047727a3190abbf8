"""Operators of the triple-analytics library."""
