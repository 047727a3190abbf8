"""Knowledge-graph and training-data analytics on Spark."""
