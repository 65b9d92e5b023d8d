"""Functions that Spark has no built-in for."""
