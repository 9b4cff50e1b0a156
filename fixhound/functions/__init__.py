"""Column expressions. Every one is built from Spark's own functions."""
