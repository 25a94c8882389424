"""Column functions: scalars that stay inside Spark's own expressions."""
