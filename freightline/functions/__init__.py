"""Column-level helpers: every function returns a pyspark ``Column``."""
